"""Source divergence, license scans and conversation repair: brute force and awkward tables."""

import hashlib
import heapq
import itertools
import random

import pytest
from pyspark.sql import functions as F

from memlake.llm import conversations, divergence, licenses, queries

EXTRA = "lang_ string, key string, term string, p string, score string, spans string, pos string, place string, block string"


# --- divergence -------------------------------------------------------------------------------

def plain_audit(rows, least, added, scale, top):
    import re
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    counts, docs, groups = {}, {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.setdefault(lang, set()).add(source)
        found = words(text)
        for w in found:
            counts[lang, source, w] = counts.get((lang, source, w), 0) + 1
        for w in set(found):
            docs[lang, w] = docs.get((lang, w), 0) + 1
    out = set()
    for lang, sources in groups.items():
        terms = [w for (l, w), n in docs.items() if l == lang and n >= least]
        n_of = {s: sum(counts.get((lang, s, w), 0) for w in terms) for s in sources}
        total = {w: sum(counts.get((lang, s, w), 0) for s in sources) for w in terms}
        share = lambda n, all_: 1 + scale * (n + added) // (all_ + added * len(terms))
        p = {(s, w): share(counts.get((lang, s, w), 0), n_of[s]) for s in sources for w in terms}
        q = {w: share(total[w], sum(total.values())) for w in terms}
        for s in sources:
            far = sorted((-sum(abs(p[s, w] - p[o, w]) for w in terms), o) for o in sources if o != s)
            out |= {(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(far, 1)}
            own = sorted((q[w] - p[s, w], w) for w in terms if counts.get((lang, s, w), 0) and p[s, w] > q[w])[:top]
            out |= {(lang, s, "term", w, -v, i) for i, (v, w) in enumerate(own, 1)}
    return out


def corpus():
    rng = random.Random(5)
    vocabulary = ["Été", "naïve", "größe", "the", "A", "zebra"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", None, ""]),
             "-".join(rng.choice(vocabulary[: 1 + rng.randrange(150)]) for _ in range(rng.randrange(40)))) for _ in range(160)]
    return rows + [("en", "s0", None), ("xx", "only", ""), ("xx", "other", "12 34"), ("en", "s9", "the " * 3000), ("zz", "z", "once")]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_TERMS": 16, "TILE": 2, "LEAF_ROWS": 1, "LEAF_TERMS": 3}])
def test_divergence_equals_plain_counting(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rows = corpus()
    frame = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], f"lang string, source string, text string, {EXTRA}")
    found = divergence.audit(frame, least_docs=3, top=5).collect()
    got = {(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found}
    assert len(got) == len(found) and got == plain_audit(rows, 3, 5, 10**9, 5)


def test_divergence_of_many_sources_walks_one_tree(monkeypatch):
    """Empty quadrants are priced without being split."""
    import numpy as np
    present = np.zeros((64, 4096), bool)
    present[3, 100] = True
    tree = divergence.quadtree(present, 0, 64)
    assert len(list(divergence.leaves(tree))) == 1
    count = lambda q: 1 + sum(count(p) for row in q.parts for p in row)
    assert count(tree) < 60
    zero = np.arange(64)
    p = np.repeat(zero[:, None], 4096, 1)
    p[3, 100] = 50
    out = np.zeros((64, 64), np.int64)
    divergence.distances(tree, tree, p, zero, out)
    assert (out == np.abs(p[:, None] - p[None]).sum(2)).all()


def test_divergence_of_an_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


# --- licenses -------------------------------------------------------------------------------------

def least_edits(phrase, text):
    """Least edits between a phrase and a stretch of whole words, cell by cell."""
    far = 10**9
    column, best = [far] * (len(phrase) + 1), far
    for j in range(len(text) + 1):
        new = [far] * (len(phrase) + 1)
        new[0] = 0 if j and text[j - 1] == " " else far
        for i in range(len(phrase) + 1):
            if j:
                new[i] = min(new[i], column[i] + 1, *([column[i - 1] + (phrase[i - 1] != text[j - 1])] if i else []))
            if i:
                new[i] = min(new[i], new[i - 1] + 1)
        column = new
        if j < len(text) and text[j] == " ":
            best = min(best, column[-1])
    return best


def damaged_notices():
    rng = random.Random(7)
    words = "the a of mit licence permission gnu apache license public general is to copy cc by bsd version clause use in".split()
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += [rng.choice(words) for _ in range(rng.randrange(8))]
            notice = rng.choice(licenses.NOTICES)
            letters = list(notice.phrase)
            for _ in range(rng.randrange(notice.edits + 3)):
                at, how = rng.randrange(len(letters)), rng.random()
                if how < 0.33:
                    letters[at] = rng.choice("abcxyz é")
                elif how < 0.66:
                    del letters[at]
                else:
                    letters.insert(at, rng.choice("abcxyz "))
            parts.append("".join(letters))
        yield " ".join(parts)


def test_seeds_lose_no_notice(spark):
    """The query's operator finds what a search of every stretch finds."""
    texts = list(damaged_notices())
    notices = tuple(n for n in licenses.NOTICES if not n.word)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(frame, notices=notices).collect():
        text = licenses.normal(r.text)
        want = {n.label for n in notices if least_edits(n.phrase, text) <= n.edits}
        want |= {n.label for n in licenses.PHRASES if f" {n.phrase} " in text}
        assert set(r.labels) == want, text
        for s in r.spans:
            words = text.split()
            assert " ".join(words[s["first"]: s["last"] + 1]) == s["text"]


def test_license_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n-"), (4, "Released under the MIT License, the mit--license; MIT licence"),
            (5, "emit license general publik license"), (6, "x " * 20000 + "Apache License"), (6, "x " * 20000 + "Apache License"),
            (None, "GNU GENERAL PUBLIC LICENSE ünder")]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, labels string, spans string")
    got = {(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels), ",".join(r.labels), round(r.score, 3))
           for r in licenses.scan(frame).collect()}
    assert got == {(1, 0, 0, None, None, "", "", 0.0), (2, 0, 0, None, None, "", "", 0.0), (3, 0, 0, None, None, "", "", 0.0),
                   (4, 10, 2, 3, 6, "mit", "mit", 1.0), (5, 5, 0, None, None, "", "gpl", 0.955),
                   (6, 20002, 1, 20000, 20000, "apache", "apache", 1.0), (None, 5, 1, 1, 1, "gpl", "gpl", 1.0)}
    assert licenses.scan(frame.limit(0)).collect() == []


def test_license_query_counts_base_phrases(spark, sf):
    import re
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(licenses.ASCII_LOWER))
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    phrases = [(n.label, n.phrase.split()) for n in licenses.PHRASES]
    for r in queries.queries()["op12_license_scan"](spark, sf).collect():
        w = docs[r.doc_id]
        at = [(i, label) for label, p in phrases for i in range(len(w)) if w[i: i + len(p)] == p]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (
            len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1.0 or not at)


# --- conversations ------------------------------------------------------------------------------------

def cheapest(codes):
    """Least (cost, letters) by Dijkstra's algorithm over the whole lattice."""
    best, heap, n = {}, [(0, "", 0, 0, "")], len(codes)
    while heap:
        cost, plain, i, state, letters = heapq.heappop(heap)
        if (i, state) in best:
            continue
        best[i, state] = (cost, plain, letters)
        follow = 3 if state == 2 else 2
        steps = [("I" + "ua"[follow == 3], 2, i, follow)]
        if i < n:
            steps.append(("D", 3, i + 1, state))
            if codes[i] != "x":
                more = int(codes[i].isupper())
                to = conversations._NEXT[state].get(codes[i].lower())
                steps += [("K", more, i + 1, to)] if to is not None else []
                steps.append(("R" + "ua"[follow == 3], 2 + more, i + 1, follow))
        for letter, price, j, to in steps:
            heapq.heappush(heap, (cost + price, plain + letter[0], j, to, letters + letter))
    return min(best[n, s] for s in (0, 3) if (n, s) in best)


def test_prices_give_the_cheapest_edits():
    rng = random.Random(1)
    some = ["".join(c) for k in range(4) for c in itertools.product("suoxSA", repeat=k)]
    some += ["".join(rng.choice("suaoxSUAO" if rng.random() < 0.5 else "uaua") for _ in range(rng.randrange(24))) for _ in range(600)]
    for codes in some:
        _, _, letters = cheapest(codes)
        assert "".join(conversations.solve(codes, conversations.ACCEPTED, True)[0][1]) == letters, codes


def conversation_rows():
    rng = random.Random(2)
    rows = [("long", t, rng.choice(["user", "assistant", "assistant", "tool", "system"]), rng.choice(["Yes.", "No", f"Word {t}.", " "]))
            for t in range(60)]
    rows += [("short", None, "user", "First."), ("short", 1, "assistant", None), ("short", 1, None, "Who?"), ("short", 5, "user", "Long " * 9000),
             ("short", 5, "user", "Long " * 9000), (None, 2, "assistant", "Alone!\n"), ("blank", 1, "user", "\t \n"), ("blank", None, None, None)]
    return rows + [(f"c{i}", t, r, "Fine.") for i in range(5) for t, r in enumerate(["system", "user", "assistant"][i % 3:])]


@pytest.mark.parametrize("segment", [conversations.SEGMENT, 7])
def test_repair_equals_plain_search(spark, segment):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], f"conv_id string, turn long, role string, text string, {EXTRA}")
    made = conversations.repair(frame, segment=segment)
    got = {r.key: r for r in conversations.digest(made).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault("" if conv is None else f"={conv}", []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(got) == set(groups)
    for key, found in groups.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        codes, kinds, seen = "", [], set()
        for _, role, text in found:
            left = text.strip(" \t\n\v\f\r")
            kind = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            code = "x" if kind in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") and role[:1] else "o"
            codes += code.upper() if kind == "truncated" else code
            kinds.append(kind)
        cost, plain, letters = cheapest(codes)
        r = got[key]
        assert (r.cost, r.audit) == (cost, plain), (key, codes)
        assert [r.blank, r.duplicate, r.truncated] == [kinds.count(k) for k in ("blank", "duplicate", "truncated")]
        near = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        assert r.illegal == sum(x not in ("su", "ua", "au") for x in near)
        turns = {t for t, _, _ in found if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
        at, lines = 0, []
        for op in __import__("re").findall("[A-Z][a-z]?", letters):
            role = {"u": "user", "a": "assistant"}.get(op[1:])
            if op[0] == "I":
                lines.append(f"{role}:")
                continue
            if op != "D":
                lines.append(f"{role or found[at][1]}:{found[at][2]}")
            at += 1
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_repair_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digest(conversations.repair(empty)).collect() == []


def test_a_conversation_is_dealt_over_segments(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = conversations.repair(frame)
    assert made.where("edit != 'K'").count() == 0 and made.count() == 3000
    assert conversations.digest(made).select(F.length("audit"), "cost").first()[:2] == (3000, 0)
