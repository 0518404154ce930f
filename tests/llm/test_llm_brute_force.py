"""Operators against plain computations on small tables, and against held-out accuracy."""

import itertools
import math
import random
import time
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from memlake.llm import (common, decontaminate, extraction, graph, jaccard, langid, language_model, lines, mixing,
                         neighbours, substrings, toxicity, words)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits, letters="abcdefgé "):
    out = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(letters)
        elif kind == 1:
            out.insert(at, rng.choice(letters))
        else:
            del out[at]
    return "".join(out)


def texts_with_copies(rng, n=120, vocabulary=400, changes=(0, 1, 2, 4, 8, 16)):
    make = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    docs = [make(rng.choice([1, 2, 3, 30, 60, 120, 200])) for _ in range(n // 3)]
    while len(docs) < n:
        copy = list(rng.choice(docs[: n // 3]))
        for _ in range(rng.choice(changes)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(vocabulary)}"
        docs.append(copy)
    rng.shuffle(docs)
    return [" ".join(d) for d in docs]


def test_words_and_windows():
    splitter = words.Splitter(lower=True)
    texts = ["A b\x0bc", None, "", "  é B ", "b c a"]
    found = splitter.split(pa.array(texts))
    assert np.diff(found.first).tolist() == [3, 0, 0, 2, 3]
    names = {}
    for text, row in zip(texts, range(5)):
        for word, name in zip((text or "").lower().split(), found.hash[found.first[row]: found.first[row + 1]]):
            assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)
    at, name = splitter.windows(found, 2)
    assert at.tolist() == [0, 1, 3, 5, 6] and name[1] == name[3] and len(set(name.tolist())) == 4


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = {}
    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in linked}


@pytest.mark.parametrize("percent,size", [(90, 3), (80, 5)])
def test_jaccard_join(spark, percent, size):
    texts = texts_with_copies(random.Random(percent))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i: i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)})
    label = list(range(len(texts)))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, size=size, percent=percent).collect()}
    assert len(links) > 20
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}


def test_jaccard_signatures_lose_no_pair():
    rng = np.random.default_rng(5)
    for percent in (80, 90):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            base = rng.integers(1, 2**63, n, dtype=np.int64).astype(np.uint64)
            drop, add = rng.integers(0, n // 8 + 2), rng.integers(0, n // 8 + 2)
            other = np.concatenate([base[drop:], rng.integers(1, 2**63, add, dtype=np.int64).astype(np.uint64)])
            shared = len(np.intersect1d(base, other))
            if not len(other) or shared == len(base) == len(other) or \
                    100 * shared < percent * (len(base) + len(other) - shared):
                continue
            feature = np.concatenate([np.sort(base), np.sort(other)])
            names, sets, _ = jaccard.signatures(feature, np.array([0, n, n + len(other)]), percent)
            assert set(names[sets == 0]) & set(names[sets == 1])
            a, b = (np.frombuffer(jaccard.sketch(x), np.uint8).astype(int) for x in (base, other))
            places = min(len(a), len(b))
            apart = np.abs(a.reshape(-1, places).sum(0) - b.reshape(-1, places).sum(0)).sum()
            assert apart <= len(base) + len(other) - 2 * shared


def test_jaccard_open_groups_are_compared_in_blocks(spark, monkeypatch):
    """Many sets that share signatures with a hub and are not linked with it, but in chains with each other."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    texts = []
    for _ in range(25):
        chain = list(base)
        for at in rng.sample(range(20, 140), 5):
            chain[at] = f"x{rng.randrange(10**6)}"
        for _ in range(3):
            texts.append(" ".join(chain))
            chain[rng.randrange(20, 140)] = f"y{rng.randrange(10**6)}"
    sets = [{tuple(t.split()[i: i + 3]) for i in range(158)} for t in texts]
    label = list(range(len(texts)))
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert len(set(label)) > 10 and got == dict(enumerate(label))


def repeated_words(rows, size):
    first, gone = {}, {}
    for key, tokens in sorted(rows):
        for i in range(len(tokens) - size + 1):
            window = tuple(tokens[i: i + size])
            if first.setdefault(window, (key, i)) != (key, i):
                gone.setdefault(key, set()).update(range(i, i + size))
    return gone


@pytest.mark.parametrize("size", [4, 20])
def test_substring_removal(spark, size):
    rng = random.Random(size)
    passages = [[rng.choice("abcdef") + str(rng.randrange(30)) for _ in range(rng.randint(15, 60))] for _ in range(12)]
    passages += [["x"] * 45, ["x", "y"] * 30, ["x"] * 19]
    rows = []
    for key in range(60):
        tokens = []
        for _ in range(rng.randint(0, 5)):
            tokens += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 40))]
        rows.append((key * 7 % 61, tokens))
    want = repeated_words(rows, size)
    docs = spark.createDataFrame([(k, "\n ".join(t)) for k, t in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs, size=size).collect()}
    assert want
    for key, tokens in rows:
        gone = want.get(key, set())
        assert got[key].kept == " ".join(t for i, t in enumerate(tokens) if i not in gone)
        assert {i for s in got[key].removed for i in range(s.start, s.end)} == gone


def test_anchors_depend_on_the_window_alone():
    rng = random.Random(2)
    window = [rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randrange(50)}" for _ in range(20)]
    splitter, seen = words.Splitter(), set()
    for _ in range(200):
        around = [[rng.choice([*"abc", window[0], window[-1]]) for _ in range(rng.randint(0, 6))] for _ in (0, 1)]
        found = splitter.split(pa.array([" ".join([*around[0], *window, *around[1]])]))
        at, anchor, place = substrings.anchors(found)
        one = len(around[0])
        seen.add((int(anchor[at == one][0]), int(place[at == one][0]) - one))
    assert len(seen) == 1


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(edits):
    rng = random.Random(edits)
    left = ["".join(rng.choice("abé") for _ in range(rng.randint(12, 40))) for _ in range(800)]
    right = [edited(rng, x, rng.randint(0, edits + 2), "abé") for x in left]
    assert lines.near(left, right, edits).tolist() == [distance(a, b) <= edits for a, b in zip(left, right)]


def test_line_dedup(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(20, 60))) for _ in range(40)]
    rows = []
    for key in range(50):
        some = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3, 4])) if rng.random() < 0.7 else
                "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 6))]
        rows.append((key * 11 % 53, "\n".join(some)))
    places = sorted((key, i, line) for key, text in rows for i, line in enumerate(text.split("\n")) if len(line) >= 20)
    want = {}
    for n, (key, i, line) in enumerate(places):
        if any(distance(line, other) <= 2 for _, _, other in places[:n] if abs(len(line) - len(other)) <= 2):
            want.setdefault(key, []).append(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in lines.dedup(docs).collect()}
    assert sum(map(len, want.values())) > 30
    for key, text in rows:
        assert got[key].removed_lines == want.get(key, [])
        assert got[key].kept_text == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in want.get(key, []))


def test_decontamination_exact_and_near(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "and", *(f"w{i}" for i in range(60))])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(30)]
    docs = []
    for key in range(60):
        tokens = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5 and len(part) > 3:
                part.insert(rng.randrange(1, len(part)), "extra")
            at = rng.randint(0, len(tokens))
            tokens[at:at] = part
        docs.append((key, ", ".join(tokens).upper()))
    windows = {}
    for item, text in items:
        w = text.split()
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i: i + 10]), set()).add(str(item))
    frames = [spark.createDataFrame(r, f"{c} long, text string") for r, c in ((docs, "doc_id"), (items, "item_id"))]
    for slop in (0, 1):
        for bound in (100_000, 60):
            got = {r.doc_id: r for r in decontaminate.find(*frames, slop=slop, block_windows=bound).collect()}
            for key, text in docs:
                w = re.findall(r"[a-z0-9]+", text.lower())
                hit, ids = set(), set()
                for window, names in windows.items():
                    for s in range(-slop, len(w) - len(window) + slop + 1):
                        if all(any(0 <= p < len(w) and w[p] == term for p in range(s + j - slop, s + j + slop + 1))
                               for j, term in enumerate(window)):
                            hit.update(p for p in range(s - slop, s + len(window) + slop) if 0 <= p < len(w))
                            ids |= names
                assert {i for s in got[key].spans for i in range(s.start, s.end)} == hit
                assert got[key]["items"] == sorted(ids) and got[key].n_words == len(w)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(900, 16)), rng.normal(size=16) + 0.05 * rng.normal(size=(400, 16)),
                        np.repeat(rng.normal(size=(1, 16)), 50, 0)]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = neighbours.nearest(rows, rows.where("vec_id % 50 = 0"), shard_rows=500).collect()
    x = x.astype(float)
    norm = np.linalg.norm(x, axis=1)
    found = total = 0
    for q in range(0, len(x), 50):
        score = x @ x[q] / norm / norm[q]
        score[q] = -9
        want = np.lexsort((np.arange(len(x)), -np.round(score, 12)))[:5]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert all(abs(score[v] - s) < 1e-12 for _, v, s in mine)
        found += len(set(want.tolist()) & {m[1] for m in mine})
        total += 5
    assert found / total >= 0.95
    last = [r.vec_id for r in sorted((r for r in got if r.query_id == 1300), key=lambda r: r["rank"])]
    assert last == [1301, 1302, 1303, 1304, 1305]  # copies: ties go to the smaller id


def test_language_profiles(spark, sf):
    docs = common.read(spark, sf, "documents")
    found = langid.identify(docs, langid.learn(docs.where(common.fold("doc_id", 4) != 2)))
    held = found.where(common.held_out("doc_id", 4, 2)).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_out_of_place_distance():
    profiles = langid.Profiles(["aa", "bb"], np.array([1, 2, 3]), np.array([[0, 2], [1, 1], [3, 0]]), 3)
    assert profiles.distances(np.array([1, 2, 9])).tolist() == [3 / 9, 5 / 9]


def test_toxicity_held_out(spark):
    rng = random.Random(6)
    common_words = [f"w{i}" for i in range(300)]
    bad = ["blarg", "zorkish", "frumpy"]
    docs, labels = [], []
    for key in range(900):
        toxic = key % 5 == 0
        tokens = [rng.choice(common_words) for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(3 * toxic):
            tokens[rng.randrange(len(tokens))] = rng.choice(bad) + rng.choice(["", "s", "est"])
        docs.append((key, " ".join(tokens)))
        labels.append((key, int(toxic)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"))
    held = toxicity.score(docs, model).where("doc_id % 3 = 0").select("doc_id", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 5 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in held)


def test_kneser_ney_against_the_formula():
    """Probabilities by plain sums, to 1e-9; with what unknown items keep, each class sums to one after every parent."""
    rng = np.random.default_rng(3)
    stem = np.sort(rng.integers(1, 6, 40)).astype(np.uint64)
    word = np.arange(100, 140).astype(np.uint64)
    counts = rng.integers(0, 9, (2, 40)).astype(float)
    counts[:, counts.sum(0) == 0] = 1
    counts[1, stem == stem[0]] = 0  # one class knows nothing of this stem
    counts[0, stem == stem[0]] = np.maximum(counts[0, stem == stem[0]], 1)
    p, parents, weight, unseen = toxicity.probabilities(word, stem, counts)
    for c in (0, 1):
        for k, parent in enumerate(parents):
            inside = np.flatnonzero(stem == parent)
            total, pool = sum(counts[c, i] for i in inside), sum(counts[0, i] + counts[1, i] for i in inside)
            escape = sum(min(counts[c, i], 3) for i in inside) / total if total else 1
            kinds = len(inside)
            for i in inside:
                shared = (counts[0, i] + counts[1, i] - 0.75 + 0.75 * kinds / (kinds + 1)) / pool
                want = (max(counts[c, i] - 3, 0) / total if total else 0) + escape * shared
                assert abs(p[c, i] - want) < 1e-9
            assert abs(p[c, inside].sum() + weight[c, k] * unseen[k] - 1) < 1e-9
    model = toxicity.estimate(stem, word, counts)
    by_stem = np.stack([np.bincount(stem.astype(int), x)[parents.astype(int)] for x in counts])
    first = toxicity.probabilities(parents, np.zeros(len(parents), np.uint64), by_stem)[0]
    at = np.searchsorted(parents, stem)
    assert np.allclose(model.ratios(stem, word), np.log(first[1, at] * p[1] / first[0, at] / p[0]), atol=1e-9)
    new = model.ratios(stem[:1], np.array([999], np.uint64))  # an unknown word of a known stem
    assert np.allclose(new, np.log(first[1, 0] * weight[1, 0] / first[0, 0] / weight[0, 0]), atol=1e-9)


def test_usual_ratio_of_a_words_company():
    stem, word = np.array([1, 1, 2], np.uint64), np.array([10, 11, 12], np.uint64)
    model = toxicity.estimate(stem, word, np.array([[5, 1, 9], [1, 7, 2]]))
    model.learn_usuals(word, stem, np.array([4, 0, 6]), np.array([2.0, 0.0, -3.0]))
    every, first = -0.1, (2.0 + 5 * -0.1) / 9
    assert np.allclose(model.usuals(stem, word), [(2 + 5 * first) / 9, first, (-3 + 5 * (-3 - 0.5) / 11) / 11])
    assert np.allclose(model.usuals(np.array([1, 7], np.uint64), np.array([99, 99], np.uint64)), [first, every])


def test_short_and_wholly_toxic_texts(spark):
    rng = random.Random(7)
    usual, bad = [f"w{i}" for i in range(300)], ["blarg", "zorkish", "frumpy"]
    docs = []
    for key in range(1200):
        tokens = [rng.choice(usual) for _ in range(rng.choice([20, 60, 200]))]
        for _ in range(3 * (key % 3 == 0)):
            tokens[rng.randrange(len(tokens))] = rng.choice(bad)
        docs.append((key, " ".join(tokens)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.learn(frame, spark.createDataFrame(
        [(key, int(key % 3 == 0)) for key, _ in docs], "doc_id long, toxic int"))
    texts = ["blarg", "blarg zorkish", "blarg zorkish frumpy blarg", "blarg zorkish frumpy blarg w1", "blarg w1 w2", "w1", "w1 w2",
             "", " ".join(usual)]
    rows = toxicity.score(spark.createDataFrame(
        list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    got = [r.score for r in rows]
    assert min(got[:5]) > 0.5 > max(got[5:]), got
    for fewer, more in ((0, 1), (1, 2), (3, 2), (4, 0)):  # more toxic words, or fewer others; scores near 1 may round to it
        weights = [(rows[i].margin - model.even) * rows[i].n_words ** 0.5 for i in (fewer, more)]
        assert weights[0] < weights[1] and got[fewer] <= got[more]


def test_mixing_targets(spark):
    sizes = {"a": 1000, "b": 50, "c": 10, "d": 0, None: 40, "e": 900}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(
        list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, full = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        heavy = sum(weight[s] for s in sizes if s not in full)
        want = {s: 3 * sizes[s] if s in full else left * weight[s] / heavy for s in sizes}
        over = {s for s in sizes if s not in full and want[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert got == pytest.approx(want)
    docs = spark.createDataFrame([(i, "x " * (i % 9 + 1), f"s{i % 4}") for i in range(4000)],
                                 "doc_id long, text string, source string")
    rows = mixing.plan(docs).collect()
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert sum(r["size"] * r.copies for r in mine) == pytest.approx(mine[0].target, rel=0.06)
    assert mixing.emit(mixing.plan(docs)).count() == sum(r.copies for r in rows)


def test_language_model(spark):
    rng = random.Random(1)
    follow = {w: [f"w{rng.randrange(40)}" for _ in range(3)] for w in (f"w{i}" for i in range(40))}
    docs = []
    for key in range(150):
        tokens = ["w0"]
        for _ in range(40):
            tokens.append(rng.choice(follow[tokens[-1]]) if rng.random() < 0.9 else f"r{rng.randrange(5000)}")
            follow.setdefault(tokens[-1], ["w0"])
        docs.append((key, " ".join(tokens).upper() if key % 2 else " \n".join(tokens)))
    got = {r.doc_id: r for r in language_model.score(
        spark.createDataFrame(docs, "doc_id long, text string"), common.held_out("doc_id", 7, 2)).collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in docs}
    tokens = {k: [*t.lower().split(), None] for k, t in docs}
    count = Counter(w for k, t in tokens.items() if not held[k] for w in t)
    n, v = sum(count.values()), len(count)
    for k, t in tokens.items():
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens) == (len(t), sum(w in count for w in t), n)
        assert got[k].base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t))
    rows = [r for k, r in got.items() if held[k]]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 20


def test_pitman_yor_probabilities_sum_to_one():
    counts = {(0, 0): 5, (0, 1): 1, (1, 0): 2, (2, 1): 300, (3, 1): 0, (3, 0): 0, (1, 1): 0, (2, 0): 0}
    order = sorted(counts)
    bucket = object.__new__(language_model.Bucket)
    bucket.word, bucket.context = (np.array([k[i] for k in order]) for i in (0, 1))
    bucket.count, bucket.n_words = np.array([counts[k] for k in order]), 4
    bucket.word_count = np.bincount(bucket.word, bucket.count, 4)
    customers = np.bincount(bucket.context, bucket.count, 2)
    rng = np.random.default_rng(0)
    state = language_model.Totals(308, 3, customers, np.array([2, 2]), 4, 3)
    for tables, root_tables in language_model.seatings(bucket, state, rng, 3):
        assert ((tables >= np.minimum(bucket.count, 1)) & (tables <= bucket.count)).all()
        root = np.bincount(bucket.word, tables, 4)
        now = language_model.Totals(308, 3, customers, np.bincount(bucket.context, tables, 2), root.sum(), root_tables.sum())
        parent = language_model.root_word(root, root_tables, now)
        assert parent.sum() == pytest.approx(1)  # three known words and the unknown one
        left = (language_model.STRENGTH + language_model.DISCOUNT * now.tables[bucket.context]) * parent[bucket.word]
        p = (bucket.count - language_model.DISCOUNT * tables + left) / (language_model.STRENGTH + customers[bucket.context])
        assert np.bincount(bucket.context, p, 2) == pytest.approx([1, 1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><div class="site-header"><a href=/>Home</a>
</div><div id="menu"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></div>{body}
<section class="comments"><p>First!</section><form><p>Your mail<input></form><script>var a="</p>";</script>
<footer>&copy; us</footer></body></html>"""


def test_extraction_by_names_and_wrapper(spark):
    marked = PAGE.format(body="<article><h1>A &amp; B</h1><p>One\n  two<br>three <b>four</b>.<p>Five&nbsp;six"
                              "<aside>Not me</aside><ul><li>x<li>y</ul></article><div>outside</div>")
    rows = [(0, "http://m.example/1", marked)]
    for i in range(6):  # no marks: constants and link lists are found by the wrapper
        rows.append((10 + i, f"http://plain.example/{i}", f"<body><div>Same on all pages</div><table><tr><td><a href=/x>L{i}</a>"
                     f"</td><td><a href=/y>M{i}</a></td></tr></table><div class=x><p>Text {i} of its own</p><p>and more {i}</p>"
                     + ("<h2>Only here</h2>" if i == 3 else "") + "</div></body>"))
    got = {r.page_id: r.text for r in extraction.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "A & B\n\nOne two three four.\n\nFive six\n\nx\n\ny"
    for i in range(6):
        assert got[10 + i] == f"Text {i} of its own\n\nand more {i}" + ("\n\nOnly here" if i == 3 else "")


def test_wrapper_has_slots_options_and_repeats():
    wrapper = extraction.infer(["<div><p>a</p><p>b</p></div><h2>same</h2>", "<div><p>c</p></div><h2>same</h2><h3>x</h3>"])
    div, h2, h3 = wrapper.children
    assert div.children[0].children[0].repeated and div.children[0].children[0].slot
    assert not h2.children[0].slot and not h2.optional and h3.optional


def test_open_quotes_and_deep_pages_end():
    assert extraction.article('<p title="x>never closed</p><p>b</p>', frozenset()) == "never closed\n\nb"
    deep = "<div>" * 3000 + "core" + "</div>" * 3000
    assert extraction.article(deep, frozenset()) == "core"
    assert extraction.infer([deep, deep]).children


def test_names_that_keep_the_article():
    text = lambda page: extraction.article(page, frozenset())
    for name in ("no-header", "has-sidebar", "ad-free", "header"):
        assert text(f'<body class="{name}"><p>kept</p></body>') == "kept"
    for name in ("no-header", "with-sidebar", "ad-free"):
        assert text(f'<body><div class="{name}"><p>kept</p></div></body>') == "kept"
    for name in ("ad", "site-header", "left-sidebar", "cookie-notice"):
        assert text(f'<body><div class="{name}"><p>gone</p></div><p>kept</p></body>') == "kept"
    assert text('<header>site</header><article><header class="entry-header"><h1>Title</h1></header><p>x</p></article>'
                ) == "Title\n\nx"


def test_long_blocks_and_lists_take_linear_time():
    begin = time.perf_counter()
    inline = "<article><p>" + "<b>a</b> " * 100_000 + "</p></article>"
    assert extraction.article(inline, frozenset()) == " ".join(["a"] * 100_000)
    assert extraction.article("<p>" + "<b>a " * 20_000, frozenset()) == " ".join(["a"] * 20_000)
    pages = ["<dl>" + "".join(f"<dt>{k}{i}<dd>x{i}" for i in range(5000)) + "</dl>" for k in "ab"]
    wrapper = extraction.infer(pages)
    assert [(c.kind, c.repeated) for c in wrapper.children[0].children] == [("dt", True), ("dd", True)]
    assert time.perf_counter() - begin < 30


def test_wrappers_from_all_pages_in_a_tree_of_merges(spark, monkeypatch):
    """Pages over many tasks, merged two by two, a few hosts at once, give what one wrapper of all pages gives."""
    monkeypatch.setattr(extraction, "FAN_IN", 2)
    monkeypatch.setattr(extraction, "HOSTS_AT_ONCE", 2)
    rows = []
    for i in range(120):
        varied = "new" if i == 77 else "old"  # equal on all pages of the host but one
        rows.append((i, f"http://h{i % 4}.example/{i}", f"<body><h2>{varied}</h2><h3>always</h3><div><p>Text {i}</p></div></body>"))
    rows += [(200 + i, "http://mixed.example/", f"<body><div><p>plain {i}</p></div></body>") for i in range(20)]
    rows.append((300, "http://mixed.example/", "<body><div><p>aside</p></div><article><p>marked</p></article></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    got = {r.page_id: r.text for r in extraction.extract(frame).collect()}
    by_host = {h: [html for i, _, html in rows[:120] if i % 4 == h] for h in range(4)}
    for i, _, html in rows[:120]:
        pages = by_host[i % 4]
        drop = frozenset(extraction.furniture(extraction.infer(pages), len(pages)))
        assert got[i] == extraction.article(html, drop)
        assert got[i] == (f"{'new' if i == 77 else 'old'}\n\n" if i % 4 == 1 else "") + f"Text {i}"
    assert all(got[200 + i] == f"plain {i}" for i in range(20)) and got[300] == "marked"


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice(["the", "and", "of", "house", "river", f"n{rng.randrange(900)}"]) for _ in range(n))
    docs = [(i, "\n".join(line(12) for _ in range(4)), "en", f"s{i % 3}") for i in range(40)]
    docs += [(50, "12 34", "en", "s0"), (51, None, "en", "s1"), (52, docs[1][1], "en", "s2")]
    item = line(14)
    docs.append((53, line(9) + " " + item + " " + line(9), "en", "s0"))
    long = line(300)
    docs += [(54, long, "en", "s1"), (55, long + " also these words more", "en", "s2")]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, seen = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.materialize(stage(spark, kept, str(tmp_path)))
        seen.append({r.doc_id for r in kept.collect()})
    everything = {d[0] for d in docs}
    assert seen[0] == everything - {50, 51}
    assert seen[1] == seen[0] - {52}
    assert seen[2] == seen[1] - {55}
    assert seen[3] == seen[2] - {53}
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} <= seen[3] and len(rows) > 20
    assert sorted(map(str, rows)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
