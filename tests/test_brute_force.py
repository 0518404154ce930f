"""Operators without SQL against plain models of what they must compute."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from memlake.catalog import fixtures as fx
from memlake.catalog.chunking import SMALL
from memlake.operators import chunking as ck
from memlake.operators import slices as sl
from memlake.operators.prefix import id_bucket, ordinal, running
from memlake.settings import Settings

TINY = Settings(context_total=300, context_free=60, map_prompt=20, reduce_prompt=20, system_prompt=20,
                reduce_output=20, chunk_max_turns=5)


def _tokens(length, per=2):
    return max(1, length // per) if length else 0


def _chunks(roles, lengths, settings):
    """Cut ranges one at a time, the worst first; sizes only."""
    a, r = settings.map_budget, settings.reduce_budget
    sizes = [_tokens(n) for n in lengths]
    n = max(1, math.ceil((sum(sizes) + r) / a)) if sum(sizes) else 1
    while max(sizes) > a - r // n and n < max(1, len(sizes)):
        n += 1
    budget, most = a - r // n, max(1, min(settings.chunk_max_turns, math.ceil(len(sizes) / n)))
    work = [[(i, 0, length) for i, length in enumerate(lengths)]]

    def total(chunk):
        return sum(_tokens(hi - lo) for _, lo, hi in chunk)

    while True:
        badness = [max((total(c) - budget) / budget, (len(c) - most) / most) for c in work]
        worst = max(range(len(work)), key=lambda i: badness[i])
        if badness[worst] <= 0:
            return work
        chunk = work[worst]
        if len(chunk) == 1:
            i, lo, hi = chunk[0]
            mid = lo + math.ceil((hi - lo) / 2)
            parts = [[(i, lo, mid)], [(i, mid, hi)]]
        else:
            rounds = [k for k in range(1, len(chunk)) if roles[chunk[k - 1][0]] == "assistant" and roles[chunk[k][0]] == "user"]
            t, m = total(chunk), len(chunk)
            cut = min(rounds or range(1, m), key=lambda k: (
                abs(total(chunk[:k]) - t / 2) / max(1, t) + abs(k - m / 2) / m + (0 if rounds else 0.25), k))
            parts = [chunk[:cut], chunk[cut:]]
        work[worst:worst + 1] = parts


def _check_chunks(spark, turns, settings):
    got = {}
    for row in ck.chunk_bounds(turns, settings).collect():
        last = row.to_char if row.to_char is not None else None
        got.setdefault(row.agent_id, []).append((row.chunk_id, row.first_turn, row.last_turn, row.from_char, last, row.token_estimate))
    days = {}
    for row in turns.orderBy("turn_index").collect():
        days.setdefault(row.agent_id, []).append((row.role, row.length))
    assert set(got) == set(days)
    for agent, rows in days.items():
        want = _chunks([r for r, _ in rows], [n for _, n in rows], settings)
        mine = sorted(got[agent])
        assert [c[0] for c in mine] == list(range(1, len(want) + 1))
        for have, chunk in zip(mine, want):
            assert (have[1], have[2]) == (chunk[0][0], chunk[-1][0])
            assert have[5] == sum(_tokens(hi - lo) for _, lo, hi in chunk)
            if have[4] is not None:
                assert (have[3], have[4]) == (chunk[0][1], chunk[0][2])


def test_chunks_of_documents(spark, sf):
    _check_chunks(spark, fx.long_turns(spark, sf), SMALL)


def test_chunks_of_odd_days(spark):
    rows = []
    for agent in range(12):
        for i in range(1 + agent * 3):
            role = "user" if (i * 7 + agent) % 3 else "assistant"
            rows.append((f"a{agent}", date(2024, 1, 1), i, role, (i * i * 13 + agent * 29) % (60 if agent % 2 else 900)))
    turns = spark.createDataFrame(rows, "agent_id string, memory_date date, turn_index bigint, role string, length bigint")
    _check_chunks(spark, turns, TINY)


def test_budget_below_one_token_is_refused(spark):
    turns = spark.createDataFrame([("a", date(2024, 1, 1), 0, "user", 9)],
                                  "agent_id string, memory_date date, turn_index bigint, role string, length bigint")
    with pytest.raises(ValueError):
        ck.chunk_bounds(turns, Settings(context_total=75_000, context_free=75_000))


def test_running_sums_match_a_plain_loop(spark):
    rows = [(i % 3 == 0, i, (i * 37) % 11) for i in range(5000)]
    df = spark.createDataFrame(rows, "hot boolean, pos bigint, v bigint").withColumn("k", F.col("hot").cast("string"))
    got = {(r.k, r.pos): r.s for r in running(df, ["k"], [id_bucket("pos")], [F.col("pos")], {"s": F.col("v")}).collect()}
    sums = {}
    for hot, pos, v in rows:
        key = str(hot).lower()
        assert got[(key, pos)] == sums.get(key, 0)
        sums[key] = sums.get(key, 0) + v


def test_descending_buckets(spark):
    df = spark.createDataFrame([("a", float(i % 7), i) for i in range(500)], "k string, v double, pos bigint")
    ranked = ordinal(df, ["k"], [(F.floor("v").cast("bigint"),), id_bucket("pos")], [F.desc("v"), F.col("pos")], "place")
    want = {pos: place for place, (_, pos) in enumerate(sorted((-(i % 7), i) for i in range(500)))}
    assert {r.pos: r.place for r in ranked.collect()} == want


def _fit(turns, budget):
    """Reduce one slice step by step, the slow way. Turns are (role, text)."""
    line = lambda t: len(t[0]) + 3 + len(t[1])
    size = lambda ts: sum(map(line, ts))
    turns = list(turns)
    if size(turns) <= budget:
        return "\n".join(f"[{r}] {t}" for r, t in turns)
    while turns and size(turns) > budget:
        spoken = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
        if not spoken:
            break
        turns.pop(min(spoken, key=lambda i: len(turns[i][1])))
    if size(turns) > budget and len(turns) > 2:
        for stride in range(2, len(turns) + 1):
            kept = [t for i, t in enumerate(turns) if i % stride == 0 or i == len(turns) - 1]
            if size(kept) <= budget:
                break
        turns = kept
    while turns and size(turns) > budget:
        longest = max(range(len(turns)), key=lambda i: len(turns[i][1]))
        role, text = turns[longest]
        if len(text) <= 24:
            break
        keep = max(24, int(len(text) * 0.85))
        head = int((keep - 3) * 0.6)
        turns[longest] = (role, text[:head] + "..." + text[len(text) - (keep - 3 - head):])
    return "\n".join(f"[{r}] {t}" for r, t in turns)[:budget]


def test_exact_recall_of_long_days(spark, sf):
    from memlake.catalog.reading import recall_exact_long
    from memlake.plans.exact import NO_TRANSCRIPT

    got = {r.slice_id: r.text for r in recall_exact_long(spark, sf).collect()}
    days = {}
    for row in fx.long_turns(spark, sf).orderBy("turn_index").collect():
        days.setdefault(row.agent_id, []).append((row.role, row.content.strip()))
    assert set(got) == set(days)
    for agent, turns in days.items():
        assert got[agent] == (_fit(turns, 10_000) or NO_TRANSCRIPT)


@pytest.mark.parametrize("budget", [40, 120, 400])
def test_slice_steps_on_small_slices(spark, budget):
    rows = [(f"s{s}", i, "user" if (i + s) % 3 else "assistant", (i * 17 + s * 5) % 23) for s in range(8) for i in range(1 + s * 4)]
    df = spark.createDataFrame(rows, "slice_id string, pos bigint, role string, content_length bigint").withColumn(
        "line_length", F.col("content_length") + F.length("role") + 3)
    kept = {}
    for r in sl.stride_downsample(df, budget).collect():
        kept.setdefault(r.slice_id, []).append(r.pos)
    for s in range(8):
        lines = [len(role) + 3 + n for sid, _, role, n in rows if sid == f"s{s}"]
        want = list(range(len(lines)))
        if len(lines) > 2:
            for stride in range(2, len(lines) + 1):
                want = [i for i in range(len(lines)) if i % stride == 0 or i == len(lines) - 1]
                if sum(lines[i] for i in want) <= budget:
                    break
        assert sorted(kept[f"s{s}"]) == want
