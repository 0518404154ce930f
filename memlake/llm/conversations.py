"""Conversation structure repair by the auction algorithm for shortest paths.

The edits of a conversation are arcs of a lattice: a node is a number of rows
read and a state of the wanted form (nothing yet, after system, after user,
after assistant). Nodes have prices that never exceed the cost of what is left.
A path grows from its origin: at its end it is extended along an arc whose cost
is the difference of the prices, or, if there is none, the price rises to the
least that an arc asks and the path is contracted by one node. It ends at a node
whose price is final. Final prices are dual to the cheapest edits: the arcs of
all cheapest ways, and no others, are tight, and following the first letter of a
tight arc at each node spells the least of them.

Long conversations are cut into segments of a bounded number of rows. A
segment's prices for each state at its end come first, in parallel; the chain of
segments is a small lattice of its own, whose prices are then the ends that each
segment is solved against. Texts take no part in this; rows meet their edits
again by place, and a conversation's digest is made while its rows stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from memlake.llm import common
from memlake.operators.prefix import BUCKET_ROWS, ordinal

DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Rows of a segment.
SEGMENT = 512
STATES = START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (0, None, None, 0)
#: What follows a state, by the initial of its role, if any way leads there.
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_FAR = 1 << 60
_SPACE = r"\x20\x09-\x0D"


# --- auction ----------------------------------------------------------------------------------

Arc = tuple[str, int, int]  # letters, cost, node


def converge(arcs: list[list[Arc]], layers: list[list[int]], price: list[int]) -> None:
    """Make the prices of all nodes final, from the last layer to the first.

    `price` holds those of the end nodes; nodes that lead nowhere stay at `_FAR`.
    """
    final = {node for node, p in enumerate(price) if p is not None}
    for layer in layers:
        ways = {node: [a for a in arcs[node]] for node in layer}
        # Within a layer a node may lead on by way of others only.
        live: set[int] = set()
        for _ in layer:
            live |= {n for n in layer if any(t in live or (t in final and price[t] < _FAR) for _, _, t in ways[n])}
        least = min((cost + price[t] for n in live for _, cost, t in ways[n] if t in final), default=_FAR)
        for node in layer:
            price[node] = _FAR
        # No way out of the layer is cheaper than `least`, however it is reached: a start below all final prices.
        for node in live:
            price[node] = min(least, min(cost for n in live for _, cost, _ in ways[n]) + least)
        for origin in layer:
            if origin not in live:
                final.add(origin)
                continue
            path = [origin]
            while path[-1] not in final:
                node = path[-1]
                asked, to = min((cost + price[t], t) for _, cost, t in ways[node])
                if price[node] < asked:
                    price[node] = asked
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            final.update(path)


def _segment(codes: str, ends: tuple, last: bool) -> tuple[list[list[Arc]], list[int]]:
    """Lattice of a segment and its final prices; node 4 * rows read + state.

    A code is `x` for a row that must go, otherwise the role's initial (`o` for
    others), a capital if the text is truncated. `ends` are the prices after the
    segment (None for no way). Rows inserted behind the last row belong to the
    `last` segment only.
    """
    n = len(codes)
    arcs: list[list[Arc]] = [[] for _ in range(4 * (n + 1))]
    for i in range(n + 1 if last else n):
        for state in STATES:
            here = arcs[4 * i + state]
            follow = ASSISTANT if state == USER else USER
            here.append(("I" + "ua"[follow == ASSISTANT], INSERT, 4 * i + follow))
            if i == n:
                continue
            here.append(("D", DELETE, 4 * (i + 1) + state))
            code = codes[i]
            if code != "x":
                more = TRUNCATED if code.isupper() else 0
                to = _NEXT[state].get(code.lower())
                if to is not None:
                    here.append(("K", more, 4 * (i + 1) + to))
                here.append(("R" + "ua"[follow == ASSISTANT], REROLE + more, 4 * (i + 1) + follow))
    price: list[int | None] = [None] * (4 * (n + 1))
    layers = [[4 * i + s for s in STATES] for i in range(n - 1, -1, -1)]
    if last:  # the end is one more node behind the last layer
        arcs.append([])
        price.append(0)
        for state in STATES:
            if ends[state] is not None:
                arcs[4 * n + state].append(("", ends[state], 4 * (n + 1)))
        layers.insert(0, [4 * n + s for s in STATES])
    else:
        price[4 * n:] = [_FAR if e is None else e for e in ends]
    converge(arcs, layers, price)
    return arcs, price


@lru_cache(1 << 14)
def crossing(codes: str) -> tuple:
    """Least cost from each state before a segment to each state behind it (None: no way), 16 numbers."""
    out: list = [None] * 16
    for to in STATES:
        _, price = _segment(codes, tuple(0 if s == to else None for s in STATES), False)
        for state in STATES:
            out[4 * state + to] = price[state] if price[state] < _FAR else None
    return tuple(out)


def chain(crossings: list, tail: tuple) -> list[list]:
    """Prices behind each segment of a chain, given those behind the last one's rows."""
    n = len(crossings)
    arcs: list[list[Arc]] = [[("", int(c[4 * s + t]), 4 * (k + 1) + t) for t in STATES if c[4 * s + t] is not None]
                             for k, c in enumerate(crossings) for s in STATES] + [[] for _ in STATES]
    price: list[int | None] = [None] * (4 * n) + [_FAR if p is None else p for p in tail]
    converge(arcs, [[4 * k + s for s in STATES] for k in range(n - 1, -1, -1)], price)
    return [[None if p >= _FAR else p for p in price[4 * k: 4 * k + 4]] for k in range(1, n + 1)]


@lru_cache(1 << 14)
def solve(codes: str, ends: tuple, last: bool) -> tuple:
    """For each state before a segment: the state behind it and the letters of each row.

    A row has the letters of what is inserted before it and its own; a new role
    follows its letter (`Iu`, `Ra`). The `last` segment has one more entry for
    what is inserted at the end.
    """
    arcs, price = _segment(codes, ends, last)
    out = []
    for state in STATES:
        if price[state] >= _FAR:
            out.append(None)
            continue
        letters, node = [""] * (len(codes) + 1), state
        while node < 4 * len(codes) or (last and node < 4 * len(codes) + 4):
            letter, _, to = min(a for a in arcs[node] if a[1] + price[a[2]] == price[node])
            letters[node // 4] += letter
            node = to
        out.append((0 if last else node % 4, letters if last else letters[:-1]))
    return tuple(out)


#: Prices behind the last row: what must still be inserted from there.
TAIL = tuple(_segment("", ACCEPTED, True)[1][:4])


# --- rows ---------------------------------------------------------------------------------------

def _key(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def faults(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows in the order of their conversation with their first fault: `blank`, `duplicate`, `truncated` or null.

    Columns: `key` (text that names the conversation), `pos` from 0, `turn`,
    `role`, `text`, `fault`. Order is by turn (null first), role and text; a null
    role or text counts as one space. Blank: no character but ASCII white space;
    duplicate: same role and text at a smaller `pos`; truncated: the last such
    character is none of `.!?`.
    """
    rows = conversations.select(
        _key(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    bucket = F.coalesce(F.floor(F.col("turn") / BUCKET_ROWS).cast("long"), F.lit(-(1 << 62)))
    placed = ordinal(rows, ["key"], [bucket], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], name="pos")
    placed = common.materialize(placed.withColumns({
        "_same": F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256),
        "_blank": ~F.col("text").rlike(f"[^{_SPACE}]"), "_open": ~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")}))
    first = placed.groupBy("key", "_same").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where(
        "_n > 1").drop("_n")
    fault = (F.when(F.col("_blank"), "blank").when(F.col("pos") > F.col("_first"), "duplicate")
             .when(F.col("_open"), "truncated"))
    again = placed.drop("turn", "role", "text").join(first, ["key", "_same"]).select("key", "pos", "_first")
    return placed.join(again, ["key", "pos"], "left").select("key", "pos", "turn", "role", "text", fault.alias("fault"))


def edits(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The cheapest edits that give every conversation the role initials `(s?(ua)+)?`; of several the least letters.

    `rows` is a result of `faults`. One row per edit, in order of `pos` and `sub`:
    `edit` (K keep, R new role, D delete, I insert before the row at `pos`),
    `role` and `text` as they are after it (of a deleted row, as they were),
    `fault`, `was` (the role before, null for an inserted row) and `turn`.
    """
    initial = F.substring("role", 1, 1)
    code = F.when(F.col("fault").isin("blank", "duplicate"), "x").otherwise(F.when(initial.isin("s", "u", "a"), initial).otherwise("o"))
    code = F.when(F.col("fault") == "truncated", F.upper(code)).otherwise(code)
    coded = rows.select("key", "pos", code.alias("code"))
    # A segment's codes: one letter a row, of a bounded number of rows.
    parts = coded.groupBy("key", F.floor(F.col("pos") / segment).cast("long").alias("seg")).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"]), "").alias("codes"))

    @F.pandas_udf("array<int>")
    def crossed(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: list(crossing(c)))

    @F.pandas_udf("array<array<int>>")
    def ends(crossings: pd.Series) -> pd.Series:
        return crossings.map(lambda all_: chain([[None if v is None or v != v else int(v) for v in c] for c in all_], TAIL))

    @F.pandas_udf("array<struct<to: int, letters: array<string>>>")
    def solved(codes: pd.Series, ends_: pd.Series, last: pd.Series) -> pd.Series:
        return pd.Series([[None if x is None else {"to": x[0], "letters": x[1]} for x in solve(
            c, ACCEPTED if is_last else tuple(None if v is None or v != v else int(v) for v in e), bool(is_last))]
            for c, e, is_last in zip(codes, ends_, last)])

    # A short conversation is one segment, which needs no prices of others.
    crossings = F.when((F.col("seg") > 0) | (F.length("codes") >= segment), crossed("codes"))
    parts = common.materialize(parts.withColumn("crossing", crossings))
    chained = parts.where("crossing is not null").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", "crossing"))).alias("_s"))
    # The crossings of a segment are sixteen small numbers for up to `segment` rows.
    chained = chained.withColumn("_all", F.transform("_s", lambda x: x["crossing"]))
    tails = parts.groupBy("key").agg(F.max("seg").alias("last"))
    known = parts.select("key", "seg").where("seg = 0 and crossing is null").select("key", "seg", F.lit(None).cast("array<int>").alias("ends"))
    behind = chained.select("key", F.posexplode(ends("_all")).alias("_at", "ends")).select("key", F.col("_at").cast("long").alias("seg"), "ends")
    return _placed(rows, parts, known.unionByName(behind), tails, solved, segment)


def _placed(rows: DataFrame, parts: DataFrame, behind: DataFrame, tails: DataFrame, solved, segment: int) -> DataFrame:
    ready = parts.join(behind, ["key", "seg"]).join(tails, "key").select("key", "seg", "codes", "ends", (F.col("seg") == F.col("last")).alias("last"))
    found = common.materialize(ready.select("key", "seg", solved("codes", "ends", "last").alias("found")))
    # Follow the states from segment to segment: the entry of each from the exit of the one before.
    steps = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seg", F.transform("found", lambda x: x["to"]).alias("to")))).alias("_s"))

    @F.pandas_udf("array<int>")
    def entries(steps: pd.Series) -> pd.Series:
        def follow(ways):
            state, out = START, []
            for way in ways:
                out.append(int(state))
                state = way[int(state)]
            return out

        return steps.map(follow)

    entered = steps.select("key", F.posexplode(entries(F.transform("_s", lambda x: x["to"]))).alias("_at", "entry")).select(
        "key", F.col("_at").cast("long").alias("seg"), "entry")
    letters = found.join(entered, ["key", "seg"]).select("key", "seg", F.posexplode(F.element_at(
        "found", F.col("entry") + 1)["letters"]).alias("_k", "letters")).select(
        "key", (F.col("seg") * segment + F.col("_k")).alias("pos"), "letters").where("letters != ''")
    each = F.posexplode(F.regexp_extract_all("letters", F.lit("([A-Z][a-z]?)"), F.lit(1))).alias("sub", "_e")
    one = letters.join(rows, ["key", "pos"], "left").select("key", "pos", "turn", "role", "text", "fault", each)
    edit = F.substring("_e", 1, 1)
    inserted = edit == "I"
    given = F.when(F.substring("_e", 2, 1) == "u", "user").when(F.substring("_e", 2, 1) == "a", "assistant")
    own = lambda c: F.when(~inserted, F.col(c)).alias(c)
    return one.select("key", "pos", "sub", edit.alias("edit"), F.coalesce(given, F.col("role")).alias("role"),
                      F.when(inserted, "").otherwise(F.col("text")).alias("text"), own("fault"),
                      F.when(~inserted, F.col("role")).alias("was"), own("turn"))


def digest(made: DataFrame) -> DataFrame:
    """One row per conversation: `key`, counts of faults and of wrong neighbours, cost, letters, and the hash of the result.

    Edits are dealt by conversation and sorted on disk; counters and the hash run
    along, so that a task never holds the texts of a conversation.
    """
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    schema = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    costs = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        key = None
        for batch in batches:
            for k, edit, role, text, fault, was, turn in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    if key is not None:
                        done.append(_closed(key, state))
                    key = k
                    state = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(),
                             "any": False, "turns": 0, "first": None, "last": None, "before": None}
                state["audit"].append(edit)
                state["cost"] += costs[edit]
                if edit != "I":
                    if fault:
                        state[fault] += 1
                        state["cost"] += TRUNCATED if fault == "truncated" and edit != "D" else 0
                    if state["before"] is not None and (state["before"] + was[:1]) not in ("su", "ua", "au"):
                        state["illegal"] += 1
                    state["before"] = was[:1]
                    if turn is not None and turn != state["last"]:
                        state["first"] = turn if state["first"] is None else state["first"]
                        state["turns"] += 1
                        state["last"] = turn
                if edit != "D":
                    state["hash"].update((f"\n{role}:" if state["any"] else f"{role}:").encode())
                    state["hash"].update(text.encode())
                    state["any"] = True
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], ARROW)
                done = []
        if key is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(names, _closed(key, state)))], ARROW)

    ARROW = pa.schema([("key", pa.string()), *[(n, pa.int64()) for n in names[1:7]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    lean = made.repartition("key").sortWithinPartitions("key", "pos", "sub").select("key", "edit", "role", "text", "fault", "was", "turn")
    return lean.mapInArrow(run, schema)


def _closed(key: str, s: dict) -> tuple:
    gaps = s["last"] - s["first"] + 1 - s["turns"] if s["turns"] else 0
    return (key, gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], s["cost"], "".join(s["audit"]), s["hash"].hexdigest())


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """The cheapest repair of every conversation, one row per edit (see `edits`), with `key` as in `faults`.

    Keeping a row costs nothing, a new role 2, deleting 3 (a must for blank and
    duplicate rows), an empty user or assistant row anywhere 2, and a truncated
    row that stays 1. Of several cheapest repairs the one whose letters D, I, K,
    R come first. A null conversation is one of its own; rows of a null turn come
    first; equal rows are in the order of role and text, and all but the first
    are duplicates; empty and very long texts are rows as any. Columns beyond the
    four named play no part. An empty table has no edits.
    """
    return edits(common.materialize(faults(conversations, conv_col, turn_col, role_col, text_col)), segment)
