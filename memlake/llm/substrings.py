"""Substring deduplication by recompression.

Every text is a sequence of word names. Rounds replace runs of an equal symbol,
then pairs of a left and a right symbol (a bit of the name tells which), by new
symbols. Names are hashes of what they stand for, so all tasks of a round name
the same run or pair alike without exchanging tables. What a round does to a
symbol depends on its two neighbours alone; a window of words thus knows part of
its own symbols whatever surrounds it. Its anchor is, among those it knows on
the highest level where it knows any, the one of most bytes, ties by hash: equal
windows have equal anchors, neighbouring windows mostly share theirs, and long
symbols seldom repeat by chance.

Anchors that occur twice anywhere mark the windows that may repeat. Those are
verified by the name of their whole word sequence, and all but the first
occurrence of a window are removed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, packed, words

WINDOW = 20
#: Rounds of runs and pairs. More leave few windows of 20 words with a symbol of their own, fewer leave short symbols.
ROUNDS = 2


def _merge(begin: np.ndarray, name: np.ndarray, join: np.ndarray, made) -> tuple[np.ndarray, np.ndarray]:
    """Symbols after `join` (whether a symbol is joined to the one before); `made` names those of several parts."""
    keep = np.flatnonzero(~join)
    length = np.diff(np.append(keep, len(name)))
    names = name[keep]
    several = length > 1
    names[several] = made(keep[several], length[several])
    return begin[keep], names


def anchors(found: words.Words, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, anchor name and anchor position of every window of a chunk."""
    n = len(found.hash)
    if n < size:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    window = np.flatnonzero(found.row[size - 1:] == found.row[: n - size + 1])
    anchor, place = np.zeros(len(window), np.uint64), np.zeros(len(window), np.int64)
    text_start = np.zeros(n + 1, bool)
    text_start[found.first] = True
    begin, name = np.arange(n), found.hash
    alive, low, high = np.arange(len(window)), window, window + size  # known symbols, by the bounds of their words

    size_before = np.concatenate([[0], np.cumsum(found.end - found.start)])  # bytes of all words before each

    def settle(which: np.ndarray, level: int) -> None:
        """Anchors of these windows from the symbols of this level."""
        own, at = _strongest(begin, name, size_before, low[which], high[which])
        anchor[alive[which]], place[alive[which]] = own ^ np.uint64(level), at

    for level in range(2 * ROUNDS):
        if level % 2 == 0:  # runs
            join = np.concatenate([[False], name[1:] == name[:-1]]) & ~text_start[begin]
            made = _merge(begin, name, join, lambda at, k: words.pair(
                name[at], k.astype(np.uint64) + np.uint64(level << 32)))
        else:  # pairs of a left and a right symbol
            left = words.mix(name ^ np.uint64(level)) & np.uint64(1) == 0
            join = np.concatenate([[False], left[:-1] & ~left[1:]]) & ~text_start[begin]
            made = _merge(begin, name, join, lambda at, k: words.pair(name[at], name[at + 1]))
        stays = np.zeros(n + 1, np.int64)
        stays[made[0]] = 1
        number = np.cumsum(stays)  # symbols that begin at or before a word
        bound = np.append(made[0], n)
        up, down = bound[number[low]], bound[number[high - 1] - 1]
        ok = up < down
        if not ok.all():
            settle(np.flatnonzero(~ok), level)
        alive, low, high = alive[ok], up[ok], down[ok]
        begin, name = made
    settle(np.arange(len(alive)), 2 * ROUNDS)
    return window, anchor, place


def _strongest(begin: np.ndarray, name: np.ndarray, size_before: np.ndarray, low: np.ndarray, high: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray]:
    """Name and first word of the symbol of most bytes between bounds, ties by hash, then the first."""
    n = len(size_before) - 1
    if not len(low):
        return np.zeros(0, np.uint64), low
    stays = np.zeros(n + 1, np.int64)
    stays[begin] = 1
    number = np.cumsum(stays)
    first, last = number[low] - 1, number[high - 1]
    size = np.minimum(size_before[np.append(begin[1:], n)] - size_before[begin], 65535).astype(np.uint64)
    rank = words.mix(name) >> np.uint64(16) | (np.uint64(65535) - size) << np.uint64(48)
    best = [np.arange(len(name))]  # of 1, 2, 4, ... symbols from each on
    wide = last - first
    while 2 << (len(best) - 1) <= wide.max():
        step = 1 << (len(best) - 1)
        one = best[-1]
        other = np.append(one[step:], one[len(one) - step:])
        best.append(np.where(rank[other] < rank[one], other, one))
    power = np.log2(wide).astype(np.int64)
    pick = np.empty(len(low), np.int64)
    for k, table in enumerate(best):
        some = power == k
        one, other = table[first[some]], table[last[some] - (1 << k)]
        pick[some] = np.where(rank[other] < rank[one], other, one)
    return name[pick], begin[pick]


def _input(docs: DataFrame, id_col: str, text_col: str, kept: list[str]) -> DataFrame:
    """Columns `c_...` to keep, `_id`, `_key` (names of document and text) and the deflated `_text`, dealt by document."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in kept],
                       F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_id"),
                       F.xxhash64(text_col).alias("_key"), F.encode(text_col, "utf-8").alias("_text"))

    def deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = pa.array([None if v is None else zlib.compress(v, 1) for v in batch["_text"].to_pylist()], pa.binary())
            yield pa.record_batch([*batch.columns[:-1], small], names=batch.schema.names)

    return rows.mapInArrow(deflate, rows.schema).repartition(parts, "_id", "_key")


def _texts(batch: pa.RecordBatch) -> pa.Array:
    found = [None if v is None else zlib.decompress(v) for v in batch["_text"].to_pylist()]
    return pa.array(found, pa.binary()).cast(pa.string())


def _stretches(batch: pa.RecordBatch, texts: pa.Array, at: int) -> tuple[np.ndarray, np.ndarray]:
    part = slice(at, at + len(texts))
    return batch["_id"].to_numpy()[part], batch["_key"].to_numpy()[part]


def _shared_anchors(size: int):
    """Message rows: for each stretch of windows with one anchor, the place first window * size + windows - 1.

    Windows that begin less than `half` before their anchor all hold the words
    from it to `size - half` further on, the others those from `half` before it:
    these words, too, are part of the stretch's name.
    """
    half = max(1, size // 2 - 2)

    def run(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        splitter, held = words.Splitter(), packed.Entries(parts, "shared")
        for batch in batches:
            for at, texts in words.chunks(_texts(batch)):
                found = splitter.split(texts)
                window, anchor, place = anchors(found, size)
                if not len(window):
                    continue
                ids, keys = _stretches(batch, texts, at)
                far = place - window >= half
                new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (place[1:] != place[:-1]) |
                                      (far[1:] != far[:-1]) | (np.diff(window) != 1) |
                                      (np.arange(1, len(window)) % size == 0)])
                cut = np.flatnonzero(new)
                length = np.diff(np.append(cut, len(window)))
                first, far = window[cut], far[cut]
                core = place[cut] - np.where(far, half, 0)
                name = words.pair(anchor[cut], splitter.spans(found, core, np.where(far, half + 1, size - half + 1)))
                row = found.row[first]
                held.add(name, row, (first - found.first[row]) * size + length - 1, ids, keys)
                if held.count > packed.ENTRIES:
                    yield from held.flush()
        yield from held.flush()
    return run


def _repeated_windows(size: int):
    """Message rows: the windows that repeat an earlier one, among those with a shared anchor."""
    def run(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
        splitter, held = words.Splitter(), packed.Entries(parts, "later")
        for batch in batches:
            for at, texts in words.chunks(_texts(batch)):
                found = splitter.split(texts)
                window, name = splitter.windows(found, size)
                wanted = np.zeros(len(found.hash) + 1, np.int64)
                for row in range(len(texts)):
                    places = packed.numbers(batch["places"][at + row].as_py())
                    first = found.first[row] + places // size
                    np.add.at(wanted, first, 1)
                    np.add.at(wanted, first + places % size + 1, -1)
                pick = np.cumsum(wanted)[window] > 0
                window, name = window[pick], name[pick]
                row = found.row[window]
                ids, keys = _stretches(batch, texts, at)
                held.add(name, row, window - found.first[row], ids, keys)
                if held.count > packed.ENTRIES:
                    yield from held.flush()
        yield from held.flush()
    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW,
                   keep: list[str] | None = None) -> DataFrame:
    """Add `n_words`, `removed` and `kept` to every row's columns `keep`, or all.

    A word is removed if it lies in a window of `size` words whose sequence also
    starts earlier: in a document of smaller id, or earlier in the same one.
    `removed` are the merged word positions [start, end), `kept` the other words
    joined by one space. Null and empty texts have no words. Rows that repeat id
    and text are one document and get equal results; rows of one id with
    different texts are documents in the order of their hash; null ids come
    last. Texts shorter than a window lose nothing.
    """
    new = ("n_words", "removed", "kept")
    kept = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    parts = packed.buckets(docs.sparkSession)
    # All three passes read all of its columns, so that they share one exchange.
    whole = _input(docs, id_col, text_col, kept)

    def bind(run):
        return lambda batches: run(batches, parts)

    by_key = [F.col("_id") == F.col("id"), F.col("_key") == F.col("text_key")]
    shared = packed.settle(whole.mapInArrow(bind(_shared_anchors(size)), packed.SCHEMA), "shared")
    candidates = whole.join(shared, by_key).drop("id", "text_key")
    repeats = packed.settle(candidates.mapInArrow(bind(_repeated_windows(size)), packed.SCHEMA), "later")
    joined = whole.join(repeats, by_key, "left").drop("id", "text_key", "_id", "_key")
    spans = "array<struct<start:bigint,end:bigint>>"
    out = joined.select(*[F.col(f"c_{c}").alias(c) for c in kept], F.lit(0).cast("long").alias("n_words"),
                        F.array().cast(spans).alias("removed"), F.lit("").alias("kept"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.chunks(_texts(batch)):
                total, texts_kept, removed = [], [], []
                for row, text in enumerate(texts):
                    parts = (text.as_py() or "").encode().split()
                    total.append(len(parts))
                    start = packed.numbers(batch["places"][at + row].as_py())
                    if len(start):
                        cut = np.flatnonzero(np.diff(start, prepend=-size - 1) > size)
                        low, high = start[cut], np.append(start[cut[1:] - 1], start[-1]) + size
                        left = np.ones(len(parts), bool)
                        for a, b in zip(low, high):
                            left[a:b] = False
                        parts = [p for p, ok in zip(parts, left) if ok]
                        removed.append([{"start": int(a), "end": int(b)} for a, b in zip(low, high)])
                    else:
                        removed.append([])
                    texts_kept.append(b" ".join(parts))
                part = batch.slice(at, len(texts))
                yield pa.record_batch([
                    *(part[f"c_{c}"] for c in kept), pa.array(total, pa.int64()),
                    pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(texts_kept, pa.binary()).cast(pa.string())], names=[*kept, *new])

    return joined.mapInArrow(finish, out.schema)
