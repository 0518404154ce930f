"""Line deduplication with a segment-partition edit join.

A line is cut into threshold + 1 segments; of a line within the threshold at
least one segment is a substring, near the same place. Each line stores its
segments under its length and looks up its substrings under every length up to
the threshold below its own. What meets is compared by character counts, then
verified with a banded bit-parallel edit distance. Lines too short for segments
that tell anything, of up to twice the threshold, are compared for equality only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, packed, words

EDITS = 2
#: Default of the length below which `dedup` leaves lines alone; the query and the pipeline's stage set no such limit.
LEAST_CHARS = 20
_STEP = 1 << 20  # pairs of a bucket compared at once


class Codes:
    """Lines as one array of code points, with prefix sums for the names of substrings."""

    def __init__(self, lines: pa.Array, splitter: words.Splitter):
        texts = lines.to_pylist()
        self.size = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.sums = splitter._sums(self.codes + np.uint64(1))
        self.inverse = splitter.inverse

    def names(self, line: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        at = self.first[line] + start
        return words.mix((self.sums[at + length] - self.sums[at]) * self.inverse[at])

    def counts(self) -> np.ndarray:
        """Lines x 2 words of sixteen 4-bit counters: how often the code points of each of 32 classes occur."""
        line = np.repeat(np.arange(len(self.size)), self.size)
        kind = (words.mix(self.codes) & np.uint64(31)).astype(np.int64)
        count = np.bincount(line * 32 + kind, minlength=32 * len(self.size)).reshape(-1, 2, 16).astype(np.uint64)
        return ((count & np.uint64(15)) << (np.uint64(4) * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64)


def counters_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number of steps between two rows of counters; an edit makes two at most."""
    total = np.zeros(len(a), np.int64)
    for word in range(a.shape[1]):
        for shift in range(0, 64, 4):
            gap = ((a[:, word] >> np.uint64(shift)) - (b[:, word] >> np.uint64(shift))) & np.uint64(15)
            total += np.minimum(gap, np.uint64(16) - gap).astype(np.int64)
    return total


def keys(lines: Codes, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names under which lines meet, the line of each, and whether it is one of its own segments."""
    parts = edits + 1
    every = np.arange(len(lines.size))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for shorter in range(edits + 1):
        target = lines.size - shorter
        for i in range(parts):
            base, extra = target // parts, target % parts
            plain = parts - extra  # the last segments are one longer
            length = base + (i >= plain)
            start = i * base + np.maximum(0, i - plain)
            low, high = max(-i, shorter - (edits - i)), min(i, shorter + edits - i)
            for shift in range(low, high + 1):
                at = start + shift
                ok = (length > 0) & (at >= 0) & (at + length <= lines.size)
                name = words.pair(lines.names(every[ok], at[ok], length[ok]),
                                  (target[ok] * parts + i).astype(np.uint64))
                own = np.full(len(name), shorter == 0 and shift == 0)
                found.append((name, every[ok], own))
    return tuple(map(np.concatenate, zip(*found)))


def within(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray, edits: int) -> np.ndarray:
    """Whether rows of code points are within `edits`; `a` is not longer than `b` and longer than `edits`.

    Bit-parallel over a band along the diagonal: bit 63 is the lowest row of the
    band, `edits` below the diagonal, and is followed down until the last row of
    `a`, then along it. All pairs step through the columns together.
    """
    one, top = np.uint64(1), np.uint64(63)
    n = len(size_a)
    vp = np.full(n, (~np.uint64(0)) << np.uint64(64 - edits - 1), np.uint64)
    vn = np.zeros(n, np.uint64)
    distance = np.full(n, edits, np.int64)
    mask = np.full(n, np.uint64(1) << np.uint64(62), np.uint64)
    width = a.shape[1]
    for j in range(int(size_b.max(initial=0))):
        match = np.zeros(n, np.uint64)
        for d in range(2 * edits + 1):
            row = j - edits + d
            if 0 <= row < width:
                match |= ((a[:, row] == b[:, j]) & (row < size_a)).astype(np.uint64) << np.uint64(63 - 2 * edits + d)
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        inside = j < size_b
        down = inside & (j < size_a - edits)
        distance += down & ((d0 >> top) == 0)
        along = inside & ~down
        distance += along & ((hp & mask) != 0)
        distance -= along & ((hn & mask) != 0)
        mask = np.where(along, mask >> one, mask)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return distance <= edits


def near(left: list[str], right: list[str], edits: int) -> np.ndarray:
    """Whether each pair of texts is within `edits`, in groups of like length."""
    swap = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(left, right)]
    size = np.array([(len(x), len(y)) for x, y in swap], np.int64).reshape(-1, 2)
    result = np.zeros(len(swap), bool)
    order = np.argsort(size[:, 1], kind="stable")
    for at in range(0, len(order), 1024):
        pick = order[at: at + 1024]
        table = []
        for side in (0, 1):
            grid = np.zeros((len(pick), int(size[pick, side].max())), np.uint32)
            for i, p in enumerate(pick):
                grid[i, : size[p, side]] = np.frombuffer(swap[p][side].encode("utf-32-le", "surrogatepass"), "<u4")
            table.append(grid)
        result[pick] = within(table[0], size[pick, 0], table[1], size[pick, 1], edits)
    return result & (size[:, 1] - size[:, 0] <= edits)


def _messages(edits: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = words.Splitter()
        held: dict[str, list[np.ndarray]] = {"name": [], "line": [], "own": [], "lines": [], "counts": []}
        known: set[int] = set()

        def flush():
            if not held["name"]:
                return
            name, own = np.concatenate(held["name"]), np.concatenate(held["own"])
            offset = np.cumsum([0, *map(len, held["lines"])])
            line = np.concatenate([x + o for x, o in zip(held["line"], offset)])
            ids, counts = np.concatenate(held["lines"]), np.concatenate(held["counts"])
            bucket = (name % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            name, own, line, bucket = name[order], own[order], line[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            batch = packed.Batch()
            for low, high in zip(cut, np.append(cut[1:], len(bucket))):
                used, short = np.unique(line[low:high], return_inverse=True)
                batch.add(kind=0, bucket=int(bucket[low]), names=name[low:high].tobytes(),
                          docs=np.concatenate([ids[used].view(np.uint64)[:, None], counts[used]], 1).tobytes(),
                          places=short.astype(np.uint32).tobytes(), flags=np.packbits(own[low:high]).tobytes())
            for values in held.values():
                values.clear()
            known.clear()
            yield batch.done()

        for batch in batches:
            for at, lines in words.chunks(batch["line"]):
                ids = batch["name"].to_numpy()[at: at + len(lines)]
                _, first = np.unique(ids, return_index=True)
                first = np.array([i for i in first.tolist() if int(ids[i]) not in known], np.int64)
                if not len(first):
                    continue
                known.update(ids[first].tolist())
                codes = Codes(lines.take(pa.array(first)), splitter)
                name, line, own = keys(codes, edits)
                for field, values in zip(held, (name, line, own, ids[first], codes.counts())):
                    held[field].append(values)
                if sum(map(len, held["name"])) > packed.ENTRIES:
                    yield from flush()
        yield from flush()
    return run


def _meetings(edits: int):
    """Pairs of lines (`a` < `b`) that meet under a name and whose character counts allow it."""
    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        name = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows])
        tables = [np.frombuffer(r["docs"], np.uint64).reshape(-1, 3) for r in rows]
        offset = np.cumsum([0, *map(len, tables)])
        short = [np.frombuffer(r["places"], np.uint32).astype(np.int64) for r in rows]
        own = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: len(s)] for r, s in
                              zip(rows, short)]).astype(bool)
        line = np.concatenate([s + o for s, o in zip(short, offset)])
        table = np.concatenate(tables)
        ids, counts = table[:, 0].view(np.int64), table[:, 1:]
        order = np.lexsort((~own, name))
        name, line, own = name[order], line[order], own[order]
        group = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        stored = np.add.reduceat(own.astype(np.int64), group)  # stored segments come first in their group
        number = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(name))))
        many = stored[number]
        done = np.concatenate([[0], np.cumsum(many)])
        at = 0
        while at < len(name):
            to = max(at + 1, int(np.searchsorted(done, done[at] + _STEP, "right")) - 1)
            size = many[at:to]
            left = np.repeat(np.arange(at, to), size)
            right = group[number[left]] + np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
            x, y = line[left], line[right]
            differ = ids[x] != ids[y]
            x, y = x[differ], y[differ]
            close = counters_apart(counts[x], counts[y]) <= 2 * edits
            x, y = ids[x[close]], ids[y[close]]
            if len(x):
                pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.record_batch({"a": pairs[0], "b": pairs[1]})
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)
    return run


def _kept(kept: list[str], new: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in words.chunks(batch["_text"]):
                part = batch.slice(at, len(texts))
                total, left, gone = [], [], []
                for text, numbers in zip(texts.to_pylist(), part["gone"].to_pylist()):
                    lines = text.split("\n") if text is not None else []
                    out = sorted(set(numbers or ()))
                    drop = set(out)
                    total.append(len(lines))
                    gone.append(out)
                    left.append(None if text is None else
                                "\n".join(line for i, line in enumerate(lines) if i not in drop))
                yield pa.record_batch([*(part[f"c_{c}"] for c in kept), pa.array(total, pa.int64()),
                                       pa.array(gone, pa.list_(pa.int64())), pa.array(left, pa.string())],
                                      names=[*kept, *new])
    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
          least_chars: int | None = LEAST_CHARS, keep: list[str] | None = None) -> DataFrame:
    """Add `n_lines`, `removed_lines` (numbers from 0) and `kept_text` to every row's columns `keep`, or all.

    Lines end at line feeds; distances count code points. A line goes if a line
    within `edits` of it, or an equal one, stands earlier: in a document of
    smaller id, or further up in the same one; lines are judged on the input.
    Lines of white space alone stay and remove none, also lines of fewer than
    `least_chars` code points if that is not None. Lines of up to twice `edits`
    code points go only if an equal one stands earlier, and remove no others. A
    null text has no lines and stays null. Rows that repeat id and text are one
    document; rows of one id with different texts follow each other in the order
    of their hash; null ids come last. Columns named as the new ones are
    replaced.
    """
    new = ("n_lines", "removed_lines", "kept_text")
    kept = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = docs.select(*[F.col(c).alias(f"c_{c}") for c in kept], F.col(text_col).alias("_text"),
                        F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_id"),
                        F.xxhash64(text_col).alias("_key"))
    lines = whole.select("_id", "_key", F.posexplode(F.split("_text", "\n")).alias("at", "line")).where(
        F.col("line").rlike(r"\S") & (F.char_length("line") >= (least_chars or 0))).withColumn(
        "name", F.xxhash64("line"))
    seen = common.materialize(lines.select("_id", "_key", F.col("at").cast("long").alias("at"), "name"))
    least = seen.groupBy("name").agg(F.min(F.struct("_id", "_key", "at")).alias("first"))
    longer = lines.where(F.char_length("line") > 2 * edits).select("name", "line")
    messages = longer.mapInArrow(_messages(edits, packed.buckets(spark)), packed.SCHEMA)
    met = messages.select("bucket", "names", "docs", "places", "flags").repartition(parts, "bucket")
    pairs = common.materialize(met.sortWithinPartitions("bucket").mapInArrow(
        _meetings(edits), "a long, b long").distinct())

    # Texts of the lines to verify, each from the document where it stands first.
    dealt = whole.repartition(parts, "_id", "_key")
    wanted = pairs.select(F.col("a").alias("name")).union(pairs.select("b")).distinct().join(least, "name")
    wanted = wanted.select(F.col("first._id").alias("id"), F.col("first._key").alias("key"),
                           F.struct(F.col("first.at").alias("at"), "name").alias("want"))
    by_doc = wanted.groupBy("id", "key").agg(F.collect_list("want").alias("wants"))
    here = [F.col("_id") == F.col("id"), F.col("_key") == F.col("key")]
    texts = dealt.join(by_doc, here).select(F.split("_text", "\n").alias("_lines"), "wants").select(
        F.inline(F.transform("wants", lambda w: F.struct(
            w["name"].alias("name"), F.get("_lines", w["at"].cast("int")).alias("line")))))
    texts = texts.dropDuplicates(["name"])
    first = least.select("name", "first")
    oriented = pairs.join(first.select(F.col("name").alias("a"), F.col("first").alias("first_a")), "a").join(
        first.select(F.col("name").alias("b"), F.col("first").alias("first_b")), "b")
    earlier = F.col("first_a") < F.col("first_b")
    oriented = oriented.select(F.when(earlier, F.col("b")).otherwise(F.col("a")).alias("later"),
                               F.when(earlier, F.col("a")).otherwise(F.col("b")).alias("earlier"))
    full = oriented.join(texts.select(F.col("name").alias("later"), F.col("line").alias("x")), "later").join(
        texts.select(F.col("name").alias("earlier"), F.col("line").alias("y")), "earlier")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = near(batch["x"].to_pylist(), batch["y"].to_pylist(), edits)
            yield batch.select(["later"]).filter(pa.array(ok))

    gone = full.select("later", "x", "y").mapInArrow(verify, "later long").distinct()
    gone = common.materialize(gone.withColumnRenamed("later", "name"))
    repeated = seen.join(first, "name").where(F.struct("_id", "_key", "at") != F.col("first"))
    all_gone = repeated.select("_id", "_key", "at").union(seen.join(gone, "name", "left_semi").select("_id", "_key", "at"))
    by_doc = all_gone.groupBy(F.col("_id").alias("id"), F.col("_key").alias("key")).agg(
        F.collect_set("at").alias("gone"))
    joined = dealt.join(by_doc, here, "left").select(*[f"c_{c}" for c in kept], "_text", "gone")
    schema = joined.select(*[F.col(f"c_{c}").alias(c) for c in kept], F.lit(0).cast("long").alias("n_lines"),
                           F.col("gone").alias("removed_lines"), F.col("_text").alias("kept_text")).schema
    return joined.mapInArrow(_kept(kept, new), schema)
