"""N-gram Jaccard join with PartEnum signatures.

Sets are put into bands of like sizes; a pair that is similar enough lies in one
band or in two neighbours, and differs in at most k features. For a band the
feature domain is cut into n1 = k // 2 + 1 parts, so that one of them holds at
most one difference, and each part into three; of the three subsets of two, one
is free of it. A signature names a subset's features: sets that are similar
enough share one. Shared signatures give candidates, which are then verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, graph, packed, words

SHINGLE = 3
PERCENT = 90
BLOCK = 2048  # sets of a group compared in one task
CHUNK_BYTES = 1 << 19  # of texts whose features are held at once
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def shingles(splitter: words.Splitter, texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all rows, row by row in ascending order, and rows + 1 offsets."""
    found = splitter.split(texts)
    at, name = splitter.windows(found, size)
    row = found.row[at]
    total = np.diff(found.first)
    for short in np.flatnonzero((total > 0) & (total < size)):  # the whole sequence is the only feature
        low, high = found.first[short], found.first[short + 1]
        whole = splitter.windows(words.Words(found.data, found.start[low:high], found.end[low:high],
                                             np.zeros(high - low, np.int64), np.array([0, high - low]),
                                             found.hash[low:high]), int(high - low))[1]
        name, row = np.append(name, whole), np.append(row, short)
    order = np.lexsort((name, row))
    name, row = name[order], row[order]
    new = np.concatenate([[True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])])[: len(name)]
    name, row = name[new], row[new]
    return name, np.searchsorted(row, np.arange(len(total) + 1))


def set_names(feature: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One name for each set; 0 for an empty one."""
    size = np.diff(first)
    names = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        sums = np.add.reduceat(words.mix(feature ^ np.uint64(0xC0FFEE)), first[:-1][full])
        names[full] = words.pair(sums, size[full].astype(np.uint64))
    return names


def bands(largest: int, percent: int) -> np.ndarray:
    """Lowest size of each band, up to beyond `largest`: sizes of a band differ by the threshold at most."""
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] * 100 // percent, lows[-1]) + 1)
    lows.append(max(lows[-1] * 100 // percent, lows[-1]) + 1)
    return np.array(lows, np.int64)


def signatures(feature: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signature names, their sets, and their numbers within the set; sets that only equal ones resemble have none.

    A set signs for its own band and for the band below, whose sets may be
    similar to it; numbers count through both.
    """
    size = np.diff(first)
    if not len(feature):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lows = bands(int(size.max()), percent)
    own = np.searchsorted(lows, size, "right") - 1
    names, sets, numbers = [], [], []
    used = np.zeros(len(size), np.int64)
    scrambled = words.mix(feature + np.uint64(0x5EED))
    row = np.repeat(np.arange(len(size)), size)
    for below in (0, 1):
        band = own - below
        top = lows[np.maximum(band, 0) + 1] - 1
        k = np.where((size > 0) & (band >= 0), top * (100 - percent) // percent, 0)
        parts = np.where(k > 0, k // 2 + 1, 0)
        offset = np.concatenate([[0], np.cumsum(parts)])
        pick = parts[row] > 0
        r = row[pick]
        if not len(r):
            continue
        part = (scrambled[pick] >> np.uint64(20)) % parts[r].astype(np.uint64)
        third = (scrambled[pick] % np.uint64(3)).astype(np.int64)
        sums = np.zeros(3 * offset[-1], np.uint64)
        np.add.at(sums, 3 * (offset[r] + part.astype(np.int64)) + third, words.mix(feature[pick]))
        sums = sums.reshape(-1, 3)
        owner = np.repeat(np.arange(len(size)), parts)
        index = np.arange(offset[-1]) - offset[owner]
        salt = words.pair(band[owner].astype(np.uint64), index.astype(np.uint64))
        for j, (x, y) in enumerate(_SUBSETS):
            names.append(words.pair(sums[:, x] + sums[:, y], salt + np.uint64(j)))
            sets.append(owner)
            numbers.append(used[owner] + 3 * index + j)
        used += 3 * parts
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(sets), np.concatenate(numbers)


def sketch(feature: np.ndarray) -> bytes:
    """Counts of a set's features by hash, at about half as many places as features (a power of two, 64 at least)."""
    places = max(64, 1 << int(len(feature)).bit_length() - 1)
    return np.minimum(np.bincount((words.mix(feature) % np.uint64(places)).astype(np.int64), minlength=places),
                      255).astype(np.uint8).tobytes()


def _compare(percent: int):
    """Pairs of sets of one group that are in different components and that size and sketch do not rule out."""
    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        names, labels, sizes, blocks = (np.array([r[c] for r in rows], np.int64)
                                        for c in ("class", "label", "n_shingles", "block"))
        places = min(len(r["sketch"]) for r in rows)
        table = np.stack([np.frombuffer(r["sketch"], np.uint8).astype(np.int16).reshape(-1, places).sum(0, np.int16)
                          for r in rows])
        step = max(1, (1 << 24) // table.size)
        for at in range(0, len(rows), step):
            part = slice(at, at + step)
            ok = (labels[part, None] < labels) & ((rows[0]["x"] == rows[0]["y"]) | (blocks[part, None] != blocks))
            both = sizes[part, None] + sizes
            ok &= np.minimum(sizes[part, None], sizes) * 100 >= np.maximum(sizes[part, None], sizes) * percent
            if not ok.any():
                continue
            apart = np.abs(table[part, None] - table).sum(2, np.int64)
            i, j = np.nonzero(ok & (apart * (100 + percent) <= both * (100 - percent)))
            yield pa.record_batch({"a": names[at + i], "b": names[j]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][c] != row[c] for c in ("name", "x", "y")):
                    yield from finish(held)
                    held = []
                held.append(row)
        if held:
            yield from finish(held)
    return run


def _sets(docs: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """`keep` columns of every row with `n_shingles` and `class`, the name of its set (null if empty)."""
    schema = docs.select(*keep, F.lit(0).cast("long").alias("n_shingles"),
                         F.lit(None).cast("long").alias("class")).schema

    def start():
        splitter = words.Splitter(lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in words.chunks(batch["_whole_text"], CHUNK_BYTES):
                feature, first = shingles(splitter, texts, size)
                n = np.diff(first)
                part = batch.slice(at, len(texts))
                yield pa.record_batch([*(part[c] for c in keep), n, pa.array(
                    set_names(feature, first).view(np.int64), mask=n == 0)], names=schema.names)
        return work

    return common.by_batch(docs.select(*keep, "_whole_text"), schema, start)


def _messages(size: int, percent: int, parts: int):
    """Message rows: shared signatures of distinct sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, held = words.Splitter(lower=True), packed.Entries(parts, "shared")
        for batch in batches:
            for _, texts in words.chunks(batch["_whole_text"], CHUNK_BYTES):
                feature, first = shingles(splitter, texts, size)
                names, sets, numbers = signatures(feature, first, percent)
                if len(names):
                    keys = set_names(feature, first).view(np.int64)
                    held.add(names, sets, numbers, np.zeros(len(keys), np.int64), keys)
                if held.count > packed.ENTRIES // 4:
                    yield from held.flush()
        yield from held.flush()
    return run


def _near(pairs: DataFrame, candidates: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (`a`, `b`) that sizes and sketches do not rule out, and so all that are similar enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch["n_a"].to_numpy() + batch["n_b"].to_numpy()
            apart = np.zeros(batch.num_rows, np.int64)
            for at, (x, y) in enumerate(zip(batch["sketch_a"], batch["sketch_b"])):
                x, y = (np.frombuffer(side.as_buffer(), np.uint8).astype(np.int32) for side in (x, y))
                places = min(len(x), len(y))
                apart[at] = np.abs(x.reshape(-1, places).sum(0) - y.reshape(-1, places).sum(0)).sum()
            good = apart * (100 + percent) <= both * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda name: candidates.select(
        F.col("class").alias(name), F.col("n_shingles").alias(f"n_{name}"), F.col("sketch").alias(f"sketch_{name}"))
    alike = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(alike)
    return common.materialize(joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(
        run, "a long, b long"))


def _texts(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """`class, text`: one text of each of the classes, given with their least ids (`class, least`)."""
    def start():
        splitter = words.Splitter(lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in words.chunks(batch["text"], CHUNK_BYTES):
                part = batch.slice(at, len(texts))
                own = set_names(*shingles(splitter, texts, size)).view(np.int64)
                yield part.filter(pa.array(own == part["class"].to_numpy()))  # an id may have several texts
        return work

    wanted = common.materialize(classes.select("class", F.col("least").alias("_id")))
    found = docs.join(wanted, "_id").select("class", F.col("_whole_text").alias("text"))
    return common.materialize(common.by_batch(found, "class long, text string", start).dropDuplicates(["class"]))


def _verified(pairs: DataFrame, candidates: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (`a`, `b`) whose sets are similar enough, compared in full.

    Most pairs share a signature by chance; sketches settle those, so that only
    texts of sets that have a likely partner are moved.
    """
    def start():
        splitter = words.Splitter(lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            good = np.zeros(batch.num_rows, bool)
            step = 64
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sides = [shingles(splitter, part[c], size) for c in ("text_a", "text_b")]
                for i in range(part.num_rows):
                    x, y = (f[o[i]: o[i + 1]] for f, o in sides)
                    common_ = len(np.intersect1d(x, y, assume_unique=True))
                    good[at + i] = 100 * common_ >= percent * (len(x) + len(y) - common_)
            yield batch.select(["a", "b"]).filter(pa.array(good))
        return work

    near = _near(pairs, candidates, percent)
    ends = near.select(F.col("a").alias("class")).union(near.select("b")).distinct()
    texts = _texts(docs, ends.join(candidates.select("class", "least"), "class"), size)
    x = texts.select(F.col("class").alias("a"), F.col("text").alias("text_a"))
    y = texts.select(F.col("class").alias("b"), F.col("text").alias("text_b"))
    joined = near.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b")
    return common.materialize(common.by_batch(joined, "a long, b long", start))


def _links(candidates: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links that connect all candidates (`class, n_shingles, least, signatures, sketch`) which links connect.

    First each set is compared with the most connected set it shares a signature
    with, then, in groups whose sets are not all connected yet, with the group's
    most connected one, last with every set of a group that it is not connected
    with and that a sketch of both does not rule out; that step works on blocks
    of a group. Comparisons left out would join what is joined already.
    """
    entries = common.materialize(candidates.select("class", F.explode("signatures").alias("name")))
    groups = entries.groupBy("name").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("class")).alias("who"))
    unlike = groups.where("n > 1").groupBy("n", "who").agg(F.min("name").alias("name"))  # one of each group of sets
    entries = common.materialize(entries.join(unlike.select("name", "n"), "name"))
    weight = entries.groupBy("class").agg(F.sum("n").alias("weight"))
    entries = common.materialize(entries.select("name", "class", "n").join(weight, "class"))
    hubs = entries.groupBy("name").agg(F.max(F.struct("weight", "class")).alias("hub"))
    to_hub = entries.join(hubs, "name").where("class <> hub.class")
    tried = to_hub.groupBy("class").agg(F.max("hub").alias("hub")).select(
        F.col("class").alias("a"), F.col("hub.class").alias("b"))
    links = _verified(tried, candidates, docs, size, percent)
    labels = entries.select("class").distinct().withColumn("label", F.col("class"))
    new = links
    for step in ("hub", "all"):
        # Labels need not be whole components: sets of one label are connected, and that is all that is left out.
        ends = new.join(labels.select(F.col("class").alias("a"), F.col("label").alias("x")), "a").join(
            labels.select(F.col("class").alias("b"), F.col("label").alias("y")), "b").where("x <> y")
        further = graph.near_labels(ends, "x", "y").select(F.col("node").alias("label"), F.col("label").alias("new"))
        labels = common.materialize(labels.join(further, "label", "left").select(
            "class", F.coalesce("new", "label").alias("label")))
        labelled = entries.join(labels, "class")
        mixed = labelled.groupBy("name").agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                             F.max(F.struct("weight", "class", "label")).alias("hub"))
        open_ = common.materialize(labelled.join(mixed.where("low <> high"), "name"))
        if step == "hub":
            pairs = open_.where("label <> hub.label").select(F.col("class").alias("a"), F.col("hub.class").alias("b"))
        else:
            sets = open_.join(candidates.select("class", "n_shingles", "sketch"), "class")
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            dealt = sets.withColumn("block", F.pmod(F.xxhash64("class"), blocks).cast("int")).withColumn(
                "other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            dealt = dealt.select("name", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"),
                                 "block", "class", "label", "n_shingles", "sketch")
            pairs = dealt.repartition("name", "x", "y").sortWithinPartitions("name", "x", "y").mapInArrow(
                _compare(percent), "a long, b long")
        new = _verified(pairs.distinct(), candidates, docs, size, percent)
        links = links.union(new)
    return links


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE,
         percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """Add `n_shingles` and `component_id` to every row's columns `keep`, or all.

    Words are split at ASCII white space, A-Z lower-cased; a set are the distinct
    shingles of `size` words, or the whole sequence of fewer words. Sets link when
    their intersection is at least `percent` of their union; `component_id` is the
    least id reachable, the own one included. Null, empty and word-less texts are
    empty sets that link with nothing. Rows of one id with different texts are
    linked each for itself; a row with a null id takes no part and has a null
    component. Columns named as the new ones are replaced.
    """
    new = ("n_shingles", "component_id")
    kept = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    whole = docs.select(*[F.col(c).alias(f"c_{c}") for c in kept], F.col(id_col).alias("_id"),
                        F.col(text_col).alias("_whole_text"))
    spark = docs.sparkSession
    named = common.materialize(_sets(whole.where("_id is not null"), size, ["_id"]))
    sizes = named.where("class is not null").groupBy("class").agg(
        F.min("_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    run = _messages(size, percent, packed.buckets(spark))
    shared = packed.settle(whole.where("_id is not null").select("_whole_text").mapInArrow(run, packed.SCHEMA),
                           "shared")
    chosen = common.materialize(shared.select(F.col("text_key").alias("class"), "places").join(sizes, "class"))
    texts = whole.select("_id", "_whole_text").join(chosen.select("class", "places", "n_shingles", F.col("least").alias(
        "_id")), "_id")

    def start():
        splitter = words.Splitter(lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, part in words.chunks(batch["_whole_text"], CHUNK_BYTES):
                feature, first = shingles(splitter, part, size)
                own = set_names(feature, first).view(np.int64)
                names, sets, numbers = signatures(feature, first, percent)
                order = np.lexsort((numbers, sets))
                names, begin = names[order], np.searchsorted(sets[order], np.arange(len(part) + 1))
                lists, sketches = [], []
                for row in range(len(part)):
                    places = packed.numbers(batch["places"][at + row].as_py())
                    mine = names[begin[row]: begin[row + 1]]
                    lists.append(mine[places].view(np.int64) if own[row] == batch["class"][at + row].as_py() else None)
                    sketches.append(sketch(feature[first[row]: first[row + 1]]))
                piece = batch.slice(at, len(part))
                yield pa.record_batch([piece["class"], piece["n_shingles"], piece["_id"],
                                       pa.array(lists, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                                      names=["class", "n_shingles", "least", "signatures", "sketch"])
        return work

    schema = texts.select("class", "n_shingles", F.col("_id").alias("least"), F.lit(None).cast("array<long>").alias(
        "signatures"), F.lit(None).cast("binary").alias("sketch")).schema
    candidates = common.by_batch(texts.select("class", "n_shingles", "_id", "_whole_text", "places"), schema, start)
    candidates = common.materialize(candidates.where("signatures is not null").dropDuplicates(["class"]))
    links = _links(candidates, whole, size, percent)
    ids = sizes.select("class", "least")
    ends = links.join(ids.select(F.col("class").alias("a"), F.col("least").alias("x")), "a").join(
        ids.select(F.col("class").alias("b"), F.col("least").alias("y")), "b")
    labels = graph.components(ends, "x", "y")
    classes = ids.join(labels, ids["least"] == labels["node"], "left").select(
        F.col("class"), F.coalesce("label", "least").alias("label"))
    if kept == [id_col]:
        rows = named.select(F.col("_id").alias(f"c_{id_col}"), "_id", "n_shingles", "class").unionByName(
            _sets(whole.where("_id is null"), size, [f"c_{id_col}", "_id"]))
    else:
        rows = _sets(whole, size, [*[f"c_{c}" for c in kept], "_id"])
    joined = rows.join(classes, "class", "left")
    label = F.when(F.col("_id").isNotNull(), F.coalesce("label", "_id"))
    return joined.select(*[F.col(f"c_{c}").alias(c) for c in kept], "n_shingles", label.alias("component_id"))
