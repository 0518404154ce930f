"""Benchmark decontamination with a distributed positional inverted index.

The index is cut by document: every chunk of training texts stores, for each
word that the benchmark uses, the sorted list of its positions. A window of an
item is looked up by its rarest word in the chunk; the lists of its other words,
each moved back by the word's offset, are intersected in order of rarity. The
same lists answer proximity: each word within `slop` places of where the phrase
would have it. Item windows are the query set; it reaches the chunks in blocks
of bounded size, one pass for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, words

WINDOW = 10
#: Bound of what is broadcast at once, in windows; about 100 bytes each.
BLOCK_WINDOWS = 200_000


@dataclass
class Block:
    """Windows as rows of word numbers (-1 behind a shorter one), their lengths, and the items of each window."""
    terms: np.ndarray
    windows: np.ndarray
    size: np.ndarray
    first_item: np.ndarray
    items: list[str]


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: `words` (hashes), `items` (ids as text, null ids left out).

    A window is `size` consecutive words, or all words of a shorter item; null
    and word-less items have none.
    """
    def start():
        splitter = words.Splitter("alnum", lower=True)

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at, texts in words.chunks(batch["text"]):
                found = splitter.split(texts)
                rows, lists = [], []
                for row in range(found.rows()):
                    low, high = found.first[row], found.first[row + 1]
                    names = found.hash[low:high].view(np.int64)
                    for i in range(max(1, high - low - size + 1) if high > low else 0):
                        rows.append(at + row)
                        lists.append(names[i: i + size])
                yield pa.record_batch({"item": batch["item"].take(pa.array(rows, pa.int64())),
                                       "words": pa.array(lists, pa.list_(pa.int64()))})
        return work

    texts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    windows = common.by_batch(texts, "item string, words array<long>", start)
    return windows.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _blocks(windows: DataFrame, most: int) -> Iterator[Block]:
    windows = common.materialize(windows.withColumn("block", F.xxhash64("words")))
    parts = -(-2 * windows.count() // most)  # hashed parts of about half of the bound
    for part in range(parts):
        rows = windows.where(F.pmod("block", F.lit(parts)) == part).select("words", "items").collect()
        if len(rows) > most:
            raise ValueError(f"a block of {len(rows)} windows, more than {most}")
        rows.sort(key=lambda r: r.words)
        lists = [np.array(r.words, np.int64).view(np.uint64) for r in rows]
        if not lists:
            continue
        terms = np.unique(np.concatenate(lists))
        table = np.full((len(lists), max(map(len, lists))), -1, np.int64)
        for i, names in enumerate(lists):
            table[i, : len(names)] = np.searchsorted(terms, names)
        yield Block(terms, table, np.array(list(map(len, lists))),
                    np.concatenate([[0], np.cumsum([len(r["items"]) for r in rows])]),
                    [item for r in rows for item in r["items"]])


def search(found: words.Words, block: Block, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, window and first position (in the chunk) of every match of a block's windows in a chunk of texts."""
    none = (np.zeros(0, np.int64),) * 3
    number, known = words.lookup(block.terms, found.hash)
    place = np.flatnonzero(known)
    if not len(place):
        return none
    number = number[place]
    place = place[np.argsort(number, kind="stable")]  # postings: positions by word, ascending
    count = np.bincount(number, minlength=len(block.terms))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = len(found.hash) + 1
    key = np.repeat(np.arange(len(count)), count) * total + place
    rarity = np.where(block.windows >= 0, count[block.windows], np.iinfo(np.int64).max)
    live = np.flatnonzero(rarity.min(1) > 0)
    if not len(live):
        return none
    order = np.argsort(rarity[live], axis=1, kind="stable")  # offsets of each window, rarest word first
    rare = block.windows[live, order[:, 0]]
    which = np.repeat(np.arange(len(live)), count[rare])
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count[rare]) - count[rare], count[rare])
    anchor = place[begin[rare][which] + inside]
    row = found.row[anchor]
    start = anchor - order[which, 0]
    if slop:
        shift = np.arange(-slop, slop + 1)
        which, row = np.repeat(which, len(shift)), np.repeat(row, len(shift))
        start = np.repeat(start, len(shift)) + np.tile(shift, len(start))
    for j in range(order.shape[1]):
        used = j < block.size[live[which]]
        offset = order[which, min(j, order.shape[1] - 1)]
        term = block.windows[live[which], offset]
        low = np.maximum(start + offset - slop, found.first[row])
        high = np.minimum(start + offset + slop, found.first[row + 1] - 1)
        at = np.minimum(np.searchsorted(key, term * total + low), len(key) - 1)
        keep = ~used | ((low <= high) & (key[at] >= term * total + low) & (key[at] <= term * total + high))
        which, row, start = which[keep], row[keep], start[keep]
        if not len(which):
            return none
    return row, live[which], start


def _spans(found: words.Words, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Merged [start, end) word positions in each text."""
    start, end = np.maximum(start, found.first[row]), np.minimum(end, found.first[row + 1])
    edge = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, end, -1)
    inside = np.concatenate([[False], np.cumsum(edge)[:-1] > 0])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    cut = np.intersect1d(found.first[:-1], np.flatnonzero(inside[1:]))  # a span ends with its text
    begins = np.union1d(change[inside[1:][change]], cut)
    ends = np.union1d(change[~inside[1:][change]], cut[inside[cut]])
    if len(begins) > len(ends):
        ends = np.append(ends, len(found.hash))
    rows = found.row[begins] if len(begins) else np.zeros(0, np.int64)
    first = np.searchsorted(rows, np.arange(found.rows() + 1))
    value = pa.StructArray.from_arrays([pa.array(begins - found.first[rows]), pa.array(ends - found.first[rows])],
                                       ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), value)


def find(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id",
         item_text_col: str = "text", size: int = WINDOW, slop: int = 0, keep: list[str] | None = None,
         block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Add `n_words`, `spans` and `items` to every row's columns `keep`, or all.

    `spans` are the merged word positions [start, end) inside any match, `items`
    the sorted ids (as text) of items with a match. With `slop` 0 a match is the
    exact phrase; otherwise the window's words lie each within `slop` places of
    one common alignment, and the span is widened by it. Null and empty texts
    have no words; without items or windows nothing matches; repeated rows each
    get their own result; columns named as the new ones are replaced.
    """
    new = ("n_words", "spans", "items")
    kept = [c for c in docs.columns if c not in new and (keep is None or c in keep)]
    spans = "array<struct<start:bigint,end:bigint>>"
    whole = common.fresh(docs, "_whole_text")
    docs = docs.select(*kept, F.col(text_col).alias(whole), F.lit(0).cast("bigint").alias("n_words"),
                       F.array().cast(spans).alias("spans"), F.array().cast("array<string>").alias("items"))
    names = docs.columns
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast(vars(b)) for b in
              _blocks(item_windows(items, id_col, item_text_col, size), block_windows)]
    if not shared:  # only the words are counted
        shared = [spark.sparkContext.broadcast(vars(Block(
            np.zeros(0, np.uint64), np.zeros((0, 1), np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64), [])))]
    for one in shared:
        def start(one=one):
            splitter, block = words.Splitter("alnum", lower=True), Block(**one.value)

            def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                for at, texts in words.chunks(batch[whole]):
                    found = splitter.split(texts)
                    part = batch.slice(at, len(texts))
                    row, window, begin = search(found, block, slop)
                    end = begin + block.size[window] + slop
                    begin = begin - slop
                    hit = {r: set(part["items"][int(r)].as_py()) for r in np.unique(row)}
                    for r, w in set(zip(row.tolist(), window.tolist())):
                        hit[r].update(block.items[block.first_item[w]: block.first_item[w + 1]])
                    known = part["spans"]
                    if pa.compute.sum(pa.compute.list_value_length(known)).as_py():  # of blocks before
                        flat, old = known.flatten(), np.repeat(
                            np.arange(len(part)), pa.compute.list_value_length(known).to_numpy(zero_copy_only=False))
                        row = np.concatenate([row, old])
                        begin = np.concatenate([begin, found.first[old] + flat.field("start").to_numpy()])
                        end = np.concatenate([end, found.first[old] + flat.field("end").to_numpy()])
                    listed = [sorted(hit[r], key=lambda s: s.encode()) if r in hit else part["items"][r].as_py()
                              for r in range(len(part))]
                    yield pa.record_batch([
                        *(part[c] for c in kept), part[whole], np.diff(found.first),
                        _spans(found, row, begin, end), pa.array(listed, pa.list_(pa.string()))], names=names)
            return work

        docs = common.by_batch(docs, docs.schema, start)
    return docs.drop(whole)
