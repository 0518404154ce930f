"""Language-model scoring with a hierarchical Pitman-Yor model.

A context restaurant seats the words that follow one previous word; all share
the root restaurant as parent, whose base is uniform. Contexts go by
`CONTEXT_BITS` bits of the word's hash, enough to tell all words apart.
Customers are all training tokens. Tokens are dealt by their word, so a bucket
holds a word's customers in every context; the seating of a dish, given all
others, is drawn anew in each sweep and kept by a Metropolis step. Between
sweeps over all buckets the contexts' totals are added up: each bucket tells the
sums of its contexts to their homes, which tell every bucket the totals of the
contexts that it has. No task holds the totals of all contexts, and buckets are
stored by number, so that totals come to them and they do not move. Scores
average the predictive probabilities of several seatings.

A word of very many tokens is dealt as several, by context, so that no bucket
grows with it. These buckets are told its customers in all and its tables as the
sweep before left them, as they are told contexts' totals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from memlake.llm import common, packed, words
from memlake.session import checkpoint_dir

CONTEXT_BITS = 40
DISCOUNT, STRENGTH = 0.8, 20.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 20.0
BURN, SAMPLES = 1, 2
CHUNK_BYTES = 1 << 19  # of texts split at once
SENT_TOKENS = 600_000  # of a task before they are sorted and sent
PIECE = 75_000  # entries of a bucket worked on at once
SPLIT = 150_000  # tokens of a word, about, that go to one bucket
_SAMPLED = 16  # a text of so many is looked at for words to split
QUARTERS = 8  # rows of a bucket, by the upper bits of the words' names
SUMS = 750_000  # of documents that a task holds before they are sent
NEW_SUMS = 200_000  # of them, not yet added up
_ONE_BY_ONE = 64  # customers of a dish seated singly; later ones in blocks of a sixteenth of those before
_START, _END = np.uint64(0x0BE61717), np.uint64(0xE2D0FDEC)
_NO_ID = -(2**63)
#: A part of a bucket's words, or with a `bucket` below 0 the documents of one message.
CELLS = ("bucket int, quarter int, flush long, words binary, entries binary, contexts binary, context binary, doc binary, "
         "n binary, held binary, flushes binary, whole binary")
#: Sums or totals of a bucket's contexts that have one home, by quarter: customers and tables. The first row of a bucket has its own sums too.
_SHARES = "home int, bucket int, quarter array<int>, names array<binary>, a array<binary>, b array<binary>, tokens long, vocabulary long, root_customers long, root_tables long, whole binary"
_SCALARS = ("tokens", "vocabulary", "root_customers", "root_tables")


@dataclass
class Shared:
    """Of words that several buckets have, in the order of `Split.names`: customers, and customers and tables in the root."""
    count: np.ndarray
    root: np.ndarray
    root_tables: np.ndarray
    seated: bool  # or there is one table for each context so far


@dataclass
class Split:
    """Words dealt as several: their names in order, how many each is, the names of all of those in order and whose they are."""
    names: np.ndarray
    pieces: np.ndarray
    parts: np.ndarray
    of: np.ndarray

    @staticmethod
    def plan(names: np.ndarray, count: np.ndarray) -> Split:
        order = np.argsort(names)
        names, pieces = names[order], -(-count[order] // SPLIT)
        of = np.repeat(np.arange(len(names)), pieces)
        parts = words.pair(names[of], (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)).astype(np.uint64))
        order = np.argsort(parts)
        return Split(names, pieces, parts[order], of[order])

    def deal(self, name: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Names of tokens, those of split words by context."""
        if not len(self.names):
            return name
        at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
        hit = np.flatnonzero(self.names[at] == name)
        name = name.copy()
        name[hit] = words.pair(name[hit], words.mix(context[hit]) % self.pieces[at[hit]].astype(np.uint64))
        return name

    def whole(self, name: np.ndarray) -> np.ndarray:
        """For each name that was dealt the number of its split word, counted from one, or zero."""
        if not len(self.parts):
            return np.zeros(len(name), np.int64)
        at = np.minimum(np.searchsorted(self.parts, name), len(self.parts) - 1)
        return np.where(self.parts[at] == name, self.of[at] + 1, 0)


NONE = Split(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


@dataclass
class Totals:
    """Of all training tokens: their number, distinct words, customers and tables of a bucket's contexts and of the root."""
    tokens: int
    vocabulary: int
    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int
    shared: Shared | None = None


def tokens(splitter: words.Splitter, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and row of every token; each text ends with one end token."""
    found = splitter.split(texts)
    rows = found.rows()
    name = np.empty(len(found.hash) + rows, np.uint64)
    row = np.empty(len(name), np.int64)
    at = np.arange(len(found.hash)) + found.row
    end = found.first[1:] + np.arange(rows)
    name[at], name[end] = found.hash, _END
    row[at], row[end] = found.row, np.arange(rows)
    before = np.concatenate([[_START], name[:-1]])[: len(name)]
    before[found.first[:-1] + np.arange(rows)] = _START
    return name, words.mix(before) >> np.uint64(64 - CONTEXT_BITS), row


def _narrow(values: np.ndarray) -> bytes:
    most = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _pack(names: np.ndarray) -> bytes:
    """Sorted names of contexts: steps from each to the next, byte by byte, the upper ones mostly zero."""
    steps = np.diff(names, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    size = CONTEXT_BITS // 8
    steps = np.zeros((len(data) // size, 8), np.uint8)
    steps[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64)


def _wide(data: bytes, n: int, at: int = 0, size: int | None = None) -> np.ndarray:
    """`n` values written by `_narrow`, in `size` bytes from `at` on."""
    size = len(data) - at if size is None else size
    return np.frombuffer(data, {0: np.uint8, 1: np.uint8, 2: np.uint16, 4: np.uint32}[size // max(n, 1)], n, at)


def _numbers(spark, parts: int) -> np.ndarray:
    """Numbers of buckets, one for each partition that rows are dealt to, so that no task has several buckets."""
    some = spark.range(64 * parts).select(F.col("id").cast("int").alias("bucket"))
    own = some.groupBy(F.pmod(F.hash("bucket"), F.lit(parts))).agg(F.min("bucket")).collect()
    left = iter(range(64 * parts, 65 * parts))  # for a partition that none of them falls to
    return np.array([number for _, number in own] + [next(left) for _ in range(parts - len(own))])


def _frequent(rows: DataFrame) -> Split:
    """Words of more than `SPLIT` tokens, as a sample of the texts has them; where it errs, only buckets are more or less even."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = words.Splitter(lower=True)
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for _, texts in words.chunks(batch["_text"], CHUNK_BYTES):
                new, n = np.unique(tokens(splitter, texts)[0], return_counts=True)
                found, at = np.unique(np.concatenate([names, new]), return_inverse=True)
                names, counts = found, np.bincount(at, np.concatenate([counts, n])).astype(np.int64)
        often = counts >= 8
        yield pa.record_batch({"name": names[often].view(np.int64), "n": counts[often]})

    some = rows.where(F.pmod(F.xxhash64("_id", "_key"), F.lit(_SAMPLED)) == 0).select("_text").mapInArrow(count, "name long, n long")
    # At most one row for each `SPLIT` tokens goes to the driver.
    found = some.groupBy("name").agg(F.sum("n").alias("n")).where(F.col("n") * _SAMPLED > SPLIT).collect()
    return Split.plan(np.array([r.name for r in found], np.int64).view(np.uint64), np.array([r.n * _SAMPLED for r in found], np.int64))


def _messages(parts: int, numbers: np.ndarray | None = None, split: Split = NONE):
    """Messages of a task, in flushes: to each bucket, and one with the flush's documents.

    Buckets know documents by flush and position. A flush is named by its rows
    and their order, so that messages of tasks that read other rows in a second
    attempt do not mix; `_join` misses them.
    """
    numbers = np.arange(parts) if numbers is None else numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = words.Splitter(lower=True)
        held: list[list[np.ndarray]] = [[], [], [], []]
        docs = count = flushes = 0

        def flush():
            nonlocal docs, count, flushes
            if not count:
                return
            name, context, doc = (np.concatenate(x) for x in held[:3])
            known = np.concatenate(held[3], 1)
            for values in held:
                values.clear()
            said = np.array([TaskContext.get().partitionId(), flushes]).tobytes() + known.tobytes()
            key = int.from_bytes(hashlib.blake2b(said, digest_size=8).digest(), "little", signed=True)
            batch = packed.Batch()
            batch.add(kind=1, bucket=-1 - key % parts, id=key, docs=known[[0, 2]].tobytes(),
                      places=np.bincount(doc, minlength=docs).astype(np.int64).tobytes())
            own = np.packbits(known[2].astype(bool)).tobytes()
            name = split.deal(name, context)
            contexts, context = np.unique(context, return_inverse=True)
            place = context.astype(np.uint64) << np.uint64(32) | doc.astype(np.uint64)
            order = np.lexsort((place, name))
            name, place = name[order], place[order]
            new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (place[1:] != place[:-1])]))
            n = np.diff(np.append(new, len(name)))
            name, place = name[new], place[new]
            bucket = (name % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            name, place, n, bucket = name[order], place[order], n[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            for low, high in zip(cut, np.append(cut[1:], len(bucket))):
                part = place[low:high]
                names, entries = words.distinct(name[low:high])
                used, context = np.unique(part >> np.uint64(32), return_inverse=True)
                context, doc = _narrow(context), _narrow(part & np.uint64(0xFFFFFFFF))
                batch.add(kind=0, bucket=int(numbers[bucket[low]]), id=key,
                          text_key=docs << 16 | len(context) // len(part) << 8 | len(doc) // len(part),
                          names=names.tobytes() + _pack(contexts[used]), flags=entries.astype(np.uint32).tobytes(), docs=own,
                          places=context + doc + _narrow(n[low:high]))
            docs = count = 0
            flushes += 1
            yield from packed.slices(batch.done())

        for batch in batches:
            known = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("_id", "_key", "_held")])
            for at, texts in words.chunks(batch["_text"], CHUNK_BYTES):
                name, context, row = tokens(splitter, texts)
                for values, one in zip(held, (name, context, row + docs, known[:, at: at + len(texts)])):
                    values.append(one)
                docs, count = docs + len(texts), count + len(name)
                if count > SENT_TOKENS:
                    yield from flush()
        yield from flush()
    return run


def _gather(split: Split = NONE):
    """Rows for each bucket, the entries of each in the order of word and context; rows of documents as they come."""
    types = {"bucket": pa.int32(), "quarter": pa.int32(), "flush": pa.int64()}

    def cell(**values) -> pa.RecordBatch:
        names = [field.split(" ")[0] for field in CELLS.split(", ")]
        return pa.record_batch([pa.array([values.get(n)], types.get(n, pa.binary())) for n in names], names=names)

    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        docs = [r["text_key"] >> 16 for r in rows]
        offset = np.cumsum([0, *docs])
        held = np.concatenate([np.unpackbits(np.frombuffer(r["docs"], np.uint8))[:k] for r, k in zip(rows, docs)])
        held, flushes = np.packbits(held).tobytes(), np.array([[r["id"] for r in rows], docs], np.int64).tobytes()
        known = [_unpack(r["names"][2 * len(r["flags"]):]) for r in rows]  # eight bytes a word, then contexts
        contexts = np.unique(np.concatenate(known))
        known = [np.searchsorted(contexts, k).astype(np.uint32) for k in known]
        for quarter in range(QUARTERS):
            found: list[list[np.ndarray]] = [[], [], [], [], []]
            for r, o, k in zip(rows, offset, known):
                entries = np.frombuffer(r["flags"], np.uint32)
                names = np.frombuffer(r["names"], np.uint64, len(entries))
                ends = np.concatenate([[0], np.cumsum(entries, dtype=np.int64)])
                size, near, width = int(ends[-1]), r["text_key"] >> 8 & 255, r["text_key"] & 255
                own = np.flatnonzero((names >> np.uint64(32)) * np.uint64(QUARTERS) >> np.uint64(32) == quarter)
                if not len(own):
                    continue
                own = slice(own[0], own[-1] + 1)  # names are in order
                part = slice(ends[own.start], ends[own.stop])
                doc = _wide(r["places"], size, near * size, width * size)[part].astype(np.uint32) + np.uint32(o)
                for values, one in zip(found, (names[own], entries[own], k[_wide(r["places"], size, 0, near * size)[part]],
                                               doc, _wide(r["places"], size, (near + width) * size)[part])):
                    values.append(one)
            if not found[0]:
                continue
            names, entries, context, doc, n = map(np.concatenate, found)
            del found
            vocabulary, number = np.unique(names, return_inverse=True)
            number = np.repeat(number, entries)
            used, context = np.unique(context, return_inverse=True)
            order = np.argsort(number << 32 | context, kind="stable")
            yield cell(bucket=rows[0]["bucket"], quarter=quarter, words=vocabulary.tobytes(),
                       entries=np.bincount(number, minlength=len(vocabulary)).astype(np.uint32).tobytes(),
                       contexts=_pack(contexts[used]), context=_narrow(context[order]), doc=doc[order].tobytes(), n=_narrow(n[order]),
                       held=held, flushes=flushes, whole=_narrow(whole) if (whole := split.whole(vocabulary)).any() else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] < 0:
                    yield cell(bucket=row["bucket"], flush=row["id"], doc=row["docs"], n=row["places"])
                    continue
                if met and met[0]["bucket"] != row["bucket"]:
                    yield from finish(met)
                    met = []
                met.append(row)
        if met:
            yield from finish(met)
    return run


class Bucket:
    """Tokens of some words: entries (word, context, document, n), grouped into types (word, context)."""
    whole: np.ndarray | None = None  # for each word the number of the split word that it is a part of, or -1

    def __init__(self, seed: list[int], word: np.ndarray, n_words: int, context: np.ndarray, doc: np.ndarray,
                 n: np.ndarray, held: np.ndarray):
        self.seed, self.n_words, self.doc, self.n = seed, n_words, doc, n
        new = np.concatenate([[True], (word[1:] != word[:-1]) | (context[1:] != context[:-1])])
        first = np.flatnonzero(new)
        self.kind = np.cumsum(new) - 1  # the type of each entry
        self.word, self.context = word[first], context[first].astype(np.int64)
        self.count = np.add.reduceat(np.where(held[doc] == 0, n, 0), first)
        self.word_count = np.bincount(self.word, self.count, n_words).astype(np.int64)

    def generator(self) -> np.random.Generator:
        return np.random.default_rng(self.seed)


def pieces(batch: pa.RecordBatch, row: int, most: int = PIECE) -> Iterator[tuple[Bucket, np.ndarray]]:
    """A bucket in pieces of about `most` entries, each with the names of its words.

    A word's customers, in all contexts, are in one piece; pieces do not depend on
    each other but through the totals.
    """
    read = lambda name, kind: np.frombuffer(batch[name][row].as_buffer(), kind)
    names, entries = read("words", np.uint64), read("entries", np.uint32).astype(np.int64)
    doc = read("doc", np.uint32)
    context = _wide(batch["context"][row].as_buffer(), len(doc))
    n, held = _wide(batch["n"][row].as_buffer(), len(doc)), np.unpackbits(read("held", np.uint8))
    whole = batch["whole"][row].as_buffer()
    whole = _wide(whole, len(names)) if whole.size else np.zeros(0, np.uint8)
    ends = np.cumsum(entries)
    low = 0
    while low < len(names):
        begin = int(ends[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + most, "right")))
        part = slice(begin, int(ends[high - 1]))
        word = np.repeat(np.arange(high - low), entries[low:high])
        bucket = Bucket([batch["bucket"][row].as_py(), batch["quarter"][row].as_py(), low], word, high - low, context[part], doc[part].astype(np.int64),
                        n[part].astype(np.int64), held)
        if len(whole) and whole[low:high].any():
            bucket.whole = whole[low:high].astype(np.int64) - 1
        yield bucket, names[low:high]
        low = high


def seat(count: np.ndarray, weight: np.ndarray, more: np.ndarray, discount: float, rng: np.random.Generator
         ) -> tuple[np.ndarray, np.ndarray]:
    """Tables of dishes with `count` customers, and the log of what the seating's Metropolis step compares.

    A new table has `weight` and `more` for each table that the dish has; an
    occupied dish with n customers at t tables has n - discount * t.
    """
    tables = (count > 0).astype(np.int64)
    level = np.zeros(len(count))
    order = np.argsort(-count, kind="stable")
    falling = -count[order]
    n = 1
    while True:
        live = order[: np.searchsorted(falling, -n, "left")]  # more than n customers
        if not len(live):
            return tables, level
        block = 1 if n < _ONE_BY_ONE else n // 16
        size = np.minimum(block, count[live] - n)
        fresh = weight[live] + more[live] * tables[live]
        total = n - discount * tables[live] + fresh
        level[live] += size * np.log(total)
        p = fresh / total
        tables[live] += rng.random(len(live)) < p if block == 1 else rng.binomial(size, p)
        n += block


def seatings(bucket: Bucket, totals: Totals, rng: np.random.Generator, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tables of every type and of every word in the root, after each sweep."""
    base = 1 / (totals.vocabulary + 1)
    tables = np.minimum(bucket.count, 1)
    root = np.bincount(bucket.word, tables, bucket.n_words).astype(np.int64)
    root_tables = np.minimum(root, 1)
    level = np.full(len(tables), -np.inf)
    root_level = np.full(len(root), -np.inf)
    several = bucket.count > 1
    for _ in range(sweeps):
        parent = root_word(*of_all(bucket, root, root_tables, totals), totals)[bucket.word]
        others = np.maximum(totals.tables[bucket.context] - tables, 0)
        weight, more = (STRENGTH + DISCOUNT * others) * parent, DISCOUNT * parent
        new, new_level = seat(bucket.count[several], weight[several], more[several], DISCOUNT, rng)
        take = np.log(rng.random(len(new))) < new_level - level[several]
        tables[several] = np.where(take, new, tables[several])
        level[several] = np.where(take, new_level, level[several])
        root = np.bincount(bucket.word, tables, bucket.n_words).astype(np.int64)
        rest = np.maximum(totals.root_tables - root_tables, 0)
        new, new_level = seat(root, (ROOT_STRENGTH + ROOT_DISCOUNT * rest) * base,
                              np.full(len(root), ROOT_DISCOUNT * base), ROOT_DISCOUNT, rng)
        take = (np.log(rng.random(len(new))) < new_level - root_level) | (root_tables > root) | (root > 0) & (root_tables == 0)
        root_tables = np.where(take, new, root_tables)
        root_level = np.where(take, new_level, root_level)
        yield tables, root_tables


def of_all(bucket: Bucket, root: np.ndarray, root_tables: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of words in the root; of split words those of all their buckets."""
    if bucket.whole is None or totals.shared is None:
        return root, root_tables
    own = bucket.whole >= 0
    at = bucket.whole[own]
    root, root_tables = root.astype(float), root_tables.copy()
    if totals.shared.seated:
        root[own] = np.maximum(totals.shared.root[at], root[own])
    else:  # the other buckets' tables are taken to have grown as these have: contexts are dealt by their hash
        kinds = np.bincount(bucket.word, np.minimum(bucket.count, 1), bucket.n_words)[own]
        root[own] = np.where(kinds > 0, totals.shared.root[at] * root[own] / np.maximum(kinds, 1), totals.shared.root[at])
    root_tables[own] = totals.shared.root_tables[at]
    return root, root_tables


def counts_of_all(bucket: Bucket, totals: Totals) -> np.ndarray:
    """Customers of words; of split words those of all their buckets."""
    if bucket.whole is None or totals.shared is None:
        return bucket.word_count
    return np.where(bucket.whole >= 0, totals.shared.count[np.maximum(bucket.whole, 0)], bucket.word_count)


def root_word(root: np.ndarray, root_tables: np.ndarray, totals: Totals) -> np.ndarray:
    """Probability of words in the root restaurant."""
    base = 1 / (totals.vocabulary + 1)
    return (root - ROOT_DISCOUNT * root_tables + (ROOT_STRENGTH + ROOT_DISCOUNT * totals.root_tables) * base) / (
        ROOT_STRENGTH + totals.root_customers)


def predict(bucket: Bucket, totals: Totals, rng: np.random.Generator) -> np.ndarray:
    """Probability of every type after its context, averaged over seatings."""
    total = np.zeros(len(bucket.count))
    for sweep, (tables, root_tables) in enumerate(seatings(bucket, totals, rng, BURN + SAMPLES)):
        if sweep >= BURN:
            root = np.bincount(bucket.word, tables, bucket.n_words)
            parent = root_word(*of_all(bucket, root, root_tables, totals), totals)[bucket.word]
            left = (STRENGTH + DISCOUNT * totals.tables[bucket.context]) * parent
            total += (bucket.count - DISCOUNT * tables + left) / (STRENGTH + totals.customers[bucket.context])
    return total / SAMPLES


def homes_of(parts: int) -> int:
    """Homes of contexts; fewer than buckets, so that what they tell each other is few rows."""
    return max(1, parts // 4)


def _homes(names: np.ndarray, homes: int) -> np.ndarray:
    """Where the contexts' first of each home begin, and their end; names are in order."""
    at = [(home << CONTEXT_BITS) // homes + ((home << CONTEXT_BITS) % homes > 0) for home in range(homes + 1)]
    return np.searchsorted(names, np.array(at, np.uint64))


def _known(batch: pa.RecordBatch, row: int, homes: int, scalars: dict) -> Totals:
    """Totals for a bucket: those of its contexts as their homes told them."""
    cut = _homes(_unpack(batch["contexts"][row].as_py()), homes)
    customers, tables = np.zeros(cut[-1], np.int64), np.zeros(cut[-1], np.int64)
    told = np.zeros(homes, bool)
    for share in batch["totals"][row].as_py():
        low, high = cut[share["home"]], cut[share["home"] + 1]
        customers[low:high], tables[low:high] = _wide(share["a"], high - low), _wide(share["b"], high - low)
        told[share["home"]] = True
    if (~told & (np.diff(cut) > 0)).any():
        raise RuntimeError("totals of a bucket's contexts are missing")
    return Totals(customers=customers, tables=tables, **scalars)


def _shares(homes: int, scalars: dict | None):
    """Sums of each bucket's contexts, a row to each home; with totals of a sweep before, after sweeps that use them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_, told, own = None, {}, np.zeros(4, np.int64)  # of the bucket at hand: by home, the lists of a row
        whole: list[np.ndarray] = []  # split words, their customers here, and those in the root

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal own
            if told:
                first = np.arange(len(told)) == 0
                columns = zip(*told.values())
                yield pa.record_batch({
                    "home": pa.array(list(told), pa.int32()), "bucket": pa.array([bucket_] * len(told), pa.int32()),
                    **{name: pa.array(list(column), pa.list_(kind)) for name, kind, column in zip(
                        ("quarter", "names", "a", "b"), (pa.int32(), *[pa.binary()] * 3), columns)},
                    **{name: pa.array(first * value, pa.int64()) for name, value in zip(_SCALARS, own)},
                    "whole": pa.array([np.concatenate(whole, 1).tobytes() if whole and one else None for one in first], pa.binary())})
            told.clear()
            whole.clear()
            own = np.zeros(4, np.int64)

        for batch in batches:
            for i in range(batch.num_rows):
                names = _unpack(batch["contexts"][i].as_py())
                totals = _known(batch, i, homes, scalars) if scalars else None
                customers, seated = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                sums, split = np.zeros(4, np.int64), []
                for bucket, _ in pieces(batch, i):
                    tables, root_tables = np.minimum(bucket.count, 1), np.minimum(bucket.word_count, 1)
                    if totals:
                        for tables, root_tables in seatings(bucket, totals, bucket.generator(), BURN + 1):
                            pass
                    customers += np.bincount(bucket.context, bucket.count, len(names)).astype(np.int64)
                    seated += np.bincount(bucket.context, tables, len(names)).astype(np.int64)
                    alone = bucket.whole < 0 if bucket.whole is not None else slice(None)
                    sums += [bucket.count.sum(), (bucket.word_count[alone] > 0).sum(), tables.sum(), root_tables[alone].sum()]
                    if bucket.whole is not None:
                        root = np.bincount(bucket.word, tables, bucket.n_words).astype(np.int64)
                        split.append(np.stack([bucket.whole, bucket.word_count, root])[:, ~alone])
                if batch["bucket"][i].as_py() != bucket_:
                    yield from send()
                    bucket_ = batch["bucket"][i].as_py()
                own += sums
                whole += split
                cut = _homes(names, homes)
                for home in np.flatnonzero(np.diff(cut)):
                    part = slice(cut[home], cut[home + 1])
                    for values, value in zip(told.setdefault(int(home), ([], [], [], [])), (
                            batch["quarter"][i].as_py(), _pack(names[part]), _narrow(customers[part]), _narrow(seated[part]))):
                        values.append(value)
        yield from send()
    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shares of each home with totals over all buckets in place of each bucket's sums."""
    schema = None

    def finish(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        each = [(r, i) for r in rows for i in range(len(r["quarter"]))]
        names = [_unpack(r["names"][i]) for r, i in each]
        size = [len(x) for x in names]
        number = np.unique(np.concatenate(names), return_inverse=True)[1]
        ends = np.cumsum(size)
        for name in ("a", "b"):
            total = np.bincount(number, np.concatenate([_wide(r[name][i], n) for (r, i), n in zip(each, size)])).astype(np.int64)
            for (r, i), low, high in zip(each, ends - size, ends):
                r[name][i] = _narrow(total[number[low:high]])
        for r in rows:
            r["names"] = None
        yield from packed.slices(pa.RecordBatch.from_pylist(rows, schema))

    met: list[dict] = []
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if met and met[0]["home"] != row["home"]:
                yield from finish(met)
                met = []
            met.append(row)
    if met:
        yield from finish(met)


def _agreed(sums: dict, told: list[bytes], scalars: dict | None) -> dict:
    """Sums over all buckets with those of split words, whose tables in the root are seated here, once for all their buckets."""
    if not told:
        return sums
    at, count, root = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in told], 1)
    count, root = (np.bincount(at, values).astype(np.int64) for values in (count, root))
    tables = np.minimum(root, 1)
    vocabulary = sums["vocabulary"] + int((count > 0).sum())
    if scalars:
        rng, level = np.random.default_rng([len(root), BURN]), np.full(len(root), -np.inf)
        base = 1 / (vocabulary + 1)
        for _ in range(BURN + 1):
            rest = np.maximum(scalars["root_tables"] - tables, 0)
            new, new_level = seat(root, (ROOT_STRENGTH + ROOT_DISCOUNT * rest) * base, np.full(len(root), ROOT_DISCOUNT * base), ROOT_DISCOUNT, rng)
            take = np.log(rng.random(len(new))) < new_level - level
            tables, level = np.where(take, new, tables), np.where(take, new_level, level)
    return {**sums, "vocabulary": vocabulary, "root_tables": sums["root_tables"] + int(tables.sum()), "shared": Shared(count, root, tables, bool(scalars))}


def _totals(cells: DataFrame, parts: int, scalars: dict | None = None) -> tuple[DataFrame, dict]:
    """Totals of contexts for each bucket, and of all tokens."""
    told = cells.mapInArrow(_shares(homes_of(parts), scalars), _SHARES)
    totals = common.write_blobs(told.repartition(homes_of(parts), "home").sortWithinPartitions("home").mapInArrow(_add, _SHARES).drop("names"), "zstd")
    sums = totals.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in _SCALARS], F.collect_list("whole").alias("whole")).first().asDict()
    return totals, _agreed(sums, sums.pop("whole"), scalars)


def _with_totals(cells: DataFrame, totals: DataFrame, parts: int) -> DataFrame:
    """Buckets, where they are, with the totals that were told to them."""
    told = totals.repartition(parts, "bucket").groupBy("bucket").agg(F.collect_list(F.struct("quarter", "home", "a", "b")).alias("totals"))
    own = lambda t, name: F.element_at(t[name], F.array_position(t["quarter"], F.col("quarter")).cast("int"))
    return cells.hint("merge").join(told, "bucket").withColumn("totals", F.transform(
        F.filter("totals", lambda t: F.array_contains(t["quarter"], F.col("quarter"))),
        lambda t: F.struct(t["home"].alias("home"), own(t, "a").alias("a"), own(t, "b").alias("b"))))


def _stored(cells: DataFrame, parts: int) -> DataFrame:
    """Buckets as files by number, in small row groups; read so that a join by bucket moves none of them."""
    spark, name = cells.sparkSession, f"memlake_cells_{uuid4().hex}"
    cells.write.option("parquet.block.size", 8 << 20).option("parquet.enable.dictionary", "false").option("compression", "zstd").option(
        "path", f"{checkpoint_dir(spark)}/tables/{name}").bucketBy(parts, "bucket").saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and the frame knows them
    return stored


_SUMS = "flush long, kind int, places binary, sums binary, tokens long"


def _sums(homes: int, scalars: dict):
    """One row from a task to a flush: positions of documents and their known tokens, base and model's log10."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # flush, position; tokens, known, base, score
        merged = 0

        def merge() -> tuple[np.ndarray, np.ndarray]:
            at, values = (np.concatenate([x[i] for x in held], 1) for i in (0, 1))
            order = np.lexsort((at[1], at[0]))
            at, values = at[:, order], values[:, order]
            new = np.flatnonzero(np.concatenate([[True], (at[:, 1:] != at[:, :-1]).any(0)]))
            held[:] = [(at[:, new], np.add.reduceat(values, new, 1))]
            return held[0]

        def send() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            at, values = merge()
            cut = np.flatnonzero(np.concatenate([[True], at[0, 1:] != at[0, :-1]]))
            for low, high in zip(cut, np.append(cut[1:], at.shape[1])):
                part = values[:, low:high]
                yield pa.record_batch({
                    "flush": at[0, low:low + 1], "kind": pa.array([1], pa.int32()), "places": [at[1, low:high].astype(np.uint32).tobytes()],
                    "sums": [part[1:].tobytes()], "tokens": [int(part[0].sum())]})
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                flushes, sizes = np.frombuffer(batch["flushes"][i].as_buffer(), np.int64).reshape(2, -1)
                used, short = np.unique(np.frombuffer(batch["doc"][i].as_buffer(), np.uint32), return_inverse=True)
                values, begin = np.zeros((4, len(used))), 0
                totals = _known(batch, i, homes, scalars)
                for bucket, _ in pieces(batch, i):
                    log = np.log10(predict(bucket, totals, bucket.generator()))
                    count = counts_of_all(bucket, totals)
                    plain = np.log10((count + 1) / (totals.tokens + totals.vocabulary + 1))
                    word, doc = bucket.word[bucket.kind], short[begin: begin + len(bucket.doc)]
                    begin += len(bucket.doc)
                    for row, value in enumerate((1, count[word] > 0, plain[word], log[bucket.kind])):
                        values[row] += np.bincount(doc, value * bucket.n, len(used))
                first = np.cumsum(sizes) - sizes
                flush = np.searchsorted(first + sizes, used, "right")
                held.append((np.stack([flushes[flush], used - first[flush]]), values))
                if sum(x[0].shape[1] for x in held) > merged + NEW_SUMS:
                    merged = merge()[0].shape[1]
                    if merged > SUMS:
                        yield from send()
                        merged = 0
        yield from send()
    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the documents of each flush with the sums of all buckets."""
    flush = known = None
    missing = 0

    def done() -> Iterator[pa.RecordBatch]:
        if missing:
            raise RuntimeError("rows of the input came in another order when a lost task was run again")
        if flush is not None:
            ids, held, n = documents
            yield pa.record_batch([
                pa.array(ids, mask=ids == _NO_ID), pa.array(held == 1), pa.array(n),
                pa.array(np.rint(known[0]).astype(np.int64)), pa.array(known[1]), pa.array(known[2])],
                names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                yield from done()
                flush, n = row["flush"], np.frombuffer(row["sums"], np.int64)
                documents = [*np.frombuffer(row["places"], np.int64).reshape(2, -1), n]
                known, missing = np.zeros((3, len(n))), int(n.sum())
            else:
                if row["flush"] != flush:
                    raise RuntimeError("rows of the input came in another order when a lost task was run again")
                at = np.frombuffer(row["places"], np.uint32)
                known[:, at] += np.frombuffer(row["sums"], np.float64).reshape(3, -1)
                missing -= row["tokens"]
    yield from done()


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows for which the column `held_out` is false and score all rows.

    Returns one row for each row: the id, `held_out`, `n_tokens`, `n_known`
    (tokens that training has), `train_tokens`, `base_score` (add-one unigram)
    and `score` (this model), both log10 probabilities of the whole text. Words
    are split at ASCII white space with A-Z lower-cased; every text, also a null
    or empty one, ends with one end token. Rows that repeat id and text are
    scored alike, null ids are scored too; without training tokens every word
    has the uniform probability. The id must be an integer.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"),
                       F.xxhash64(text_col).alias("_key"), held_out.cast("int").alias("_held"),
                       F.col(text_col).alias("_text"))
    split = _frequent(rows)
    sent = rows.mapInArrow(_messages(parts, _numbers(spark, parts), split), packed.SCHEMA).drop("kind")
    written = _stored(sent.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather(split), CELLS), parts)
    cells = written.where("bucket >= 0")
    totals, scalars = _totals(cells, parts)
    totals, scalars = _totals(_with_totals(cells, totals, parts), parts, scalars)
    sums = _with_totals(cells, totals, parts).mapInArrow(_sums(homes_of(parts), scalars), _SUMS)
    listed = written.where("bucket < 0").select("flush", F.lit(0).alias("kind"), F.col("doc").alias("places"),
                                                F.col("n").alias("sums"), F.lit(0).cast("long").alias("tokens"))
    found = listed.union(sums).repartition(parts, "flush").sortWithinPartitions("flush", "kind").mapInArrow(
        _join, "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known",
                        F.lit(scalars["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")
