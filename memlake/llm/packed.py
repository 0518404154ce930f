"""Deciding about names that tasks have in common, with one packed message from each task to each bucket.

A task sorts its (name, document, place) entries and sends each name once, as
flat arrays to the name's bucket; what it can already tell from its own entries
it reports directly. So a name held by a third of all documents reaches its
bucket once from each task, not once from each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from memlake.llm import words

ENTRIES = 2_000_000  # of a task before they are sorted and sent
SLICE_BYTES = 1 << 20  # of messages handed to Spark at once
#: `kind` 0: arrays for a bucket; 1: places of the documents of a group that are decided.
SCHEMA = "kind int, bucket int, id long, text_key long, names binary, docs binary, places binary, flags binary"
_FIELDS = ["kind", "bucket", "id", "text_key", "names", "docs", "places", "flags"]


def buckets(spark: SparkSession) -> int:
    return 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dense(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct documents in order, and the number of each row's document."""
    order = np.lexsort((keys, ids))
    a, b = ids[order], keys[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return a[new], b[new], number


def in_order(names: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Order by name, document and place, without repeated entries (of repeated rows)."""
    order = np.lexsort((place, doc, names))
    n, d, p = names[order], doc[order], place[order]
    new = np.concatenate([[True], (n[1:] != n[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])])
    return order[new]


class Batch:
    """Rows of the message table under construction."""

    def __init__(self):
        self.rows: dict[str, list] = {name: [] for name in _FIELDS}

    def add(self, **values) -> None:
        for name in _FIELDS:
            self.rows[name].append(values.get(name))

    def done(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.record_batch([pa.array(self.rows[n], t) for n, t in zip(_FIELDS, kinds)], names=_FIELDS)


def decided(batch: Batch, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray, groups: int) -> None:
    """Report places (numbers) of documents, one row a group of documents: steps of the places, counts as `flags`."""
    if not len(doc):
        return
    group = words.mix(words.mix(ids.view(np.uint64)) ^ keys.view(np.uint64)) % np.uint64(groups)
    order = in_order(group[doc], doc, place)
    doc, place = doc[order], place[order]
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    count = np.diff(np.append(first, len(doc)))
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    used = doc[first]
    own = group[used]
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    for low, high in zip(cut, np.append(cut[1:], len(used))):
        part = used[low:high]
        steps = step[first[low]: first[high - 1] + count[high - 1]]
        batch.add(kind=1, bucket=-1 - int(own[low]), docs=np.stack([ids[part], keys[part]]).tobytes(),
                  places=_narrow(steps), flags=count[low:high].astype(np.uint32).tobytes())


def _narrow(values: np.ndarray) -> bytes:
    return values.astype(_width(int(values.max()) + 1)).tobytes()


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of the groups, with the steps of all its places."""
    def finish(rows: list[dict]) -> pa.RecordBatch:
        docs = np.concatenate([np.frombuffer(r["docs"], np.int64).reshape(2, -1) for r in rows], 1)
        counts = [np.frombuffer(r["flags"], np.uint32).astype(np.int64) for r in rows]
        step = np.concatenate([np.frombuffer(r["places"], np.uint16 if len(r["places"]) == 2 * c.sum() else np.uint32)
                               .astype(np.int64) for r, c in zip(rows, counts)])
        count = np.concatenate(counts)
        total, first = np.cumsum(step), np.cumsum(count) - count
        place = total - np.repeat(total[first] - step[first], count)
        ids, keys, number = dense(*docs)
        doc = np.repeat(number, count)
        order = in_order(doc, doc, place)
        doc, place = doc[order], place[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        step = np.diff(place, prepend=0)
        step[first] = place[first]
        ends = np.append(first, len(doc))
        lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [
            None, pa.py_buffer(ends * 4), pa.py_buffer(step.astype(np.uint32))]).cast(pa.binary())
        return pa.record_batch([ids, keys, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), lists)],
                               names=["id", "text_key", "places"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["bucket"] != row["bucket"]:
                yield from slices(finish(held))
                held = []
            held.append(row)
    if held:
        yield from slices(finish(held))


def _width(n: int) -> type:
    return np.uint16 if n <= 1 << 16 else np.uint32


def _pack_names(names: np.ndarray, rule: str) -> bytes:
    """Names as bytes. Where `shared` is all that is asked, the upper 40 bits do: two names that look alike are told
    to be shared, which callers verify."""
    if rule != "shared":
        return names.tobytes()
    return np.ascontiguousarray((names >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack_names(data: bytes, rule: str) -> np.ndarray:
    if rule != "shared":
        return np.frombuffer(data, np.uint64)
    names = np.zeros((len(data) // 5, 8), np.uint8)
    names[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return names.view(np.uint64).ravel()


class Entries:
    """Collects a task's entries; `rule` tells which are decided and which are sent."""

    def __init__(self, parts: int, rule: str):
        self.parts, self.rule, self.groups = parts, rule, max(1, parts // 4)
        self.clear()

    def clear(self) -> None:
        self.names, self.docs, self.places, self.ids, self.keys = [], [], [], [], []
        self.count = self.rows = 0

    def add(self, names: np.ndarray, doc: np.ndarray, place: np.ndarray, ids: np.ndarray, keys: np.ndarray) -> None:
        self.names.append(names)
        self.docs.append(doc + self.rows)
        self.places.append(place)
        self.ids.append(ids)
        self.keys.append(keys)
        self.count += len(names)
        self.rows += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        names, doc, place = map(np.concatenate, (self.names, self.docs, self.places))
        ids, keys = np.concatenate(self.ids), np.concatenate(self.keys)
        self.clear()
        ids, keys, number = dense(ids, keys)
        doc = number[doc]
        order = in_order(names, doc, place)
        names, doc, place = names[order], doc[order], place[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        at = np.flatnonzero(first)
        several = np.diff(np.append(at, len(names))) > 1
        batch = Batch()
        if self.rule == "shared":  # every entry of a name with two entries
            group = np.cumsum(first) - 1
            own = several[group]
        else:  # "later": every entry but the least
            own = ~first
        decided(batch, doc[own], place[own], ids, keys, self.groups)
        bucket = (names[at] % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        at, several, bucket = at[order], several[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        for low, high in zip(cut, np.append(cut[1:], len(bucket))):
            used, short = np.unique(doc[at[low:high]], return_inverse=True)
            batch.add(kind=0, bucket=int(bucket[low]), names=_pack_names(names[at[low:high]], self.rule),
                      docs=np.stack([ids[used], keys[used]]).tobytes(),
                      places=_narrow(place[at[low:high]]) + short.astype(_width(len(used))).tobytes(),
                      flags=np.packbits(several[low:high]).tobytes())
        yield from slices(batch.done())


def slices(messages: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Messages in parts of about `SLICE_BYTES`."""
    step = max(1, messages.num_rows * SLICE_BYTES // max(1, messages.nbytes))
    for at in range(0, messages.num_rows, step):
        yield messages.slice(at, step)


def numbers(lists: list[bytes] | None) -> np.ndarray:
    """Distinct decided places of a document, from the steps that are kept of each sorted list."""
    found = [np.cumsum(np.frombuffer(x, np.uint32), dtype=np.int64) for x in lists or ()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def settle(messages: DataFrame, rule: str) -> DataFrame:
    """`id, text_key, places` (list of binary) of all decided places, from the messages of all tasks.

    A task tells the decisions of its buckets as tasks told their entries: packed,
    one row for a group of documents, not one for each document and bucket.
    """
    spark = messages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    told = ["bucket", "docs", "places", "flags"]

    def finish(rows: list[dict]) -> list[np.ndarray]:
        """Ids and keys of documents, and the numbers and places of the decided entries."""
        names = [_unpack_names(r["names"], rule) for r in rows]
        docs = [np.frombuffer(r["docs"], np.int64).reshape(2, -1) for r in rows]
        offset = np.cumsum([0, *(d.shape[1] for d in docs)])
        place, doc = [], []
        for r, n, d, o in zip(rows, names, docs, offset):
            short = np.dtype(_width(d.shape[1]))
            wide = len(r["places"]) - short.itemsize * len(n)  # bytes of the places
            place.append(np.frombuffer(r["places"], np.uint16 if wide == 2 * len(n) else np.uint32, len(n)).astype(np.int64))
            doc.append(np.frombuffer(r["places"], short, len(n), wide).astype(np.int64) + o)
        place, doc = np.concatenate(place), np.concatenate(doc)
        flags = np.concatenate([np.unpackbits(np.frombuffer(r["flags"], np.uint8))[: len(n)]
                                for r, n in zip(rows, names)]).astype(bool)
        names = np.concatenate(names)
        ids, keys = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
        ids, keys, number = dense(ids, keys)
        doc = number[doc]
        order = in_order(names, doc, place)
        names, doc, place, flags = names[order], doc[order], place[order], flags[order]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        own = ~first
        if rule == "shared":
            at = np.flatnonzero(first)
            several = np.diff(np.append(at, len(names))) > 1
            own = (several | np.logical_or.reduceat(flags, at))[np.cumsum(first) - 1] & ~flags  # flagged: told at home
        used, short = np.unique(doc[own], return_inverse=True)
        return [ids[used], keys[used], short, place[own]]

    def tell(found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        found = [f for f in found if len(f[3])]
        if not found:
            return
        offset = np.cumsum([0, *(len(f[0]) for f in found)])
        ids, keys, number = dense(*(np.concatenate([f[i] for f in found]) for i in (0, 1)))
        doc = number[np.concatenate([f[2] + o for f, o in zip(found, offset)])]
        batch = Batch()
        decided(batch, doc, np.concatenate([f[3] for f in found]), ids, keys, max(1, parts))
        yield from slices(batch.done().select(told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        found: list[list[np.ndarray]] = []
        for batch in batches:
            done = pa.compute.equal(batch["kind"], 1)
            yield batch.filter(done).select(told)
            for row in batch.filter(pa.compute.invert(done)).to_pylist():
                if held and held[0]["bucket"] != row["bucket"]:
                    found.append(finish(held))
                    held = []
                    if sum(len(f[3]) for f in found) > ENTRIES:
                        yield from tell(found)
                        found = []
                held.append(row)
        if held:
            found.append(finish(held))
        yield from tell(found)

    # Decided rows go through the same exchange, so that the tasks that made the messages run once.
    settled = messages.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "bucket int, docs binary, places binary, flags binary")
    return settled.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(
        _by_document, "id long, text_key long, places array<binary>")
