"""Findings of the third round's driver run."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memlake.llm import language_model, packed, substrings


def test_decided_places_travel_by_group():
    batch = packed.Batch()
    ids, keys = np.arange(5000), np.arange(5000) * 7
    doc, place = np.repeat(np.arange(5000), 3), np.tile([2, 5, 70_000], 5000)
    packed.decided(batch, doc, place, ids, keys, 8)
    packed.decided(batch, doc[:6], np.array([1, 2, 2, 3, 3, 9]), ids, keys, 8)
    rows = batch.done()
    assert rows.num_rows <= 16  # not one for each document
    got = {}
    for group in packed._by_document(iter([rows.take(np.argsort(rows["bucket"].to_numpy(), kind="stable"))])):
        for row in group.to_pylist():
            assert row["text_key"] == row["id"] * 7 and row["id"] not in got
            got[row["id"]] = packed.numbers(row["places"]).tolist()
    assert len(got) == 5000 and got[0] == [1, 2, 5, 70_000] and got[1] == [2, 3, 5, 9, 70_000] and got[4999] == [2, 5, 70_000]


def test_substrings_of_a_long_document(spark):
    passage = [f"p{i}" for i in range(25)]
    long_ = [f"w{i}" for i in range(70_000)]
    docs = spark.createDataFrame([(1, " ".join(passage)), (2, " ".join(long_ + passage)), (3, " ".join(long_[100:130]))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.remove_repeats(docs).collect()}
    assert [tuple(r) for r in got[2].removed] == [(70_000, 70_025)] and got[2].n_words == 70_025
    assert got[1].removed == [] and [tuple(r) for r in got[3].removed] == [(0, 30)] and got[3].kept == ""


def test_language_model_messages_do_not_repeat_documents(spark):
    docs = spark.range(400).select(F.col("id").alias("_id"), F.xxhash64("id").alias("_key"), (F.col("id") % 2).cast("int").alias("_held"),
                                   F.concat(F.lit("a b c d e f g w"), F.col("id").cast("string")).alias("_text")).coalesce(1)
    sent = docs.mapInArrow(language_model._messages(8), packed.SCHEMA).collect()
    dealt = [r for r in sent if r.kind == 0]
    assert len(dealt) == 8 and sum(len(r.docs) for r in dealt) <= 400  # a bit a document, not three numbers
    assert [len(r.docs) for r in sent if r.kind == 1] == [400 * 16]
    entries = sum(int(np.frombuffer(r.flags, np.uint32).sum()) for r in dealt)
    assert entries == 400 * 9 and sum(len(r.places) for r in dealt) <= 5 * entries


def test_language_model_misses_lost_sums():
    row = {"flush": 1, "kind": 0, "places": np.array([5, 6, 0, 1]).tobytes(), "sums": np.array([3, 1]).tobytes(), "tokens": 0}
    part = {"flush": 1, "kind": 1, "places": np.array([0], np.uint32).tobytes(),
            "sums": np.array([[2.0], [-4.0], [-3.0]]).tobytes(), "tokens": 3}
    with pytest.raises(RuntimeError):
        list(language_model._join(iter([pa.RecordBatch.from_pylist([row, part])])))
    part["tokens"] = 4
    got = [r for b in language_model._join(iter([pa.RecordBatch.from_pylist([row, part])])) for r in b.to_pylist()]
    assert [(r["id"], r["held_out"], r["n_tokens"], r["n_known"], r["score"]) for r in got] == [(5, False, 3, 2, -3.0), (6, True, 1, 0, 0.0)]
