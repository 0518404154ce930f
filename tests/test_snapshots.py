"""Versioned tables: old or new, never between; partition values of any kind; nothing left behind."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from memlake.sources import snapshots, tables
from memlake.sources.snapshots import Change, Store
from memlake.streaming import intake

ODD = [None, "", "a/b", "k=v", "x y", "100%", "ünï", "../up", "__HIVE_DEFAULT_PARTITION__", "long" * 100]


def rows(spark, values, n=2):
    return spark.createDataFrame([(v, i, f"{v}-{i}") for v in values for i in range(n)], "kind string, n int, text string")


def content(df):
    return sorted((str(r.kind), r.n) for r in df.collect())


def test_partitions_of_any_value(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_layer(rows(spark, ODD), path, ["kind"])
    assert content(tables.read(spark, path)) == content(rows(spark, ODD))
    for value in ODD:
        assert content(tables.read(spark, path, {"kind": [value]})) == content(rows(spark, [value])), value
    tables.write_layer(rows(spark, ["a/b", None], 1), path, ["kind"])
    assert content(tables.read(spark, path, {"kind": ["a/b", None]})) == [("None", 0), ("a/b", 0)]
    doomed = spark.createDataFrame([(v, 0) for v in ODD] + [("a/b", 1)], "kind string, n int")
    assert tables.delete_rows(spark, path, doomed, ["kind", "n"]) == 2  # "a/b" and null had one row left
    assert content(tables.read(spark, path)) == sorted((str(v), 1) for v in ODD if v not in ("a/b", None))
    assert tables.delete_rows(spark, path, doomed, ["kind", "n"]) == 0


def test_readers_see_the_old_or_the_new(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    first = store.publish({"a": Change(rows(spark, ["x"]), ("kind",)), "b": Change(rows(spark, ["x"]), whole=True)}, {"step": 1})
    opened = store.read("a")
    # A job dies after its data is written and before the pointer moves.
    monkeypatch.setattr(Store, "_move", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.publish({"a": Change(rows(spark, ["y"]), ("kind",)), "b": Change(rows(spark, ["y"]), whole=True)}, {"step": 2})
    monkeypatch.undo()
    assert content(store.read("a")) == content(store.read("b")) == content(rows(spark, ["x"])) and store.mark("step") == 1
    # The same change once more; who opened the old version still reads it.
    store.publish({"a": Change(rows(spark, ["y"]), ("kind",)), "b": Change(rows(spark, ["y"]), whole=True)}, {"step": 2})
    assert content(store.read("a")) == content(rows(spark, ["x", "y"])) and content(store.read("b")) == content(rows(spark, ["y"]))
    assert content(opened) == content(rows(spark, ["x"])) == content(store.read("b", version=first)) and store.mark("step") == 2


def test_a_table_may_be_computed_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_layer(rows(spark, ["x", "y"]), path, ["kind"])
    tables.write_layer(tables.read(spark, path).where("kind = 'x'").withColumn("n", F.col("n") + 10), path, ["kind"])
    assert content(tables.read(spark, path)) == [("x", 10), ("x", 11), ("y", 0), ("y", 1)]


def test_expired_versions_leave_no_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        tables.write_layer(rows(spark, ["x" if i else "y"], i + 1), path, ["kind"])
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4
    assert tables.expire(spark, path, keep=1) == 2  # "y" still stands in the first folder
    assert content(tables.read(spark, path)) == content(rows(spark, ["x"], 4)) + content(rows(spark, ["y"], 1))
    assert tables.expire(spark, path, keep=1) == 0


def test_a_second_writer_fails(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store = Store(spark, path)
    store.publish({"a": Change(rows(spark, ["x"]))})
    write = Store._write

    def late(self, text, *names):
        write(self, text, *names)
        if names[0] == "versions":
            monkeypatch.setattr(Store, "_write", write)
            Store(spark, path).publish({"a": Change(rows(spark, ["z"]))})

    monkeypatch.setattr(Store, "_write", late)
    with pytest.raises(snapshots.Conflict):
        store.publish({"a": Change(rows(spark, ["y"]))})
    assert content(store.read("a")) == content(rows(spark, ["z"]))


def test_a_batch_writes_its_own_rows_once(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda d, n: spark.createDataFrame([("a", date(2024, 1, d), n, n, 0)], "agent_id string, memory_date date, "  # noqa: E731
                                             "total_turns long, user_turns long, assistant_turns long")
    for number, (d, n) in enumerate([(1, 5), (2, 7), (1, 3)]):
        intake._append(path, day(d, n), number)
    intake._append(path, day(1, 3), 2)  # run again after a crash
    counts = lambda: sorted((str(r.memory_date), r.total_turns) for r in intake.read_day_stats(spark, path).collect())
    assert counts() == [("2024-01-01", 8), ("2024-01-02", 7)]
    assert all(len(list(f.glob("*/*.parquet"))) == 1 for f in (tmp_path / "t" / "data").iterdir())
    assert intake.compact(spark, path, intake.merge_day_stats, most=2) == ["2024-01"]
    assert len(Store(spark, path).parts(tables.TABLE)) == 1 and counts() == [("2024-01-01", 8), ("2024-01-02", 7)]
    intake._append(path, day(1, 3), 2)  # and once more, after its rows were folded
    intake._append(path, day(1, 1), 3)
    assert counts() == [("2024-01-01", 9), ("2024-01-02", 7)]
