"""F3 of the fourth round: an archive of many separate weeks is planned, and weeks it has already are not written again."""

from datetime import date

from pyspark.sql import functions as F

from memlake.plans import preserve
from memlake.sources import archive_files
from memlake.sources.snapshots import Store


def days(spark, n: int):
    return spark.range(n).select(F.lit("a").alias("agent_id"), F.date_add(F.lit("1930-01-06").cast("date"), F.col("id").cast("int")).alias("memory_date"))


def index(spark, n: int):
    return days(spark, n).select("agent_id", F.explode(F.array(F.lit("surface"), F.lit("deep"))).alias("depth"), F.col("memory_date").cast("string").alias("time_key"))


def test_every_second_week_of_a_century(spark):
    tables = {"l2_days": days(spark, 7 * 5200), "l0_index": index(spark, 7 * 5200)}
    weeks = sorted({"{}-W{:02d}".format(*date.fromordinal(date(1930, 1, 6).toordinal() + 7 * i).isocalendar()) for i in range(5200)})
    assert len(weeks) == 5200
    found = preserve.archive_weeks(tables, weeks[::2])  # 2,600 ranges; their nesting was too deep for the stack
    for rows in found.values():
        met = {r.week_id: r["count"] for r in rows.groupBy("week_id").count().collect()}
        assert met == {week: 7 for week in weeks[::2]}
    assert preserve.archive_weeks(tables, [])["l2_days"].isEmpty()
    apart = preserve.archive_weeks(tables, ["1931-W01", "1930-W4", "1930-W4"])["l0_index"]
    assert sorted(r.week_id for r in apart.collect()) == ["1930-W04"] * 7 + ["1931-W01"] * 7
    one = preserve.archive_weeks(tables, ["1930-W02", "1930-W03"])["l0_index"]
    assert {(r.week_id, r.depth) for r in one.collect()} == {("1930-W02", "surface"), ("1930-W03", "surface")} and one.count() == 14


def test_weeks_without_new_rows_are_not_written_again(spark, tmp_path):
    tables = {"l2_days": days(spark, 28)}
    weeks = [f"1930-W{i:02d}" for i in range(2, 6)]
    path = str(tmp_path / "archive")
    assert archive_files.write_archive(tables, path, weeks[::2]).count() == 2
    before = Store(spark, path).parts("l2_days")
    late = days(spark, 1).select(F.lit("b").alias("agent_id"), "memory_date")
    assert archive_files.write_archive({"l2_days": tables["l2_days"].unionByName(late)}, path, weeks).count() == 3
    after = Store(spark, path).parts("l2_days")
    kept = Store(spark, path).parts("l2_days", {"week_id": [weeks[2]]})
    assert kept.items() <= before.items() and len(after) == 4  # the week of the late agent and the two new ones are new
    rows = Store(spark, path).read("l2_days")
    assert sorted((r.agent_id, r.week_id) for r in rows.collect()) == sorted([("a", w) for w in weeks for _ in range(7)] + [("b", weeks[0])])
    again = Store(spark, path).read("l2_days", {"week_id": weeks[:1]})
    assert again.count() == 8 and archive_files.manifest(spark, path).count() == 5
