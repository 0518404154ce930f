"""Work that would sit in a few tasks."""

from memlake.catalog import queries


def test_landmark_histograms_have_no_window_by_chart(spark, sf):
    frame = queries()["landmark_histograms"](spark, sf)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(chart" not in plan.lower()
    assert frame.where("chart = 'score'").count() > 0
