"""Streams over several batches and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voxspark.functions.storage import new_path
from voxspark.streaming import metrics

START = datetime(2024, 1, 1)
POINTS = "run long, step long, t double, ts timestamp"


def points(spark, *rows):
    return spark.createDataFrame([(run, step, float(minute * 60), START + timedelta(minutes=minute)) for run, step, minute in rows], POINTS)


def rates(df):
    return sorted((r.run, r.step, round(r.steps_per_s * 60, 6)) for r in df.collect() if r.run >= 0)


def test_meter_over_restarts(spark):
    """Points of a later batch that are within the delay take their place; the first point opens no window."""
    batches = [points(spark, (1, 10, 10), (1, 0, 0), (2, 0, 5)), points(spark, (1, 30, 40), (2, 100, 55)), points(spark, (1, 20, 20), (1, 40, 50), (2, 150, 80)), points(spark, (-1, 0, 100_000))]
    out = metrics.fed(batches, lambda s: metrics.throughput(s, "1 hour"))
    assert rates(out) == [(1, 10, 1.0), (1, 20, 1.0), (1, 30, 0.5), (1, 40, 1.0), (2, 100, 2.0), (2, 150, 2.0)]


def test_meter_forgets_silent_runs(spark):
    batches = [points(spark, (1, 0, 0), (1, 10, 10)), points(spark, (1, 20, 500), (1, 30, 510)), points(spark, (-1, 0, 100_000))]
    assert rates(metrics.fed(batches, lambda s: metrics.throughput(s, "1 minute", ttl=60 * 60_000))) == [(1, 10, 1.0), (1, 30, 1.0)]


def test_a_batch_is_written_once(spark):
    path, one, two = new_path(spark, "sink"), spark.range(5), spark.range(5, 9)
    metrics.commit_batch(one, 0, path, "a")
    metrics.commit_batch(one, 0, path, "a")
    metrics.commit_batch(spark.range(100), 0, path, "a")  # committed, so this changes nothing
    metrics.commit_batch(two, 1, path, "a")
    metrics.commit_batch(one, 0, path, "b")
    two.write.parquet(f"{path}/rows/run=a/batch=2")  # a writer that ended before its commit
    rows = metrics.committed(spark, path, "id long")
    assert sorted((r.run, r.batch, r.id) for r in rows.collect()) == sorted([("a", 0, i) for i in range(5)] + [("a", 1, i) for i in range(5, 9)] + [("b", 0, i) for i in range(5)])
    metrics.commit_batch(spark.range(3), 2, path, "a")
    assert metrics.committed(spark, path, "id long").where("run = 'a' and batch = 2").count() == 3
    assert {(r.run, r.batch, r.n) for r in metrics.commits(spark, path).collect()} == {("a", 0, 5), ("a", 1, 4), ("a", 2, 3), ("b", 0, 5)}


@pytest.mark.parametrize("late", ["1 hour", "3 hours"])
def test_late_rows_are_those_that_a_window_lacks(spark, late):
    batches = [points(spark, (1, 0, 0), (1, 1, 200)), points(spark, (1, 2, 30), (1, 3, 150), (1, 4, 260)), points(spark, (1, 5, 190), (1, 6, 10))]
    path = new_path(spark, "late")
    metrics.fed(batches, lambda s: s, sink=lambda rows, number: metrics.commit_batch(rows.withColumnRenamed("run", "of"), number, path, "all", "ts"))
    found = {r.step for r in metrics.late_rows(spark, path, batches[0].withColumnRenamed("run", "of").schema, "ts", late).collect()}
    assert found == ({2, 5, 6} if late == "1 hour" else {6})
    kept = metrics.fed([*batches, points(spark, (1, -1, 100_000))], lambda s: metrics.once(s, "ts", ["step"], late))
    assert {r.step for r in kept.collect()} == set(range(-1, 7)) - found - {-1} | {-1}


def test_counts_grow_over_restarts(spark):
    rows = spark.range(30).select(F.col("id"), (F.col("id") % 3 - 1).alias("label"), (F.col("id") % 2).alias("pred"))
    out = metrics.fed([rows.where(f"id % 5 = {k}") for k in range(5)], lambda s: metrics.confusion(s, "label", "pred"), "complete")
    assert {(r.target, r.predicted): r.n for r in out.collect()} == {(0, 0): 5, (0, 1): 5, (1, 0): 5, (1, 1): 5}


def test_the_meter_query_takes_all_points(spark):
    """Late points are waited for: every tenth step of a run but its first has a rate."""
    from voxspark.plans import vectors
    from voxspark.sources import views

    folder = "/root/testdata/sf0.001"
    rows = views.metric_log(spark, folder).where("step % 10 = 0")
    late = {(r.run, r.step) for r in rows.where("event_id % 41 = 0 and step > 10").collect()}
    found = {(r.run, r.step) for r in vectors.meter(spark, folder).collect()}
    assert late and late <= found and len(found) == rows.count() - rows.select("run").distinct().count()
    assert "% 41" not in vectors.QUERIES["st02_throughput_meter"][1]
