"""Running folds against plain Python, with one hot group over many parts."""

import random

import pytest
from pyspark.sql import functions as F

from voxspark.operators import sampling, scans, telemetry
from voxspark.operators.scans import Fold

SCHEMA = "g string, at long, v long, part string, `__value` string"


def naive(rows, kind, before):
    out, state = {}, {}
    for g, at, v, *_ in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        old = state.get(g, 0 if kind == "sum" else None)
        values = [x for x in (old, v) if x is not None]
        new = {"sum": lambda: old + (v or 0), "max": lambda: max(values, default=None), "min": lambda: min(values, default=None), "last": lambda: old if v is None else v}[kind]()
        out[g, at], state[g] = (old if before else new), new
    return out


@pytest.mark.parametrize("part_rows", [7, 50, 10_000])
def test_folds_by_brute_force(spark, part_rows):
    draw = random.Random(1)
    rows = [(draw.choice(["hot"] * 8 + ["a", "b", None]), at, draw.choice([None, draw.randint(-9, 9)]), "x", "y") for at in range(600)]
    folds = {f"{kind}{int(before)}": Fold(kind, F.col("v"), before) for kind in ("sum", "max", "min", "last") for before in (False, True)}
    out = scans.running(spark.createDataFrame(rows, SCHEMA).repartition(5), ["g"], ["at"], folds, part_rows).collect()
    assert len(out) == len(rows) and {"part", "__value"} <= set(out[0].asDict())
    for kind in ("sum", "max", "min", "last"):
        for before in (False, True):
            wanted = naive(rows, kind, before)
            assert {(r.g, r.at): r[f"{kind}{int(before)}"] for r in out} == wanted


def test_parts_grow_with_the_rows_and_a_run_is_spread(spark, monkeypatch):
    monkeypatch.setattr(scans, "PART_ROWS", 500)
    kept = []
    monkeypatch.setattr(scans, "stored", lambda df, name: kept.append(df) or df)
    for n in (5_000, 20_000):
        scans.running(spark.range(n).withColumn("g", F.lit(1)), ["g"], ["id"], {"s": Fold("sum", F.col("id"))})
    parts = [df.select(df.columns[-1]).distinct().count() for df in kept]
    assert parts[0] >= 8 and parts[1] >= 3 * parts[0]


def test_empty_and_null_groups(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert scans.running(rows, ["g"], ["at"], {"s": Fold("sum", F.col("v"))}).collect() == []
    out = sampling.number_rows(spark.createDataFrame([(None, k, None, None, None) for k in range(9)], SCHEMA), ["at"], "n", ["g"])
    assert sorted((r.at, r.n) for r in out.collect()) == [(k, k) for k in range(9)]


def test_one_hot_run(spark, monkeypatch):
    """All rows are of one run or process and lie in many parts."""
    monkeypatch.setattr(scans, "PART_ROWS", 40)
    draw = random.Random(2)
    points = [(1, s, s * 0.5 + draw.random() * 0.1) for s in range(0, 3000, 10)]
    out = {r.step: r.samples_per_s for r in telemetry.throughput(spark.createDataFrame(points, "run long, step long, t double"), 2.0, 1.0, F.lit(4.0)).collect()}
    assert len(out) == len(points) - 1 and all(abs(out[b[1]] - 20 / (b[2] - a[2])) < 1e-9 for a, b in zip(points, points[1:], strict=False))

    log = [(1, s, draw.choice(["mark", "wait", "wait", "other", "valid"]), 0.25, float(s)) for s in range(500)]
    found = {r.window: (r.waited, r.wall) for r in telemetry.input_wait(spark.createDataFrame(log, "run long, step long, metric string, value double, t double"), "mark", "wait", "valid").collect()}
    wanted, opened, waited, window = {}, None, 0.0, 0
    for _, _, metric, value, t in log:
        waited += value if metric == "wait" else 0
        if metric in ("mark", "valid"):
            if metric == "mark" and opened is not None:
                wanted[window] = (waited, t - opened)
            opened, waited, window = t, 0.0, window + 1
    assert found == wanted

    spans = [(1, draw.randint(0, 9000), draw.randint(0, 12)) for _ in range(800)]
    covered = {t for _, a, d in spans for t in range(a, a + d)}
    row = telemetry.busy_time(spark.createDataFrame(spans, "pid long, ts long, dur long"), ["pid"]).first()
    width = max(a + d for _, a, d in spans) - min(a for _, a, _ in spans)
    assert (row.busy, row.window, row.idle) == (len(covered), width, width - len(covered))
