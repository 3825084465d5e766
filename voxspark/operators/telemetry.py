"""Tables of runs: metrics, throughput, traces, configurations, selectors and reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.workers import ship
from voxspark.operators.scans import Fold, running


def reduce_ranks(log: DataFrame, by: list[str], worst: list[str]) -> DataFrame:
    """Mean over ranks of each metric; the maximum for those where the worst rank counts."""
    return log.groupBy(*by, "metric").agg(F.when(F.first("metric").isin(worst), F.max("value")).otherwise(F.avg("value")).alias("value"))


def throughput(points: DataFrame, samples: float, tflop: float, peak: Column) -> DataFrame:
    """Rates between consecutive log points of a run, by the measured number of steps.

    ``points``: run, step, t (seconds).  The first point opens no window; the
    model FLOP utilisation is null where the peak is not known.
    """
    rows = running(points, ["run"], ["step"], {"__last": Fold("last", F.struct("step", "t"), before=True)})
    rows = rows.withColumn("steps", F.col("step") - F.col("__last.step")).withColumn("seconds", F.col("t") - F.col("__last.t")).where("steps is not null and seconds > 0")
    rate = F.col("steps") / F.col("seconds")
    return rows.select("run", "step", (rate * samples).alias("samples_per_s"), (rate * tflop).alias("tflops"), (rate * tflop / peak).alias("mfu"))


def input_wait(log: DataFrame, mark: str, wait: str, rebase: str | None) -> DataFrame:
    """Share of each log window that was spent waiting for input.

    Windows end at ``mark`` records; ``rebase`` records (validation) start a new
    window without ending one, so their time is in none.  ``log``: run, step,
    metric, value (seconds), t (seconds).
    """
    cuts = F.col("metric").isin([m for m in (mark, rebase) if m])
    rows = running(log, ["run"], ["step"], {"window": Fold("sum", cuts.cast("int"), before=True), "opened": Fold("last", F.when(cuts, F.col("t")), before=True)})
    ends = rows.groupBy("run", "window").agg(F.sum(F.when(F.col("metric") == wait, F.col("value")).otherwise(0.0)).alias("waited"), F.max(F.when(F.col("metric") == mark, F.col("t"))).alias("closed"), F.min("opened").alias("opened"))
    return ends.where("closed is not null and opened is not null").select("run", "window", "waited", (F.col("closed") - F.col("opened")).alias("wall"), (F.col("waited") / F.greatest(F.col("closed") - F.col("opened"), F.lit(1e-9))).alias("fraction"))


def spans(events: DataFrame) -> DataFrame:
    """Complete events that have a duration."""
    return events.where((F.col("ph") == "X") & F.col("dur").isNotNull())


def busy_time(events: DataFrame, by: list[str]) -> DataFrame:
    """Union length of intervals and idle time inside their window.

    An interval adds what it has beyond the furthest end of those before it.
    """
    rows = running(events.withColumn("__end", F.col("ts") + F.col("dur")), by, ["ts", "__end", *by], {"__reach": Fold("max", F.col("__end"), before=True)})
    own = F.greatest(F.col("__end") - F.greatest("ts", "__reach"), F.lit(0))
    out = rows.groupBy(*by).agg(F.sum(own).alias("busy"), (F.max("__end") - F.min("ts")).alias("window"))
    return out.withColumn("idle", F.col("window") - F.col("busy"))


def step_statistics(events: DataFrame, by: list[str], prefix: str, category: str, device: list[str]) -> DataFrame:
    """Number and mean length of step markers; without any, one step as long as the device window."""
    step = F.col("name").startswith(prefix) & (F.col("cat") == category)
    on_device = F.col("cat").isin(device)
    window = F.max(F.when(on_device, F.col("ts") + F.col("dur"))) - F.min(F.when(on_device, F.col("ts")))
    return events.groupBy(*by).agg(F.greatest(F.count(F.when(step, 1)), F.lit(1)).alias("steps"), F.coalesce(F.avg(F.when(step, F.col("dur"))), window.cast("double")).alias("step_us"))


def regions(events: DataFrame, by: list[str], categories: list[str], step_prefix: str, steps: DataFrame, top: int = 12) -> DataFrame:
    """Totals of annotated regions by category, per step and as a share of a step; the ``top`` largest."""
    rows = events.where(F.col("cat").isin(categories) & ~F.col("name").startswith(step_prefix))
    totals = rows.groupBy(*by, "cat", "name").agg(F.sum("dur").alias("total"), F.count("*").alias("calls"))
    place = F.row_number().over(Window.partitionBy(*by, "cat").orderBy(F.desc("total"), "name"))
    kept = totals.withColumn("place", place).where(F.col("place") <= top).join(steps, by)
    return kept.select(*by, "cat", "name", "total", "calls", "place", (F.col("total") / F.col("steps")).alias("per_step"), (100 * F.col("total") / F.col("steps") / F.col("step_us")).alias("percent"))


def top_kernels(events: DataFrame, category: str, k: int) -> DataFrame:
    """The k kernels with the most time, over all processes."""
    totals = events.where(F.col("cat") == category).groupBy("pid", "name").agg(F.sum("dur").alias("total"), F.count("*").alias("calls"))
    return totals.orderBy(F.desc("total"), "pid", "name").limit(k)


def sync_stall(events: DataFrame, by: list[str], category: str, marker: str, steps: DataFrame) -> DataFrame:
    """Time and calls per step of runtime calls whose name has a marker."""
    hit = (F.col("cat") == category) & F.col("name").contains(marker)
    sums = events.groupBy(*by).agg(F.sum(F.when(hit, F.col("dur")).otherwise(0)).alias("stall"), F.count(F.when(hit, 1)).alias("calls"))
    return sums.join(steps, by).select(*by, (F.col("stall") / F.col("steps")).alias("stall_per_step"), (F.col("calls") / F.col("steps")).alias("calls_per_step"))


def category_rollup(events: DataFrame) -> DataFrame:
    """Totals by category and name, by category, and over all, in one pass."""
    return events.rollup("cat", "name").agg(F.sum("dur").alias("total"), F.count("*").alias("calls"), F.grouping_id().alias("depth"))


def _leaves(text: str, empty: bool) -> list[tuple[str, str | None, str]]:
    """(path, value, kind) of the leaves of one JSON text, without recursion."""
    try:
        top = json.loads(text)
    except ValueError:
        return [("", text, "invalid")]
    out, todo = [], [("", top)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict) and (value or path == ""):
            todo += [(f"{path}.{name}" if path else name, inner) for name, inner in reversed(value.items())]
        elif not isinstance(value, dict):
            kind = KINDS[type(value)]
            out.append((path, value if kind == "string" else None if kind == "null" else json.dumps(value, separators=(",", ":"), ensure_ascii=False), kind))
        elif empty:
            out.append((path, "{}", "object"))
    return list({leaf[0]: leaf for leaf in out}.values())  # a path that comes twice has its last value


KINDS = {dict: "object", list: "array", str: "string", int: "number", float: "number", bool: "boolean", type(None): "null"}


def flatten(documents: DataFrame, column: str, key: str, empty: bool = True) -> DataFrame:
    """(key, path, value, kind) of the leaves of nested JSON objects of any depth, in one pass.

    Values are told apart by their kind: ``string`` (whatever it looks like),
    ``number``, ``boolean``, ``null``, ``array`` (as JSON) or, with ``empty``, an
    ``object`` without members (``{}``).  A text that is no JSON is one leaf of the
    kind ``invalid``, one that is no object one leaf, both with an empty path; a null
    text has no leaves.
    """
    ship(documents.sparkSession)
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                found = [(i, *leaf) for i, text in enumerate(part.column("text").to_pylist()) if text is not None for leaf in _leaves(text, empty)]
                rows, *columns = zip(*found, strict=True) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.string()) for c in columns]], names=[key, "path", "value", "kind"])

    return documents.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(run, f"`{key}` {kind}, path string, value string, kind string")


def config_diff(old: DataFrame, new: DataFrame, key: str, frozen: tuple[str, ...] = ("model.", "algorithm.name", "lora.")) -> DataFrame:
    """Paths whose values differ between two flattened configurations; absent equals null, 1 equals 1.0 and no string."""
    both = old.select(key, "path", F.col("value").alias("old"), F.col("kind").alias("__a")).join(new.select(key, "path", F.col("value").alias("new"), F.col("kind").alias("__b")), [key, "path"], "full")
    number = (F.col("__a") == "number") & (F.col("__b") == "number")
    absent = F.coalesce("__a", F.lit("null")) == F.coalesce("__b", F.lit("null"))
    same = F.when(number, F.col("old").cast("double") == F.col("new").cast("double")).otherwise(absent & F.col("old").eqNullSafe(F.col("new")))
    clash = F.lit(False)
    for prefix in frozen:
        clash = clash | F.col("path").startswith(prefix)
    return both.where(~same).drop("__a", "__b").withColumn("incompatible", clash)


def layered(defaults: DataFrame, *layers: DataFrame, key: str) -> DataFrame:
    """(key, path, value): each layer's values that are not null win over the layers before."""
    rows = None
    for k, layer in enumerate((defaults, *layers)):
        part = layer.where(F.col("value").isNotNull()).select(key, "path", "value", F.lit(k).alias("__layer"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key, "path").agg(F.max_by("value", "__layer").alias("value"))


def newest_run(runs: DataFrame, experiment: Column, name: str = "name") -> DataFrame:
    """The newest run of each experiment by the time stamp that ends its name.

    The name is the experiment, an underscore and the stamp, nothing else, so
    ``exp`` does not find runs of ``exp_other``.
    """
    stamp = F.regexp_extract(name, r"_(\d{8}_\d{6})$", 1)
    own = F.col(name) == F.concat(experiment, F.lit("_"), stamp)
    return runs.where(own & (stamp != "")).groupBy(experiment.alias("experiment")).agg(F.max_by(name, stamp).alias("run"))


def newest_checkpoint(checkpoints: DataFrame, by: list[str], name: str = "checkpoint") -> DataFrame:
    """The checkpoint with the highest step of each run, by number and not by text."""
    return checkpoints.groupBy(*by).agg(F.max_by(name, F.regexp_extract(name, r"(\d+)$", 1).cast("long")).alias("checkpoint"))


def in_force(steps: DataFrame, changes: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """As-of join: for every step row the latest change at or before it."""
    rows = steps.select(by, at, F.lit(1).alias("__kind"), F.lit(None).cast(changes.schema[value].dataType).alias("__new"), F.struct(*[c for c in steps.columns if c not in (by, at)]).alias("__row"))
    marks = changes.select(by, at, F.lit(0).alias("__kind"), F.col(value).alias("__new"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    both = running(rows.unionByName(marks), [by], [at, "__kind"], {value: Fold("last", F.col("__new"))})
    return both.where("__kind = 1").select(by, at, "__row.*", value)


def name_clashes(files: DataFrame, run: str, path: str) -> DataFrame:
    """Distinct referenced files, with the base names that several paths of a run share."""
    base = F.substring_index(path, "/", -1)
    return files.select(run, path).distinct().groupBy(run, base.alias("base")).agg(F.count("*").alias("paths")).withColumn("clash", F.col("paths") > 1)


def round_table(rounds: DataFrame, by: str, order: str, more: float = 0.01, gain: float = 0.002) -> DataFrame:
    """Rounds with their change since the first, flagged where coverage grew and precision did not."""
    w = Window.partitionBy(by).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rounds.withColumn("d_coverage", F.col("coverage") - F.lag("coverage").over(w)).withColumn("d_precision", F.col("precision") - F.lag("precision").over(w))
    out = out.withColumn("total_coverage", F.last("coverage").over(whole) - F.first("coverage").over(whole)).withColumn("total_precision", F.last("precision").over(whole) - F.first("precision").over(whole))
    return out.withColumn("suspect", F.coalesce((F.col("d_coverage") > more) & (F.col("d_precision") < gain), F.lit(False)))


def trivial_predictor(log: DataFrame, by: str, order: str, accuracy: str, rate: str, window: int, tolerance: float) -> DataFrame:
    """Alarm where the accuracy follows the positive rate over the last ``window`` records."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(1 - window, 0)
    gap = F.avg(F.abs(F.col(accuracy) - F.col(rate))).over(w)
    return log.withColumn("gap", gap).withColumn("alarm", (F.count("*").over(w) == window) & (gap < tolerance))


def matched_age(log: DataFrame, offsets: DataFrame, one: int, other: int) -> DataFrame:
    """Values of two arms at equal age: the step plus the arm's warm-start offset."""
    aged = log.join(F.broadcast(offsets), "arm").withColumn("age", F.col("step") + F.col("offset"))
    left = aged.where(F.col("arm") == one).select("metric", "age", F.col("value").alias("value_a"))
    right = aged.where(F.col("arm") == other).select("metric", "age", F.col("value").alias("value_b"))
    return left.join(right, ["metric", "age"]).withColumn("diff", F.col("value_a") - F.col("value_b"))
