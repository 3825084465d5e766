"""Queries on telemetry and artifacts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxspark.operators import artifacts, telemetry
from voxspark.sources import views

DEPTH = 12  # of the deepest objects in the configurations
DEVICE = ["kernel", "gpu_memcpy"]


def reduced(spark, sf_dir):
    """T-01: metrics over ranks; the worst rank for one of them."""
    log = views.metric_log(spark, sf_dir).withColumn("at", F.expr("step div 8"))
    return telemetry.reduce_ranks(log, ["run", "at"], ["error"]).withColumn("value", F.round("value", 6))


def _seconds(log):
    return log.withColumn("t", F.unix_micros("ts") / 1e6)


def throughput(spark, sf_dir):
    """T-02: rates between log points (every tenth step)."""
    points = _seconds(views.metric_log(spark, sf_dir)).where("step % 10 = 0").select("run", "step", "t")
    out = telemetry.throughput(points, 8.0, 2.0, F.when(F.col("run") % 2 == 0, 10.0))
    return out.select("run", "step", *[F.round(c, 9).alias(c) for c in ("samples_per_s", "tflops", "mfu")])


def waits(spark, sf_dir):
    """T-03: share of each log window spent waiting; validation is in no window."""
    log = _seconds(views.metric_log(spark, sf_dir))
    return telemetry.input_wait(log, "error", "click", "signup").select("run", F.col("window").cast("long").alias("window"), F.round("waited", 6).alias("waited"), F.round("wall", 6).alias("wall"), F.round("fraction", 6).alias("fraction"))


def busy(spark, sf_dir):
    """T-04: busy and idle time of every process."""
    return telemetry.busy_time(telemetry.spans(views.trace(spark, sf_dir)), ["pid"])


def _steps(spark, sf_dir):
    return telemetry.step_statistics(telemetry.spans(views.trace(spark, sf_dir)), ["pid"], "purchase", "user_annotation", DEVICE)


def step_stats(spark, sf_dir):
    """T-05: step markers of every process, else the device window."""
    return _steps(spark, sf_dir).select("pid", "steps", F.round("step_us", 3).alias("step_us"))


def region_totals(spark, sf_dir):
    """T-06: annotated regions, per step and in percent of a step."""
    rows = telemetry.regions(telemetry.spans(views.trace(spark, sf_dir)), ["pid"], ["user_annotation", "gpu_user_annotation"], "purchase", _steps(spark, sf_dir))
    return rows.select("pid", "cat", "name", "total", "calls", F.round("per_step", 3).alias("per_step"), F.round("percent", 6).alias("percent"))


def kernels(spark, sf_dir):
    """T-07: the twelve kernels with the most time."""
    return telemetry.top_kernels(telemetry.spans(views.trace(spark, sf_dir)), "kernel", 12)


def stalls(spark, sf_dir):
    """T-07: synchronisation stalls of every process."""
    out = telemetry.sync_stall(telemetry.spans(views.trace(spark, sf_dir)), ["pid"], "cuda_runtime", "err", _steps(spark, sf_dir))
    return out.select("pid", F.round("stall_per_step", 3).alias("stall_per_step"), F.round("calls_per_step", 6).alias("calls_per_step"))


def categories(spark, sf_dir):
    """T-07: totals by category and name with their marginals."""
    return telemetry.category_rollup(telemetry.spans(views.trace(spark, sf_dir)))


def _configs(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    deep = '{"a":' * DEPTH + '{"end":%d}' + "}" * DEPTH
    text = F.format_string(
        '{"model":{"depth":%d,"heads":"%d"},"lora":{"rank":%d.0,"targets":[1,{"x":%d}]},"train":{"opt":{"lr":%d,"warm":true},"init":{},"mask":"{not json %d","like":"{\\"a\\":1}","seed":null},"deep":' + deep + "%s}",
        *[F.col(c) % n for c, n in (("c_nationkey", 4), ("c_nationkey", 3), ("c_custkey", 2), ("c_custkey", 6), ("c_custkey", 5), ("c_custkey", 7), ("c_custkey", 9))],
        F.when(F.col("c_custkey") % 3 == 0, ',"note":"x"').otherwise(""),
    )
    return c.select("c_custkey", text.alias("config"))


def flattened(spark, sf_dir):
    """T-08: nested configurations as dotted paths."""
    return telemetry.flatten(_configs(spark, sf_dir), "config", "c_custkey")


def diffs(spark, sf_dir):
    """T-08: each configuration against the one before."""
    rows = telemetry.flatten(_configs(spark, sf_dir), "config", "c_custkey", empty=False)
    return telemetry.config_diff(rows, rows.withColumn("c_custkey", F.col("c_custkey") + 1), "c_custkey")


def layers(spark, sf_dir):
    """I-11: defaults, then a file, then inline values; nulls do not win."""
    c = views.table(spark, sf_dir, "customer").select("c_custkey")
    paths = F.explode(F.array(F.lit("lr"), F.lit("size"), F.lit("seed"))).alias("path")
    base = c.select("c_custkey", paths).withColumn("value", F.lit("default"))
    file = c.where("c_custkey % 2 = 0").select("c_custkey", paths).withColumn("value", F.when(F.col("path") != "seed", F.concat(F.lit("file"), F.col("c_custkey") % 7)))
    inline = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit("lr").alias("path"), F.when(F.col("c_custkey") % 2 == 0, "inline").alias("value"))
    return telemetry.layered(base, file, inline, key="c_custkey")


def _runs(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    experiment = F.concat(F.lit("exp"), F.when(F.col("o_custkey") % 3 == 0, "_other").otherwise(""), F.lit("_"), F.col("o_custkey") % 11)
    stamp = F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"))
    return o.select("o_orderkey", experiment.alias("exp"), F.concat_ws("_", experiment, stamp).alias("name"), F.concat(F.lit("step_"), F.col("o_orderkey").cast("string")).alias("checkpoint"))


def newest(spark, sf_dir):
    """T-09: the newest run of every experiment and its last checkpoint by number."""
    runs = _runs(spark, sf_dir)
    last = telemetry.newest_checkpoint(runs, ["exp"]).withColumnRenamed("exp", "experiment")
    return telemetry.newest_run(runs, F.col("exp")).join(last, "experiment")


def as_of(spark, sf_dir):
    """T-09: the value in force at each step: the last purchase at or before it."""
    log = views.metric_log(spark, sf_dir)
    changes = log.where("metric = 'purchase'").select("run", "step", F.col("event_id").alias("change"))
    return telemetry.in_force(log.select("run", "step", "metric"), changes, "run", "step", "change")


def clashes(spark, sf_dir):
    """T-10: base names that several files of one run share."""
    files = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.concat_ws("/", F.lit("cfg"), (F.col("l_partkey") % 3).cast("string"), F.concat(F.lit("f"), F.col("l_partkey") % 50, F.lit(".toml"))).alias("path"))
    return telemetry.name_clashes(files, "run", "path")


def provenance(spark, sf_dir):
    """T-11: blocks, first setting and mean fractions of each round."""
    part = views.table(spark, sf_dir, "part").withColumn("round", F.col("p_partkey") % 9)
    return part.groupBy("round").agg(F.count("*").alias("blocks"), F.min_by("p_name", "p_partkey").alias("first_name"), F.bround(F.avg(F.col("p_size") / 50.0), 4).alias("frac_instance"))


def rounds(spark, sf_dir):
    """T-12: rounds with their changes and a flag."""
    events = views.table(spark, sf_dir, "events").withColumn("round", F.dayofmonth("ts"))
    table = events.groupBy("event_type", "round").agg(F.avg(F.col("value") / 500).alias("coverage"), F.avg(F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0)).alias("precision"))
    out = telemetry.round_table(table, "event_type", "round")
    return out.select("event_type", "round", *[F.round(c, 6).alias(c) for c in ("d_coverage", "d_precision", "total_coverage", "total_precision")], "suspect")


def alarms(spark, sf_dir):
    """T-13: accuracy that follows the positive rate over eight records."""
    log = views.metric_log(spark, sf_dir).withColumn("acc", F.col("value") / 500).withColumn("rate", (F.col("event_id") % 100) / 100.0)
    return telemetry.trivial_predictor(log, "run", "step", "acc", "rate", 8, 0.35).select("run", "step", F.round("gap", 9).alias("gap"), "alarm")


def ages(spark, sf_dir):
    """T-14: two arms compared at equal age."""
    log = views.metric_log(spark, sf_dir).groupBy(F.col("run").alias("arm"), F.expr("step div 4").alias("step"), "metric").agg(F.avg("value").alias("value"))
    offsets = log.select("arm").distinct().withColumn("offset", F.col("arm") * 5)
    return telemetry.matched_age(log, offsets, 1, 2).select("metric", "age", F.round("diff", 6).alias("diff"))


def reconciled(spark, sf_dir):
    """W-01: every tensor of checkpoint and model with its status."""
    ckpt, model = views.tensors(spark, sf_dir)
    return artifacts.reconcile(ckpt, model.withColumn("name", F.regexp_replace("name", "^model\\.", "")), "model.", ("blocks.7.",))


def groups(spark, sf_dir):
    """W-05: parameter groups by learning rate and weight decay."""
    _, model = views.tensors(spark, sf_dir)
    return artifacts.group_sizes(artifacts.parameter_groups(model, 24, 0.8, 1e-3, 0.05))


def trainable(spark, sf_dir):
    """W-06, W-07: what trains and why, in elements and percent."""
    _, model = views.tensors(spark, sf_dir)
    out = artifacts.trainable_report(model, {"stem": r"^patch_embed\.", "norm": r"\.bias$", "adapter": r"blocks\.(3|5)\."})
    return out.select("reason", "tensors", "elements", F.round("percent", 6).alias("percent"))


def peaks(spark, sf_dir):
    """W-08: device peaks by ordered substring rules."""
    rules = spark.createDataFrame([(0, "H200", 989.0), (1, "H100 PCIE", 756.0), (2, "H100", 989.0), (3, "T4", None)], "priority int, pattern string, peak double")
    names = F.array(*[F.lit(x) for x in ("nvidia h100-pcie", "NVIDIA H100 80GB", "nvidia_h200", "Tesla T4", "abacus")])
    devices = views.table(spark, sf_dir, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 5).cast("int")).alias("device"))
    return artifacts.device_peaks(devices, rules)


def schedules(spark, sf_dir):
    """W-09: planned values at every logged step beside what was logged."""
    log = views.metric_log(spark, sf_dir)
    s = F.col("step")
    planned = artifacts.warmup(s, 100) * artifacts.decayed(s, "cosine", 100, 1200, 0.1)
    return log.select(
        "run", "step", F.round(planned, 9).alias("lr"), F.round(artifacts.decayed(s, "linear", 100, 1200, 0.1), 9).alias("linear"), F.round(artifacts.cosine_between(s, 1200, 0.04, 0.4), 9).alias("wd"), F.round(artifacts.linear_between(s, 300, 0.04, 0.07), 9).alias("temperature"), (F.abs(F.col("value") / 500 - planned) > 0.5).alias("deviates")
    )


STEP_SQL = "st AS (SELECT pid, greatest(count(*) FILTER (name LIKE 'purchase%' AND cat = 'user_annotation'), 1) AS steps, coalesce(avg(dur) FILTER (name LIKE 'purchase%' AND cat = 'user_annotation'), max(ts + dur) FILTER (cat IN ('kernel', 'gpu_memcpy')) - min(ts) FILTER (cat IN ('kernel', 'gpu_memcpy'))) AS step_us FROM trace GROUP BY pid)"
LEAVES = f"""leaves AS (SELECT c_custkey, unnest(paths) AS path, unnest(vals) AS value, unnest(kinds) AS kind FROM (SELECT c_custkey,
 ['model.depth', 'model.heads', 'lora.rank', 'lora.targets', 'train.opt.lr', 'train.opt.warm', 'train.mask', 'train.like', 'train.seed', 'deep.{"a." * DEPTH}end', 'train.init'] AS paths,
 [(c_nationkey % 4)::VARCHAR, (c_nationkey % 3)::VARCHAR, (c_custkey % 2) || '.0', '[1,{{"x":' || (c_custkey % 6) || '}}]', (c_custkey % 5)::VARCHAR, 'true', '{{not json ' || (c_custkey % 7), '{{"a":1}}', NULL, (c_custkey % 9)::VARCHAR, '{{}}'] AS vals,
 ['number', 'string', 'number', 'array', 'number', 'boolean', 'string', 'string', 'null', 'number', 'object'] AS kinds FROM customer) UNION ALL SELECT c_custkey, 'note', 'x', 'string' FROM customer WHERE c_custkey % 3 = 0)"""
RUNS = "runs AS (SELECT o_orderkey, 'exp' || CASE WHEN o_custkey % 3 = 0 THEN '_other' ELSE '' END || '_' || (o_custkey % 11) AS exp, strftime(o_orderdate, '%Y%m%d') || '_' || lpad((o_orderkey % 240000)::VARCHAR, 6, '0') AS stamp FROM orders)"

QUERIES = {
    "t01_reduce_ranks": (reduced, views.sql("metric_log", "SELECT run, step // 8 AS at, metric, round(CASE WHEN metric = 'error' THEN max(value) ELSE avg(value) END, 6) AS value FROM metric_log GROUP BY run, step // 8, metric")),
    "t02_throughput": (
        throughput,
        views.sql(
            "metric_log",
            "WITH p AS (SELECT run, step, epoch_us(ts) / 1e6 AS t FROM metric_log WHERE step % 10 = 0), w AS (SELECT run, step, (step - lag(step) OVER w) / (t - lag(t) OVER w) AS r, t - lag(t) OVER w AS s FROM p WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, step, round(8 * r, 9) AS samples_per_s, round(2 * r, 9) AS tflops, CASE WHEN run % 2 = 0 THEN round(2 * r / 10, 9) END AS mfu FROM w WHERE s > 0",
        ),
    ),
    "t03_input_wait": (
        waits,
        views.sql(
            "metric_log",
            """WITH r AS (SELECT *, epoch_us(ts) / 1e6 AS t, coalesce(sum((metric IN ('error', 'signup'))::INT) OVER w, 0) AS win, max(CASE WHEN metric IN ('error', 'signup') THEN epoch_us(ts) / 1e6 END) OVER w AS opened FROM metric_log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
, e AS (SELECT run, win, coalesce(sum(value) FILTER (metric = 'click'), 0) AS waited, max(t) FILTER (metric = 'error') AS closed, min(opened) AS opened FROM r GROUP BY run, win)
SELECT run, win::BIGINT AS "window", round(waited, 6) AS waited, round(closed - opened, 6) AS wall, round(waited / greatest(closed - opened, 1e-9), 6) AS fraction FROM e WHERE closed IS NOT NULL AND opened IS NOT NULL""",
        ),
    ),
    "t04_busy_time": (
        busy,
        views.sql(
            "trace",
            'WITH r AS (SELECT pid, ts, ts + dur AS e, max(ts + dur) OVER (PARTITION BY pid ORDER BY ts, ts + dur ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM trace), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts > reach THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY ts, e ROWS UNBOUNDED PRECEDING) AS k FROM r), s AS (SELECT pid, k, min(ts) AS a, max(e) AS b FROM i GROUP BY pid, k) SELECT pid, sum(b - a)::BIGINT AS busy, max(b) - min(a) AS "window", (max(b) - min(a) - sum(b - a))::BIGINT AS idle FROM s GROUP BY pid',
        ),
    ),
    "t05_step_statistics": (step_stats, views.sql("trace", f"WITH {STEP_SQL} SELECT pid, steps, round(step_us, 3) AS step_us FROM st")),
    "t06_regions": (
        region_totals,
        views.sql(
            "trace",
            f"WITH {STEP_SQL}, g AS (SELECT pid, cat, name, sum(dur)::BIGINT AS total, count(*) AS calls FROM trace WHERE cat IN ('user_annotation', 'gpu_user_annotation') AND name NOT LIKE 'purchase%' GROUP BY pid, cat, name), k AS (SELECT *, row_number() OVER (PARTITION BY pid, cat ORDER BY total DESC, name) AS place FROM g) SELECT pid, cat, name, total, calls, round(total / steps, 3) AS per_step, round(100 * total / steps / step_us, 6) AS percent FROM k JOIN st USING (pid) WHERE place <= 12",
        ),
    ),
    "t07_top_kernels": (kernels, views.sql("trace", "SELECT pid, name, sum(dur)::BIGINT AS total, count(*) AS calls FROM trace WHERE cat = 'kernel' GROUP BY pid, name ORDER BY total DESC, pid, name LIMIT 12")),
    "t07_sync_stall": (
        stalls,
        views.sql("trace", f"WITH {STEP_SQL}, s AS (SELECT pid, coalesce(sum(dur) FILTER (cat = 'cuda_runtime' AND contains(name, 'err')), 0) AS stall, count(*) FILTER (cat = 'cuda_runtime' AND contains(name, 'err')) AS calls FROM trace GROUP BY pid) SELECT pid, round(stall / steps, 3) AS stall_per_step, round(calls / steps, 6) AS calls_per_step FROM s JOIN st USING (pid)"),
    ),
    "t07_category_rollup": (categories, views.sql("trace", "SELECT cat, name, sum(dur)::BIGINT AS total, count(*) AS calls, grouping(cat, name) AS depth FROM trace GROUP BY ROLLUP (cat, name)")),
    "t08_flatten": (flattened, f"WITH {LEAVES} SELECT c_custkey, path, value, kind FROM leaves"),
    "t08_config_diff": (
        diffs,
        f"WITH {LEAVES}, filled AS (SELECT * FROM leaves WHERE kind <> 'object') SELECT coalesce(a.c_custkey, b.c_custkey + 1) AS c_custkey, coalesce(a.path, b.path) AS path, a.value AS old, b.value AS new, coalesce(a.path, b.path) LIKE 'model.%' OR coalesce(a.path, b.path) LIKE 'lora.%' OR coalesce(a.path, b.path) LIKE 'algorithm.name%' AS incompatible FROM filled a FULL JOIN filled b ON a.c_custkey = b.c_custkey + 1 AND a.path = b.path WHERE a.value IS DISTINCT FROM b.value",
    ),
    "i11_layers": (
        layers,
        "WITH p AS (SELECT c_custkey, unnest(['lr', 'size', 'seed']) AS path FROM customer) SELECT c_custkey, path, CASE WHEN path = 'lr' AND c_custkey % 6 = 0 THEN 'inline' WHEN c_custkey % 2 = 0 AND path <> 'seed' THEN 'file' || (c_custkey % 7) ELSE 'default' END AS value FROM p",
    ),
    "t09_newest": (newest, f"WITH {RUNS} SELECT exp AS experiment, exp || '_' || max(stamp) AS run, 'step_' || max(o_orderkey) AS checkpoint FROM runs GROUP BY exp"),
    "t09_in_force": (as_of, views.sql("metric_log", "SELECT l.run, l.step, l.metric, c.event_id AS change FROM metric_log l ASOF LEFT JOIN (SELECT * FROM metric_log WHERE metric = 'purchase') c ON l.run = c.run AND l.step >= c.step")),
    "t10_name_clashes": (clashes, "WITH f AS (SELECT DISTINCT l_suppkey AS run, l_partkey % 3 AS d, 'f' || (l_partkey % 50) || '.toml' AS base FROM lineitem) SELECT run, base, count(*) AS paths, count(*) > 1 AS clash FROM f GROUP BY run, base"),
    "t11_provenance": (provenance, "SELECT p_partkey % 9 AS round, count(*) AS blocks, arg_min(p_name, p_partkey) AS first_name, round_even(avg(p_size / 50.0::DOUBLE), 4) AS frac_instance FROM part GROUP BY 1"),
    "t12_rounds": (
        rounds,
        """WITH t AS (SELECT event_type, dayofmonth(ts)::INT AS round, avg(value / 500) AS c, avg(CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS p FROM events GROUP BY 1, 2), w AS (SELECT *, c - lag(c) OVER o AS dc, p - lag(p) OVER o AS dp, last(c) OVER a - first(c) OVER a AS tc, last(p) OVER a - first(p) OVER a AS tp FROM t WINDOW o AS (PARTITION BY event_type ORDER BY round), a AS (PARTITION BY event_type ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT event_type, round, round(dc, 6) AS d_coverage, round(dp, 6) AS d_precision, round(tc, 6) AS total_coverage, round(tp, 6) AS total_precision, coalesce(dc > 0.01 AND dp < 0.002, false) AS suspect FROM w""",
    ),
    "t13_trivial_predictor": (
        alarms,
        views.sql("metric_log", "SELECT run, step, round(avg(abs(value / 500 - (event_id % 100) / 100.0::DOUBLE)) OVER w, 9) AS gap, count(*) OVER w = 8 AND avg(abs(value / 500 - (event_id % 100) / 100.0::DOUBLE)) OVER w < 0.35 AS alarm FROM metric_log WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"),
    ),
    "t14_matched_age": (ages, views.sql("metric_log", "WITH l AS (SELECT run, step // 4 AS step, metric, avg(value) AS v FROM metric_log GROUP BY 1, 2, 3) SELECT a.metric, a.step + 5 AS age, round(a.v - b.v, 6) AS diff FROM l a JOIN l b ON a.run = 1 AND b.run = 2 AND a.metric = b.metric AND a.step + 5 = b.step + 10")),
    "w01_reconcile": (
        reconciled,
        views.sql(
            "tensors",
            """WITH m AS (SELECT regexp_replace(name, '^model\\.', '') AS name, shape FROM model), c AS (SELECT substr(name, 7) AS name, shape FROM ckpt WHERE name LIKE 'model.%')
SELECT coalesce(m.name, c.name) AS name, CASE WHEN coalesce(m.name, c.name) LIKE 'blocks.7.%' THEN 'skipped' WHEN m.name IS NULL THEN 'unused' WHEN c.name IS NULL THEN 'kept_initial' WHEN m.shape = c.shape THEN 'copied' WHEN len(c.shape) = 4 AND len(m.shape) = 5 AND c.shape[1:2] = m.shape[1:2] THEN 'inflated' ELSE 'mismatched' END AS status FROM m FULL JOIN c ON m.name = c.name UNION ALL SELECT name, 'dropped' FROM ckpt WHERE name NOT LIKE 'model.%'""",
        ),
    ),
    "w05_parameter_groups": (
        groups,
        views.sql(
            "tensors",
            """WITH d AS (SELECT *, CASE WHEN regexp_extract(name, 'blocks\\.(\\d+)\\.', 1) <> '' THEN regexp_extract(name, 'blocks\\.(\\d+)\\.', 1)::INT + 1 WHEN contains(name, 'patch_embed.') THEN 0 ELSE 25 END AS depth FROM model)
SELECT round(1e-3::DOUBLE * pow(0.8::DOUBLE, 25 - depth), 12) AS lr, CASE WHEN len(shape) < 2 THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS wd, count(*) AS tensors, sum(list_product(shape))::BIGINT AS elements FROM d GROUP BY 1, 2""",
        ),
    ),
    "w06_trainable": (
        trainable,
        views.sql("tensors", "WITH r AS (SELECT CASE WHEN name LIKE 'patch_embed.%' THEN 'stem' WHEN name LIKE '%.bias' THEN 'norm' WHEN regexp_matches(name, 'blocks\\.(3|5)\\.') THEN 'adapter' ELSE 'frozen' END AS reason, list_product(shape)::BIGINT AS n FROM model) SELECT reason, count(*) AS tensors, sum(n)::BIGINT AS elements, round(100 * sum(n) / (SELECT sum(n) FROM r), 6) AS percent FROM r GROUP BY reason"),
    ),
    "w08_device_peaks": (
        peaks,
        """SELECT c_custkey, (['nvidia h100-pcie', 'NVIDIA H100 80GB', 'nvidia_h200', 'Tesla T4', 'abacus'])[c_custkey % 5 + 1] AS device, ([756.0::DOUBLE, 989.0::DOUBLE, 989.0::DOUBLE, NULL, NULL])[c_custkey % 5 + 1] AS peak, ([1, 2, 0, 3, NULL])[c_custkey % 5 + 1] AS rule, ([NULL, NULL, NULL, 'no such precision', 'unknown device'])[c_custkey % 5 + 1] AS reason FROM customer""",
    ),
    "w09_schedules": (
        schedules,
        views.sql(
            "metric_log",
            """WITH s AS (SELECT *, least((step + 1) / 100.0::DOUBLE, 1) * (0.1::DOUBLE + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((step - 100) / 1100.0::DOUBLE, 0), 1)))) AS lr FROM metric_log)
SELECT run, step, round(lr, 9) AS lr, round(1 - least(greatest((step - 100) / 1100.0::DOUBLE, 0), 1) * 0.9::DOUBLE, 9) AS linear, round(0.4::DOUBLE - 0.36 * 0.5 * (1 + cos(pi() * least(step / 1200.0::DOUBLE, 1))), 9) AS wd, round(0.04::DOUBLE + 0.03::DOUBLE * least(step / 300.0::DOUBLE, 1), 9) AS temperature, abs(value / 500 - lr) > 0.5 AS deviates FROM s""",
        ),
    ),
}
