"""Queries on vectors, readers and streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxspark.functions.storage import new_path, stored
from voxspark.functions.workers import ship
from voxspark.operators import artifacts, representation
from voxspark.sources import blocks as block_files
from voxspark.sources import readers, views
from voxspark.streaming import metrics as streams

TRACE_EVENTS = 50_000  # most events in a trace file
MANIFEST_KEYS = 20_000  # keys from which a block of manifests, one for each of 20 runs, is made
BATCHES, LATE = 4, "2 hours"  # of the streams
COPIES = ((29, 1), (31, 0))  # every so many rows come again, so many batches later
HALF = "transform(vec, v -> v * 0.5D)"


def balanced(spark, sf_dir):
    """R-01: Sinkhorn balancing of each label's vectors over 64 prototypes."""
    rows = views.tokens(spark, sf_dir).withColumn("logits", F.expr(HALF))
    out = representation.sinkhorn(rows, ["label"], "vec_id", "logits", 64, 1.0)
    return out.select("label", "vec_id", F.round(F.col("q")[0], 8).alias("q0"), F.round(F.array_max("q"), 8).alias("top"), F.round(representation.total(F.col("q")), 8).alias("total"))


def balanced_masked(spark, sf_dir):
    """R-02: the same over the masked patches of each sample."""
    rows = views.tokens(spark, sf_dir).withColumn("logits", F.expr(HALF)).where("token % 3 <> 0")
    out = representation.sinkhorn(rows, ["sample"], "token", "logits", 64, 0.7)
    return out.select("sample", "token", F.round(F.col("q")[5], 8).alias("q5"))


def _views(spark, sf_dir):
    rows = views.tokens(spark, sf_dir)
    students = representation.mean_vector(rows.withColumn("s", F.col("token") % 4), ["sample", "s"], "vec", 64).withColumnRenamed("vec", "logits")
    teachers = representation.mean_vector(rows.withColumn("t", F.col("token") % 2), ["sample", "t"], "vec", 64)
    return students, teachers.withColumn("probs", F.transform(representation.log_softmax(F.col("vec"), 0.5), lambda v: F.exp(v)))


def view_loss(spark, sf_dir):
    """R-03: cross-entropy between views, with and without equal indices, and their weighted sum."""
    students, teachers = _views(spark, sf_dir)
    both = {"cross": (representation.view_cross_entropy(students, teachers, 0.1, True), 2 / 6), "all": (representation.view_cross_entropy(students, teachers, 0.1, False), 4 / 6)}
    return representation.combined_view_loss(both).select(F.round("loss", 6).alias("loss"))


def patch_loss(spark, sf_dir):
    """R-04: masked-patch cross-entropy, weighted by the masked patches of each view."""
    rows = views.tokens(spark, sf_dir).withColumnRenamed("vec", "logits").withColumn("probs", F.transform(representation.log_softmax(F.col("logits"), 0.5), lambda v: F.exp(v)))
    rows = rows.withColumn("hidden", (F.col("token") * 7 + F.col("sample")) % 5 < F.col("sample") % 3)
    return representation.masked_patch_cross_entropy(rows, "sample", 0.2).select(F.round("loss", 6).alias("loss"))


def neighbours(spark, sf_dir):
    """R-05: the nearest other vector of each, exactly, by a pivot partition."""
    ship(spark)
    return representation.nearest_neighbours(views.tokens(spark, sf_dir), "vec_id", "vec", 512).select(F.col("key").alias("vec_id"), "neighbour", F.round("dot", 6).alias("dot"))


def koleo(spark, sf_dir):
    """R-05: spread of the vectors by nearest neighbours."""
    ship(spark)
    return representation.spread(views.tokens(spark, sf_dir), "vec_id", "vec").select(F.round("spread", 6).alias("spread"))


def approximate(spark, sf_dir):
    """R-05: the nearest other vector in the blocks nearest to each; some may be missed."""
    ship(spark)
    out = representation.approximate_neighbours(views.tokens(spark, sf_dir), "vec_id", "vec")
    return out.select(F.col("key").alias("vec_id"), "neighbour", F.round("dot", 6).alias("dot"))


def refreshed(spark, sf_dir):
    """R-06, R-09: moving average of a vector table and the cosine of old and new."""
    old = views.tokens(spark, sf_dir).select("vec_id", "vec")
    new = old.where("vec_id % 10 <> 0").withColumn("vec", F.transform("vec", lambda v, i: v * (1 + i / 64.0)))
    fresh = artifacts.moving_average(old, new, "vec_id", "vec", 0.9)
    drift = artifacts.cosine_drift(old, fresh, "vec_id", "vec")
    return fresh.join(drift, "vec_id").select("vec_id", F.round(F.col("vec")[63], 6).alias("v63"), F.round("cosine", 6).alias("cosine"))


def pooled(spark, sf_dir):
    """R-08: mean token vector of each sample."""
    out = representation.mean_vector(views.tokens(spark, sf_dir), ["sample"], "vec", 64)
    return out.select("sample", F.round(F.col("vec")[0], 6).alias("v0"), F.round(F.col("vec")[63], 6).alias("v63"))


def blocks(spark, sf_dir):
    """I-04, I-06, I-07: voxels written as blocks by volume, a box of them scanned back."""
    path = new_path(spark, "blocks")
    voxels = views.vox(spark, sf_dir)
    block_files.write_blocks(readers.voxels_to_blocks(voxels, 4, ["img", "label"]), path)
    vols = voxels.select("vol").where("vol % 2 = 1").distinct()
    return readers.scan_box(spark, path, vols, 0, {"x": 1, "y": 0, "z": 2}, {"x": 7, "y": 5, "z": 8}, 4, ["img", "label"]).select(F.col("vol").cast("long").alias("vol"), "x", "y", "z", "img", "label")


def block_source(spark, sf_dir):
    """I-04: the same box through the data source of block files."""
    path = new_path(spark, "blocks")
    block_files.write_blocks(readers.voxels_to_blocks(views.vox(spark, sf_dir), 4, ["img", "label"]), path)
    rows = block_files.read_voxels(spark, path, 4, "img double, label long", level=0, x="1:7", y=":5", z="2:")
    return rows.where("vol % 2 = 1").drop("level")


def pyramid_blocks(spark, sf_dir):
    """I-04: three levels written as blocks, a box of the middle one scanned back."""
    path = new_path(spark, "pyramid")
    voxels = views.pyramid(spark, sf_dir)
    block_files.write_blocks(readers.voxels_to_blocks(voxels, 2, ["img", "label"]), path)
    out = readers.scan_box(spark, path, views.vox(spark, sf_dir).select("vol").distinct(), 1, {"x": 0, "y": 1, "z": 1}, {"x": 3, "y": 4, "z": 3}, 2, ["img", "label"])
    return out.select(F.col("vol").cast("long").alias("vol"), "x", "y", "z", F.round("img", 6).alias("img"), "label")


def buffers(spark, sf_dir):
    """I-01: raw buffers with a shape, decoded to voxels."""
    ship(spark)
    byte = F.expr("unhex(lpad(hex(cast(round(img * 255) as bigint)), 2, '0'))")
    rows = views.vox(spark, sf_dir).withColumn("byte", byte).withColumn("lab", F.expr("unhex(lpad(hex(greatest(label, 0)), 2, '0'))"))
    cells = F.array_sort(F.collect_list(F.struct(F.expr("x * 64 + y * 8 + z").alias("o"), F.hex("byte").alias("b"), F.hex("lab").alias("l"))))
    packed = rows.groupBy("vol").agg(cells.alias("c")).select("vol", F.unhex(F.array_join("c.b", "")).alias("volume"), F.unhex(F.array_join("c.l", "")).alias("label"), F.array(F.lit(8), F.lit(8), F.lit(8)).alias("shape"))
    return readers.buffers_to_voxels(packed)


def _plane(data: bytes):
    import numpy as np

    return np.frombuffer(data, dtype=np.uint8).reshape(-1, 8)


def planes(spark, sf_dir):
    """I-02: encoded planes, decoded by a function of the caller."""
    ship(spark)
    cells = F.array_sort(F.collect_list(F.struct(F.expr("x * 8 + y").alias("o"), F.expr("lpad(hex(cast(round(img * 255) as bigint)), 2, '0')").alias("b"))))
    rows = views.vox(spark, sf_dir).groupBy((F.col("vol") * 8 + F.col("z")).alias("plane")).agg(cells.alias("c"))
    rows = rows.select("plane", F.struct(F.unhex(F.array_join("c.b", "")).alias("bytes"), F.lit(None).cast("string").alias("path")).alias("image"))
    return readers.planes_to_voxels(rows, _plane)


def traces(spark, sf_dir):
    """I-08: trace files written as compressed JSON and read back."""
    path = new_path(spark, "traces")
    events = views.trace(spark, sf_dir)
    e = F.struct("ph", "cat", "name", F.col("ts").cast("double").alias("ts"), F.when(F.col("event_id") % 10 != 0, F.col("dur").cast("double")).alias("dur"), "pid", F.lit(0).cast("long").alias("tid"))
    # the reader takes one document from a file, so each has a folder of its own
    files = events.groupBy((F.col("pid") % 5).alias("part"), F.expr(f"event_id div {TRACE_EVENTS}").alias("block"))
    files.agg(F.collect_list(e).alias("traceEvents")).write.partitionBy("part", "block").option("compression", "gzip").json(path)
    return readers.read_traces(spark, path).groupBy("pid", "cat").agg(F.count("*").alias("n"), F.sum("dur").alias("dur"))


def manifests(spark, sf_dir):
    """I-09: pseudo-label manifests written as JSON and read back, one row for each block."""
    path = new_path(spark, "manifests")
    part = views.table(spark, sf_dir, "part").withColumn("m", F.col("p_partkey") % 20).withColumn("b", F.expr(f"p_partkey div {MANIFEST_KEYS}"))
    box = F.array(*[F.array(F.col("p_partkey") + k, F.col("p_partkey") + k + F.col("p_size")) for k in range(3)])
    block = F.struct(F.col("p_name").alias("block"), (F.col("p_size") / 50).alias("frac_instance"), (F.col("p_size") / 100).alias("frac_ignore"))
    rows = part.groupBy("m", "b").agg(F.array_sort(F.collect_list(F.struct("p_partkey", box.alias("box"), block.alias("block")))).alias("all"))
    rows.select("m", "b", F.col("all.box").alias("bounding_boxes"), F.col("all.block").alias("blocks"), F.lit("round1").alias("label_name"), F.concat(F.lit("run"), "m").alias("run"), F.lit(1000).alias("step"), F.lit(4.0).alias("cc_logit"), F.lit(0.1).alias("tau_bg"), F.lit(0.9).alias("tau_fg"), F.lit(50).alias("min_size")).write.partitionBy("m", "b").json(path)
    out = readers.read_manifests(spark, path)
    return out.select("run", "step", F.col("box")[0][0].alias("x0"), F.col("box")[2][1].alias("z1"), F.round("frac_instance", 6).alias("frac_instance"), F.round("frac_ignore", 6).alias("frac_ignore"))


def reports(spark, sf_dir):
    """I-10: report files of rounds, one JSON object each."""
    path = new_path(spark, "reports")
    rows = views.table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 12).alias("r")).agg(F.count("*").alias("blocks"), F.round(F.avg("p_size") / 50, 6).alias("pair_precision"), F.sum("p_size").alias("merged_pseudo"))
    rows.withColumn("label_name", F.concat(F.lit("round"), "r")).drop("r").repartition(12).write.json(path)
    return readers.read_reports(spark, path).select("label_name", "blocks", "pair_precision", "merged_pseudo")


def scalars(spark, sf_dir):
    """I-12, I-13, I-14: scalars streamed to an idempotent sink, attempt log and mixture, written and read back."""
    path = new_path(spark, "scalars")
    log = views.metric_log(spark, sf_dir).select(F.col("run").cast("string").alias("name"), F.when(F.col("rank") == 0, "val").otherwise("train").alias("phase"), "metric", "step", "value")

    def sink(batch, number):
        streams.commit_batch(batch, number, path, "attempt0")
        streams.commit_batch(batch, number, path, "attempt0")  # delivered again

    streams.fed([log.where(f"step % 3 = {k}") for k in range(3)], lambda stream: stream, sink=sink)
    attempts = new_path(spark, "attempts")
    for commit in ("a1", "b2"):
        readers.append_attempt(spark, attempts, "run0", commit)
    mixture = new_path(spark, "mixture")
    volumes = views.volumes(spark, sf_dir)
    readers.write_mixture(volumes.select("vid", "name", "weight", "origin"), volumes.agg(F.count("*").alias("n")), mixture)
    n_attempts = spark.read.parquet(attempts).agg(F.count("*").alias("attempts"))
    n_volumes = spark.read.json(f"{mixture}/volumes").agg(F.sum("weight").alias("weights"))
    rows = streams.committed(spark, path, log.schema).groupBy(F.col("name").cast("long").alias("run"), "phase")
    out = rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.join(F.broadcast(n_attempts)).join(F.broadcast(n_volumes))


def _arrivals(spark, sf_dir):
    """metric_log with the batch in which each row arrives: by event time, but some rows two batches late.

    The rows of a batch's last tenth are on time, so no late row is near a watermark.
    """
    log = stored(views.metric_log(spark, sf_dir).withColumn("us", F.unix_micros("ts")), "metrics")
    lo, hi = log.agg(F.min("us"), F.max("us")).first()
    place = (F.col("us") - lo) * BATCHES / (hi - lo + 1)
    late = (F.col("event_id") % 41 == 0) & (place - F.floor(place) < 0.9)
    batch = F.least(F.floor(place) + F.when(late, 2).otherwise(0), F.lit(BATCHES - 1))
    return log.withColumn("arrival", batch.cast("int"))


def _batches(rows):
    return [rows.where(F.col("arrival") == k).drop("arrival", "us") for k in range(BATCHES)]


def _closed(rows):
    """The batches and one row of a run -1 that is late enough to close every window."""
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 3650 DAYS")).alias("ts"))
    last = end.where("ts is not null").select(*[F.lit(-1).cast(f.dataType).alias(f.name) if f.name != "ts" else F.col("ts") for f in rows.schema.fields])
    return [*_batches(rows), last.drop("arrival", "us")]


def windows(spark, sf_dir):
    """ST-01: tumbling hours of the metric stream in four batches and four restarts; late rows are dropped."""
    out = streams.fed(_closed(_arrivals(spark, sf_dir)), lambda s: streams.windowed(s, "ts", ["metric"], "1 hour"))
    return out.select("start", "metric", F.round("mean", 6).alias("mean"), "most", "n")


def sliding(spark, sf_dir):
    """ST-01: hours that slide by a quarter."""
    out = streams.fed(_closed(_arrivals(spark, sf_dir)), lambda s: streams.windowed(s, "ts", ["run"], "1 hour", "15 minutes"))
    return out.select("start", "run", F.round("mean", 6).alias("mean"), "most", "n")


def dropped(spark, sf_dir):
    """ST-01: the rows that the watermark drops, kept by a sink of all arrivals."""
    rows, path = _arrivals(spark, sf_dir), new_path(spark, "late")
    batches = _batches(rows)
    streams.fed(batches, lambda s: s, sink=lambda batch, number: streams.commit_batch(batch.withColumnRenamed("run", "of"), number, path, "all", "ts"))
    out = streams.late_rows(spark, path, batches[0].withColumnRenamed("run", "of").schema, "ts", LATE)
    return out.select("event_id", F.col("of").alias("run"), "step", F.col("batch").cast("long").alias("batch"))


def meter(spark, sf_dir):
    """ST-02: a stateful throughput meter for each run, over four batches and restarts; it waits for the late points."""
    arrived = _arrivals(spark, sf_dir)
    lo, hi = arrived.agg(F.min("us"), F.max("us")).first()
    late = f"{2 * (hi - lo) // BATCHES // 1_000_000 + 1} seconds"  # a late row comes two batches after its time
    rows = arrived.where("step % 10 = 0").withColumn("t", F.col("us") / 1e6)
    out = streams.fed(_closed(rows), lambda s: streams.throughput(s.select("run", "step", "t", "ts"), late))
    return out.select("run", "step", F.round("steps_per_s", 9).alias("steps_per_s"))


def attempts(spark, sf_dir):
    """ST-03: runs cut into attempts where nothing came for half an hour; late rows are dropped."""
    return streams.fed(_closed(_arrivals(spark, sf_dir)), lambda s: streams.sessions(s, "ts", ["run"], "30 minutes"))


def deliveries(spark, sf_dir):
    """ST-04: repeated deliveries dropped, those of a later batch too, and with them what comes after the watermark."""
    rows = _arrivals(spark, sf_dir)
    copies = [rows.where(f"event_id % {n} = 0").withColumn("arrival", F.col("arrival") + more) for n, more in COPIES]
    out = streams.fed(_batches(rows.unionByName(copies[0]).unionByName(copies[1])), lambda s: streams.once(s, "ts", ["event_id"], "10 days"))
    return out.select("event_id", "run", "step")


def arriving(spark, sf_dir):
    """ST-05: a confusion table that grows with the volumes that arrive."""
    voxels = views.vox(spark, sf_dir).select("vol", "id", "label", "pred")
    return streams.fed([voxels.where(f"vol % {BATCHES} = {k}") for k in range(BATCHES)], lambda s: streams.confusion(s, "label", "pred"), "complete")


def _sinkhorn_sql(where: str, by: str, key: str, temperature: float, pick: str) -> str:
    out = [f"q0 AS (SELECT {by}, {key}, k, exp(v * 0.5 / {temperature}::DOUBLE) AS q FROM (SELECT {by}, {key}, unnest(vec) AS v, unnest(range(0, 64)) AS k FROM tokens {where})), n AS (SELECT {by}, count(DISTINCT {key}) AS b FROM q0 GROUP BY {by}), p0 AS (SELECT {by}, {key}, k, q / sum(q) OVER (PARTITION BY {by}) AS q FROM q0)"]
    for i in range(3):
        out.append(f"c{i} AS (SELECT {by}, {key}, k, q / sum(q) OVER (PARTITION BY {by}, k) / 64 AS q FROM p{i}), p{i + 1} AS (SELECT c.{by}, {key}, k, q / sum(q) OVER (PARTITION BY c.{by}, {key}) / b AS q FROM c{i} c JOIN n ON n.{by} = c.{by})")
    return f"WITH {', '.join(out)}, z AS (SELECT p.{by}, {key}, k, q * b AS q FROM p3 p JOIN n ON n.{by} = p.{by}) {pick}"


def _on_time(late: str, copies: tuple = ()) -> str:
    """CTE ok: the rows with their batch and the watermark that they meet there."""
    again = "".join([f" UNION ALL SELECT * REPLACE (arrival + {more} AS arrival) FROM a0 WHERE event_id % {n} = 0 AND arrival + {more} < {BATCHES}" for n, more in copies])
    return f"""WITH lim AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM metric_log), p0 AS (SELECT *, (epoch_us(ts) - lo) * {BATCHES} / (hi - lo + 1) AS place FROM metric_log, lim
), a0 AS (SELECT *, least(floor(place)::INT + CASE WHEN event_id % 41 = 0 AND place - floor(place) < 0.9::DOUBLE THEN 2 ELSE 0 END, {BATCHES - 1}) AS arrival FROM p0
), a1 AS (SELECT * FROM a0{again}
), top AS (SELECT arrival, max(ts) AS latest FROM a1 GROUP BY arrival
), marks AS (SELECT b.arrival, coalesce(date_trunc('millisecond', max(t.latest)) - INTERVAL {late}, TIMESTAMP '1970-01-01') AS mark FROM top b LEFT JOIN top t ON t.arrival < b.arrival GROUP BY b.arrival
), ok AS (SELECT a1.*, mark FROM a1 JOIN marks USING (arrival))"""


LSM = "list_transform({v}, lambda q: q / {t}::DOUBLE - ln(list_sum(list_transform({v}, lambda r: exp(r / {t}::DOUBLE)))))"
SOFT = "list_transform({v}, lambda q: exp(q / 0.5::DOUBLE) / list_sum(list_transform({v}, lambda r: exp(r / 0.5::DOUBLE))))"
UNIT = "u AS (SELECT vec_id, list_transform(vec, lambda v: v / sqrt(list_dot_product(vec, vec))) AS u FROM tokens), nn AS (SELECT a.vec_id, arg_max(b.vec_id, list_dot_product(a.u, b.u)) AS neighbour, max(list_dot_product(a.u, b.u)) AS dot FROM u a JOIN u b ON a.vec_id <> b.vec_id GROUP BY a.vec_id)"
MEANS = "long AS (SELECT sample, token, unnest(vec) AS v, unnest(range(0, 64)) AS k FROM tokens)"

QUERIES = {
    "r01_sinkhorn": (balanced, views.sql("tokens", _sinkhorn_sql("", "label", "vec_id", 1.0, "SELECT label, vec_id, round(max(q) FILTER (k = 0), 8) AS q0, round(max(q), 8) AS top, round(sum(q), 8) AS total FROM z GROUP BY label, vec_id"))),
    "r02_sinkhorn_masked": (balanced_masked, views.sql("tokens", _sinkhorn_sql("WHERE token % 3 <> 0", "sample", "token", 0.7, "SELECT sample, token, round(max(q) FILTER (k = 5), 8) AS q5 FROM z GROUP BY sample, token"))),
    "r03_view_cross_entropy": (
        view_loss,
        views.sql(
            "tokens",
            f"""WITH {MEANS}, s AS (SELECT sample, s, list(v ORDER BY k) AS v FROM (SELECT sample, token % 4 AS s, k, avg(v) AS v FROM long GROUP BY 1, 2, 3) GROUP BY sample, s), t AS (SELECT sample, t, list(v ORDER BY k) AS v FROM (SELECT sample, token % 2 AS t, k, avg(v) AS v FROM long GROUP BY 1, 2, 3) GROUP BY sample, t)
, l AS (SELECT sample, s, {LSM.format(v='v', t=0.1)} AS l FROM s), p AS (SELECT sample, t, {SOFT.format(v='v')} AS p FROM t), c AS (SELECT s, t, -list_dot_product(l, p) AS ce FROM l JOIN p USING (sample)), b AS (SELECT count(DISTINCT sample) AS b FROM tokens)
SELECT round((SELECT sum(ce) FROM c WHERE s <> t) / (b * 8 - b * 2) * 2 / 6 + (SELECT sum(ce) FROM c) / (b * 8) * 4 / 6, 6) AS loss FROM b""",
        ),
    ),
    "r04_masked_patch_cross_entropy": (
        patch_loss,
        views.sql("tokens", f"WITH c AS (SELECT sample, -list_dot_product({LSM.format(v='vec', t=0.2)}, {SOFT.format(v='vec')}) AS ce, (token * 7 + sample) % 5 < sample % 3 AS hidden FROM tokens), s AS (SELECT sample, coalesce(sum(ce) FILTER (hidden), 0) / greatest(count(*) FILTER (hidden), 1) AS x FROM c GROUP BY sample) SELECT round(sum(x) / count(*), 6) AS loss FROM s"),
    ),
    "r05_nearest_neighbours": (neighbours, views.sql("tokens", f"WITH {UNIT} SELECT vec_id, neighbour, round(dot, 6) AS dot FROM nn")),
    "r05_spread": (koleo, views.sql("tokens", f"WITH {UNIT} SELECT round(-avg(ln(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.u[i] - b.u[i] + 1e-8) * (a.u[i] - b.u[i] + 1e-8)))) + 1e-8)), 6) AS spread FROM nn JOIN u a ON a.vec_id = nn.vec_id JOIN u b ON b.vec_id = nn.neighbour")),
    "r05_approximate_neighbours": (approximate, None),
    "r06_moving_average": (
        refreshed,
        views.sql("tokens", "WITH f AS (SELECT vec_id, vec, CASE WHEN vec_id % 10 = 0 THEN vec ELSE list_transform(range(1, 65), lambda i: 0.9::DOUBLE * vec[i] + (1 - 0.9::DOUBLE) * vec[i] * (1 + (i - 1) / 64.0::DOUBLE)) END AS n FROM tokens) SELECT vec_id, round(n[64], 6) AS v63, round(list_dot_product(vec, n) / sqrt(list_dot_product(vec, vec) * list_dot_product(n, n)), 6) AS cosine FROM f"),
    ),
    "r08_mean_pooling": (pooled, views.sql("tokens", "SELECT sample, round(avg(vec[1]), 6) AS v0, round(avg(vec[64]), 6) AS v63 FROM tokens GROUP BY sample")),
    "i04_block_scan": (blocks, views.sql("vox", "SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, img, label FROM vox WHERE vol % 2 = 1 AND x BETWEEN 1 AND 6 AND y < 5 AND z >= 2")),
    "i04_block_source": (block_source, views.sql("vox", "SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, img, label FROM vox WHERE vol % 2 = 1 AND x BETWEEN 1 AND 6 AND y < 5 AND z >= 2")),
    "i04_pyramid_scan": (pyramid_blocks, views.sql("pyramid", "SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, round(img, 6) AS img, label FROM pyramid WHERE level = 1 AND x < 3 AND y >= 1 AND z BETWEEN 1 AND 2")),
    "i01_raw_buffers": (buffers, views.sql("vox", "SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, round(img * 255) / 255.0::DOUBLE AS img, greatest(label, 0) AS label FROM vox")),
    "i02_encoded_planes": (planes, views.sql("vox", "SELECT vol * 8 + z AS plane, x::INT AS x, y::INT AS y, round(img * 255) AS img FROM vox")),
    "i08_traces": (traces, views.sql("trace", "SELECT pid, cat, count(*) AS n, sum(dur)::DOUBLE AS dur FROM trace WHERE event_id % 10 <> 0 GROUP BY pid, cat")),
    "i09_manifests": (manifests, "SELECT 'run' || (p_partkey % 20) AS run, 1000::BIGINT AS step, p_partkey AS x0, p_partkey + 2 + p_size AS z1, round(p_size / 50.0::DOUBLE, 6) AS frac_instance, round(p_size / 100.0::DOUBLE, 6) AS frac_ignore FROM part"),
    "i10_reports": (reports, "SELECT 'round' || (p_partkey % 12) AS label_name, count(*) AS blocks, round(avg(p_size) / 50, 6) AS pair_precision, sum(p_size)::BIGINT AS merged_pseudo FROM part GROUP BY p_partkey % 12"),
    "i12_scalar_sink": (scalars, views.sql("metric_log", "SELECT run, CASE WHEN rank = 0 THEN 'val' ELSE 'train' END AS phase, count(*) AS n, round(sum(value), 4) AS total, 2 AS attempts, (SELECT sum(1 + c_custkey % 5)::DOUBLE FROM customer) AS weights FROM metric_log GROUP BY 1, 2")),
    "st01_windows": (windows, views.sql("metric_log", f"{_on_time('2 HOURS')} SELECT date_trunc('hour', ts) AS start, metric, round(avg(value), 6) AS mean, max(value) AS most, count(*) AS n FROM ok WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > mark GROUP BY 1, 2")),
    "st01_sliding": (sliding, views.sql("metric_log", f"{_on_time('2 HOURS')}, s AS (SELECT unnest([0, 15, 30, 45]) AS back), w AS (SELECT *, time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(back) AS start FROM ok, s) SELECT start, run, round(avg(value), 6) AS mean, max(value) AS most, count(*) AS n FROM w WHERE start + INTERVAL 1 HOUR > mark GROUP BY 1, 2")),
    "st01_dropped": (dropped, views.sql("metric_log", f"{_on_time('2 HOURS')} SELECT event_id, run, step, arrival::BIGINT AS batch FROM ok WHERE ts <= mark")),
    "st02_throughput_meter": (meter, views.sql("metric_log", "WITH p AS (SELECT run, step, epoch_us(ts) / 1e6 AS t FROM metric_log WHERE step % 10 = 0), w AS (SELECT run, step, (step - lag(step) OVER w) / (t - lag(t) OVER w) AS r, t - lag(t) OVER w AS s FROM p WINDOW w AS (PARTITION BY run ORDER BY step)) SELECT run, step, round(r, 9) AS steps_per_s FROM w WHERE s > 0")),
    "st03_attempt_sessions": (
        attempts,
        views.sql("metric_log", f"{_on_time('2 HOURS')}, e AS (SELECT run, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY run ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM ok WHERE ts + INTERVAL 30 MINUTES > mark), s AS (SELECT *, sum(fresh) OVER (PARTITION BY run ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS \"end\", run, count(*) AS n FROM s GROUP BY run, k"),
    ),
    "st04_once": (deliveries, views.sql("metric_log", f"{_on_time('10 DAYS', COPIES)} SELECT DISTINCT event_id, run, step FROM ok WHERE ts > mark")),
    "st05_confusion": (arriving, views.sql("vox", "SELECT label AS target, pred AS predicted, count(*) AS n FROM vox WHERE label >= 0 GROUP BY label, pred")),
}
