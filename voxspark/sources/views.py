"""Voxel, score, telemetry and artifact views over the given tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.draws import uniform, uniform_sql
from voxspark.operators.curation import pyramid as coarsen
from voxspark.operators.sampling import number_rows

SIDE = 8
CUBE = SIDE**3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubes of 8 x 8 x 8 voxels made from all ``orders``: intensity and three label columns.

    What the last cube lacks is void: intensity 0, label unknown.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    rest = F.explode(F.expr(f"filter(sequence(n, n + {CUBE - 1}), i -> i < ceil(n / {CUBE}) * {CUBE})")).alias("id")  # no job of its own
    void = orders.agg(F.count("*").alias("n")).select(rest, F.lit(None).cast(orders.schema["o_totalprice"].dataType).alias("o_totalprice"))
    cells = orders.unionByName(void).withColumn("void", F.col("o_totalprice").isNull()).withColumn("o_totalprice", F.coalesce("o_totalprice", F.lit(0))).select(
        F.expr("id div 512").alias("vol"),
        F.lit(0).alias("level"),
        F.expr("cast((id div 64) % 8 as int)").alias("x"),
        F.expr("cast((id div 8) % 8 as int)").alias("y"),
        F.expr("cast(id % 8 as int)").alias("z"),
        "id",
        ((F.floor("o_totalprice") % 256) / F.lit(255.0)).alias("img"),
        (F.floor("o_totalprice") % 3).cast("long").alias("lab_noise"),
        "void",
    )
    blob = F.expr("(x div 3 + y div 3 + z div 3 + vol) % 3").cast("long")
    cells = cells.withColumn("label", F.when(F.col("void") | (F.col("id") % 37 == 0), F.lit(-1).cast("long")).otherwise(blob)).drop("void")
    flip = (uniform(7, "flip", "id") < 0.15) & (F.col("label") >= 0)
    return cells.withColumn("pred", F.when(flip, (F.col("label") + 1) % 3).otherwise(F.col("label")))


def pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cubes at three levels of 8, 4 and 2 voxels an axis; ``id`` is unique over all of them."""
    rows = coarsen(vox(spark, sf_dir), 3, ["img"], ["lab_noise", "label"])
    return rows.withColumn("id", (((F.col("vol") * 8 + F.col("x")) * 8 + F.col("y")) * 8 + F.col("z")) * 4 + F.col("level") + 1)


def scores(voxels: DataFrame, classes: int = 4) -> DataFrame:
    """Long class scores of every voxel."""
    cls = F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("cls")
    return voxels.select("vol", "level", "x", "y", "z", "id", "img", "label", cls).withColumn("score", F.col("img") * (F.col("cls") + 1) - (F.col("x") + F.col("cls")) % 4)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token vectors: 50 tokens for each sample."""
    return table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 50").alias("sample"), (F.col("vec_id") % 50).alias("token"), F.expr("transform(embedding, v -> cast(v as double))").alias("vec"), "label", "vec_id")


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events: process, category, name, start and duration in microseconds."""
    kind = F.create_map(*[F.lit(x) for pair in {"click": "kernel", "view": "gpu_memcpy", "purchase": "user_annotation", "signup": "gpu_user_annotation", "error": "cuda_runtime"}.items() for x in pair])
    events = table(spark, sf_dir, "events")
    return events.select(
        F.lit("X").alias("ph"),
        F.col("user_id").alias("pid"),
        F.col("event_type").alias("name"),
        F.coalesce(kind[F.col("event_type")], F.lit("kernel")).alias("cat"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.floor(F.col("value") * 60_000_000).alias("dur"),
        "event_id",
    )


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric records: run, rank, step, metric, value and time."""
    events = number_rows(table(spark, sf_dir, "events").withColumn("run", F.col("user_id") % 7), ["ts", "event_id"], by=["run"])
    return events.select("run", (F.col("user_id") % 4).alias("rank"), (F.col("row") + 1).alias("step"), F.col("event_type").alias("metric"), "value", F.col("ts").cast("timestamp").alias("ts"), "event_id")


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume descriptors: weight, origin and a path-like name."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("vid"), (1 + F.col("c_custkey") % 5).cast("double").alias("weight"), F.when(F.col("c_custkey") % 4 == 0, "gt").otherwise("pseudo").alias("origin"), F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"), "c_name").alias("name")
    )


def tensors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(checkpoint, model) manifests: tensor name and shape."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("int")
    weight = key % 2 == 0
    block = F.concat(F.lit("model.blocks."), (key % 24).cast("string"), F.lit("."), key.cast("string"), F.when(weight, ".weight").otherwise(".bias"))
    name = F.when(key % 50 == 0, F.concat(F.lit("patch_embed."), key.cast("string"))).otherwise(block)
    part = table(spark, sf_dir, "part").select(key.alias("k"), name.alias("name"), F.when(weight, F.array(size, (1 + key % 7).cast("int"))).otherwise(F.array(size)).alias("shape"))
    odd = F.transform("shape", lambda v, i: F.when((i == 0) & (F.col("k") % 11 == 0), v + 1).otherwise(v))
    return part.where("k % 5 <> 0").select("name", odd.alias("shape")), part.where("k % 3 <> 0").select("name", "shape")


#: the same views for DuckDB, as common table expressions
SQL = {
    "vox": f"""vox0 AS (
  SELECT o_orderkey // 512 AS vol, 0 AS level, (o_orderkey // 64) % 8 AS x, (o_orderkey // 8) % 8 AS y, o_orderkey % 8 AS z, o_orderkey AS id,
    (floor(coalesce(o_totalprice, 0))::BIGINT % 256) / 255.0::DOUBLE AS img, floor(coalesce(o_totalprice, 0))::BIGINT % 3 AS lab_noise, o_totalprice IS NULL AS void
  FROM (SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT unnest(range((SELECT count(*) FROM orders), (SELECT (count(*) + 511) // 512 * 512 FROM orders))), NULL)
), vox1 AS (SELECT * EXCLUDE (void), CASE WHEN void OR id % 37 = 0 THEN -1 ELSE (x // 3 + y // 3 + z // 3 + vol) % 3 END AS label FROM vox0
), vox AS (SELECT *, CASE WHEN label >= 0 AND {uniform_sql(7, "flip", "id")} < 0.15 THEN (label + 1) % 3 ELSE label END AS pred FROM vox1)""",
    "pyramid": """pyramid AS (SELECT *, (((vol * 8 + x) * 8 + y) * 8 + z) * 4 + level + 1 AS id FROM (
  SELECT vol, level, x, y, z, img, lab_noise, label FROM vox UNION ALL
  SELECT vol, l, x // s, y // s, z // s, avg(img), max(lab_noise) FILTER (x % s = 0 AND y % s = 0 AND z % s = 0), max(label) FILTER (x % s = 0 AND y % s = 0 AND z % s = 0) FROM vox, (VALUES (1, 2), (2, 4)) AS p(l, s) GROUP BY vol, l, x // s, y // s, z // s))""",
    "scores": "scores AS (SELECT vol, level, x, y, z, id, img, label, cls, img * (cls + 1) - (x + cls) % 4 AS score FROM vox, (SELECT unnest(range(0, 4)) AS cls))",
    "tokens": "tokens AS (SELECT vec_id // 50 AS sample, vec_id % 50 AS token, embedding::DOUBLE[] AS vec, label, vec_id FROM embeddings)",
    "trace": """trace AS (SELECT 'X' AS ph, user_id AS pid, event_type AS name,
  coalesce(map(['click', 'view', 'purchase', 'signup', 'error'], ['kernel', 'gpu_memcpy', 'user_annotation', 'gpu_user_annotation', 'cuda_runtime'])[event_type], 'kernel') AS cat,
  epoch_us(ts) AS ts, floor(value * 60000000)::BIGINT AS dur, event_id FROM events)""",
    "metric_log": "metric_log AS (SELECT user_id % 7 AS run, user_id % 4 AS rank, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS step, event_type AS metric, value, ts, event_id FROM events)",
    "volumes": "volumes AS (SELECT c_custkey AS vid, (1 + c_custkey % 5)::DOUBLE AS weight, CASE WHEN c_custkey % 4 = 0 THEN 'gt' ELSE 'pseudo' END AS origin, concat_ws('/', c_mktsegment, c_nationkey::VARCHAR, c_name) AS name FROM customer)",
    "tensors": """part0 AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 50 = 0 THEN 'patch_embed.' || p_partkey ELSE 'model.blocks.' || (p_partkey % 24) || '.' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.weight' ELSE '.bias' END END AS name,
  CASE WHEN p_partkey % 2 = 0 THEN [p_size::BIGINT, 1 + p_partkey % 7] ELSE [p_size::BIGINT] END AS shape FROM part
), ckpt AS (SELECT name, CASE WHEN k % 11 = 0 THEN list_concat([shape[1] + 1], shape[2:]) ELSE shape END AS shape FROM part0 WHERE k % 5 <> 0
), model AS (SELECT name, shape FROM part0 WHERE k % 3 <> 0)""",
}
NEEDS = {"scores": ["vox"], "pyramid": ["vox"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """A query over some views, named with spaces between."""
    names: list[str] = []
    for name in views.split():
        names += [n for n in [*NEEDS.get(name, []), name] if n not in names]
    head = ",\n".join(SQL[n] for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}\n{body}"
