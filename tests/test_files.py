"""Written files stay small however many rows there are."""

from pyspark.sql import functions as F

from voxspark.plans import vectors
from voxspark.sources import readers


def written(monkeypatch, tmp_path):
    monkeypatch.setattr(vectors, "new_path", lambda spark, name: f"{tmp_path}/{name}")


def test_trace_files_grow_in_number(spark, tmp_path, monkeypatch):
    written(monkeypatch, tmp_path)
    kinds = F.array(*map(F.lit, ["click", "view", "error"]))
    spark.range(400_000).select(F.col("id").alias("event_id"), (F.col("id") % 37).alias("user_id"), kinds[(F.col("id") % 3).cast("int")].alias("event_type"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    rows = vectors.traces(spark, str(tmp_path)).collect()
    assert sum(r.n for r in rows) == 360_000 and len(rows) == 37 * 3
    files = spark.read.schema(readers.TRACE).json(f"{tmp_path}/traces", multiLine=True).select(F.size("traceEvents").alias("n"))
    assert files.count() >= 8 and files.agg(F.max("n")).first()[0] <= 50_000 and files.agg(F.sum("n")).first()[0] == 400_000


def test_manifests_grow_in_number(spark, tmp_path, monkeypatch):
    written(monkeypatch, tmp_path)
    spark.range(50_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("p"), "id").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    rows = vectors.manifests(spark, str(tmp_path)).select("run", "x0").collect()
    assert sorted(r.x0 for r in rows) == list(range(50_000)) and all(r.run == f"run{r.x0 % 20}" for r in rows)
    files = spark.read.schema(readers.MANIFEST).json(f"{tmp_path}/manifests", multiLine=True).select(F.size("blocks").alias("n"))
    assert files.count() == 60 and files.agg(F.max("n")).first()[0] <= 1000
