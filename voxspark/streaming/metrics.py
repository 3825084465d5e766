"""Structured Streaming over metric records and results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from voxspark.functions.storage import exists, new_path
from voxspark.functions.workers import ship


def windowed(stream: DataFrame, ts: str, by: list[str], width: str, slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Mean, maximum and count in event-time windows; rows later than the watermark are dropped."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = stream.withWatermark(ts, late).groupBy(window.alias("w"), *by).agg(F.avg("value").alias("mean"), F.max("value").alias("most"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *by, "mean", "most", "n")


def sessions(stream: DataFrame, ts: str, by: list[str], gap: str, late: str = "2 hours") -> DataFrame:
    """Attempts: records of a run without a gap between them."""
    out = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def once(stream: DataFrame, ts: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Rows without repeated deliveries."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def confusion(stream: DataFrame, truth: str, pred: str) -> DataFrame:
    """A confusion table that grows with the volumes that arrive."""
    return stream.where(F.col(truth) >= 0).groupBy(F.col(truth).alias("target"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


class Meter(StatefulProcessor):
    """Rates between consecutive log points of a run, in the order of their steps, whatever order they come in.

    State: the last point that was passed on, and the points that wait.  A timer
    fires when the watermark has passed the points of a batch; those are then
    complete and go on in order.  A run that is silent for ``ttl`` ms of event time
    is forgotten, so its next point opens no window.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "step long, t double, at long")
        self.waiting = handle.getListState("waiting", "step long, t double, at long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for frame in rows:
            at = frame["ts"].to_numpy().astype("datetime64[us]").astype("int64")
            self.waiting.appendList(list(zip(frame["step"].tolist(), frame["t"].tolist(), at.tolist(), strict=True)))
            self.handle.registerTimer(int(at.max() // 1000) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs() * 1000
        points = [tuple(p) for p in self.waiting.get()] if self.waiting.exists() else []
        ready, rest, out = sorted(p for p in points if p[2] <= now), [p for p in points if p[2] > now], []
        last = tuple(self.last.get()) if self.last.exists() else None
        for step, t, at in ready:
            if last and at - last[2] < self.ttl * 1000 and step > last[0] and t > last[1]:
                out.append((key[0], step, (step - last[0]) / (t - last[1])))
            last = (step, t, at)
        self.waiting.put(rest) if rest else self.waiting.clear()
        if last and now - last[2] >= self.ttl * 1000:
            self.last.clear()
        elif last:
            self.last.update(last)
            self.handle.registerTimer(last[2] // 1000 + self.ttl)
        yield pd.DataFrame(out, columns=["run", "step", "steps_per_s"])


def throughput(stream: DataFrame, late: str = "2 hours", ttl: int = 365 * 86_400_000) -> DataFrame:
    """Steps a second between log points of a run (run, step, t, ts), by a state for each run."""
    ship(stream.sparkSession)
    keyed = stream.withWatermark("ts", late).groupBy("run")
    return keyed.transformWithStateInPandas(Meter(ttl), "run long, step long, steps_per_s double", "Append", "EventTime")


def commit_batch(batch: DataFrame, number: int, path: str, run: str, ts: str | None = None) -> None:
    """A sink for ``foreachBatch``: each batch of a run is written once.

    Rows go to a folder of their own, then a commit record says how many they are
    and (``ts``) how far their event time goes.  A batch that is delivered again
    writes its folder anew if it was not committed, and nothing if it was.
    """
    spark = batch.sparkSession
    record = f"{path}/commits/run={run}/batch={number}"
    if exists(spark, f"{record}/_SUCCESS"):
        return
    rows = f"{path}/rows/run={run}/batch={number}"
    batch.write.mode("overwrite").parquet(rows)
    written = spark.read.schema(batch.schema).parquet(rows)
    latest = F.max(F.col(ts)) if ts else F.lit(None).cast("timestamp")
    written.agg(F.count("*").alias("n"), latest.alias("latest")).coalesce(1).write.mode("overwrite").parquet(record)


def committed(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """The rows of all committed batches, with their ``run`` and ``batch``."""
    done = commits(spark, path).select("run", "batch")
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    kinds = StructType([*fields.fields, StructField("run", StringType()), StructField("batch", LongType())])
    return spark.read.schema(kinds).parquet(f"{path}/rows").join(F.broadcast(done), ["run", "batch"], "left_semi")  # one row a batch


def commits(spark: SparkSession, path: str) -> DataFrame:
    """The commit table: run, batch, n, latest."""
    return spark.read.schema("n long, latest timestamp, run string, batch long").parquet(f"{path}/commits")


def late_rows(spark: SparkSession, path: str, schema: str | StructType, ts: str, late: str) -> DataFrame:
    """Committed rows that came after the watermark: what an event-time operator with that delay drops.

    The watermark of a batch is the latest event time of the batches before it, in
    whole milliseconds, less the delay.
    """
    before = Window.partitionBy("run").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)  # a row for each batch
    mark = F.date_trunc("millisecond", F.max("latest").over(before)) - F.expr(f"INTERVAL {late}")
    marks = commits(spark, path).select("run", "batch", mark.alias("watermark"))
    return committed(spark, path, schema).join(F.broadcast(marks), ["run", "batch"]).where(F.col(ts) <= F.col("watermark"))


def fed(batches: list[DataFrame], build: Callable[[DataFrame], DataFrame], mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Feed a stream batch by batch and read what it wrote.

    After every batch the query is stopped; the next one starts it again from its
    checkpoint, so state, watermark and offsets are those that were stored.  In
    ``append`` mode the result has all rows that were emitted, in ``complete`` mode
    those of the last batch; with a ``sink`` nothing is read.
    """
    spark = batches[0].sparkSession
    source, path, name = new_path(spark, "arrivals"), new_path(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    out, query = None, None
    try:
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        for batch in batches:
            batch.write.mode("append").parquet(source)
            out = build(spark.readStream.schema(batch.schema).parquet(source))
            writer = out.writeStream.outputMode(mode).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True)
            if sink:
                writer = writer.foreachBatch(sink)
            elif mode == "append":
                writer = writer.format("parquet").option("path", path)
            else:
                writer = writer.foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/{number:06d}"))
            query = writer.start()
            query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    if sink:
        return None
    return spark.read.schema(out.schema).parquet(path if mode == "append" else f"{path}/{query.lastProgress['batchId']:06d}")
