"""Readers and writers: raw buffers, encoded images, blocks, traces, manifests, reports, logs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxspark.sources.blocks import in_ranges

TRACE = "traceEvents array<struct<ph:string,cat:string,name:string,ts:double,dur:double,pid:long,tid:long>>"
MANIFEST = "bounding_boxes array<array<array<long>>>, blocks array<struct<block:string,frac_instance:double,frac_ignore:double>>, label_name string, run string, step long, cc_logit double, tau_bg double, tau_fg double, min_size long"
REPORT = "label_name string, blocks long, pair_precision double, pair_recall double, frac_instance double, frac_ignore double, merged_pseudo long, split_gt long, boundary_enrichment double, teacher_run string, teacher_step long"


def buffers_to_voxels(rows: DataFrame, key: str = "vol") -> DataFrame:
    """Voxels of rows that hold uint8 buffers ``volume`` and ``label`` and a ``shape`` of three, row-major."""
    if missing := [c for c in ("volume", "label", "shape") if c not in rows.columns]:
        raise ValueError(f"no column {', '.join(missing)} for raw buffers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for vol, volume, label, shape in zip(*(batch.column(c).to_pylist() for c in (key, "volume", "label", "shape")), strict=True):
                image, ids = np.frombuffer(volume, dtype=np.uint8), np.frombuffer(label, dtype=np.uint8)
                if len(image) != np.prod(shape) or len(ids) != len(image):
                    raise ValueError(f"buffers of {len(image)} and {len(ids)} bytes do not have the shape {shape}")
                x, y, z = np.unravel_index(np.arange(len(image)), shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(image), vol, dtype=np.int64)), *(pa.array(c.astype(np.int32)) for c in (x, y, z)), pa.array(image / 255.0), pa.array(ids.astype(np.int64))], names=["vol", "x", "y", "z", "img", "label"])

    return rows.select(key, "volume", "label", "shape").mapInArrow(run, "vol long, x int, y int, z int, img double, label long")


def planes_to_voxels(rows: DataFrame, decode: Callable[[bytes], np.ndarray], key: str = "plane") -> DataFrame:
    """Pixels of encoded planes (``image.bytes``), decoded in the tasks by a function of the caller."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist(), strict=True):
                plane = np.asarray(decode(data), dtype=np.float64)
                x, y = np.unravel_index(np.arange(plane.size), plane.shape)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(plane.size, name, dtype=np.int64)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(plane.reshape(-1))], names=["plane", "x", "y", "img"])

    return rows.select(F.col(key).alias("key"), F.col("image.bytes").alias("data")).mapInArrow(run, "plane long, x int, y int, img double")


def voxels_to_blocks(voxels: DataFrame, side: int, values: list[str]) -> DataFrame:
    """One row for each block: origin and its values in row-major order."""
    block = [F.expr(f"{a} div {side}").cast("int").alias(f"b{a}") for a in "xyz"]
    offset = (F.col("x") % side) * side * side + (F.col("y") % side) * side + F.col("z") % side
    rows = voxels.select("vol", "level", *block, offset.cast("int").alias("o"), *values).groupBy("vol", "level", "bx", "by", "bz")
    cells = F.array_sort(F.collect_list(F.struct("o", *values)))
    out = rows.agg(cells.alias("cells"))
    return out.select("vol", "level", "bx", "by", "bz", *[F.col(f"cells.{v}").alias(v) for v in values])


def blocks_to_voxels(blocks: DataFrame, side: int, values: list[str]) -> DataFrame:
    """The voxels of full blocks."""
    rows = blocks.select("vol", "level", "bx", "by", "bz", F.posexplode(F.arrays_zip(*values)).alias("o", "c"))
    place = {"x": F.expr(f"o div {side * side}"), "y": F.expr(f"(o div {side}) % {side}"), "z": F.col("o") % side}
    return rows.select("vol", "level", *[(F.col(f"b{a}") * side + place[a]).cast("int").alias(a) for a in "xyz"], *[F.col(f"c.{v}").alias(v) for v in values])


def scan_box(spark: SparkSession, path: str, vols: DataFrame, level: int, lo: dict[str, int], hi: dict[str, int], side: int, values: list[str]) -> DataFrame:
    """Voxels of a box of some volumes, a table with a row for each ``vol``: folders, then row groups by ranges of keys, then rows are pruned."""
    near = spark.read.parquet(path).where((F.col("level") == level) & in_ranges(lo, hi, side))
    found = near.where("vol is null").drop("vol").withColumnRenamed("block_vol", "vol").join(vols.select(F.col("vol").cast("long")), "vol", "left_semi")
    folder = near.schema["vol"].dataType
    if not isinstance(folder, T.NullType):  # some volumes have folders of their own
        own = near.where("vol is not null").drop("block_vol").join(vols.select(F.col("vol").try_cast(folder).alias("vol")), "vol", "left_semi")
        found = found.unionByName(own.withColumn("vol", F.col("vol").cast("long")))
    inside = F.lit(True)
    for a in lo:
        inside = inside & (F.col(a) >= lo[a]) & (F.col(a) < hi[a])
    return blocks_to_voxels(found, side, values).where(inside)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Complete events with a duration of trace files (.json or .json.gz), with the file they are from."""
    rows = spark.read.schema(TRACE).json(path, multiLine=True).select(F.input_file_name().alias("file"), F.explode("traceEvents").alias("e"))
    return rows.select("file", "e.*").where("ph = 'X' and dur is not null")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each block of pseudo-label manifests; boxes and blocks must pair up."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True).withColumn("file", F.input_file_name())
    if rows.isEmpty():
        raise ValueError(f"no manifest at {path}")
    alike = F.when(F.size("bounding_boxes") == F.size("blocks"), F.arrays_zip("bounding_boxes", "blocks")).otherwise(F.raise_error(F.concat(F.lit("boxes and blocks differ in number in "), "file")))
    return rows.withColumn("pair", F.explode(alike)).select("file", "label_name", "run", "step", "cc_logit", "tau_bg", "tau_fg", "min_size", F.col("pair.bounding_boxes").alias("box"), "pair.blocks.*")


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row for each round's report."""
    return spark.read.schema(REPORT).json(path, multiLine=True)


def append_attempt(spark: SparkSession, path: str, run: str, commit: str) -> None:
    """Append one (run, ts, commit) row to the attempt log."""
    spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("ts"), F.lit(commit).alias("commit")).write.mode("append").parquet(path)


def write_mixture(volumes: DataFrame, provenance: DataFrame, path: str) -> None:
    """A round's mixture: the volume descriptors and a one-row provenance table, as JSON."""
    volumes.write.json(f"{path}/volumes")
    provenance.write.json(f"{path}/provenance")
