"""Block files in Morton order, and a data source that opens only those a box needs.

A block's key interleaves the bits of its coordinates, so blocks that are near in
space are near in the order of keys and a box is a few ranges of it.  A volume is
cut into files by range of keys, however large it is; volumes smaller than a file
share files, by level, in the order of volumes and keys, so that files grow in
number with the voxels and not with the volumes.  A table beside them, the
directory, has a row for each file with the volumes, keys and coordinates that it
holds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, StructType

from voxspark.functions.storage import drop, stored
from voxspark.functions.workers import ship

AXES = ("x", "y", "z")
FILE_VOXELS = 1 << 19  # of a file; one block may be larger
BATCH_VOXELS = 1 << 18  # of a batch that is read; one block may be larger
MOST_RANGES = 64  # of keys that a box is cut into; more would only be finer
BITS = 20  # of a block coordinate
#: fixed values: shifts and masks that spread the bits of a number three places apart
SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def morton(*coordinates: Column) -> Column:
    """The key of a block; coordinates are 0 to 2**20 - 1."""
    out = F.lit(0).cast("long")
    for k, c in enumerate(coordinates):
        wide = F.when((c >= 0) & (c < 1 << BITS), c.cast("long")).otherwise(F.raise_error(F.lit("block coordinates are 0 to 2**20 - 1")))
        for shift, mask in SPREAD:
            wide = wide.bitwiseOR(F.shiftleft(wide, shift)).bitwiseAND(F.lit(mask))
        out = out.bitwiseOR(F.shiftleft(wide, len(coordinates) - 1 - k))
    return out


def key_ranges(low: tuple[int, ...], high: tuple[int, ...], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, both ends in, that hold all blocks from ``low`` to ``high``.

    Cubes of the octree are cut until there would be more than ``most``; what is cut
    no further may hold other blocks too.
    """
    rank = len(low)
    cubes, whole = [((0,) * rank, BITS)], []
    while cubes:
        inner, done = [], []
        for at, bits in cubes:
            for corner in np.ndindex(*(2,) * rank):
                start = tuple(a + (c << (bits - 1)) for a, c in zip(at, corner, strict=True))
                end = tuple(s + (1 << (bits - 1)) - 1 for s in start)
                if all(s <= h and e >= lo for s, e, lo, h in zip(start, end, low, high, strict=True)):
                    inside = bits == 1 or all(lo <= s and e <= h for s, e, lo, h in zip(start, end, low, high, strict=True))
                    (done if inside else inner).append((start, bits - 1))
        if len(whole) + len(done) + len(inner) > most:
            whole += cubes
            break
        cubes, whole = inner, whole + done
    found = sorted((first := _key(at), first + (1 << (rank * bits)) - 1) for at, bits in whole)
    out: list[tuple[int, int]] = []
    for first, last in found:
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _key(at: tuple[int, ...]) -> int:
    return sum((c >> bit & 1) << (bit * len(at) + len(at) - 1 - k) for k, c in enumerate(at) for bit in range(BITS))


def write_blocks(blocks: DataFrame, path: str, file_blocks: int | None = None) -> None:
    """Blocks as Parquet, files cut by range of volumes and keys, with their directory.

    ``block_vol`` is a block's volume.  A volume with ``file_blocks`` blocks of a
    level or more has folders ``vol=`` and ``level=`` of its own, of which there are
    no more than files; in the folder name of shared files the volume is null.
    """
    keyed = stored(blocks.withColumn("key", morton(*[F.col(f"b{a}") for a in AXES])).withColumn("block_vol", F.col("vol").cast("long")).drop("vol"), "keyed-blocks")
    values = [f.name for f in blocks.schema.fields if isinstance(f.dataType, ArrayType)]
    n, voxels = keyed.agg(F.count("*"), F.max(F.size(values[0])) if values else F.lit(1)).first()
    file_blocks = file_blocks or max(1, FILE_VOXELS // max(1, voxels or 1))
    parts = max(1, math.ceil(n / file_blocks))
    large = keyed.groupBy("block_vol", "level").agg(F.count("*").alias("n")).where(F.col("n") >= file_blocks).select("block_vol", "level", F.col("block_vol").alias("vol"))
    order = ["vol", "level", "block_vol", "key"]
    rows = keyed.join(F.broadcast(large), ["block_vol", "level"], "left").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.write.option("maxRecordsPerFile", file_blocks).option("parquet.block.row.count.limit", max(1, file_blocks // 8)).partitionBy("vol", "level").parquet(path)
    drop(keyed)
    files = blocks.sparkSession.read.parquet(path).withColumn("file", F.input_file_name()).groupBy("file", F.col("vol").cast("long").alias("vol"), F.col("level").cast("int").alias("level"))
    edges = [f(c).alias(f"{name}_{c.removeprefix('block_')}") for c in ("block_vol", "key", "bx", "by", "bz") for name, f in (("low", F.min), ("high", F.max))]
    files.agg(F.count("*").alias("blocks"), *edges).write.parquet(f"{path}/_directory")


def in_ranges(lo: dict[str, int], hi: dict[str, int], side: int) -> Column:
    """Whether a block may hold voxels of a box: its key is in a range and its coordinates are."""
    low, high = tuple(max(0, lo[a] // side) for a in AXES), tuple((hi[a] - 1) // side for a in AXES)
    keys = F.lit(False)
    for first, last in key_ranges(low, high):
        keys = keys | F.col("key").between(first, last)
    for a, first, last in zip(AXES, low, high, strict=True):
        keys = keys & F.col(f"b{a}").between(first, last)
    return keys


@dataclass
class BlockFile(InputPartition):
    """A file to be read."""

    file: str
    level: int


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class BlockSource(DataSource):
    """``spark.read.format("voxel_blocks").options(path=..., side=..., level=0, x="1:7").schema(...)``: voxels of block files.

    The schema is vol, level, x, y, z and the values.  The options vol, level, x, y
    and z are a number or a range ``from:to`` (the end out, either may lack); files
    are chosen by the directory, then the blocks inside.  They are options and not
    pushed filters, as this version of Spark keeps filters once pushed for every
    other query on the same frame.
    """

    @classmethod
    def name(cls) -> str:
        return "voxel_blocks"

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlockReader(self.options, schema)


class BlockReader(DataSourceReader):
    """One partition for each file that the options leave."""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.side = options["path"], int(options["side"])
        self.values = [f.name for f in schema.fields if f.name not in ("vol", "level", *AXES)]
        self.bounds = {}
        for c in ("vol", "level", *AXES):
            first, colon, end = options.get(c, ":").partition(":")
            self.bounds[c] = (int(first) if first else -math.inf, (int(end) - 1 if end else math.inf) if colon else int(first))

    def _block_bounds(self) -> list[tuple[str, float, float]]:
        return [(f"b{a}", self.bounds[a][0] // self.side, self.bounds[a][1] // self.side) for a in AXES]

    def partitions(self) -> list[InputPartition]:
        store, root = _store(f"{self.path}/_directory")
        files = [name for name in (i.path for i in store.get_file_info(pafs.FileSelector(root))) if name.endswith(".parquet")]
        keep = pads.scalar(True)
        for column, low, high in (*[(c, *self.bounds[c]) for c in ("vol", "level")], *self._block_bounds()):
            first, last = (column, column) if column == "level" else (f"low_{column}", f"high_{column}")
            if low > -math.inf:
                keep = keep & (pads.field(last) >= int(low))
            if high < math.inf:
                keep = keep & (pads.field(first) <= int(high))
        rows = pads.dataset(files, filesystem=store, format="parquet").to_table(["file", "level"], filter=keep) if files else pa.table({"file": [], "level": []})
        return [BlockFile(**row) for row in rows.to_pylist()]

    def read(self, partition: BlockFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file is left
            return
        store, root = _store(partition.file)
        keep = pads.scalar(True)
        for column, low, high in (("block_vol", *self.bounds["vol"]), *self._block_bounds()):
            if low > -math.inf:
                keep = keep & (pads.field(column) >= int(low))
            if high < math.inf:
                keep = keep & (pads.field(column) <= int(high))
        cube = np.indices((self.side,) * 3, dtype=np.int32).reshape(3, -1)
        rows = pads.dataset(root, filesystem=store, format="parquet", partitioning=None)
        for batch in rows.to_batches(columns=["block_vol", "bx", "by", "bz", *self.values], filter=keep, batch_size=max(1, BATCH_VOXELS // cube.shape[1])):
            if n := batch.num_rows:
                at = [(np.repeat(batch.column(f"b{a}").to_numpy() * self.side, cube.shape[1]) + np.tile(cube[k], n)).astype(np.int32) for k, a in enumerate(AXES)]
                size = n * cube.shape[1]
                names = {"vol": pa.array(np.repeat(batch.column("block_vol").to_numpy(), cube.shape[1])), "level": pa.array(np.full(size, partition.level), pa.int32())}
                names |= {a: pa.array(c) for a, c in zip(AXES, at, strict=True)} | {v: batch.column(v).flatten() for v in self.values}
                inside = np.logical_and.reduce([(c >= self.bounds[a][0]) & (c <= self.bounds[a][1]) for a, c in zip(AXES, at, strict=True)])
                yield pa.RecordBatch.from_pydict(names).filter(pa.array(inside))


def read_voxels(spark: SparkSession, path: str, side: int, values: str, **box: str | int) -> DataFrame:
    """The voxels of full block files, of a box if there is one; ``values``: names and types, such as ``img double``."""
    ship(spark)
    spark.dataSource.register(BlockSource)
    return spark.read.format("voxel_blocks").schema(f"vol long, level int, x int, y int, z int, {values}").options(path=path, side=side, **box).load()
