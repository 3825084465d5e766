"""Block files: keys, files of one volume, and what a box opens."""

import glob
import math
import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from voxspark.sources import blocks, readers


def naive_key(at):
    return int("".join(f"{c:020b}"[k] for k in range(20) for c in at), 2)


def grid(spark, n, vols=1):
    """Blocks of 2 voxels an axis, n an axis."""
    place = [F.expr(f"cast((id div {n ** (2 - k)}) % {n} as int)").alias(f"b{a}") for k, a in enumerate("xyz")]
    return spark.range(n**3 * vols).select(F.expr(f"cast(id div {n**3} as int)").alias("vol"), F.lit(0).alias("level"), *place, F.expr("transform(sequence(0, 7), k -> id * 8 + k)").alias("label"))


def test_keys_and_ranges_by_brute_force(spark):
    draw = random.Random(1)
    rows = [tuple(draw.randrange(1 << 20) for _ in range(3)) for _ in range(200)] + [(0, 0, 0), ((1 << 20) - 1,) * 3]
    df = spark.createDataFrame(rows, "bx int, by int, bz int")
    assert all(r.key == naive_key(tuple(r)[:3]) == blocks._key(tuple(r)[:3]) for r in df.withColumn("key", blocks.morton(F.col("bx"), F.col("by"), F.col("bz"))).collect())
    with pytest.raises(Exception, match="block coordinates"):
        spark.range(1).select(blocks.morton(F.lit(-1), F.lit(0), F.lit(0))).collect()
    for _ in range(60):
        low = [draw.randrange(12) for _ in range(3)]
        high = [a + draw.randrange(5) for a in low]
        for most in (1, 8, 1000):
            found = blocks.key_ranges(tuple(low), tuple(high), most)
            inside = {naive_key((x + low[0], y + low[1], z + low[2])) for x, y, z in np.ndindex(*[h - a + 1 for a, h in zip(low, high, strict=True)])}
            assert len(found) <= max(most, 8) and all(any(a <= k <= b for a, b in found) for k in inside)
            if most == 1000:
                assert sum(b - a + 1 for a, b in found) == len(inside)


def test_one_volume_is_many_files_and_a_box_opens_few(spark, tmp_path):
    path = str(tmp_path / "blocks")
    blocks.write_blocks(grid(spark, 16), path, file_blocks=128)
    files = glob.glob(f"{path}/vol=0/level=0/*.parquet")
    assert len(files) >= 4096 / 128 and max(pq.read_metadata(f).num_rows for f in files) <= 128
    lo, hi = {"x": 8, "y": 8, "z": 8}, {"x": 15, "y": 15, "z": 15}
    wanted = {(x, y, z) for x in range(8, 15) for y in range(8, 15) for z in range(8, 15)}
    found = readers.scan_box(spark, path, spark.range(1).withColumnRenamed("id", "vol"), 0, lo, hi, 2, ["label"]).collect()
    assert {(r.x, r.y, r.z) for r in found} == wanted and len(found) == len(wanted)
    ranges = blocks.key_ranges((4, 4, 4), (7, 7, 7))
    opened = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.names.index("key")
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(at).statistics
            opened += any(s.min <= b and s.max >= a for a, b in ranges)
    assert opened <= 4  # 64 of 4,096 blocks


def test_the_source_opens_no_other_file(spark, tmp_path):
    path = str(tmp_path / "blocks")
    blocks.write_blocks(grid(spark, 8, vols=2), path, file_blocks=32)
    rows = blocks.read_voxels(spark, path, 2, "label long")
    assert rows.count() == 2 * 16**3 and rows.select("vol", "x", "y", "z").distinct().count() == 2 * 16**3
    assert rows.where("label <> ((vol * 8 + x div 2) * 64 + (y div 2) * 8 + z div 2) * 8 + (x % 2) * 4 + (y % 2) * 2 + z % 2").count() == 0
    for d in range(2):  # files beyond the box cannot be read any more
        for r in spark.read.parquet(f"{path}/_directory").where(f"vol = {d} and (vol = 0 or low_bx > 3 or low_by > 3 or low_bz > 3)").collect():
            os.remove(r.file.removeprefix("file://"))
    box = blocks.read_voxels(spark, path, 2, "label long", vol=1, level=0, x=":8", y="0:8", z="3:8")
    assert box.count() == 8 * 8 * 5 and box.where("x = 2").count() == 8 * 5 and box.count() == 8 * 8 * 5
    assert blocks.read_voxels(spark, path, 2, "label long", vol=7).count() == 0
    with pytest.raises(Exception, match="[Nn]o such file|not exist|NotFound"):
        rows.count()


def test_small_volumes_share_files_and_large_ones_do_not(spark, tmp_path):
    path = str(tmp_path / "blocks")
    small = grid(spark, 2, vols=300).unionByName(grid(spark, 2, vols=300).withColumn("level", F.lit(1)))
    blocks.write_blocks(small.unionByName(grid(spark, 8).withColumn("vol", F.lit(1000))), path, file_blocks=256)
    directory = spark.read.parquet(f"{path}/_directory").collect()
    assert len(directory) <= 2 * math.ceil((2 * 300 * 8 + 512) / 256)
    assert {(r.low_vol, r.high_vol) for r in directory if r.vol is not None} == {(1000, 1000)} and sum(r.blocks for r in directory if r.vol is None) == 2 * 300 * 8
    assert sorted(os.listdir(path)) == sorted({"_SUCCESS", "._SUCCESS.crc", "_directory", "vol=1000", "vol=__HIVE_DEFAULT_PARTITION__"})
    wanted = {(v, x, y, z) for v in (7, 299, 1000) for x in range(3) for y in range(1, 4) for z in range(4)}
    ids = spark.createDataFrame([(7,), (299,), (1000,), (4444,)], "vol long")
    found = readers.scan_box(spark, path, ids, 0, {"x": 0, "y": 1, "z": 0}, {"x": 3, "y": 4, "z": 4}, 2, ["label"]).collect()
    assert {(r.vol, r.x, r.y, r.z) for r in found} == wanted and len(found) == len(wanted)
    one = blocks.read_voxels(spark, path, 2, "label long", vol=7, level=1)
    assert one.count() == 64 and one.where("vol <> 7 or level <> 1 or label div 64 <> 7").count() == 0
    assert blocks.read_voxels(spark, path, 2, "label long", vol="299:").where("level = 0").count() == 64 + 16**3


def test_a_box_of_volumes_that_all_share_files(spark, tmp_path):
    path = str(tmp_path / "blocks")
    blocks.write_blocks(grid(spark, 2, vols=40), path)
    found = readers.scan_box(spark, path, spark.range(38, 44).withColumnRenamed("id", "vol"), 0, {a: 1 for a in "xyz"}, {a: 3 for a in "xyz"}, 2, ["label"])
    assert sorted((r.vol, r.x, r.y, r.z) for r in found.collect()) == [(v, x, y, z) for v in (38, 39) for x in (1, 2) for y in (1, 2) for z in (1, 2)]
    assert spark.read.parquet(f"{path}/_directory").count() == 1
