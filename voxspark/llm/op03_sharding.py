"""Sharding by Karmarkar-Karp differencing.

Documents with equal text form one indivisible group.  Groups are hashed into
cells of about ``cell_rows`` groups; inside a cell the two partial partitions
with the largest spread are combined again and again, oppositely ordered, until
one is left.  What remains of every cell is a partial partition of ``n_shards``
sums, and those are combined in the same way, level by level, so no task and
not the driver ever holds more than ``cell_rows`` partial partitions.

Nulls and edge cases: a null text counts as an empty one (size 1, CRC 0) and
groups with empty texts; repeated rows stay separate rows of the same group;
an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.functions.workers import ship


def differencing(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Combine partial partitions; return (slot of every part, final sums).

    ``sums`` has a row per partial partition and a column per part.  The result
    gives, for every row and part, the part of the final partition it went to.
    """
    n, k = sums.shape
    follow = np.full(n * k, -1, dtype=np.int64)  # linked lists of (row, part)
    heap = []
    for i, row in enumerate(sums.tolist()):
        order = sorted(range(k), key=row.__getitem__, reverse=True)
        values = [row[j] for j in order]
        chains = [(i * k + j, i * k + j) for j in order]
        heap.append((values[-1] - values[0], i, values, chains))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ca = heapq.heappop(heap)
        _, _, b, cb = heapq.heappop(heap)
        merged = []
        for j in range(k):
            (head, tail), (head2, tail2) = ca[j], cb[k - 1 - j]
            follow[tail] = head2
            merged.append((a[j] + b[k - 1 - j], (head, tail2)))
        merged.sort(key=lambda x: -x[0])
        values = [x[0] for x in merged]
        heapq.heappush(heap, (values[-1] - values[0], tick, values, [x[1] for x in merged]))
        tick += 1
    slots = np.zeros(n * k, dtype=np.int32)
    values, chains = heap[0][2:] if heap else ([0] * k, [])
    for j, (head, _) in enumerate(chains):
        at = head
        while at >= 0:
            slots[at] = j
            at = follow[at]
    return slots.reshape(n, k), np.array(values, dtype=np.int64)


def _combine(items: DataFrame, n_cells: int, n_shards: int) -> DataFrame:
    """items(item, sums) -> (item, cell, slots, total): one partition for each cell."""

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        sums = np.zeros((len(pdf), n_shards), dtype=np.int64)
        for i, row in enumerate(pdf["sums"]):
            sums[i, : len(row)] = row
        slots, total = differencing(sums)
        return pd.DataFrame({"item": pdf["item"], "cell": pdf["cell"], "slots": list(slots), "total": [total.tolist()] * len(pdf)})

    cells = items.withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(n_cells)))
    return cells.groupBy("cell").applyInPandas(cell, "item string, cell long, slots array<int>, total array<long>")


def shard(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text", cell_rows: int = 20_000) -> DataFrame:
    """Assign every row to a shard of nearly equal bytes, equal texts together.

    Returns ``key, size, text_crc32, shard, slot``; slots number the rows of a
    shard from 0 without gaps.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = stored(docs.select(F.col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("crc"), F.md5(body).alias("item")), "shard-rows")
    groups = stored(rows.groupBy("item").agg(F.sum("size").alias("size")), "shard-groups")
    items, n_items = groups.select("item", F.array("size").alias("sums")), groups.count()
    steps = []
    while True:
        step = stored(_combine(items, max(1, math.ceil(n_items / cell_rows)), n_shards), "shard-step")
        steps.append(step)
        left = step.groupBy("cell").agg(F.first("total").alias("sums"))
        n_items = left.count()
        if n_items <= 1:
            break
        items = left.select(F.col("cell").cast("string").alias("item"), "sums")
    placed = steps[0].select(F.col("item").alias("group"), F.col("cell").cast("string").alias("item"), F.col("slots")[0].alias("shard"))
    for step in steps[1:]:
        placed = placed.join(step.select("item", F.col("cell").alias("up"), "slots"), "item").select("group", F.col("up").cast("string").alias("item"), F.expr("slots[shard]").alias("shard"))
    out = rows.join(placed.select(F.col("group").alias("item"), "shard"), "item", "left")
    return _number(out, rows.count())


def _number(rows: DataFrame, n_rows: int, block_rows: int = 100_000) -> DataFrame:
    """Number the rows of each shard from 0: by hashed block, plus the offsets of blocks."""
    n_blocks = max(64, math.ceil(n_rows / block_rows))
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("key", "item"), F.lit(n_blocks))).select("key", "size", "crc", "item", "shard", "block"), "shard-placed")
    sizes = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # copies share key and item only when rows repeat; the salt splits no shard's block further
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("key", "item")) - 1
    return rows.withColumn("place", place).join(starts, ["shard", "block"]).select("key", "size", "crc", "shard", (F.col("start") + F.col("place")).alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents under the law ``bytes``."""
    out = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        F.col("key").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
