"""Drawing, shuffling and dealing rows, the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.draws import uniform
from voxspark.operators.scans import Fold, running

AXES = ("x", "y", "z")


def running_sum(df: DataFrame, order: list[str], value: Column, name: str, by: list[str] | None = None) -> DataFrame:
    """Add the sum of ``value`` over the rows up to each in an order (of each group), without one task for all of them."""
    return running(df, by or [], order, {name: Fold("sum", value)})


def number_rows(df: DataFrame, order: list[str], name: str = "row", by: list[str] | None = None) -> DataFrame:
    """Number rows (of each group) from 0 in an order, without one task for all of them."""
    return running_sum(df, order, F.lit(1).cast("long"), name, by).withColumn(name, (F.col(name) - 1).cast("long"))


def draw_rows(df: DataFrame, order: list[str], n_draws: int | None, seed: int) -> DataFrame:
    """Rows drawn with replacement: draw i takes a row that (seed, i) decides."""
    numbered = number_rows(df, order)
    total = numbered.count()
    draws = df.sparkSession.range(n_draws or total).select(F.col("id").alias("draw"), F.floor(uniform(seed, "row", "id") * total).cast("long").alias("row"))
    return draws.join(numbered, "row").drop("row")


def draw_weighted(volumes: DataFrame, n_draws: int, seed: int, key: str = "vid", weight: str = "weight") -> DataFrame:
    """Volumes drawn in proportion to their weights: (draw, key).

    Each volume owns an interval of the running sum of weights; intervals and
    draws meet by equal buckets, then by range.  There are as many buckets as
    volumes, so a bucket has few intervals and all volumes together at most
    twice as many pieces.
    """
    spans = running_sum(volumes.select(key, weight), [key], F.col(weight), "hi").withColumn("lo", F.col("hi") - F.col(weight))
    total, buckets = volumes.agg(F.sum(weight), F.greatest(F.count("*"), F.lit(1))).first()
    width = total / buckets
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    draws = volumes.sparkSession.range(n_draws).select(F.col("id").alias("draw"), (uniform(seed, "volume", "id") * total).alias("at")).withColumn("bucket", F.floor(F.col("at") / width))
    return draws.join(spans, "bucket").where("at >= lo and at < hi").select("draw", key)


def shares(volumes: DataFrame, gt_weight: float, origin: str = "origin") -> DataFrame:
    """Add ``share``: ground-truth volumes split gt_weight evenly, pseudo-labelled ones the rest."""
    if not 0 <= gt_weight <= 1:
        raise ValueError("gt_weight is between 0 and 1")
    sizes = volumes.groupBy(origin).agg(F.count("*").alias("__n"))
    part = F.when(F.col(origin) == "gt", gt_weight).otherwise(1 - gt_weight)
    return volumes.join(F.broadcast(sizes), origin).withColumn("share", part / F.col("__n")).drop("__n")


def shuffle_rows(df: DataFrame, key: str, seed: int, epoch: int, bucket_rows: int = 100_000) -> DataFrame:
    """Add ``pos``: a permutation decided by (seed, epoch); draws are even, so are their buckets."""
    mixed = df.withColumn("__u", uniform(seed, f"epoch{epoch}", key))
    buckets = max(8, math.ceil(df.count() / bucket_rows))
    mixed = mixed.withColumn("__b", F.floor(F.col("__u") * buckets))
    sizes = mixed.groupBy("__b").agg(F.count("*").alias("n"))
    starts = sizes.select("__b", F.coalesce(F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__u", key)) - 1
    return mixed.withColumn("__place", place).join(F.broadcast(starts), "__b").withColumn("pos", (F.col("__start") + F.col("__place")).cast("long")).drop("__u", "__b", "__start", "__place")


def deal_ranks(shuffled: DataFrame, world: int) -> DataFrame:
    """Add ``rank``: positions go round the ranks; the first rows come again to fill the last round."""
    total = shuffled.count()
    short = -total % world
    again = shuffled.where(F.col("pos") < short).withColumn("pos", F.col("pos") + total)
    return shuffled.unionByName(again).withColumn("rank", F.pmod("pos", F.lit(world)).cast("int"))


def batches(ranked: DataFrame, size: int, drop_last: bool = True) -> DataFrame:
    """Add ``batch`` within each rank; a short last batch goes if asked for."""
    world = ranked.agg(F.max("rank") + 1).first()[0] or 1
    out = ranked.withColumn("batch", F.expr(f"(pos div {world}) div {size}"))
    if not drop_last:
        return out
    full = out.groupBy("rank", "batch").agg(F.count("*").alias("__n")).where(F.col("__n") == size)
    return out.join(full.drop("__n"), ["rank", "batch"])


def endless(df: DataFrame, key: str, seed: int, world: int, max_steps: int, batch: int, start_step: int = 0, bucket_rows: int = 100_000) -> DataFrame:
    """(step, rank, key) until ``max_steps``; on resume the epoch counter starts at the step number.

    The epoch is a column: every row comes once for each, with its place in that
    epoch's permutation.
    """
    total = df.count()
    each = math.ceil(total / world)  # rows of a rank in an epoch
    per_epoch = max(1, each // batch)
    epochs = math.ceil((max_steps - start_step) / per_epoch)
    if epochs < 1:
        return df.select(F.lit(0).cast("long").alias("step"), F.lit(0).alias("rank"), key).limit(0)
    mixed = df.select(key, F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("__e"))
    mixed = mixed.withColumn("__u", uniform(seed, F.concat(F.lit("epoch"), F.col("__e") + start_step), key))
    mixed = mixed.withColumn("__b", F.floor(F.col("__u") * max(8, math.ceil(total / bucket_rows))))
    sizes = mixed.groupBy("__e", "__b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__e").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__e", "__b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__e", "__b").orderBy("__u", key)) - 1
    pos = F.col("__start") + F.col("__place")
    again = F.when(pos < -total % world, F.array(pos, pos + total)).otherwise(F.array(pos))  # the first rows fill the last round
    dealt = mixed.withColumn("__place", place).join(starts, ["__e", "__b"]).select("__e", key, F.explode(again).alias("pos"))
    turn = F.expr(f"(pos div {world}) div {batch}")
    full = dealt.where(turn < each // batch)
    return full.select((turn + start_step + F.col("__e") * per_epoch).alias("step"), F.pmod("pos", F.lit(world)).cast("int").alias("rank"), key).where(F.col("step") < max_steps)


def crop(voxels: DataFrame, want: dict[str, int], seed: int, values: list[str]) -> DataFrame:
    """A window of fixed size from each volume; short axes start at 0 and are filled with 0 at the end."""
    size = voxels.groupBy("vol").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in AXES])
    start = size.select("vol", *[F.floor(uniform(seed, f"crop.{a}", "vol") * (F.greatest(F.col(f"n{a}") - want[a], F.lit(0)) + 1)).cast("int").alias(f"s{a}") for a in AXES])
    grid = start
    for a in AXES:
        grid = grid.withColumn(f"w{a}", F.explode(F.sequence(F.lit(0), F.lit(want[a] - 1))))
    grid = grid.select("vol", *[(F.col(f"s{a}") + F.col(f"w{a}")).alias(a) for a in AXES], *[F.col(f"w{a}") for a in AXES])
    out = grid.join(voxels.select("vol", *AXES, *values), ["vol", *AXES], "left")
    return out.select("vol", *[F.col(f"w{a}").alias(a) for a in AXES], *[F.coalesce(F.col(v), F.lit(0).cast(voxels.schema[v].dataType)).alias(v) for v in values])


def nested_arms(df: DataFrame, order: list[str], sizes: list[int], by: str) -> DataFrame:
    """(arm, ...) for arms that take the first 1, 3, 5 ... rows of each stratum in one order, so each holds the one before."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    arm = F.explode(F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: F.col("__place") <= s))
    return df.withColumn("__place", place).where(F.col("__place") <= max(sizes)).withColumn("arm", arm).drop("__place")


def natural_key(name: Column) -> Column:
    """Sort key of names that end in a number: the number as a number."""
    return F.regexp_extract(name, r"(\d+)$", 1).cast("long")


def shard_of(df: DataFrame, name: str, shards: int) -> DataFrame:
    """Add ``shard``: the place in version order, counted from 1, modulo the shards."""
    return number_rows(df.withColumn("__natural", natural_key(F.col(name))), ["__natural", name]).withColumn("shard", F.pmod(F.col("row") + 1, F.lit(shards)).cast("int")).drop("__natural", "row")


def unfinished(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items that no finished record names."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def completeness(done: DataFrame, expected: int) -> DataFrame:
    """The number of finished items, which must be the number expected."""
    n = F.count("*")
    return done.agg(F.when(n == expected, n).otherwise(F.raise_error(F.concat(n.cast("string"), F.lit(f" items are done, {expected} are expected")))).alias("done"))


def log_uniform(seed: int, tag: str, lo: float, hi: float, *keys: str) -> Column:
    """A number between two bounds whose logarithm is even."""
    return F.exp(F.lit(math.log(lo)) + uniform(seed, tag, *keys) * (math.log(hi) - math.log(lo)))
