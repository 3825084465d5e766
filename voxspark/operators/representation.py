"""Statistics of vectors: balancing, cross-entropies, nearest neighbours, pooling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.operators import pivots


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def sinkhorn(rows: DataFrame, by: list[str], key: str, logits: str, prototypes: int, temperature: float, rounds: int = 3) -> DataFrame:
    """Balanced assignments: prototypes get equal shares, then every sample sums to one.

    A sample is one array.  An assignment is a fixed kernel times a scale of its
    prototype and one of its sample, so a round is one pass over the rows that
    shuffles the sums of each prototype only; the scales of the samples follow
    from those of the prototypes.  The number of samples (all, or masked
    patches) scales every assignment alike and cancels out.  ``rounds`` is one
    at least.  Extreme logits overflow, as documented for the plain method:
    there is no clamp.
    """
    kernel = rows.select(*by, key, F.transform(logits, lambda v: F.exp(v / temperature)).alias("k"))

    def prototype_scales(placed: DataFrame) -> DataFrame:
        sums = placed.groupBy(*by).agg(F.array(*[F.sum(F.col("k")[j] / F.col("all")) for j in range(prototypes)]).alias("s"))
        return sums.select(*by, F.transform("s", lambda s: 1 / s).alias("u"))

    def place(scales: DataFrame) -> DataFrame:
        return kernel.join(scales, by).withColumn("q", F.zip_with("k", "u", lambda k, u: k * u)).withColumn("all", total(F.col("q")))

    scales = prototype_scales(kernel.withColumn("all", F.lit(1.0)))
    for _ in range(rounds - 1):
        scales = prototype_scales(place(scales))
    return place(scales).select(*by, key, F.transform("q", lambda v: v / F.col("all")).alias("q"))


def log_softmax(values: Column, temperature: float) -> Column:
    """Log-softmax of an array, by subtraction of its maximum."""
    scaled = F.transform(values, lambda v: v / temperature)
    top = F.array_max(scaled)
    norm = F.log(F.aggregate(scaled, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
    return F.transform(scaled, lambda v: v - top - norm)


def view_cross_entropy(students: DataFrame, teachers: DataFrame, temperature: float, drop_same: bool, sample: str = "sample") -> DataFrame:
    """Cross-entropy of every student view with every teacher view of a sample, one number.

    ``students``: sample, s, logits; ``teachers``: sample, t, probs.  Without
    pairs of one view index the divisor falls by B min(S, T).
    """
    left = students.withColumn("__l", log_softmax(F.col("logits"), temperature)).select(sample, "s", "__l")
    pairs = left.join(teachers.select(sample, "t", "probs"), sample)
    if drop_same:
        pairs = pairs.where("s <> t")
    counts = students.agg(F.countDistinct(sample).alias("b"), F.countDistinct("s").alias("ns")).join(F.broadcast(teachers.agg(F.countDistinct("t").alias("nt"))))
    loss = pairs.agg((-F.sum(total(F.zip_with("__l", "probs", lambda a, b: a * b)))).alias("total"))
    divisor = F.col("b") * F.col("ns") * F.col("nt") - (F.col("b") * F.least("ns", "nt") if drop_same else 0)
    return loss.join(F.broadcast(counts)).select((F.col("total") / divisor).alias("loss"))


def masked_patch_cross_entropy(rows: DataFrame, view: str, temperature: float) -> DataFrame:
    """Patches weigh 1 / max(masked in their view, 1); divided by the number of views, unmasked ones too."""
    per = rows.groupBy(view).agg(
        F.sum(F.when(F.col("hidden"), -total(F.zip_with(log_softmax(F.col("logits"), temperature), "probs", lambda a, b: a * b))).otherwise(0.0)).alias("ce"),
        F.count(F.when(F.col("hidden"), 1)).alias("masked"),
    )
    return per.agg((F.sum(F.col("ce") / F.greatest("masked", F.lit(1))) / F.count("*")).alias("loss"))


def normalised(values: Column) -> Column:
    """A vector of length one (zero vectors stay zero)."""
    norm = F.greatest(F.sqrt(total(F.transform(values, lambda v: v * v))), F.lit(1e-12))
    return F.transform(F.array(norm), lambda n: F.transform(values, lambda v: v / n))[0]  # the norm is taken once


def nearest_neighbours(rows: DataFrame, key: str, vec: str, block_rows: int = pivots.BLOCK_ROWS) -> DataFrame:
    """(key, neighbour, dot) of the nearest other row by dot product of unit vectors, exactly; the lowest key wins ties."""
    return pivots.search(rows.select(F.col(key).alias("key"), normalised(F.col(vec)).alias("vec")), block_rows).found


def spread(rows: DataFrame, key: str, vec: str, eps: float = 1e-8) -> DataFrame:
    """Minus the mean logarithm of the distance to the nearest other row (the eps is added to each difference too)."""
    units = rows.select(F.col(key).alias("key"), normalised(F.col(vec)).alias("vec"))
    units = units.hint("merge")  # Spark counts an array as one number, so vectors look small enough to broadcast
    near = nearest_neighbours(rows, key, vec).join(units, "key").join(units.select(F.col("key").alias("neighbour"), F.col("vec").alias("other")).hint("merge"), "neighbour")
    distance = F.sqrt(total(F.zip_with("vec", "other", lambda a, b: (a - b + eps) * (a - b + eps))))
    return near.agg((-F.avg(F.log(distance + eps))).alias("spread"))


def approximate_neighbours(rows: DataFrame, key: str, vec: str, block_rows: int = 512, probes: int = 4) -> DataFrame:
    """(key, neighbour, dot) of the nearest other row in the ``probes`` blocks nearest to each; rows may be missed.

    A block has at most ``block_rows`` rows (more only beyond ``pivots.MOST_BLOCKS``
    blocks), so a row is compared with ``probes * block_rows`` others at most.
    """
    return pivots.search(rows.select(F.col(key).alias("key"), normalised(F.col(vec)).alias("vec")), block_rows, probes).found


def mean_vector(rows: DataFrame, by: list[str], vec: str, size: int) -> DataFrame:
    """Element-wise mean of vectors: one aggregate of ``size`` columns."""
    return rows.groupBy(*by).agg(F.array(*[F.avg(F.col(vec)[k]) for k in range(size)]).alias(vec))


def combined_view_loss(parts: dict[str, tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of one-row losses (global and local terms)."""
    rows = reduce(DataFrame.union, [df.select(F.lit(name).alias("term"), "loss", F.lit(weight).alias("weight")) for name, (df, weight) in parts.items()])
    return rows.agg(F.sum(F.col("loss") * F.col("weight")).alias("loss"))
