"""Confusion counts, segmentation metrics, cross-entropy and validation averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, classes: int, ignore: int = -1, truth: str = "label", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts for every (truth, prediction), absent ones too; ignored truths are left out."""
    known = rows.where(F.col(truth) != ignore).groupBy(*by, F.col(truth).alias("target"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    grid = spark.range(classes * classes).select(F.expr(f"id div {classes}").alias("target"), (F.col("id") % classes).alias("predicted"))
    if by:
        grid = rows.select(*by).distinct().join(F.broadcast(grid))
    return grid.join(known, [*by, "target", "predicted"], "left").na.fill(0, ["n"])


def segmentation_metrics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pixel accuracy and means of IoU and Dice over the classes present in the truth."""
    target = counts.groupBy(*by, F.col("target").alias("cls")).agg(F.sum("n").alias("a"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = counts.groupBy(*by, F.col("predicted").alias("cls")).agg(F.sum("n").alias("p"))
    per = target.join(predicted, [*by, "cls"]).withColumn("iou", F.col("tp") / F.greatest(F.col("a") + F.col("p") - F.col("tp"), F.lit(1))).withColumn("dice", 2 * F.col("tp") / F.greatest(F.col("a") + F.col("p"), F.lit(1)))
    present = F.col("a") > 0
    return per.groupBy(*by).agg(
        F.round(F.sum("tp") / F.greatest(F.sum("a"), F.lit(1)), 6).alias("accuracy"),
        F.round(F.avg(F.when(present, F.col("iou"))), 6).alias("mean_iou"),
        F.round(F.avg(F.when(present, F.col("dice"))), 6).alias("mean_dice"),
        F.count(F.when(present, 1)).alias("present"),
        F.transform(F.array_sort(F.collect_list(F.struct("cls", "iou"))), lambda s: F.round(s["iou"], 6)).alias("iou"),
    )


def batch_metrics(rows: DataFrame, by: list[str], ignore: int = -1, truth: str = "label", pred: str = "pred") -> DataFrame:
    """IoU over the classes present in the valid truth, and accuracy; NaN where nothing is valid."""
    valid = F.col(truth) != ignore
    table = rows.groupBy(*by, F.when(valid, F.col(truth)).alias("t"), F.when(valid, F.col(pred)).alias("p")).agg(F.count("*").alias("n"))
    ends = table.select(*by, F.explode(F.array(F.struct(F.col("t").alias("cls"), F.lit(1).alias("is_truth")), F.struct(F.col("p").alias("cls"), F.lit(0).alias("is_truth")))).alias("e"), "n", (F.col("t") == F.col("p")).alias("hit")).select(*by, "e.*", "n", "hit")
    per = ends.groupBy(*by, "cls").agg(F.sum(F.when(F.col("is_truth") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("is_truth") == 0, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when((F.col("is_truth") == 1) & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    some = F.col("cls").isNotNull() & (F.col("a") > 0)
    nan = F.lit(float("nan"))
    total = F.sum(F.when(F.col("cls").isNotNull(), F.col("a")))
    return per.groupBy(*by).agg(
        F.coalesce(F.round(F.avg(F.when(some, F.col("tp") / F.greatest(F.col("a") + F.col("p") - F.col("tp"), F.lit(1)))), 6), nan).alias("iou"),
        F.when(total > 0, F.round(F.sum("tp") / total, 6)).otherwise(nan).alias("accuracy"),
    )


def log_softmax_at(scores: Column, index: Column) -> Column:
    """Log-softmax of an array at a place counted from 0, by subtraction of the maximum."""
    top = F.array_max(scores)
    return F.get(scores, index) - top - F.log(F.aggregate(scores, F.lit(0.0), lambda s, v: s + F.exp(v - top)))


def weighted_cross_entropy(rows: DataFrame, by: list[str], weights: list[float], scores: str = "scores", truth: str = "label", ignore: int = -1) -> DataFrame:
    """sum(w[y] * nll) / sum(w[y]) over the rows whose truth is known."""
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col(truth).cast("int"))
    known = rows.where(F.col(truth) != ignore).withColumn("w", weight).withColumn("nll", -log_softmax_at(F.col(scores), F.col(truth).cast("int")))
    return known.groupBy(*by).agg((F.sum(F.col("w") * F.col("nll")) / F.sum("w")).alias("loss"))


def validation_average(log: DataFrame, by: list[str]) -> DataFrame:
    """Mean over batches of the mean over ranks: (batch, rank, metric, value) -> metric."""
    ranks = log.groupBy(*by, "batch", "metric").agg(F.avg("value").alias("value"))
    return ranks.groupBy(*by, "metric").agg(F.avg("value").alias("value"), F.count("*").alias("batches"))
