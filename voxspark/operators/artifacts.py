"""Tables of checkpoints, parameters, devices and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(ckpt: DataFrame, model: DataFrame, strip: str = "", skip: tuple[str, ...] = ()) -> DataFrame:
    """(name, status) of every tensor of a model and a checkpoint (name, shape).

    Checkpoint names lose ``strip``; those without it are ``dropped``.  A model
    tensor is skipped, kept_initial (not in the checkpoint), copied (same
    shape), inflated (four axes to five, the outer two alike) or mismatched; a
    checkpoint tensor that no model tensor takes is unused, or skipped.
    """

    def skipped(name: Column) -> Column:
        out = F.lit(False)
        for prefix in skip:
            out = out | name.startswith(prefix)
        return out

    own = F.col("name").startswith(strip)
    left = ckpt.where(own).select(F.substring("name", len(strip) + 1, 1 << 20).alias("name"), F.col("shape").alias("have"), F.lit(True).alias("in_ckpt"))
    both = model.select("name", F.col("shape").alias("want"), F.lit(True).alias("in_model")).join(left, "name", "full")
    inflated = (F.size("have") == 4) & (F.size("want") == 5) & (F.slice("have", 1, 2) == F.slice("want", 1, 2))
    status = (
        F.when(skipped(F.col("name")), "skipped")
        .when(F.col("in_model").isNull(), "unused")
        .when(F.col("in_ckpt").isNull(), "kept_initial")
        .when(F.col("have") == F.col("want"), "copied")
        .when(inflated, "inflated")
        .otherwise("mismatched")
    )
    return both.select("name", status.alias("status")).union(ckpt.where(~own).select("name", F.lit("dropped")))


def strict(statuses: DataFrame) -> DataFrame:
    """Counts by status, or an error: mismatches first, then nothing matched, then leftovers."""
    counts = statuses.groupBy().pivot("status", ["copied", "inflated", "kept_initial", "mismatched", "skipped", "unused", "dropped"]).count().na.fill(0)
    fail = F.when(F.col("mismatched") > 0, "shapes differ").when(F.col("copied") + F.col("inflated") == 0, "nothing matched").when(F.col("unused") > 0, "tensors are left over")
    return counts.select("*", F.when(fail.isNotNull(), F.raise_error(fail)).otherwise(F.lit("ok")).alias("verdict"))


def numel(shape: Column) -> Column:
    """Number of elements of a tensor."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda s, v: s * v)


def parameter_groups(tensors: DataFrame, blocks: int, decay: float, lr: float, wd: float, stem: tuple[str, ...] = ("patch_embed.",), adapters: str = "lora") -> DataFrame:
    """Learning rate and weight decay of every tensor by its depth.

    Blocks have depth 1 to ``blocks``, stem and tokens 0, all else ``blocks`` + 1;
    the rate falls by ``decay`` a layer from the top; tensors of fewer than two
    axes and adapters are not decayed.
    """
    block = F.regexp_extract("name", r"blocks\.(\d+)\.", 1)
    at_stem = F.lit(False)
    for prefix in stem:
        at_stem = at_stem | F.col("name").contains(prefix)
    depth = F.when(block != "", block.try_cast("int") + 1).when(at_stem, 0).otherwise(blocks + 1)
    free = (F.size("shape") < 2) | F.col("name").contains(adapters)
    return tensors.withColumn("depth", depth).withColumn("lr", F.lit(lr) * F.pow(F.lit(decay), F.lit(blocks + 1) - F.col("depth"))).withColumn("wd", F.when(free, 0.0).otherwise(wd))


def group_sizes(grouped: DataFrame) -> DataFrame:
    """One row for each (lr, wd): tensors and elements."""
    return grouped.groupBy(F.round("lr", 12).alias("lr"), "wd").agg(F.count("*").alias("tensors"), F.sum(numel(F.col("shape"))).alias("elements"))


def trainable_report(tensors: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Elements trained for each reason (first pattern that fits a name), and frozen ones; shares in percent."""
    why = F.lit("frozen")
    for reason, pattern in reversed(patterns.items()):
        why = F.when(F.col("name").rlike(pattern), reason).otherwise(why)
    sums = tensors.groupBy(why.alias("reason")).agg(F.count("*").alias("tensors"), F.sum(numel(F.col("shape"))).alias("elements"))
    total = tensors.agg(F.sum(numel(F.col("shape"))).alias("__all"))
    return sums.join(F.broadcast(total)).select("reason", "tensors", "elements", (100 * F.col("elements") / F.col("__all")).alias("percent"))


def device_peaks(devices: DataFrame, rules: DataFrame, name: str = "device") -> DataFrame:
    """Peak of every device: the first rule (by priority) whose text is in its normalised name.

    Unknown devices have a null peak and a reason.
    """
    plain = F.upper(F.regexp_replace(name, r"[\s_-]+", " "))
    hit = devices.withColumn("__plain", plain).join(F.broadcast(rules), F.col("__plain").contains(F.col("pattern")), "left")
    best = hit.groupBy(*devices.columns).agg(F.min_by("peak", "priority").alias("peak"), F.min("priority").alias("rule"))
    return best.withColumn("reason", F.when(F.col("rule").isNull(), "unknown device").when(F.col("peak").isNull(), "no such precision"))


def warmup(step: Column, steps: int) -> Column:
    """Linear warm-up: (s + 1) / w, one from then on."""
    return F.least((step + 1) / F.lit(float(steps)), F.lit(1.0))


def _progress(step: Column, start: int, total: int) -> Column:
    return F.least(F.greatest((step - start) / F.lit(float(max(total - start, 1))), F.lit(0.0)), F.lit(1.0))


def decayed(step: Column, kind: str, start: int, total: int, floor: float) -> Column:
    """Linear or cosine decay from one to a floor."""
    p = _progress(step, start, total)
    return F.lit(1.0) - p * (1 - floor) if kind == "linear" else F.lit(floor) + (1 - floor) * 0.5 * (1 + F.cos(math.pi * p))


def cosine_between(step: Column, total: int, first: float, last: float) -> Column:
    """From one value to another along half a cosine (weight decay, momentum)."""
    return F.lit(last) + (first - last) * 0.5 * (1 + F.cos(math.pi * _progress(step, 0, total)))


def linear_between(step: Column, total: int, first: float, last: float) -> Column:
    """From one value to another in a straight line, then flat (teacher temperature, unfreezing)."""
    return F.lit(first) + (last - first) * _progress(step, 0, total)


def moving_average(old: DataFrame, new: DataFrame, key: str, vec: str, momentum: float) -> DataFrame:
    """m * old + (1 - m) * new for each key; keys on one side only stay as they are."""
    both = old.select(key, F.col(vec).alias("__o")).join(new.select(key, F.col(vec).alias("__n")), key, "full")
    mixed = F.zip_with("__o", "__n", lambda a, b: momentum * a + (1 - momentum) * b)
    return both.select(key, F.coalesce(mixed, "__o", "__n").alias(vec))


def cosine_drift(old: DataFrame, new: DataFrame, key: str, vec: str) -> DataFrame:
    """Cosine between the vectors of one key in two tables."""

    def dot(a: str, b: str) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    both = old.select(key, F.col(vec).alias("__o")).join(new.select(key, F.col(vec).alias("__n")), key)
    return both.select(key, (dot("__o", "__n") / F.greatest(F.sqrt(dot("__o", "__o") * dot("__n", "__n")), F.lit(1e-12))).alias("cosine"))
