"""Augmentation of voxel tables: every draw is a keyed hash of the sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.functions.draws import normal, uniform
from voxspark.operators.curation import guarded, isotropic

AXES = ("x", "y", "z")
#: fixed values: the permutations of three axes, the first two keep the section axis
PERMUTATIONS = [(0, 1, 2), (1, 0, 2), (0, 2, 1), (1, 2, 0), (2, 0, 1), (2, 1, 0)]


def rotation_guard(voxels: DataFrame, side: int, by: str = "vol", sizes: str | None = None, fix_section: bool = False) -> DataFrame:
    """One row if every sample can be rotated, an error otherwise.

    Axes that may change places must have ``side`` voxels, the section axis too
    where it is flipped, and equal voxel sizes (an array column ``sizes``;
    unknown sizes pass).
    """
    size = F.first(sizes) if sizes else F.lit(None).cast("array<double>")
    shape = voxels.groupBy(by).agg(F.array(*[F.min(a) for a in AXES]).alias("low"), F.array(*[F.max(a) + 1 for a in AXES]).alias("high"), size.alias("size"))
    cube = F.forall("low", lambda v: v == 0) & F.forall("high", lambda v: v == side)
    alike = isotropic(F.slice("size", 1, 2) if fix_section else F.col("size"))
    bad = shape.agg(F.count(F.when(~cube, 1)).alias("shapes"), F.count(F.when(~alike, 1)).alias("sizes"))
    return bad.select(
        F.when(F.col("shapes") > 0, F.raise_error(F.concat("shapes", F.lit(f" samples are no cubes of {side} voxels a side")))).when(F.col("sizes") > 0, F.raise_error(F.concat("sizes", F.lit(" samples have axes of unequal voxel size to be exchanged")))).otherwise(F.lit(1)).alias("ok")
    )


def rotate_plane(pixels: DataFrame, side: int, seed: int, by: str = "plane") -> DataFrame:
    """One of the eight flips and exchanges of the axes x and y of each square plane."""
    x, y = [F.when(uniform(seed, f"flip{a}", by) < 0.5, side - 1 - F.col(a)).otherwise(F.col(a)).cast("int") for a in AXES[:2]]
    swap = uniform(seed, "perm", by) < 0.5
    rows = pixels.withColumn("__c", F.when(swap, F.array(y, x)).otherwise(F.array(x, y)))
    return rows.withColumns({a: F.col("__c")[i] for i, a in enumerate(AXES[:2])}).drop("__c")


def rotate(voxels: DataFrame, side: int, seed: int, fix_section: bool = False, by: str = "vol", sizes: str | None = None) -> DataFrame:
    """Signed axis permutation of each cube: flips, then slot i takes axis perm[i]; one draw for all columns.

    Other grids than cubes, and axes of unequal voxel size, are refused.
    """
    voxels = guarded(voxels, rotation_guard(voxels, side, by, sizes, fix_section))
    choices = PERMUTATIONS[:2] if fix_section else PERMUTATIONS
    pick = F.floor(uniform(seed, "perm", by) * len(choices)).cast("int")
    flipped = [F.when(uniform(seed, f"flip{a}", by) < 0.5, side - 1 - F.col(a)).otherwise(F.col(a)) for a in AXES]
    perm = F.get(F.array(*[F.array(*map(F.lit, p)) for p in choices]), pick)
    rows = voxels.withColumn("__c", F.array(*flipped)).withColumn("__p", perm)
    return rows.withColumns({a: F.get(F.col("__c"), F.get(F.col("__p"), F.lit(i))).cast("int") for i, a in enumerate(AXES)}).drop("__c", "__p")


def _axis(seed: int, tag: str, by: str) -> Column:
    """The drawn section axis of a sample: 0, 1 or 2."""
    return F.floor(uniform(seed, tag, by) * 3).cast("int")


def shift_sections(voxels: DataFrame, side: int, seed: int, p: float, most: int, by: str = "vol") -> DataFrame:
    """Roll some sections of each sample along the other two axes, image and label alike."""
    axis = _axis(seed, "shift.axis", by)
    section = F.get(F.array(*[F.col(a) for a in AXES]), axis)
    chosen = uniform(seed, "shift.on", by, section) < p
    out = voxels
    moved = {}
    for i, a in enumerate(AXES):
        step = F.floor(uniform(seed, f"shift.{a}", by, section) * (2 * most + 1)).cast("int") - most
        moved[a] = F.when(chosen & (axis != i), F.pmod(F.col(a) + step, F.lit(side))).otherwise(F.col(a)).cast("int")
    return out.withColumns(moved)


def drop_sections(voxels: DataFrame, seed: int, p: float, value: str = "img", by: str = "vol") -> DataFrame:
    """Blank some sections of the image; labels stay."""
    section = F.get(F.array(*[F.col(a) for a in AXES]), _axis(seed, "drop.axis", by))
    return voxels.withColumn(value, F.when(uniform(seed, "drop.on", by, section) < p, 0.0).otherwise(F.col(value)))


def jitter(voxels: DataFrame, seed: int, scale: float, shift: float, value: str = "img", by: str = "vol") -> DataFrame:
    """value * U(1 - m, 1 + m) + U(-a, a), one pair for each sample."""
    return voxels.withColumn(value, F.col(value) * (1 - scale + 2 * scale * uniform(seed, "jitter.m", by)) + (2 * uniform(seed, "jitter.a", by) - 1) * shift)


def noise(voxels: DataFrame, seed: int, scale: float, value: str = "img", by: str = "vol") -> DataFrame:
    """Gaussian noise; its width is U(0, 1) * scale for each sample."""
    return voxels.withColumn(value, F.col(value) + uniform(seed, "noise.s", by) * scale * normal(seed, "noise.v", by, *AXES))


def recipe(voxels: DataFrame, side: int, seed: int, value: str = "img", by: str = "vol") -> DataFrame:
    """Rotate, then shift, drop, jitter and noise, the last four each behind a coin of the sample; for training rows."""
    if value not in voxels.columns:
        raise ValueError(f"no image column {value}")
    out = rotate(voxels, side, seed, by=by)
    coin = {k: uniform(seed, f"coin.{k}", by) < 0.5 for k in ("shift", "drop", "jitter", "noise")}
    out = _either(out, lambda d: shift_sections(d, side, seed, 0.3, 2, by), coin["shift"], list(AXES))
    out = _either(out, lambda d: drop_sections(d, seed, 0.2, value, by), coin["drop"], [value])
    out = _either(out, lambda d: jitter(d, seed, 0.1, 0.1, value, by), coin["jitter"], [value])
    return _either(out, lambda d: noise(d, seed, 0.05, value, by), coin["noise"], [value])


def _either(rows: DataFrame, change: Callable[[DataFrame], DataFrame], coin: Column, columns: list[str]) -> DataFrame:
    """Apply a change of some columns where the coin shows heads."""
    kept = rows.withColumns({f"__{c}": F.col(c) for c in columns})
    changed = change(kept)
    return changed.withColumns({c: F.when(coin, F.col(c)).otherwise(F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def _reflect(c: Column, size: int) -> Column:
    """Coordinates beyond an end come back without repeating the edge."""
    period = 2 * (size - 1)
    at = F.pmod(c, F.lit(period))
    return F.when(at >= size, period - at).otherwise(at).cast("int")


def gaussian_blur(voxels: DataFrame, side: int, sigma: Column, value: str = "img", radius: int = 4, by: str = "vol") -> DataFrame:
    """Separable blur: per axis, every voxel takes from its reflected neighbours; weights add to one.

    One axis at a time; a line of voxels is one array, its taps are looked up in it.
    """
    rows = voxels.select(by, *AXES, F.col(value).cast("double").alias("v"), sigma.alias("sigma"))
    taps = F.sequence(F.lit(-radius), F.lit(radius))
    norm = F.aggregate(taps, F.lit(0.0), lambda s, t: s + F.exp(-0.5 * F.pow(t / F.col("sigma"), F.lit(2))))
    for axis in AXES:
        line = rows.groupBy(by, *[a for a in AXES if a != axis]).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "v"))), lambda s: s["v"]).alias("line"), F.first("sigma").alias("sigma"))
        spread = line.select("*", F.posexplode("line").alias(axis, "__v"))
        total = _taps(axis, side, taps)
        rows = spread.select(by, *AXES, (total / norm).alias("v"), "sigma")
    return rows.select(by, *AXES, F.col("v").alias(value))


def _taps(axis: str, side: int, taps: Column) -> Column:
    return F.aggregate(taps, F.lit(0.0), lambda s, t: s + F.exp(-0.5 * F.pow(t / F.col("sigma"), F.lit(2))) * F.get(F.col("line"), _reflect(F.col(axis) + t, side)))


def photometric(views: DataFrame, by: list[str], contrast: Column, brightness: Column, on: Column, value: str = "img") -> DataFrame:
    """(v - mean) * contrast + mean * brightness over each whole view, where the coin shows heads."""
    mean = views.groupBy(*by).agg(F.avg(value).alias("__m"))
    out = (F.col(value) - F.col("__m")) * contrast + F.col("__m") * brightness
    return views.join(mean, by).withColumn(value, F.when(on, out).otherwise(F.col(value))).drop("__m")


def resize(voxels: DataFrame, sizes: dict[str, tuple[int, int]], value: str = "img", by: str = "vol") -> DataFrame:
    """Multilinear resize, one axis at a time: src = (dst + 0.5) * in / out - 0.5, not below 0."""
    rows = voxels.select(by, *AXES, F.col(value).cast("double").alias("v"))
    for axis, (size, want) in sizes.items():
        line = rows.groupBy(by, *[a for a in AXES if a != axis]).agg(F.transform(F.array_sort(F.collect_list(F.struct(axis, "v"))), lambda s: s["v"]).alias("line"))
        rows = line.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(want - 1))))
        src = F.greatest((F.col(axis) + 0.5) * (size / want) - 0.5, F.lit(0.0))
        low = F.least(F.floor(src), F.lit(size - 1)).cast("int")
        high = F.least(low + 1, F.lit(size - 1))
        part = src - low
        rows = rows.select(by, *AXES, (F.get("line", low) * (1 - part) + F.get("line", high) * part).alias("v"))
    return rows.select(by, *AXES, F.col("v").alias(value))


def resized_crop(voxels: DataFrame, specs: DataFrame, side: int, seed: int, value: str = "img", by: str = "vol") -> DataFrame:
    """Random resized crops: (sample, view) rows of ``specs`` with out size and fraction bounds lo, hi.

    Side lengths are f ** (1/3) * exp((u - 0.5) * 0.4), within [0.05, 1]; the
    centre is drawn so that the crop fits; axes are flipped by coins, the first
    two exchanged by another; values are multilinear with half-pixel centres and
    reflection.  The eight corner rows of an output voxel are one equi-join, always
    a shuffled one: the corners come from a few view rows, so Spark takes their
    table for a small one that it could broadcast.
    """
    keys = (by, "view")
    f = F.col("lo") + uniform(seed, "crop.f", *keys) * (F.col("hi") - F.col("lo"))
    boxes = specs
    for a in AXES:
        boxes = boxes.withColumn(f"s{a}", F.least(F.greatest(F.pow(f, F.lit(1 / 3)) * F.exp((uniform(seed, f"crop.s{a}", *keys) - 0.5) * 0.4), F.lit(0.05)), F.lit(1.0)))
        boxes = boxes.withColumn(f"c{a}", F.col(f"s{a}") / 2 + uniform(seed, f"crop.c{a}", *keys) * (1 - F.col(f"s{a}"))).withColumn(f"f{a}", F.when(uniform(seed, f"crop.f{a}", *keys) < 0.5, -1.0).otherwise(1.0))
    boxes = boxes.withColumn("turn", uniform(seed, "crop.turn", *keys) < 0.5)
    rows = boxes
    for a in AXES:
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0), F.col("out") - 1)))
    unit = {a: ((F.col(a) + 0.5) / F.col("out") - 0.5) for a in AXES}
    turned = {"x": F.when(F.col("turn"), unit["y"]).otherwise(unit["x"]), "y": F.when(F.col("turn"), unit["x"]).otherwise(unit["y"]), "z": unit["z"]}
    for a in AXES:
        src = (F.col(f"c{a}") + turned[a] * F.col(f"f{a}") * F.col(f"s{a}")) * side - 0.5
        rows = rows.withColumn(f"p{a}", src)
    corners = rows.select(by, "view", *AXES, *[f"p{a}" for a in AXES])
    for a in AXES:
        low = F.floor(f"p{a}")
        corners = corners.withColumn(f"k{a}", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(f"w{a}", F.when(F.col(f"k{a}") == 0, 1 - (F.col(f"p{a}") - low)).otherwise(F.col(f"p{a}") - low)).withColumn(f"q{a}", _edge(low + F.col(f"k{a}"), side))
    source = voxels.select(by, *[F.col(a).alias(f"q{a}") for a in AXES], F.col(value).alias("v"))
    return corners.hint("merge").join(source, [by, *[f"q{a}" for a in AXES]]).groupBy(by, "view", *AXES).agg(F.sum(F.col("v") * F.col("wx") * F.col("wy") * F.col("wz")).alias(value))


def _edge(c: Column, size: int) -> Column:
    """Reflection that repeats the edge (half-pixel centres)."""
    at = F.pmod(c, F.lit(2 * size))
    return F.when(at >= size, 2 * size - 1 - at).otherwise(at).cast("int")


def multi_crop(samples: DataFrame, n_local: int, global_out: int, local_out: int) -> DataFrame:
    """Two global and ``n_local`` local view specs of every sample, crop-major."""
    view = F.explode(F.sequence(F.lit(0), F.lit(n_local + 1))).alias("view")
    rows = samples.select("*", view)
    is_global = F.col("view") < 2
    return rows.withColumn("out", F.when(is_global, global_out).otherwise(local_out)).withColumn("lo", F.when(is_global, 0.32).otherwise(0.05)).withColumn("hi", F.when(is_global, 1.0).otherwise(0.32))
