"""Patch tables, masks and reconstruction errors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.draws import gamma, uniform

AXES = ("x", "y", "z")


def patch_ids(voxels: DataFrame, extent: dict[str, int], patch: int) -> DataFrame:
    """Add ``patch`` (row-major over the grid) and ``offset`` (row-major in the patch)."""
    if bad := [a for a in extent if extent[a] % patch]:
        raise ValueError(f"patches of {patch} do not fill the axis {bad[0]} of {extent[bad[0]]}")
    at, offset = F.lit(0), F.lit(0)
    for a in extent:
        at = at * (extent[a] // patch) + F.expr(f"{a} div {patch}")
        offset = offset * patch + F.col(a) % patch
    return voxels.withColumn("patch", at.cast("int")).withColumn("offset", offset.cast("int"))


def patchify(voxels: DataFrame, extent: dict[str, int], patch: int, by: list[str], value: str = "img") -> DataFrame:
    """One row for each patch: its values in row-major order."""
    cells = patch_ids(voxels, extent, patch)
    ordered = F.sort_array(F.collect_list(F.struct("offset", F.col(value).alias("v"))))
    return cells.groupBy(*by, "patch").agg(ordered["v"].alias("values"))


def unpatchify(patches: DataFrame, extent: dict[str, int], patch: int, by: list[str]) -> DataFrame:
    """The voxels of patch rows."""
    rows = patches.select(*by, "patch", F.posexplode("values").alias("offset", "value"))
    rest_p, rest_o, coords = F.col("patch"), F.col("offset"), []
    for a in reversed(list(extent)):
        grid = extent[a] // patch
        coords.append(((rest_p % grid) * patch + rest_o % patch).cast("int").alias(a))
        rest_p, rest_o = F.floor(rest_p / grid), F.floor(rest_o / patch)
    return rows.select(*by, *reversed(coords), "value")


def grid_coordinates(patch: Column, grid: list[int]) -> list[Column]:
    """Indices along each axis of a row-major patch number."""
    out, rest = [], patch
    for n in reversed(grid):
        out.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    return list(reversed(out))


def world_coordinates(index: Column, count: int, lo: Column, hi: Column) -> Column:
    """lo + i / (n - 1) * (hi - lo); a single patch lies at lo."""
    return lo + (index / F.lit(float(max(count - 1, 1)))) * (hi - lo) if count > 1 else lo


def recentred_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes (sample, level, lo, hi arrays) relative to the centre of the sample's finest level."""
    finest = boxes.groupBy("sample").agg(F.min_by(F.zip_with("lo", "hi", lambda a, b: (a + b) / 2), "level").alias("__c"))
    moved = boxes.join(finest, "sample")
    return moved.withColumn("lo", F.zip_with("lo", "__c", lambda a, c: a - c)).withColumn("hi", F.zip_with("hi", "__c", lambda a, c: a - c)).drop("__c")


def keep_count(n: Column, ratio: float) -> Column:
    """max(1, round(n (1 - ratio))), halves to even."""
    return F.greatest(F.lit(1), F.bround(n * F.lit(1 - ratio)).cast("int"))


def random_mask(tokens: DataFrame, by: list[str], token: str, ratio: float, seed: int) -> DataFrame:
    """Add ``hidden``: in each sample exactly the kept count of tokens stays visible."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(uniform(seed, "mask", *by, token), token))
    n = F.count("*").over(Window.partitionBy(*by))
    return tokens.withColumn("hidden", place > keep_count(n, ratio))


def granular_mask(patches: DataFrame, by: list[str], grid: list[int], granularity: int, ratio: float, seed: int) -> DataFrame:
    """Add ``hidden`` by coarse units: max(1, round(units * ratio)) of them are hidden whole."""
    coarse = [-(-g // granularity) for g in grid]
    unit = F.lit(0)
    for index, n in zip(grid_coordinates(F.col("patch"), grid), coarse, strict=True):
        unit = unit * n + F.floor(index / granularity)
    units = int(np.prod(coarse))
    hide = max(1, round(units * ratio))
    rows = patches.withColumn("unit", unit.cast("int"))
    drawn = rows.select(*by, "unit").distinct()
    drawn = drawn.withColumn("hidden", F.row_number().over(Window.partitionBy(*by).orderBy(uniform(seed, "unit", *by, "unit"), "unit")) <= hide)
    return rows.join(drawn, [*by, "unit"]).drop("unit")


def dirichlet(levels: DataFrame, sample: str, level: str, alpha: float, seed: int) -> DataFrame:
    """Add ``__w``: the part of each level of a sample in a symmetric Dirichlet draw, 1e-9 at least."""
    drawn = levels.withColumn("__g", gamma(alpha, seed, "dir", sample, level))
    whole = F.greatest(F.sum("__g").over(Window.partitionBy(sample)), F.lit(1e-300))  # a row for each level
    return drawn.withColumn("__w", F.greatest(F.col("__g") / whole, F.lit(1e-9))).drop("__g")


def level_weighted_mask(tokens: DataFrame, sample: str, level: str, token: str, visible: int, seed: int, alpha: float = 0.5) -> DataFrame:
    """Add ``hidden``: ``visible`` tokens of a sample stay, drawn without replacement.

    The weight of a level is its part of a symmetric Dirichlet draw of concentration
    ``alpha``: gamma numbers, normalised; tokens are ordered by ln(u) / w.
    """
    weights = dirichlet(tokens.select(sample, level).distinct(), sample, level, alpha, seed)
    key = F.log(1 - uniform(seed, "gumbel", sample, level, token)) / F.col("__w")
    place = F.row_number().over(Window.partitionBy(sample).orderBy(F.desc(key), level, token))
    return tokens.join(weights, [sample, level]).withColumn("hidden", place > visible).drop("__w")


#: fixed values: the law of block masks
LEAST_PATCHES, MOST_ASPECT = 4, 1 / 0.3


class _Draws:
    """Numbers that ``np.random.default_rng([seed, sample])`` draws, for many samples side by side."""

    def __init__(self, seed: int, samples: np.ndarray, size: int) -> None:
        self.words = np.stack([np.random.PCG64([seed, s]).random_raw(size) for s in samples.tolist()])
        self.at, self.half, self.kept = (np.zeros(len(samples), dtype=t) for t in (np.int64, bool, np.uint64))

    def _word(self, rows: np.ndarray) -> np.ndarray:
        out = self.words[rows, self.at[rows]]
        self.at[rows] += 1
        return out

    def uniform(self, rows: np.ndarray) -> np.ndarray:
        return (self._word(rows) >> np.uint64(11)) * (1.0 / (1 << 53))

    def _short(self, rows: np.ndarray) -> np.ndarray:
        """32 bits: the low half of a word, then its high half."""
        out, fresh = self.kept[rows], rows[~self.half[rows]]
        word = self._word(fresh)
        out[~self.half[rows]] = word & np.uint64(0xFFFFFFFF)
        self.kept[fresh] = word >> np.uint64(32)
        self.half[rows] = ~self.half[rows]
        return out

    def below(self, rows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whole numbers from 0 to before ``ends``, by multiplication; an end of 1 draws nothing."""
        out = np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(ends > 1)
        while len(todo):
            n = ends[todo].astype(np.uint64)
            wide = self._short(rows[todo]) * n
            low, least = wide & np.uint64(0xFFFFFFFF), (np.uint64(1 << 32) - n) % n
            out[todo] = wide >> np.uint64(32)
            todo = todo[low < least]
        return out


def _drawn_masks(samples: np.ndarray, ratio: np.ndarray, grid: list[int], seed: int) -> np.ndarray:
    """Flat masks of samples, step by step for all of them at once."""
    size, rank = int(np.prod(grid)), len(grid)
    masks, goal = np.zeros((len(samples), size), dtype=bool), (ratio * size).astype(np.int64)
    rows = np.flatnonzero(goal > 0)
    if not len(rows):
        return masks
    draws = _Draws(seed, samples[rows], 64 * (2 + rank) + 64)
    place = np.indices(grid).reshape(rank, size)
    left, cells, alive = goal[rows], masks[rows], np.arange(len(rows))
    for _ in range(64):
        alive = alive[left[alive] > 0]
        if not len(alive):
            break
        area = LEAST_PATCHES + (np.maximum(LEAST_PATCHES + 1, left[alive]) - LEAST_PATCHES) * draws.uniform(alive)
        aspect = np.exp((-1 + 2 * draws.uniform(alive)) * np.log(MOST_ASPECT))
        side = np.maximum(1, np.rint((area * aspect) ** (1 / rank)).astype(np.int64))
        box = np.ones((len(alive), size), dtype=bool)
        for axis, g in zip(place, grid, strict=True):
            sides = np.minimum(side, g)
            start = draws.below(alive, g - sides + 1)
            box &= (axis >= start[:, None]) & (axis < (start + sides)[:, None])
        fresh = (box & ~cells[alive]).sum(axis=1)
        taken = (fresh > 0) & (fresh <= left[alive])
        cells[alive[taken]] |= box[taken]
        left[alive[taken]] -= fresh[taken]
    masks[rows] = cells
    return masks


def block_masks(samples: DataFrame, grid: list[int], share: float, lo: float, hi: float, seed: int) -> DataFrame:
    """(sample, ratio, hidden array) for samples numbered 0 .. B - 1 in ``pos`` of ``total``.

    The first int(B * share) samples are masked, at ratios spaced from ``lo`` to
    ``hi``.  At most 64 blocks of equal sides are proposed: an even area from
    ``LEAST_PATCHES`` to what is left, an aspect whose logarithm is even within
    1 / ``MOST_ASPECT`` to ``MOST_ASPECT``; one is taken if it adds patches and does not
    exceed what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sample, pos, total = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sample", "pos", "total"))
            masked = (total * share).astype(np.int64)
            ratio = np.where(pos < masked, lo + (hi - lo) * pos / np.maximum(masked - 1, 1), 0.0)
            masks = np.concatenate([_drawn_masks(sample[k : k + 2048], ratio[k : k + 2048], grid, seed) for k in range(0, len(sample), 2048)] or [np.zeros((0, int(np.prod(grid))), dtype=bool)])
            bounds = pa.array(np.arange(len(masks) + 1, dtype=np.int32) * masks.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("sample"), pa.array(ratio, pa.float64()), pa.ListArray.from_arrays(bounds, pa.array(masks.reshape(-1)))], names=["sample", "ratio", "hidden"])

    return samples.select("sample", "pos", "total").mapInArrow(run, "sample long, ratio double, hidden array<boolean>")


def restore(visible: DataFrame, grid: DataFrame, by: list[str], token: str, vec: str, mask_vectors: dict[int, list[float]], level: str | None = None) -> DataFrame:
    """All tokens in order: visible ones as they are, hidden ones by the constant vector (of their level)."""
    constant = F.lit(None).cast("array<double>")
    for k, v in mask_vectors.items():
        here = F.array(*[F.lit(float(x)) for x in v])
        constant = F.when(F.col(level) == k, here).otherwise(constant) if level else here
    return grid.join(visible.select(*by, token, vec), [*by, token], "left").withColumn(vec, F.coalesce(F.col(vec), constant))


def standardise(values: Column) -> Column:
    """(v - mean) / sqrt(sample variance + 1e-6) of an array; null for a single value."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / n

    def root(mean: Column) -> Column:
        spread = F.when(n > 1, F.aggregate(values, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean)) / F.greatest(n - 1, F.lit(1)))
        return F.sqrt(spread + 1e-6)

    # what stands inside a lambda is computed for each element, so mean and root are arguments
    scaled = F.transform(F.array(mean), lambda m: F.transform(F.array(root(m)), lambda r: F.transform(values, lambda v: (v - m) / r))[0])
    return scaled[0]


def patch_error(pred: Column, target: Column, power: int) -> Column:
    """Mean of |p - t| ** power over the values of a patch."""
    total = F.aggregate(F.zip_with(pred, target, lambda p, t: F.pow(F.abs(p - t), F.lit(power))), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(target)


def masked_loss(rows: DataFrame, by: list[str], error: str = "error") -> DataFrame:
    """Mean error of hidden patches, of visible ones, and the hidden share; denominators are one at least."""
    hidden = F.col("hidden")
    return rows.groupBy(*by).agg(
        (F.sum(F.when(hidden, F.col(error)).otherwise(0.0)) / F.greatest(F.count(F.when(hidden, 1)), F.lit(1))).alias("masked"),
        (F.sum(F.when(~hidden, F.col(error)).otherwise(0.0)) / F.greatest(F.count(F.when(~hidden, 1)), F.lit(1))).alias("visible"),
        F.avg(hidden.cast("double")).alias("share"),
    )


def level_balanced_loss(rows: DataFrame, sample: str, level: str, error: str = "error") -> DataFrame:
    """Mean over the (sample, level) pairs that have hidden patches of their mean error; share of visible patches at the finest level."""
    pairs = rows.groupBy(sample, level).agg(F.avg(F.when(F.col("hidden"), F.col(error))).alias("loss"), F.avg((~F.col("hidden")).cast("double")).alias("visible"))
    finest = rows.agg(F.min(level).alias("__finest"))
    return pairs.join(F.broadcast(finest)).agg(F.avg("loss").alias("loss"), F.count("loss").alias("pairs"), F.avg(F.when(F.col(level) == F.col("__finest"), F.col("visible"))).alias("finest_visible"))
