"""Tiled scoring: tile starts, blend weights, overlap-blended sums, orthoplanes, user predictors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def tile_starts(extent: Column, tile: Column, overlap: Column) -> Column:
    """Starts of tiles that cover an extent; the last is pulled back to end with it."""
    stride = F.greatest(tile - overlap, F.lit(1))
    last = extent - tile
    return F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("long"), last.cast("long"), stride.cast("long")), last.cast("long"))))


def register_tile_starts(spark: SparkSession, name: str = "tile_starts") -> str:
    """``tile_starts(extent, tile, overlap)`` as a table function for SQL, joined laterally.

    The same starts as the expression above, one row each; rows go to Python in
    Arrow batches.  A null argument has no tile.
    """

    class TileStarts:
        def eval(self, extent: int | None, tile: int | None, overlap: int | None) -> Iterator[tuple[int]]:
            if extent is None or tile is None or overlap is None:
                return
            last = max(extent - tile, 0)
            for start in range(0, last, max(tile - overlap, 1)):
                yield (start,)
            yield (last,)

    spark.udtf.register(name, F.udtf(TileStarts, returnType="start: bigint", useArrow=True))
    return name


def blend_weight(tile: int, *coordinates: Column) -> Column:
    """Product over the axes of the distance to the nearer tile face, plus one."""
    weight = F.lit(1)
    for c in coordinates:
        weight = weight * (F.least(c, F.lit(tile - 1) - c) + 1)
    return weight


def tiles(extents: DataFrame, tile: int, overlap: int) -> DataFrame:
    """(vol, x0, y0, z0) of every tile; ``extents`` has vol, nx, ny, nz."""
    out = extents
    for a in AXES:
        out = out.withColumn(f"{a}0", F.explode(tile_starts(F.col(f"n{a}"), F.lit(tile), F.lit(overlap))))
    return out.select("vol", *[f"{a}0" for a in AXES], *[f"n{a}" for a in AXES])


def cut_tiles(voxels: DataFrame, tile: int, overlap: int, extent: dict[str, int]) -> DataFrame:
    """One row for each voxel and tile that holds it, with its place in the tile.

    The tiling is known from the extents, so the tiles of a voxel are computed
    from its coordinates; nothing is joined.
    """

    def holding(axis: str) -> Column:
        starts = tile_starts(F.lit(extent[axis]), F.lit(tile), F.lit(overlap))
        return F.filter(starts, lambda s: (F.col(axis) >= s) & (F.col(axis) < s + tile))

    out = voxels
    for a in AXES:
        out = out.withColumn(f"{a}0", F.explode(holding(a))).withColumn(f"t{a}", F.col(a) - F.col(f"{a}0"))
    return out


def blend(predictions: DataFrame, tile: int, by: list[str]) -> DataFrame:
    """Weighted mean over tiles: sum(score * w) / max(sum(w), 1e-8) for each ``by``.

    ``predictions`` has the place in the tile (tx, ty, tz) and a score.
    """
    weight = blend_weight(tile, *[F.col(f"t{a}") for a in AXES])
    return predictions.groupBy(*by).agg((F.sum(F.col("score") * weight) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("score"))


def orthoplane_mean(planes: dict[str, DataFrame], by: list[str]) -> DataFrame:
    """Mean of the scores of three plane stacks, each back in the frame of the volume.

    ``planes[axis]`` has vol, slice, row, col and a score, where slice runs along
    the axis and row, col along the other two in order.
    """
    parts = None
    for axis, df in planes.items():
        others = [a for a in AXES if a != axis]
        part = df.withColumnsRenamed({"slice": axis, "row": others[0], "col": others[1]}).select(*by, "score")
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy(*by).agg((F.sum("score") / len(planes)).alias("score"))


def argmax_class(scores: DataFrame, by: list[str]) -> DataFrame:
    """The class with the highest score; the lowest class on ties."""
    return scores.groupBy(*by).agg(F.max_by("cls", F.struct(F.col("score"), -F.col("cls"))).alias("pred"))


def predict_tiles(blocks: DataFrame, predict: Callable[[np.ndarray], np.ndarray], tile: tuple[int, int, int], batch: int = 8) -> DataFrame:
    """Run a predictor (B, 1, *tile) -> (B, K, *tile) on rows (vol, x0, y0, z0, values)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first in range(0, len(frame), batch):
                part = frame.iloc[first : first + batch]
                out = predict(np.stack([np.asarray(v, dtype=np.float32).reshape(1, *tile) for v in part["values"]]))
                yield part[["vol", "x0", "y0", "z0"]].assign(scores=[o.reshape(-1).tolist() for o in np.asarray(out, dtype=np.float64)])

    return blocks.mapInPandas(run, "vol long, x0 long, y0 long, z0 long, scores array<double>")
