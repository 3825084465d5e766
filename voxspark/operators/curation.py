"""Choosing rows: allow lists, hold-out groups, checks on grids and labels, boxes and defaults."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def _need(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def guarded(df: DataFrame, check: DataFrame) -> DataFrame:
    """``df`` if the one row of ``check`` can be computed (it raises otherwise).

    The filter reads the row's value, so that it is computed even where no
    column of it is used.
    """
    mark = check.select(F.coalesce(check[check.columns[0]].cast("string"), F.lit("")).alias("__ok"))
    return df.join(F.broadcast(mark)).where(F.length("__ok") >= 0).drop("__ok")


def counted(df: DataFrame, seen: Observation) -> DataFrame:
    """``df``, whose rows are counted in ``seen`` by the job that reads them."""
    return df.observe(seen, F.count(F.lit(1)).alias("rows"))


def require_rows(seen: Observation, least: int = 1, most: int | None = None) -> int:
    """The rows that ``counted`` saw, once their job has run; too few or too many are an error."""
    rows = seen.get["rows"]
    if rows < least or (most is not None and rows > most):
        raise ValueError(f"{rows} rows, expected {least if most == least else f'{least} to {most}' if most is not None else f'{least} or more'}")
    return rows


def allow(df: DataFrame, allowed: dict[str, list], seen: Observation | None = None) -> DataFrame:
    """Rows whose columns all hold an allowed value; an unknown column or no row left is an error.

    With ``seen`` no job runs here: the rows are counted by the job that uses
    them, and ``require_rows(seen)`` is the check afterwards.
    """
    _need(df, *allowed)
    out = df
    for name, values in allowed.items():
        out = out.where(F.col(name).isin(values))
    if seen is not None:
        return counted(out, seen)
    if out.isEmpty():
        raise ValueError(f"no row has {allowed}")
    return out


def group_key(name: Column, levels: int) -> Column:
    """The first ``levels`` parts of a path-like name."""
    return F.substring_index(name, "/", levels)


def hold_out(df: DataFrame, name: str, levels: int, held: Iterable[str] | None, split: str, seen: Observation | None = None) -> DataFrame:
    """The ``val`` rows (groups that are held out) or the ``train`` rows (all others).

    ``seen`` as in ``allow``.
    """
    held = list(held or [])
    if split not in ("train", "val"):
        raise ValueError(f"a split is train or val, not {split}")
    if split == "val" and not held:
        raise ValueError("a val split needs held-out groups")
    inside = group_key(F.col(name), levels).isin(held)
    out = df.where(inside if split == "val" else ~inside)
    if seen is not None:
        return counted(out, seen)
    if out.isEmpty():
        some = [r[0] for r in df.select(group_key(F.col(name), levels)).distinct().limit(20).collect()]
        raise ValueError(f"the {split} split is empty; groups are {some}")
    return out


def check_class_bound(df: DataFrame, label: str, classes: int) -> DataFrame:
    """``df``, which fails when a label is not below the number of classes."""
    top = F.coalesce(F.max(label), F.lit(-1))
    return guarded(df, df.agg(top.alias("top")).select(F.when(F.col("top") < classes, F.col("top")).otherwise(F.raise_error(F.concat(F.lit(f"{label} reaches "), F.col("top").cast("string"), F.lit(f" but there are {classes} classes")))).alias("top")))


def without_ignored(df: DataFrame, label: str, ignore: int = -1) -> DataFrame:
    """Rows whose label is known."""
    return df.where(F.col(label) != ignore)


def parse_axes(axes: str, channels: bool = True) -> dict[str, list[str]]:
    """Layout of a string such as ``lcxyz``: spatial axes in order of appearance, and the label layout.

    A level axis ``l`` is required, other letters occur once, and at most one
    channel axis stands in front of the spatial ones once ``l`` is taken out.
    """
    if len(set(axes)) != len(axes) or not set(axes) <= set("lcxyz"):
        raise ValueError(f"axes are l, c, x, y, z, each once: {axes}")
    if "l" not in axes:
        raise ValueError(f"no level axis in {axes}")
    rest = axes.replace("l", "")
    if "c" in rest and (not channels or rest[0] != "c"):
        raise ValueError(f"the channel axis comes first: {axes}")
    return {"spatial": [a for a in axes if a in AXES], "label": [a for a in axes if a != "c"], "offset_from_end": [str(axes.index(a) - len(axes)) for a in axes if a in AXES]}


def by_axes(df: DataFrame, axes: str) -> DataFrame:
    """Rename the spatial columns to a0, a1, ... in the order of the layout."""
    return df.withColumnsRenamed({a: f"a{i}" for i, a in enumerate(parse_axes(axes)["spatial"])})


def level_gate(df: DataFrame, levels: list[int]) -> DataFrame:
    """``df``, which fails unless its levels are exactly those declared."""
    found = df.agg(F.array_sort(F.collect_set("level")).alias("found"))
    return guarded(df, found.select(F.when(F.col("found") == F.array(*[F.lit(v) for v in sorted(levels)]), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("levels are "), F.to_json("found")))).alias("found")))


def extents(df: DataFrame, by: list[str]) -> DataFrame:
    """Grid shape of each volume."""
    return df.groupBy(*by).agg(*[(F.max(a) - F.min(a) + 1).cast("long").alias(f"n{a}") for a in AXES])


def registration(image: DataFrame, label: DataFrame, by: list[str]) -> DataFrame:
    """Volumes of an image and a label table with both shapes and whether they agree."""
    names = [f"n{a}" for a in AXES]
    left = extents(image, by).select(*by, F.array(*names).alias("image_shape"))
    right = extents(label, by).select(*by, F.array(*names).alias("label_shape"))
    return left.join(right, by, "full").withColumn("agree", F.coalesce(F.col("image_shape") == F.col("label_shape"), F.lit(False)))


def isotropic(sizes: Column, rtol: float = 1e-6, atol: float = 1e-9) -> Column:
    """Whether voxel sizes of axes to be exchanged are equal; unknown sizes pass."""
    top, low = F.array_max(sizes), F.array_min(sizes)
    return F.coalesce(top - low <= atol + rtol * F.abs(top), F.lit(True))


def in_box(lo: dict[str, int], hi: dict[str, int]) -> Column:
    """Whether coordinates lie in [lo, hi) on every axis: range predicates that a scan can use."""
    inside = F.lit(True)
    for a in lo:
        inside = inside & (F.col(a) >= lo[a]) & (F.col(a) < hi[a])
    return inside


def sparse_default(written: DataFrame, grid: DataFrame, keys: list[str], label: str = "label", default: int = -1) -> DataFrame:
    """Labels of every grid point; those never written are unknown."""
    return grid.join(written.select(*keys, label), keys, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default).cast("long")))


def pyramid(voxels: DataFrame, levels: int, means: list[str], corners: list[str]) -> DataFrame:
    """Level 0 with the coarser levels made from it, each of half the voxels an axis of the one before.

    A coarse voxel has the mean of ``means`` over the voxels inside it (fewer at
    a ragged end), and of ``corners`` (labels) the value of its first voxel,
    null where that is missing.  Only coarse voxels are shuffled.
    """
    fine = voxels.where(F.col("level") == 0)
    names = ["vol", "level", *AXES, *means, *corners]
    if levels < 2:
        return fine.select(names)
    steps = fine.drop("level").withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels - 1)))).withColumn("__side", F.expr("shiftleft(1, level)"))
    first = F.lit(True)
    for a in AXES:
        first = first & (F.col(a) % F.col("__side") == 0)
    cell = [F.expr(f"cast({a} div __side as int)").alias(a) for a in AXES]
    coarse = steps.groupBy("vol", "level", *cell).agg(*[F.avg(c).alias(c) for c in means], *[F.max(F.when(first, F.col(c))).alias(c) for c in corners])
    return fine.select(names).unionByName(coarse.select(names))


def choose_level(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """The coarsest level whose voxel size is at most the request on every axis, else the finest.

    ``requests``: id and want (array); ``levels``: level (finest first) and size
    (array), a handful of rows.
    """
    fits = F.forall(F.zip_with("size", "want", lambda v, w: v <= w), lambda ok: ok)
    return requests.join(F.broadcast(levels)).groupBy("id").agg(F.coalesce(F.max(F.when(fits, F.col("level"))), F.min("level")).alias("level"))
