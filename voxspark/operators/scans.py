"""Running folds over ordered groups of any size, without a task that holds a group.

Rows are dealt out by range of (group, order) into parts that grow in number
with the rows, and kept.  Every part is folded by itself; what a group brings
along from the parts before is a carry.  Of the groups of a part only the first
can have begun before it, so there is at most one carry a part: that table is
small at any size and is broadcast.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.storage import stored

PART_ROWS = 1_000_000


class Fold(NamedTuple):
    """What is folded: ``sum`` (nulls count 0), ``max``, ``min`` or ``last`` (the last value that is not null).

    ``before``: the row itself is left out.
    """

    kind: str
    value: Column
    before: bool = False


def _within(fold: Fold, value: str, window: Window) -> Column:
    kinds = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}
    return kinds[fold.kind](value).over(window.rowsBetween(Window.unboundedPreceding, -1 if fold.before else 0))


def _of_part(fold: Fold, value: str, order: list[str]) -> Column:
    """The fold of all rows of a group in a part."""
    if fold.kind == "last":
        return F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max, "min": F.min}[fold.kind](value)


def _both(fold: Fold, carry: Column, own: Column) -> Column:
    if fold.kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(own, F.lit(0))
    return F.coalesce(own, carry) if fold.kind == "last" else {"max": F.greatest, "min": F.least}[fold.kind](own, carry)


def running(df: DataFrame, by: list[str], order: list[str], folds: dict[str, Fold], part_rows: int | None = None) -> DataFrame:
    """Add a column for each fold over the rows of a group up to each row in an order (nulls first).

    Rows that are equal in ``order`` are folded in any order and share a part, so
    an order that tells rows apart is needed for a defined result and for parts of
    even size.  Columns of any name may be there.
    """
    free = "_" * (1 + max(map(len, df.columns)))
    part, values = free + "part", {name: f"{free}v{k}" for k, name in enumerate(folds)}
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / (part_rows or PART_ROWS)))
    valued = df.withColumns({values[name]: fold.value for name, fold in folds.items()})
    dealt = stored(valued.repartitionByRange(parts, *by, *order).withColumn(part, F.spark_partition_id()), "dealt")
    window = Window.partitionBy(*by, part).orderBy(*order)
    found = dealt.withColumns({name: _within(fold, values[name], window) for name, fold in folds.items()})

    sums = dealt.groupBy(*by, part).agg(*[_of_part(fold, values[name], order).alias(values[name]) for name, fold in folds.items()])
    earlier = Window.partitionBy(*by).orderBy(part)  # a row for each part
    carries = {f"{values[name]}c": _within(fold._replace(before=True), values[name], earlier) for name, fold in folds.items()}
    place = f"{free}n"
    carried = sums.withColumns({**carries, place: F.row_number().over(earlier)}).where(F.col(place) > 1)  # at most one a part
    keys = {b: f"{free}b{k}" for k, b in enumerate(by)}
    carried = carried.select(F.col(part).alias(free + "at"), *[F.col(b).alias(k) for b, k in keys.items()], *carries)
    same = F.col(part) == F.col(free + "at")
    for b, k in keys.items():
        same = same & F.col(b).eqNullSafe(F.col(k))
    out = found.join(F.broadcast(carried), same, "left")
    return out.select(*[F.col(c) for c in df.columns if c not in folds], *[_both(fold, F.col(f"{values[name]}c"), F.col(name)).alias(name) for name, fold in folds.items()])
