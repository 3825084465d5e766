"""Label volumes: offsets, neighbour affinities, adjacency, components, scores and overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxspark.functions.storage import stored
from voxspark.functions.workers import map_groups, ship
from voxspark.operators import merge_trees
from voxspark.operators.graph import connected_components

AXES = ("x", "y", "z")
GRID = ("vol", "level")


def offset_rows(rank: int = 3, short: int = 1, far: int = 10) -> list[tuple[int, tuple[int, ...]]]:
    """(channel, offset): one short step along each axis, then one far step along each."""
    return [(block * rank + axis, tuple(step if a == axis else 0 for a in range(rank))) for block, step in enumerate((short, far)) for axis in range(rank)]


def offset_table(spark: SparkSession, rank: int = 3, short: int = 1, far: int = 10) -> DataFrame:
    """The offsets as a table: channel and one column per axis."""
    rows = [(channel, *offset) for channel, offset in offset_rows(rank, short, far)]
    return spark.createDataFrame(rows, "channel int, " + ", ".join(f"d{a} int" for a in AXES[:rank]))


def neighbours(voxels: DataFrame, offsets: list[tuple[int, ...]], values: tuple[str, ...], keep: tuple[str, ...] = (), side: int = 64) -> DataFrame:
    """Add ``near_<value>`` for each of ``values``: an array of that column at every offset, null where no voxel is.

    One shuffle whatever the offsets: a voxel goes to its own block of ``side``
    voxels an axis and, without the columns named in ``keep``, to those other
    blocks from which an offset reaches it.  Grids may have gaps; of voxels
    repeated at one place any one is the neighbour.  Coordinates are not null.
    """
    if any(len(offset) != len(AXES) for offset in offsets):
        raise ValueError(f"offsets need the rank of the grid, {len(AXES)}")
    ship(voxels.sparkSession)
    keys, steps = [*GRID, *AXES], [np.array(offset, dtype=np.int64) for offset in offsets]
    fields = [voxels.schema[c] for c in [*keys, *keep, *values]]
    out = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(f"near_{v}", T.ArrayType(voxels.schema[v].dataType)) for v in values])

    def block(offset: tuple[int, ...]) -> Column:
        return F.struct(*[F.floor((F.col(a) - d) / side).alias(a) for a, d in zip(AXES, offset, strict=True)])

    own = block((0,) * len(AXES))
    homes = voxels.select(*keys, *keep, *values, F.explode(F.array_distinct(F.array(own, *[block(o) for o in offsets]))).alias("__home")).withColumn("__own", F.col("__home") == own)
    homes = homes.withColumns({c: F.when(F.col("__own"), F.col(c)) for c in keep})

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        place = np.stack([table[a].to_numpy() for a in AXES], axis=1).astype(np.int64)
        low, high = place.min(axis=0), place.max(axis=0)
        shape = high - low + 1

        def flat(at: np.ndarray) -> np.ndarray:
            return ((at[:, 0] - low[0]) * shape[1] + at[:, 1] - low[1]) * shape[2] + at[:, 2] - low[2]

        code = flat(place)
        order = np.argsort(code)
        code, mine = code[order], table["__own"].to_numpy()
        ends = np.empty((int(mine.sum()), len(steps)), dtype=np.int64)
        for k, step in enumerate(steps):
            end = place[mine] + step
            wanted = flat(end)
            found = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
            hit = ((end >= low) & (end <= high)).all(axis=1) & (code[found] == wanted)
            ends[:, k] = np.where(hit, order[found], -1)
        picks = pa.array(ends.ravel(), mask=ends.ravel() < 0)
        bounds = pa.array(np.arange(len(ends) + 1, dtype=np.int32) * len(steps))
        columns = table.select([f.name for f in fields]).filter(table["__own"])
        for v in values:
            near = table[v].take(picks).combine_chunks()
            columns = columns.append_column(f"near_{v}", pa.ListArray.from_arrays(bounds, near))
        return columns

    return homes.groupBy(*GRID, "__home").applyInArrow(run, out)


def affinities(voxels: DataFrame, offsets: list[tuple[int, tuple[int, ...]]], label: str = "label", keep: tuple[str, ...] = (), side: int = 64) -> DataFrame:
    """Long rows (vol, level, x, y, z, channel, affinity, mask) of every voxel and offset.

    An affinity holds where both ends have one positive id; the mask holds where
    both ends are inside and known (not -1).  Columns of the voxels named in
    ``keep`` are repeated in each of its rows.  ``side``: see :func:`neighbours`.
    """
    keys = [*GRID, *AXES]
    near = neighbours(voxels.select(*keys, *keep, F.col(label).alias("own")), [o for _, o in offsets], ("own",), keep, side)
    ends = F.array(*[F.struct(F.lit(channel).alias("channel"), F.col("near_own")[k].alias("other")) for k, (channel, _) in enumerate(offsets)])
    found = near.select(*keys, *keep, "own", F.explode(ends).alias("e")).select(*keys, *keep, "own", "e.*")
    known = F.col("other").isNotNull() & (F.col("own") >= 0) & (F.col("other") >= 0)
    same = F.coalesce((F.col("own") == F.col("other")) & (F.col("own") > 0), F.lit(False))
    return found.select(*keys, *keep, "channel", same.alias("affinity"), F.coalesce(known, F.lit(False)).alias("mask"))


def _steps(rank: int) -> list[tuple[int, ...]]:
    """One step along each of the first ``rank`` axes."""
    return [tuple(int(a == axis) for a in range(len(AXES))) for axis in range(rank)]


def adjacency(voxels: DataFrame, label: str = "label", rank: int = 3, side: int = 64) -> DataFrame:
    """Edges (u, v) between face neighbours with one positive id, by flat index ``id``."""
    near = neighbours(voxels.select(*GRID, *AXES, "id", F.col(label).alias("own")), _steps(rank), ("id", "own"), (), side)
    return near.where("own > 0").select("id", "own", F.explode(F.arrays_zip("near_id", "near_own")).alias("e")).where("e.near_own = own").select(F.col("id").alias("u"), F.col("e.near_id").alias("v"))


def split_components(voxels: DataFrame, label: str = "label", rank: int = 3, side: int = 64) -> DataFrame:
    """Add ``piece``: the smallest flat index of the voxel's connected piece of one id.

    Background and unknown voxels keep their own label as the piece (0 and -1
    cannot clash with a piece: those of a grid start at id 1 or hold ``base``).
    Levels and volumes never touch, as ``id`` is unique over all of them.
    """
    pieces = split_components_by_block(voxels.select(*GRID, *AXES, "id", label), side, label, rank)
    return pieces if set(voxels.columns) == set(pieces.columns) - {"piece"} else voxels.join(pieces.select("id", "piece"), "id")


def _local_roots(ids: np.ndarray, own: np.ndarray, number: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Smallest id of the piece of each voxel inside its block; see :func:`merge_trees.next_pairs`."""
    order = np.argsort(ids, kind="stable")
    ids, own = ids[order], own[order]
    ends = []
    for a, b in merge_trees.next_pairs(number[order], place[order]):
        same = (own[a] == own[b]) & (own[a] > 0)
        ends.append((a[same], b[same]))
    u, v = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
    parent = np.arange(len(ids))
    while len(u):  # hook roots, then shorten all paths
        a, b = parent[u], parent[v]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        apart = parent[u] != parent[v]
        u, v = u[apart], v[apart]
    out = np.empty(len(ids), dtype=np.int64)
    out[order] = ids[parent]
    return out


def split_components_by_block(voxels: DataFrame, side: int, label: str = "label", rank: int = 3) -> DataFrame:
    """The same as :func:`split_components`, in two levels.

    A task labels blocks of ``side`` voxels an axis each by itself; only pairs of
    local pieces that touch across block faces become edges, so the loop over
    the graph grows with the faces of blocks and not with their voxels.
    """
    axes = AXES[:rank]
    kept = ["vol", "level", *AXES, "id", label]
    blocks = [F.floor(F.col(a) / side).alias(f"b{a}") for a in axes]

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        place = np.stack([table[a].to_numpy() for a in axes], axis=1).astype(np.int64) % side
        roots = _local_roots(table["id"].to_numpy(), table[label].to_numpy(), number, place)
        yield table.select(kept).append_column("root", pa.array(roots))

    schema = ", ".join(f"`{c}` {voxels.schema[c].dataType.simpleString()}" for c in kept) + ", root long"
    local = stored(map_groups(voxels.select(*kept, *blocks), [*GRID, *[f"b{a}" for a in axes]], run, schema), "local")
    edges = None
    for a in axes:
        others = [*GRID, *[o for o in AXES if o != a]]
        left = local.where((F.pmod(a, F.lit(side)) == side - 1) & (F.col(label) > 0)).select(*others, (F.col(a) + 1).alias(a), F.col(label).alias("own"), F.col("root").alias("u"))
        right = local.where((F.pmod(a, F.lit(side)) == 0) & (F.col(label) > 0)).select(*others, a, F.col(label).alias("own"), F.col("root").alias("v"))
        part = left.join(right, [*others, a, "own"]).select("u", "v").distinct()
        edges = part if edges is None else edges.union(part)
    edges = stored(edges, "face-edges")
    if edges.isEmpty():  # every volume is one block
        out = local.withColumn("top", F.col("root"))
    else:
        out = local.join(connected_components(edges).select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    out = out.withColumn("piece", F.when(F.col(label) > 0, F.coalesce("top", "root")).otherwise(F.col(label)))
    return out.select(*kept, "piece")


def segment(voxels: DataFrame, threshold: float, min_size: int, logits: str = "logits", side: int = 64) -> DataFrame:
    """(id, segment): pieces of the graph of short edges whose logit is above the threshold; small pieces are 0.

    ``logits``: an array with the logit of the step along each axis first.
    """
    pieces = merge_trees.cut(merge_trees.build(voxels, logits, side), [threshold])
    sizes = pieces.groupBy("name").agg(F.count("*").alias("size"))
    return pieces.join(sizes, "name").select("id", F.when(F.col("size") >= min_size, F.col("name") + 1).otherwise(0).alias("segment"))


def threshold_sweep(trees: merge_trees.MergeTrees, thresholds: list[float], min_size: int, truth: str) -> DataFrame:
    """Coverage, merges, splits and score of pairs (F1) at every threshold, from one build of the merge trees."""
    found = merge_trees.sums(trees, thresholds, min_size, truth)
    total = found.totals.groupBy("k").agg(*[F.sum(c).alias(c) for c in merge_trees.TOTALS], F.lit(0).alias("ignored"))
    by_true = found.truths.groupBy("k", "truth").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids")).groupBy("k").agg(_pairs(F.col("n")).alias("true_pairs"), F.count(F.when(F.col("ids") > 1, 1)).alias("splits"))
    found = _overlap_scores(total.join(by_true, "k", "left"), ["k"])
    both = F.col("pair_precision") + F.col("pair_recall")
    score = F.round(F.when(both > 0, 2 * F.col("pair_precision") * F.col("pair_recall") / both).otherwise(0.0), 6)
    value = F.get(F.array(*[F.lit(float(t)) for t in thresholds]), F.col("k").cast("int"))
    return found.select(value.alias("threshold"), F.col("frac_instance").alias("coverage"), "merges", "splits", score.alias("score"))


def binary_cross_entropy(logit: Column, target: Column) -> Column:
    """Of a logit and a boolean target, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target.cast("double") + F.log1p(F.exp(-F.abs(logit)))


def affinity_scores(pairs: DataFrame, by: list[str], logit: str = "logit") -> DataFrame:
    """Masked loss, accuracy, accuracy on the cuts, positive rate and masked fraction.

    ``pairs``: affinity, mask and a logit; every denominator is one at least.
    """
    mask, cut = F.col("mask"), F.col("mask") & ~F.col("affinity")
    right = (F.col(logit) > 0) == F.col("affinity")

    def share(part: Column, whole: Column) -> Column:
        return F.count(F.when(part, 1)) / F.greatest(F.count(F.when(whole, 1)), F.lit(1))

    loss = F.coalesce(F.sum(F.when(mask, binary_cross_entropy(F.col(logit), F.col("affinity")))), F.lit(0.0)) / F.greatest(F.count(F.when(mask, 1)), F.lit(1))
    return pairs.groupBy(*by).agg(
        F.count(F.when(mask & F.col("affinity"), 1)).alias("n_same"),
        F.count(F.when(cut, 1)).alias("n_cut"),
        F.count(F.when(~mask, 1)).alias("n_unknown"),
        F.round(loss, 6).alias("loss"),
        F.round(share(mask & right, mask), 6).alias("accuracy"),
        F.round(share(cut & right, cut), 6).alias("boundary_accuracy"),
        F.round(share(mask & F.col("affinity"), mask), 6).alias("positive_rate"),
        F.round(share(mask, F.lit(True)), 6).alias("mask_fraction"),
    )


def abstain(voxels: DataFrame, kept: Column, foreground: Column, disagrees: Column, tau_bg: float, tau_long: float) -> DataFrame:
    """Pseudo labels that may say "unknown".

    A kept voxel keeps its segment unless the far channels disagree by
    ``tau_long`` or more; a dropped voxel is background where the foreground
    score is below ``tau_bg``, and unknown (-1) elsewhere.
    """
    rule = F.when(kept, F.when(disagrees < tau_long, F.col("segment")).otherwise(-1)).otherwise(F.when(foreground < tau_bg, 0).otherwise(-1))
    return voxels.withColumn("pseudo", rule.cast("long"))


def overlap(voxels: DataFrame, by: list[str], pred: str = "pred", truth: str = "label") -> DataFrame:
    """Pair precision and recall, merges, splits and fractions, from one contingency table.

    Voxels count where both ids are positive.  A pair is two voxels of one id; a
    predicted id over several true ids is a merge, a true id over several
    predicted ids a split.
    """
    both = F.col(pred).isNotNull() & F.col(truth).isNotNull()
    return overlap_of_counts(voxels.where(both).groupBy(*by, F.col(pred).alias("p"), F.col(truth).alias("t")).agg(F.count("*").alias("n")), by)


def overlap_of_counts(table: DataFrame, by: list[str]) -> DataFrame:
    """:func:`overlap` of a contingency table (by, p, t, n)."""
    known = table.where("p > 0 and t > 0")
    marginals = known.groupBy(*by, "p", "t", "n").agg(F.lit(1).alias("one")).drop("one")
    by_pred = marginals.groupBy(*by, "p").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).groupBy(*by).agg(_pairs(F.col("n")).alias("pred_pairs"), F.count(F.when(F.col("ids") > 1, 1)).alias("merges"))
    by_true = marginals.groupBy(*by, "t").agg(F.sum("n").alias("n"), F.count("*").alias("ids")).groupBy(*by).agg(_pairs(F.col("n")).alias("true_pairs"), F.count(F.when(F.col("ids") > 1, 1)).alias("splits"))
    common = marginals.groupBy(*by).agg(_pairs(F.col("n")).alias("pairs"))
    total = table.groupBy(*by).agg(F.sum("n").alias("voxels"), F.sum(F.when(F.col("p") > 0, F.col("n")).otherwise(0)).alias("instance"), F.sum(F.when(F.col("p") < 0, F.col("n")).otherwise(0)).alias("ignored"))
    return _overlap_scores(total.join(by_pred, by, "left").join(by_true, by, "left").join(common, by, "left"), by)


def _pairs(c: Column) -> Column:
    return F.sum(c * (c - 1) / 2)


def _overlap_scores(sums: DataFrame, by: list[str]) -> DataFrame:
    return sums.select(
        *by,
        F.round(F.coalesce(F.col("pairs") / F.greatest("pred_pairs", F.lit(1)), F.lit(0.0)), 6).alias("pair_precision"),
        F.round(F.coalesce(F.col("pairs") / F.greatest("true_pairs", F.lit(1)), F.lit(0.0)), 6).alias("pair_recall"),
        F.coalesce("merges", F.lit(0)).alias("merges"),
        F.coalesce("splits", F.lit(0)).alias("splits"),
        F.round(F.col("instance") / F.col("voxels"), 6).alias("frac_instance"),
        F.round(F.col("ignored") / F.col("voxels"), 6).alias("frac_ignore"),
    )


def boundary(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Add ``boundary``: whether a face neighbour has another id, both being known."""
    sides = [tuple(sign * d for d in step) for step in _steps(len(AXES)) for sign in (1, -1)]
    keep = tuple(c for c in voxels.columns if c not in (*GRID, *AXES, label))
    near = neighbours(voxels, sides, (label,), keep).withColumnRenamed(f"near_{label}", "__near")
    other = F.exists("__near", lambda n: F.coalesce((n >= 0) & (n != F.col(label)), F.lit(False)))
    return near.select(*voxels.columns, ((F.col(label) >= 0) & other).alias("boundary"))


def boundary_enrichment(voxels: DataFrame, by: list[str], pred: str = "pred", truth: str = "label") -> DataFrame:
    """How much denser boundaries are among abstained voxels (``pred`` below 0) than among all known ones.

    1 means that abstention does not look for boundaries; null where nothing is
    abstained or there is no boundary.  Voxels of unknown truth do not count.
    """
    count = {"known": F.lit(True), "edges": F.col("boundary"), "ignored": F.col(pred) < 0, "both": F.col("boundary") & (F.col(pred) < 0)}
    sums = boundary(voxels.select(*{*by, *GRID, *AXES, pred, truth}), truth).where(F.col(truth) >= 0).groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in count.items()])
    return sums.select(
        *by,
        F.round(F.col("edges") / F.col("known"), 6).alias("frac_boundary"),
        F.round(F.col("ignored") / F.col("known"), 6).alias("frac_abstained"),
        F.round(F.col("both") * F.col("known") / F.nullif(F.col("ignored") * F.col("edges"), F.lit(0)), 6).alias("boundary_enrichment"),
    )


def choose_threshold(sweep: DataFrame) -> DataFrame:
    """Mark two choices in a sweep (threshold, merges, score).

    ``chosen``: the first threshold without a merge, else the last.  ``best``: the
    one of the highest score, the lowest of equals.
    """
    first = F.coalesce(F.min(F.when(F.col("merges") == 0, F.col("threshold"))), F.max("threshold"))
    pick = sweep.agg(first.alias("__first"), F.max_by("threshold", F.struct("score", -F.col("threshold"))).alias("__top"))
    return sweep.join(F.broadcast(pick)).withColumn("chosen", F.col("threshold") == F.col("__first")).withColumn("best", F.col("threshold") == F.col("__top")).drop("__first", "__top")


def same_partition(voxels: DataFrame, by: list[str], one: str, other: str) -> DataFrame:
    """Whether two labelings cut the foreground alike: ids map one to one."""
    ids = voxels.where((F.col(one) > 0) | (F.col(other) > 0)).select(*by, F.col(one).alias("a"), F.col(other).alias("b")).distinct()
    forth = ids.groupBy(*by, "a").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("most_b"))
    back = ids.groupBy(*by, "b").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max("n").alias("most_a"))
    return forth.join(back, by).select(*by, ((F.col("most_a") == 1) & (F.col("most_b") == 1)).alias("same"))
