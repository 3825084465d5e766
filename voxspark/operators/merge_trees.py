"""Merge trees: the pieces of an affinity graph at every threshold from one build.

Edges join face neighbours; their weight is a logit.  A piece at a threshold is a
set of voxels joined by edges above it, named by its smallest id.  As the
threshold falls pieces merge, and of two that merge the one with the larger name
ends.  Every voxel's name ends once, at one weight, in one other piece: the table
(id, parent, weight) says it for all thresholds, and climbing while the weight is
above a threshold gives the piece there.

A task builds the tree of one block of ``side`` voxels an axis, from a maximum
spanning forest that it finds by Boruvka rounds.  Edges across block faces are a
table of their own; a cut joins the names of the blocks along those of them that
are above the threshold, for all thresholds in one loop over a graph that grows
with the faces of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.functions.workers import map_groups
from voxspark.operators.graph import connected_components

AXES = ("x", "y", "z")
GRID = ("vol", "level")
BLOCK = [f"b{a}" for a in AXES]


def next_pairs(number: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each axis the rows that are next to each other along it in one block.

    ``number``: the block of each row; ``place``: its coordinates in there, a
    column for each axis.  Of rows at one place the last one is taken.
    """
    place = place - place.min(axis=0)
    shape = place.max(axis=0) + 1
    strides = np.append(np.cumprod(shape[:0:-1])[::-1], 1)
    code = number * shape.prod() + place @ strides
    at = np.argsort(code, kind="stable")
    at = at[np.append(code[at][1:] != code[at][:-1], True)]
    code, place = code[at], place[at]
    for k, stride in enumerate(strides):
        left = np.flatnonzero(place[:, k] < shape[k] - 1)
        right = np.minimum(np.searchsorted(code, code[left] + stride), len(code) - 1)
        found = code[right] == code[left] + stride
        yield at[left[found]], at[right[found]]


def spanning_forest(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The edges of a maximum spanning forest of ``n`` nodes; edges come from the heaviest to the lightest."""
    root, chosen, alive = np.arange(n), [], np.arange(len(u))
    while len(alive):
        a, b = root[u[alive]], root[v[alive]]
        apart = a != b
        alive, a, b = alive[apart], a[apart], b[apart]
        best = np.full(n, len(u))
        np.minimum.at(best, a, alive)
        np.minimum.at(best, b, alive)
        picks = np.unique(best[best < len(u)])
        chosen.append(picks)
        a, b = root[u[picks]], root[v[picks]]
        while len(a):  # hook pieces that the picked edges join
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
    return np.sort(np.concatenate(chosen)) if chosen else np.zeros(0, dtype=np.int64)


def merge_tree(n: int, u: np.ndarray, v: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parent, weight at which the name ends) of ``n`` nodes; a name that never ends is its own parent at -infinity."""
    order = np.argsort(-weight, kind="stable")
    order = order[spanning_forest(n, u[order], v[order])]
    name, parent, ends = list(range(n)), np.arange(n), np.full(n, -np.inf)
    for a, b, w in zip(u[order].tolist(), v[order].tolist(), weight[order].tolist(), strict=True):
        while name[a] != a:
            name[a] = a = name[name[a]]
        while name[b] != b:
            name[b] = b = name[name[b]]
        low, high = (a, b) if a < b else (b, a)
        name[high], parent[high], ends[high] = low, low, w
    return parent, ends


def climb(parent: np.ndarray, ends: np.ndarray, threshold: float) -> np.ndarray:
    """The name of every node's piece at a threshold: weights fall on the way up, so pointers can be doubled."""
    name = np.where(ends > threshold, parent, np.arange(len(parent)))
    while (name[name] != name).any():
        name = name[name]
    return name


class MergeTrees(NamedTuple):
    """``local``: vol, level, bx, by, bz, kept columns, id, parent, weight, face; ``faces``: u, v, weight across blocks."""

    local: DataFrame
    faces: DataFrame


def build(voxels: DataFrame, logits: str = "logits", side: int = 64, keep: tuple[str, ...] = ()) -> MergeTrees:
    """The merge trees of volumes; ``logits`` has a voxel's logit towards the next voxel of each axis.

    A null or NaN logit is no edge; grids may have gaps; ids are unique.
    """
    blocks = [F.floor(F.col(a) / side).alias(b) for a, b in zip(AXES, BLOCK, strict=True)]
    weights = [F.nanvl(F.get(logits, F.lit(k)).cast("double"), F.lit(None).cast("double")).alias(f"w{a}") for k, a in enumerate(AXES)]
    rows = voxels.select(*GRID, *AXES, "id", *keep, *blocks, *weights)
    ends = []
    for axis in AXES:
        others = [*GRID, *[a for a in AXES if a != axis]]
        left = rows.where((F.pmod(axis, F.lit(side)) == side - 1) & F.col(f"w{axis}").isNotNull()).select(*others, (F.col(axis) + 1).alias(axis), F.col("id").alias("u"), F.col(f"w{axis}").alias("weight"))
        ends.append(left.join(rows.where(F.pmod(axis, F.lit(side)) == 0).select(*others, axis, F.col("id").alias("v")), [*others, axis]).select("u", "v", "weight"))
    faces = stored(ends[0].unionByName(ends[1]).unionByName(ends[2]), "faces")

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        table, number = table.take(pa.array(order)), number[order]
        place = np.stack([table[a].to_numpy() for a in AXES], axis=1).astype(np.int64) % side
        u, v, w = [], [], []
        for axis, (a, b) in zip(AXES, next_pairs(number, place), strict=True):
            weight = table[f"w{axis}"].to_numpy()[a].astype(float)
            u, v, w = [*u, a[weight == weight]], [*v, b[weight == weight]], [*w, weight[weight == weight]]
        parent, weight = merge_tree(len(place), np.concatenate(u), np.concatenate(v), np.concatenate(w))
        edge = ((place == 0) | (place == side - 1)).any(axis=1)
        yield table.select([*GRID, *BLOCK, *keep, "id"]).append_column("parent", table["id"].take(pa.array(parent))).append_column("weight", pa.array(weight)).append_column("face", pa.array(edge))

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (*GRID, *BLOCK, *keep, "id"))
    local = map_groups(rows, [*GRID, *BLOCK], run, f"{kinds}, parent {rows.schema['id'].dataType.simpleString()}, weight double, face boolean")
    return MergeTrees(stored(local, "merge-trees"), faces)


def _names(table: pa.Table, thresholds: list[float]) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """The ids of whole blocks in order, and the place of the name of each at every threshold."""
    ids, parents = table["id"].to_numpy(), table["parent"].to_numpy()
    order = np.argsort(ids)
    parent, ends = np.searchsorted(ids[order], parents[order]), table["weight"].to_numpy()[order]
    return order, (climb(parent, ends, t) for t in thresholds)


def _whole(**columns: np.ndarray | int) -> pa.Table:
    """Whole numbers as a table; a single one is repeated."""
    n = max(np.size(c) for c in columns.values() if np.ndim(c))
    return pa.table({name: pa.array(c if np.ndim(c) else np.full(n, c), pa.int64()) for name, c in columns.items()})


def joined_names(trees: MergeTrees, thresholds: list[float]) -> DataFrame | None:
    """(k, name, top): names of blocks that end in another block at threshold k; None if no volume has two blocks."""
    if trees.faces.isEmpty():
        return None

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        order, names = _names(table, thresholds)
        ids = table["id"].to_numpy()[order]
        here = table["face"].to_numpy(zero_copy_only=False)[order]
        for k, name in enumerate(names):
            yield _whole(k=k, id=ids[here], name=ids[name[here]])

    ends = stored(map_groups(trees.local, [*GRID, *BLOCK], run, "k long, id long, name long"), "face-names")
    above = F.explode(F.filter(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(float(t)).alias("t")) for k, t in enumerate(thresholds)]), lambda x: x["t"] < F.col("weight"))).alias("x")
    edges = trees.faces.select("u", "v", above).select(F.col("x.k").alias("k"), "u", "v")
    node, n = F.col("name") * len(thresholds) + F.col("k"), len(thresholds)  # in the order of the names
    for side in ("u", "v"):
        edges = edges.join(ends.select("k", F.col("id").alias(side), node.alias(f"n{side}")), ["k", side])
    roots = connected_components(edges.select(F.col("nu").alias("u"), F.col("nv").alias("v")))
    return roots.where("node <> root").select(F.pmod("node", F.lit(n)).alias("k"), F.floor(F.col("node") / n).alias("name"), F.floor(F.col("root") / n).alias("top"))


def _topped(rows: DataFrame, names: DataFrame | None) -> DataFrame:
    if names is None:
        return rows
    return rows.join(names, ["k", "name"], "left").withColumn("name", F.coalesce("top", "name")).drop("top")


def cut(trees: MergeTrees, thresholds: list[float]) -> DataFrame:
    """(k, id, name): the piece of every voxel at every threshold, by the number of the threshold."""

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        order, names = _names(table, thresholds)
        ids = table["id"].to_numpy()[order]
        for k, name in enumerate(names):
            yield _whole(k=k, id=ids, name=ids[name])

    return _topped(map_groups(trees.local, [*GRID, *BLOCK], run, "k long, id long, name long"), joined_names(trees, thresholds))


def _counted(name: np.ndarray, number: np.ndarray, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, number, count) of the pairs that occur, in order."""
    codes, counts = np.unique(name * values + number, return_counts=True)
    return codes // values, codes % values, counts


def contingency(trees: MergeTrees, thresholds: list[float], truth: str) -> DataFrame:
    """(k, name, truth, n): voxels by piece and a kept whole number at every threshold, counted where the blocks are."""

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        order, names = _names(table, thresholds)
        ids = table["id"].to_numpy()[order]
        values, at = np.unique(table[truth].to_numpy()[order], return_inverse=True)
        for k, name in enumerate(names):
            piece, t, n = _counted(name, at, len(values))
            yield _whole(k=k, name=ids[piece], truth=values[t], n=n)

    rows = _topped(map_groups(trees.local, [*GRID, *BLOCK], run, "k long, name long, truth long, n long"), joined_names(trees, thresholds))
    return rows.groupBy("k", "name", "truth").agg(F.sum("n").alias("n"))


class Sums(NamedTuple):
    """``totals``: k, voxels, instance, pred_pairs, merges, pairs; ``truths``: k, truth, n, ids; several rows may be of one key."""

    totals: DataFrame
    truths: DataFrame


TOTALS = ("voxels", "instance", "pred_pairs", "merges", "pairs")
SUMS = ("k", "name", "truth", "n", "ids", *TOTALS)


def sums(trees: MergeTrees, thresholds: list[float], min_size: int, truth: str) -> Sums:
    """What the overlap of pieces and a kept whole number is made of, at every threshold.

    Pieces below ``min_size`` voxels are 0.  A piece without a voxel on a block face
    is whole in its block: the task that has the block adds it up, so that only
    pieces on faces are counted by name in a shuffle, and none where no volume has
    two blocks.  Totals: voxels, those in pieces, pairs of voxels of one piece,
    pieces over several truths, pairs of one piece and truth.  Truths: their voxels
    in pieces, and over how many pieces.
    """
    names = joined_names(trees, thresholds)
    alone = names is None

    def run(table: pa.Table, number: np.ndarray) -> Iterator[pa.Table]:
        def rows(**columns: np.ndarray | int) -> pa.Table:
            given = _whole(**columns)
            return pa.table({c: given[c] if c in columns else pa.nulls(given.num_rows, pa.int64()) for c in SUMS})

        order, pieces = _names(table, thresholds)
        ids = table["id"].to_numpy()[order]
        face = np.zeros(len(ids), dtype=bool) if alone else table["face"].to_numpy(zero_copy_only=False)[order]
        values, at = np.unique(table[truth].to_numpy()[order], return_inverse=True)
        for k, name in enumerate(pieces):
            size, shared = np.bincount(name, minlength=len(ids)), np.zeros(len(ids), dtype=bool)
            shared[name[face]] = True
            out = shared[name]
            if out.any():
                piece, t, n = _counted(name[out], at[out], len(values))
                yield rows(k=k, name=ids[piece], truth=values[t], n=n)
            held = ~out & (size[name] >= min_size) & (ids[name] >= 0)
            known = held & (values[at] > 0)
            piece, t, n = _counted(name[known], at[known], len(values))
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])[: len(piece)])
            of_piece = np.add.reduceat(n, first) if len(n) else n
            several = np.diff(np.append(first, len(piece))) > 1
            pairs = [(c * (c - 1) // 2).sum() for c in (of_piece, n)]
            yield rows(k=np.array([k]), voxels=(~out).sum(), instance=held.sum(), pred_pairs=pairs[0], merges=several.sum(), pairs=pairs[1])
            here = np.unique(t)
            yield rows(k=k, truth=values[here], n=np.bincount(t, n, len(values))[here].astype(np.int64), ids=np.bincount(t, minlength=len(values))[here])

    found = stored(map_groups(trees.local, [*GRID, *BLOCK], run, ", ".join(f"{c} long" for c in SUMS)), "sweep-sums")
    totals, truths = found.where("voxels is not null").select("k", *TOTALS), found.where("ids is not null").select("k", "truth", "n", "ids")
    if alone:
        return Sums(totals, truths)
    table = _topped(found.where("name is not null").select("k", "name", "truth", "n"), names).groupBy("k", "name", "truth").agg(F.sum("n").alias("n"))
    kept = table.groupBy("k", "name").agg(F.sum("n").alias("size")).where((F.col("size") >= min_size) & (F.col("name") >= 0))
    known = table.where("truth > 0").join(kept.select("k", "name"), ["k", "name"])
    own = F.col("n") * (F.col("n") - 1) / 2
    by_name = known.groupBy("k", "name").agg(F.sum("n").alias("n"), F.count("*").alias("ids"), F.sum(own).alias("pairs"))
    zero = [F.lit(0).alias(c) for c in TOTALS]
    parts = [
        table.groupBy("k").agg(F.sum("n").alias("voxels"), *zero[1:]),
        kept.groupBy("k").agg(zero[0], F.sum("size").alias("instance"), *zero[2:]),
        by_name.groupBy("k").agg(*zero[:2], F.sum(own).alias("pred_pairs"), F.count(F.when(F.col("ids") > 1, 1)).alias("merges"), F.sum("pairs").alias("pairs")),
    ]
    for part in parts:
        totals = totals.unionByName(part)
    return Sums(totals, truths.unionByName(known.groupBy("k", "truth").agg(F.sum("n").alias("n"), F.count("*").alias("ids"))))
