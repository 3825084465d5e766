"""Merge trees against flood fill at every threshold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxspark.functions import workers
from voxspark.operators import labels, merge_trees

THRESHOLDS = [-1.0, 0.0, 0.25, 0.5, 0.6, 0.75, 0.9, 2.0]


def volumes(spark, seed, shape, gaps=0.0):
    """Two volumes of a shape with some voxels missing, with tied, null and NaN logits; coordinates may be negative."""
    draw, rows = np.random.default_rng(seed), []
    for vol in range(2):
        for at in np.ndindex(shape):
            logits = [float(np.round(draw.random(), 1)) if draw.random() < 0.9 else [None, float("nan")][draw.integers(2)] for _ in range(3)]
            if draw.random() >= gaps:
                rows.append((vol, 0, at[0] - 3, at[1], at[2], vol * 10_000 + int(np.ravel_multi_index(at, shape)), logits, int(draw.integers(0, 3))))
    return spark.createDataFrame(rows, "vol long, level int, x int, y int, z int, id long, logits array<double>, truth long"), rows


def naive(rows, threshold):
    places = {(r[0], *r[2:5]): r for r in rows}
    name = {r[5]: r[5] for r in rows}
    changed = True
    while changed:
        changed = False
        for place, r in places.items():
            for axis in range(3):
                other = places.get((place[0], *[c + (a == axis) for a, c in enumerate(place[1:])]))
                w = r[6][axis]
                if other and w is not None and w == w and w > threshold and name[r[5]] != name[other[5]]:
                    name[r[5]] = name[other[5]] = min(name[r[5]], name[other[5]])
                    changed = True
    return name


@pytest.mark.parametrize(("side", "gaps"), [(64, 0.0), (2, 0.0), (3, 0.3)])
def test_every_threshold_by_flood_fill(spark, side, gaps):
    voxels, rows = volumes(spark, side, (5, 4, 3), gaps)
    trees = merge_trees.build(voxels, side=side, keep=("truth",))
    found = {(r.k, r.id): r.name for r in merge_trees.cut(trees, THRESHOLDS).collect()}
    truth = {r[5]: r[7] for r in rows}
    counts = {(r.k, r.name, r.truth): r.n for r in merge_trees.contingency(trees, THRESHOLDS, "truth").collect()}
    for k, threshold in enumerate(THRESHOLDS):
        names = naive(rows, threshold)
        assert {i: found[k, i] for i in names} == names
        for voxel, name in names.items():
            counts[k, name, truth[voxel]] -= 1
        one = {r.id: r.segment for r in labels.segment(voxels, threshold, 2, side=side).collect()} if threshold in (0.5, 0.9) else None
        if one is not None:
            sizes = {n: list(names.values()).count(n) for n in set(names.values())}
            assert one == {i: n + 1 if sizes[n] > 1 else 0 for i, n in names.items()}
    assert len(found) == len(rows) * len(THRESHOLDS) and set(counts.values()) == {0}


def test_the_tree_of_drawn_graphs():
    draw = np.random.default_rng(5)
    for _ in range(60):
        n, m = int(draw.integers(1, 25)), int(draw.integers(0, 60))
        u, v, w = draw.integers(0, n, m), draw.integers(0, n, m), np.round(draw.random(m), 1)
        parent, ends = merge_trees.merge_tree(n, u, v, w)
        assert len(merge_trees.spanning_forest(n, u, v)) == n - len({merge_trees.climb(parent, ends, -1)[k] for k in range(n)})
        for t in (0.0, 0.35, 0.5, 0.95):
            name = list(range(n))
            for _ in range(n):
                for a, b, x in zip(u, v, w, strict=True):
                    if x > t:
                        name[a] = name[b] = min(name[a], name[b])
            assert merge_trees.climb(parent, ends, t).tolist() == name


def test_edges_of_the_loop_grow_with_faces(spark):
    grid = spark.range(32**3).select(F.lit(0).cast("long").alias("vol"), F.lit(0).alias("level"), F.expr("cast(id div 1024 as int)").alias("x"), F.expr("cast((id div 32) % 32 as int)").alias("y"), F.expr("cast(id % 32 as int)").alias("z"), "id", F.expr("transform(array(1, 2, 3), k -> rand(3))").alias("logits"))
    assert merge_trees.build(grid, side=16).faces.count() == 3 * 32 * 32
    assert merge_trees.build(grid, side=32).faces.count() == 0


def test_no_voxels(spark):
    voxels, _ = volumes(spark, 1, (1, 1, 1))
    assert labels.segment(voxels.where("vol < 0"), 0.5, 1).collect() == []


@pytest.mark.parametrize(("side", "gaps"), [(64, 0.0), (2, 0.1), (3, 0.3)])
def test_a_sweep_is_the_overlap_of_the_contingency(spark, side, gaps):
    voxels, rows = volumes(spark, side + 7, (5, 4, 3), gaps)
    trees = merge_trees.build(voxels, side=side, keep=("truth",))
    found = {r.threshold: tuple(r)[1:] for r in labels.threshold_sweep(trees, THRESHOLDS, 2, "truth").collect()}
    assert set(found) == set(THRESHOLDS)
    for threshold in THRESHOLDS:
        names, counts, by_truth = naive(rows, threshold), {}, {}
        sizes = {n: list(names.values()).count(n) for n in names.values()}
        for r in rows:
            if sizes[names[r[5]]] > 1 and r[7] > 0:
                by_name = counts.setdefault(names[r[5]], {})
                by_name[r[7]] = by_name.get(r[7], 0) + 1
        for by_name in counts.values():
            for t, n in by_name.items():
                by_truth.setdefault(t, []).append(n)
        pairs = [sum(n * (n - 1) // 2 for n in ns) for ns in ([n for by in counts.values() for n in by.values()], [sum(by.values()) for by in counts.values()], [sum(ns) for ns in by_truth.values()])]
        p, r = (round(pairs[0] / max(whole, 1), 6) for whole in pairs[1:])
        coverage = round(sum(n for n in sizes.values() if n > 1) / len(rows), 6)
        wanted = (coverage, sum(len(by) > 1 for by in counts.values()), sum(len(ns) > 1 for ns in by_truth.values()), round(2 * p * r / (p + r), 6) if p + r else 0)
        assert found[threshold] == pytest.approx(wanted, abs=2e-6)


def test_a_sweep_of_small_volumes_sends_sums_and_no_pieces(spark):
    cubes = spark.range(64 * 512).select(F.expr("id div 512").alias("vol"), F.lit(0).alias("level"), F.expr("cast((id div 64) % 8 as int)").alias("x"), F.expr("cast((id div 8) % 8 as int)").alias("y"), F.expr("cast(id % 8 as int)").alias("z"), "id", F.expr("transform(array(1, 2, 3), k -> rand(3))").alias("logits"), F.expr("1 + id % 2").alias("truth"))
    found = merge_trees.sums(merge_trees.build(cubes, keep=("truth",)), THRESHOLDS, 2, "truth")
    calls = found.totals.where("k = 0").count()
    assert calls <= 4 and found.totals.count() == calls * len(THRESHOLDS)  # partitions; 64 blocks
    assert found.truths.count() <= 2 * calls * len(THRESHOLDS)
    assert found.totals.where("k = 0").agg(F.sum("voxels")).first()[0] == 64 * 512


def test_calls_have_whole_groups():
    draw = np.random.default_rng(2)
    sizes = draw.integers(1, 40, 50).tolist() + [500, 1, 2]
    keys = [None if g == 3 else g // 2 for g in range(len(sizes)) for _ in range(sizes[g])]
    rest = [str(g % 2) for g in range(len(sizes)) for _ in range(sizes[g])]
    table = pa.table({"a": pa.array(keys, pa.int64()), "b": rest, "n": np.arange(len(keys))})
    calls = list(workers.whole_groups(iter(table.to_batches(max_chunksize=7)), ["a", "b"], 100))
    assert [n for t, _ in calls for n in t["n"].to_pylist()] == list(range(len(keys))) and len(calls) < 15
    assert [int((number == g).sum()) for _, number in calls for g in range(number[-1] + 1)] == sizes
    assert list(workers.whole_groups(iter([]), ["a"])) == []
