"""Analytic and property cases of the grid operators."""

import itertools

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from voxspark.operators import augment, curation, labels, metrics, patches, representation, sampling, telemetry, tiles
from voxspark.operators.graph import connected_components


def cube(spark, array, name="label"):
    rows = [(0, 0, x, y, z, (x * array.shape[1] + y) * array.shape[2] + z, int(array[x, y, z])) for x, y, z in itertools.product(*map(range, array.shape))]
    return spark.createDataFrame(rows, f"vol long, level int, x int, y int, z int, id long, {name} long")


def test_border_mask_counts(spark):
    """Ones of side 6, far step 2: (6 - shift) * 36 known pairs in each channel."""
    offsets = labels.offset_rows(3, 1, 2)
    found = labels.affinities(cube(spark, np.ones((6, 6, 6), dtype=int)), offsets).groupBy("channel").agg(F.count(F.when(F.col("mask"), 1)).alias("n")).collect()
    assert {r.channel: r.n for r in found} == {c: (6 - max(o)) * 36 for c, o in offsets}


@pytest.mark.parametrize("side", [2, 3, 64])
def test_pairs_by_brute_force(spark, side):
    """Straight, slanted, negative and overlong offsets on a grid with gaps, in blocks of several sizes."""
    array = np.random.default_rng(12).integers(-1, 3, (4, 5, 7))
    offsets = [(0, (0, 0, 1)), (1, (0, 2, 0)), (2, (3, 0, 0)), (3, (0, 7, 0)), (4, (1, -2, 3)), (5, (-1, 0, 0))]
    rows = cube(spark, array).where("id % 5 <> 3").withColumn("note", F.concat(F.lit("voxel "), F.col("id")))
    there = {(r.x, r.y, r.z): r.note for r in rows.collect()}
    found = labels.affinities(rows, offsets, keep=("note",), side=side).collect()
    assert len(found) == len(offsets) * len(there) == len({(r.x, r.y, r.z, r.channel) for r in found})
    for r in found:
        at, end = (r.x, r.y, r.z), tuple(a + b for a, b in zip((r.x, r.y, r.z), dict(offsets)[r.channel], strict=True))
        known = bool(end in there and array[at] >= 0 and array[end] >= 0)
        assert r.mask == known and r.affinity == bool(known and array[at] == array[end] > 0) and r.note == there[at]


def test_one_shuffle_finds_all_neighbours(spark):
    plan = labels.affinities(cube(spark, np.ones((2, 2, 2), dtype=int)), labels.offset_rows())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rounds", [1, 3])
def test_sinkhorn_as_stated(spark, rounds):
    """Columns, then rows, of each group's matrix are divided by their sums."""
    logits = np.random.default_rng(2).normal(size=(2, 9, 5))
    rows = spark.createDataFrame([(g, i, logits[g, i].tolist()) for g in range(2) for i in range(9)], "g int, i int, logits array<double>")
    q = np.exp(logits / 0.5)
    for _ in range(rounds):
        q /= q.sum(axis=1, keepdims=True)
        q /= q.sum(axis=2, keepdims=True)
    for r in representation.sinkhorn(rows, ["g"], "i", "logits", 5, 0.5, rounds).collect():
        assert r.q == pytest.approx(q[r.g, r.i].tolist(), rel=1e-9)


def test_offsets_of_another_rank_are_refused(spark):
    with pytest.raises(ValueError, match="rank"):
        labels.affinities(cube(spark, np.ones((2, 2, 2), dtype=int)), [(0, (1, 0))])


def test_rotation_refuses_what_it_would_spoil(spark):
    flat = cube(spark, np.zeros((4, 4, 3), dtype=int))
    with pytest.raises(Exception, match="no cubes of 4 voxels"):
        augment.rotate(flat, 4, 1).collect()
    whole = cube(spark, np.zeros((4, 4, 4), dtype=int)).withColumn("size", F.array(F.lit(4.0), F.lit(4.0), F.lit(30.0)))
    with pytest.raises(Exception, match="unequal voxel size"):
        augment.rotate(whole, 4, 1, sizes="size").collect()
    assert augment.rotate(whole, 4, 1, fix_section=True, sizes="size").count() == augment.rotate(whole.withColumn("size", F.lit(None).cast("array<double>")), 4, 1, sizes="size").count() == 64


def test_planes_reach_all_eight_turns(spark):
    rows = spark.range(200).select(F.col("id").alias("plane")).crossJoin(cube(spark, np.arange(9).reshape(3, 3, 1)).select("x", "y", F.col("label").alias("v")))
    turned = augment.rotate_plane(rows, 3, 4).groupBy("plane").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "v"))), lambda s: s["v"]).alias("ids")).collect()
    assert {tuple(r.ids) for r in turned} == {tuple(np.rot90(g, k).reshape(-1)) for g in (np.arange(9).reshape(3, 3), np.arange(9).reshape(3, 3).T) for k in range(4)}


def test_gate_of_finished_items(spark):
    rows = spark.range(10).withColumn("done", F.col("id") < 7)
    done = rows.where("done")
    assert curation.guarded(sampling.unfinished(rows, done, "id"), sampling.completeness(done, 7)).count() == 3
    with pytest.raises(Exception, match="14 items are done, 7 are expected"):
        curation.guarded(rows, sampling.completeness(done.union(done), 7)).count()


def test_running_sums_and_weighted_draws(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 500).alias("vid"), (F.col("id") % 3).alias("grp"), (1.0 + F.col("id") % 5).alias("weight"))
    plain = rows.toPandas().sort_values("vid")
    plain["sum"] = plain.groupby("grp")["weight"].cumsum()
    got = sampling.running_sum(rows, ["vid"], F.col("weight"), "sum", ["grp"]).toPandas().sort_values("vid")
    assert got["sum"].tolist() == plain["sum"].tolist()
    assert sorted(r.row for r in sampling.number_rows(rows, ["vid"]).collect()) == list(range(500))
    drawn = sampling.draw_weighted(rows.select("vid", "weight"), 20_000, 5).groupBy("vid").count().join(rows, "vid").groupBy("weight").agg(F.sum("count").alias("n")).collect()
    assert sum(r.n for r in drawn) == 20_000
    for r in drawn:
        assert abs(r.n / 20_000 - r.weight / 15) < 0.02


@pytest.mark.parametrize("alpha", [0.1, 0.5, 1.0, 5.0])
def test_dirichlet_moments(spark, alpha):
    """Mean and variance of a part of three, and of the gamma numbers themselves."""
    from voxspark.functions.draws import gamma

    levels = spark.range(12_000).select(F.floor(F.col("id") / 3).alias("sample"), (F.col("id") % 3).alias("level"))
    w = patches.dirichlet(levels, "sample", "level", alpha, 5).where("level = 1").agg(F.avg("__w"), F.var_samp("__w")).first()
    assert w[0] == pytest.approx(1 / 3, abs=0.02) and w[1] == pytest.approx(2 / 9 / (3 * alpha + 1), rel=0.12)
    g = levels.select(gamma(alpha, 6, "g", "sample", "level").alias("g")).agg(F.avg("g"), F.var_samp("g")).first()
    assert g[0] == pytest.approx(alpha, rel=0.1) and g[1] == pytest.approx(alpha, rel=0.2)


@pytest.mark.parametrize("grid", [[8, 8], [6, 6, 6]])
def test_block_masks_keep_their_law(spark, grid):
    samples = spark.range(40).select(F.col("id").alias("sample"), F.col("id").alias("pos"), F.lit(40).alias("total"))
    rows = sorted(patches.block_masks(samples, grid, 0.5, 0.1, 0.6, 3).collect(), key=lambda r: r.sample)
    size = int(np.prod(grid))
    for r in rows:
        assert len(r.hidden) == size and r.ratio == (pytest.approx(0.1 + 0.5 * r.sample / 19) if r.sample < 20 else 0.0)
        assert sum(r.hidden) <= int(r.ratio * size) and (sum(r.hidden) > 0) == (r.sample < 20)
    assert sum(sum(r.hidden) for r in rows) > 0.7 * sum(int(r.ratio * size) for r in rows)
    assert rows == sorted(patches.block_masks(samples.repartition(7), grid, 0.5, 0.1, 0.6, 3).collect(), key=lambda r: r.sample)


@pytest.mark.parametrize("seed", [0, 1])
def test_components_match_flood_fill(spark, seed):
    rng = np.random.default_rng(seed)
    array = np.where(rng.random((6, 6, 6)) < 0.45, rng.integers(1, 4, (6, 6, 6)), 0)
    wanted = {}
    for start in zip(*np.nonzero(array), strict=True):
        if start in wanted:
            continue
        stack, piece = [start], []
        while stack:
            p = stack.pop()
            if p in wanted:
                continue
            wanted[p] = start
            piece.append(p)
            for axis, d in itertools.product(range(3), (-1, 1)):
                q = tuple(c + d * (a == axis) for a, c in enumerate(p))
                if all(0 <= c < 6 for c in q) and array[q] == array[p]:
                    stack.append(q)
    found = {(r.x, r.y, r.z): r.piece for r in labels.split_components(cube(spark, array), "label").collect()}
    assert {p for p, v in found.items() if v == 0 and array[p] == 0} == {tuple(map(int, p)) for p in np.argwhere(array == 0)}
    pairs = {(wanted[p], found[tuple(map(int, p))]) for p in wanted}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.where("u < 0")).count() == 0


@pytest.mark.parametrize("extent, tile, overlap", [(100, 32, 8), (64, 64, 0), (10, 32, 4), (97, 16, 15)])
def test_tiles_cover_everything(spark, extent, tile, overlap):
    starts = spark.range(1).select(tiles.tile_starts(F.lit(extent), F.lit(tile), F.lit(overlap)).alias("s")).first().s
    assert starts[0] == 0 and len(set(starts)) == len(starts)
    assert {c for s in starts for c in range(s, min(s + tile, extent))} == set(range(extent))


def test_tile_starts_as_a_table_function(spark):
    rows = spark.createDataFrame([(1, 100, 32, 8), (2, 64, 64, 0), (3, 10, 32, 4), (4, 97, 16, 15), (5, 20, 4, 9), (6, None, 4, 1), (7, 0, 3, 1)], "k long, extent long, tile long, overlap long")
    name = tiles.register_tile_starts(spark)
    got = spark.sql(f"SELECT k, start FROM {{rows}}, LATERAL {name}(extent, tile, overlap)", rows=rows)
    built_in = rows.where("extent IS NOT NULL").select("k", F.explode(tiles.tile_starts(F.col("extent"), F.col("tile"), F.col("overlap"))).alias("start"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, built_in.collect()))


def test_rows_are_counted_by_the_job_that_reads_them(spark):
    rows = spark.range(100).select("id", F.concat(F.lit("g"), F.col("id") % 4, F.lit("/"), "id").alias("name"))
    seen = Observation()
    assert curation.allow(rows, {"id": [1, 2, 300]}, seen).count() == curation.require_rows(seen, 2, 2) == 2
    none = Observation()
    assert curation.allow(rows, {"id": [300]}, none).collect() == []
    with pytest.raises(ValueError, match="0 rows"):
        curation.require_rows(none)
    train = Observation()
    assert len(curation.hold_out(rows, "name", 1, ["g1"], "train", train).collect()) == curation.require_rows(train) == 75
    with pytest.raises(ValueError, match="75 rows, expected 76"):
        curation.require_rows(train, 76, 76)


def test_confusion_cases(spark):
    rows = spark.createDataFrame([(0, 0)] * 90 + [(1, 0)] * 10, "label long, pred long")
    got = metrics.segmentation_metrics(metrics.confusion(rows, 2)).first()
    assert (got.accuracy, got.present) == (0.9, 2) and got.iou == [0.9, 0.0]


def test_rotation_is_a_bijection_and_reaches_all(spark):
    rows = spark.range(400).select(F.col("id").alias("vol")).crossJoin(cube(spark, np.arange(8).reshape(2, 2, 2)).drop("vol"))
    turned = augment.rotate(rows, 2, 3).groupBy("vol").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "z", "id"))), lambda s: s["id"]).alias("ids")).collect()
    assert all(sorted(r.ids) == list(range(8)) for r in turned)
    assert len({tuple(r.ids) for r in turned}) == 48


def test_level_balanced_loss_example(spark):
    rows = spark.createDataFrame([(0, 0, True, 12.0), (0, 0, False, 0.0), (0, 1, True, 0.0), (0, 1, True, 0.0)], "sample int, level int, hidden boolean, error double")
    assert patches.level_balanced_loss(rows, "sample", "level").first().loss == 6.0


def test_throughput_example(spark):
    points = spark.createDataFrame([(0, 0, 100.0), (0, 5, 102.0), (0, 15, 106.0)], "run int, step int, t double")
    rates = telemetry.throughput(points, 8.0, 2.0, F.lit(10.0)).collect()
    assert [(r.tflops, r.mfu, r.samples_per_s) for r in rates] == [(5.0, 0.5, 20.0)] * 2


def test_ranks_are_disjoint_when_they_divide(spark):
    dealt = sampling.deal_ranks(sampling.shuffle_rows(spark.range(10).toDF("k"), "k", 1, 0), 2).collect()
    assert sorted(r.k for r in dealt) == list(range(10)) and {r.rank for r in dealt} == {0, 1}


def test_failures_say_why(spark):
    rows = spark.createDataFrame([("a/b", 5)], "name string, label int")
    with pytest.raises(ValueError, match="no column"):
        curation.allow(rows, {"other": [1]})
    with pytest.raises(ValueError, match="no row"):
        curation.allow(rows, {"label": [1]})
    with pytest.raises(ValueError, match="held-out"):
        curation.hold_out(rows, "name", 1, None, "val")
    with pytest.raises(ValueError, match="is empty"):
        curation.hold_out(rows, "name", 1, ["a"], "train")
    with pytest.raises(Exception, match="classes"):
        curation.check_class_bound(rows, "label", 3).count()
    with pytest.raises(ValueError, match="level axis"):
        curation.parse_axes("cxyz")
    with pytest.raises(ValueError, match="fill the axis"):
        patches.patch_ids(rows, {"x": 7}, 2)


def test_boundaries_by_brute_force(spark):
    array = np.random.default_rng(4).integers(-1, 3, (4, 5, 6))
    wanted = set()
    for p in itertools.product(*map(range, array.shape)):
        near = [tuple(c + d * (a == axis) for a, c in enumerate(p)) for axis in range(3) for d in (-1, 1)]
        if array[p] >= 0 and any(all(0 <= c < n for c, n in zip(q, array.shape, strict=True)) and array[q] >= 0 and array[q] != array[p] for q in near):
            wanted.add(p)
    voxels = cube(spark, array).withColumn("pred", F.when(F.col("id") % 3 == 0, -1).otherwise(1))
    assert {(r.x, r.y, r.z) for r in labels.boundary(voxels).where("boundary").collect()} == wanted
    known = {p: (p[0] * 5 + p[1]) * 6 + p[2] for p in itertools.product(*map(range, array.shape)) if array[p] >= 0}
    off = {p for p, k in known.items() if k % 3 == 0}
    got = labels.boundary_enrichment(voxels, ["vol"]).first()
    assert got.boundary_enrichment == pytest.approx((len(wanted & off) / len(off)) / (len(wanted) / len(known)), abs=1e-6)
    assert labels.boundary_enrichment(voxels.withColumn("pred", F.lit(1)), ["vol"]).first().boundary_enrichment is None


def test_choices_of_a_threshold(spark):
    def picked(rows):
        out = labels.choose_threshold(spark.createDataFrame(rows, "threshold double, merges long, score double")).collect()
        return [r.threshold for r in out if r.chosen], [r.threshold for r in out if r.best]

    assert picked([(3.0, 0, 0.5), (1.0, 2, 0.7), (2.0, 0, 0.7)]) == ([2.0], [1.0])
    assert picked([(1.0, 4, 0.1), (2.0, 1, 0.2)]) == ([2.0], [2.0])


def test_pyramid_of_a_ragged_grid(spark):
    array = np.arange(5 * 4 * 3).reshape(5, 4, 3)
    rows = cube(spark, array).withColumn("img", F.col("label").cast("double"))
    found = {(r.level, r.x, r.y, r.z): (r.img, r.label) for r in curation.pyramid(rows, 3, ["img"], ["label"]).collect()}
    assert len(found) == 60 + 3 * 2 * 2 + 2 * 1 * 1
    for (level, *at), (img, label) in found.items():
        cell = array[tuple(slice(c << level, (c + 1) << level) for c in at)]
        assert img == pytest.approx(cell.mean()) and label == cell[0, 0, 0]
    assert curation.pyramid(rows, 1, ["img"], ["label"]).count() == 60
    with pytest.raises(Exception, match="levels are"):
        curation.level_gate(curation.pyramid(rows, 2, ["img"], ["label"]), [0]).collect()


def test_empty_tables(spark):
    none = cube(spark, np.zeros((1, 1, 1), dtype=int)).where("vol < 0")
    assert labels.affinities(none, labels.offset_rows(3, 1, 2)).count() == 0
    assert labels.split_components(none).count() == 0
    assert sampling.number_rows(none, ["id"]).count() == 0


def test_blockwise_components_agree(spark):
    rng = np.random.default_rng(7)
    array = np.where(rng.random((7, 8, 5)) < 0.6, rng.integers(1, 3, (7, 8, 5)), 0)
    voxels = cube(spark, array)
    one = {r.id: r.piece for r in labels.split_components(voxels).collect()}
    for side in (2, 3, 16):
        assert {r.id: r.piece for r in labels.split_components_by_block(voxels, side).collect()} == one


def test_chain_augments_training_only(spark):
    from voxspark.operators.chain import Chain

    chain = Chain(spark.range(3)).then(lambda d: d.where("id > 0"), targets=True).then(lambda d: d.union(d))
    assert (chain.table("train").count(), chain.table("val").count()) == (4, 2)
    with pytest.raises(RuntimeError, match="built"):
        chain.then(lambda d: d)


def test_strict_reconciliation(spark):
    from voxspark.operators import artifacts

    model = spark.createDataFrame([("a", [2, 3]), ("k", [4, 1, 8, 8, 8])], "name string, shape array<int>")
    ckpt = spark.createDataFrame([("m.a", [2, 3]), ("m.k", [4, 1, 8, 8])], "name string, shape array<int>")
    found = artifacts.strict(artifacts.reconcile(ckpt, model, "m.")).first()
    assert (found.copied, found.inflated, found.verdict) == (1, 1, "ok")
    with pytest.raises(Exception, match="left over"):
        artifacts.strict(artifacts.reconcile(ckpt, model.where("name = 'a'"), "m.")).collect()
    with pytest.raises(Exception, match="shapes differ"):
        artifacts.strict(artifacts.reconcile(ckpt.withColumn("shape", F.array(F.lit(9))), model, "m.")).collect()


def test_crop_corners_are_never_broadcast(spark):
    """The corners of all views go through the shuffle, however small their table looks."""
    voxels = spark.createDataFrame([(v, x, y, z, float(x)) for v in range(2) for x, y, z in np.ndindex(4, 4, 4)], "vol long, x int, y int, z int, img double")
    out = augment.resized_crop(voxels, augment.multi_crop(voxels.select("vol").distinct(), 2, 4, 3), 4, 37)
    assert out.count() == 2 * (2 * 64 + 2 * 27)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_standardise_takes_mean_and_root_once(spark):
    """2,000 values: with both inside the lambda this was 8 * 10**9 steps."""
    values = np.random.default_rng(3).normal(size=2000)
    row = spark.createDataFrame([([float(v) for v in values],)], "values array<double>")
    found = row.select(patches.standardise(F.col("values")).alias("s")).repartition(1).first().s
    assert np.allclose(found, (values - values.mean()) / np.sqrt(values.var(ddof=1) + 1e-6))
    assert representation.normalised(F.col("values"))._jc.toString().count("sqrt") == 1 and patches.standardise(F.col("values"))._jc.toString().lower().count("sqrt") == 1


def plain_mask(sample, ratio, grid, seed):
    mask, rng = np.zeros(grid, dtype=bool), np.random.default_rng([seed, sample])
    goal = int(ratio * mask.size)
    for _ in range(64):
        left = goal - int(mask.sum())
        if left <= 0:
            break
        area, aspect = rng.uniform(patches.LEAST_PATCHES, max(patches.LEAST_PATCHES + 1, left)), np.exp(rng.uniform(-1, 1) * np.log(patches.MOST_ASPECT))
        side = max(1, round((area * aspect) ** (1 / len(grid))))
        sides = [min(side, g) for g in grid]
        box = tuple(slice(a, a + s) for a, s in ((int(rng.integers(0, g - s + 1)), s) for g, s in zip(grid, sides, strict=True)))
        if 0 < (fresh := int((~mask[box]).sum())) <= left:
            mask[box] = True
    return mask.reshape(-1)


@pytest.mark.parametrize("grid", [[8, 8], [6, 6, 6], [3, 40], [1, 9]])
def test_masks_drawn_together_are_those_drawn_alone(grid):
    samples, ratio = np.arange(400), np.random.default_rng(1).random(400)
    together = patches._drawn_masks(samples, ratio, grid, 24)
    assert all((together[k] == plain_mask(k, ratio[k], grid, 24)).all() for k in range(400))
    assert patches._drawn_masks(samples[:0], ratio[:0], grid, 24).shape == (0, int(np.prod(grid)))


def test_blocks_share_a_call_and_stay_apart():
    draw = np.random.default_rng(3)
    number = np.repeat(np.arange(5), 27)[(there := draw.random(135) < 0.8)]
    place = np.tile(np.stack(np.unravel_index(np.arange(27), (3, 3, 3)), axis=1), (5, 1))[there]
    ids, own = draw.permutation(len(number)) * 3, draw.integers(-1, 3, len(number))
    root, changed = ids.copy(), True
    while changed:
        changed = False
        for a in range(len(ids)):
            for b in range(len(ids)):
                if number[a] == number[b] and own[a] == own[b] > 0 and np.abs(place[a] - place[b]).sum() == 1 and root[a] > root[b]:
                    root[a], changed = root[b], True
    assert labels._local_roots(ids, own, number, place).tolist() == root.tolist()
