"""Queries on patches, masks and augmentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxspark.functions.draws import gamma_sql, normal_sql, uniform, uniform_sql
from voxspark.operators import augment, patches
from voxspark.sources import views

EXTENT = {"x": 8, "y": 8, "z": 8}


def patchified(spark, sf_dir):
    """M-01, M-10: patches of side 4, standardised."""
    rows = patches.patchify(views.vox(spark, sf_dir), EXTENT, 4, ["vol"])
    return rows.select("vol", "patch", F.round(F.col("values")[7], 6).alias("v7"), F.round(patches.standardise(F.col("values"))[9], 6).alias("s9"))


def folded(spark, sf_dir):
    """M-02: patches folded back to voxels."""
    rows = patches.patchify(views.vox(spark, sf_dir), EXTENT, 4, ["vol"])
    return patches.unpatchify(rows, EXTENT, 4, ["vol"]).withColumn("value", F.round("value", 9))


def coordinates(spark, sf_dir):
    """M-03, M-04: grid indices and world coordinates of patches in re-centred boxes."""
    part = views.table(spark, sf_dir, "part")
    boxes = part.select(F.expr("p_partkey div 3").alias("sample"), (F.col("p_partkey") % 3).alias("level"), F.array(*[(F.col("p_size") + k).cast("double") for k in range(3)]).alias("lo"), F.array(*[(2 * F.col("p_size") + 10 + k * (1 + F.col("p_partkey") % 3)).cast("double") for k in range(3)]).alias("hi"))
    rows = patches.recentred_boxes(boxes).withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(7))))
    index = patches.grid_coordinates(F.col("patch"), [2, 4, 1])
    out = rows.select("sample", "level", "patch", *[i.alias(f"i{k}") for k, i in enumerate(index)], *[F.round(patches.world_coordinates(i, n, F.col("lo")[k], F.col("hi")[k]), 6).alias(f"w{k}") for k, (i, n) in enumerate(zip(index, (2, 4, 1), strict=True))])
    return out


def random_masks(spark, sf_dir):
    """M-05: exactly the kept count of tokens stays visible in each sample."""
    return patches.random_mask(views.tokens(spark, sf_dir).select("sample", "token"), ["sample"], "token", 0.63, 21)


def granular_masks(spark, sf_dir):
    """M-06: hidden in coarse units of a 4 x 4 x 4 patch grid."""
    rows = patches.patch_ids(views.vox(spark, sf_dir), EXTENT, 2).select("vol", "patch").distinct()
    return patches.granular_mask(rows, ["vol"], [4, 4, 4], 3, 0.6, 22)


def weighted_masks(spark, sf_dir):
    """M-07: visible tokens drawn by Dirichlet level weights."""
    rows = views.tokens(spark, sf_dir).select("sample", F.expr("cast(token div 20 as int)").alias("level"), "token")
    return patches.level_weighted_mask(rows, "sample", "level", "token", 15, 23, ALPHA)


def block_masks(spark, sf_dir):
    """M-08: block masks; samples numbered over all orders' customers."""
    from voxspark.functions.workers import ship

    ship(spark)
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample"), (F.col("p_partkey") % 8).alias("pos"), F.lit(8).alias("total"))
    out = patches.block_masks(rows, [8, 8], 0.5, 0.1, 0.5, 24)
    return out.select("sample", F.round("ratio", 6).alias("ratio"), F.size(F.filter("hidden", lambda h: h)).alias("n_hidden"))


def restored(spark, sf_dir):
    """M-09: hidden tokens replaced by the constant vector of their level, in order."""
    rows = patches.random_mask(views.tokens(spark, sf_dir), ["sample"], "token", 0.63, 21).withColumn("level", (F.col("token") % 2).cast("int"))
    out = patches.restore(rows.where("not hidden"), rows.select("sample", "token", "level"), ["sample"], "token", "vec", {0: [0.0] * 64, 1: [0.5] * 64}, "level")
    return out.select("sample", "token", F.round(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


def _errors(spark, sf_dir, power):
    rows = patches.patchify(views.vox(spark, sf_dir), EXTENT, 4, ["vol"])
    pred = F.transform("values", lambda v, i: v * 0.5 + i / 256.0)
    rows = rows.withColumn("error", patches.patch_error(pred, F.col("values"), power))
    return rows.withColumn("hidden", uniform(25, "hide", "vol", "patch") < 0.6).withColumn("level", (F.col("patch") % 2).cast("int"))


def losses(spark, sf_dir):
    """M-11, M-12: masked squared and absolute errors, visible ones, hidden share."""
    two, one = (patches.masked_loss(_errors(spark, sf_dir, p), ["vol"]) for p in (2, 1))
    two = two.select("vol", F.round("masked", 6).alias("l2"), F.round("share", 6).alias("share"))
    return two.join(one.select("vol", F.round("masked", 6).alias("l1"), F.round("visible", 6).alias("visible_l1")), "vol")


def balanced_loss(spark, sf_dir):
    """M-13: level-balanced masked loss over all volumes."""
    out = patches.level_balanced_loss(_errors(spark, sf_dir, 2), "vol", "level")
    return out.select(F.round("loss", 6).alias("loss"), "pairs", F.round("finest_visible", 6).alias("finest_visible"))


def rotated(spark, sf_dir):
    """G-01: each cube turned by one of 48 signed permutations."""
    return augment.rotate(views.vox(spark, sf_dir), 8, 31).select("id", "x", "y", "z", "label")


def rotated_planes(spark, sf_dir):
    """G-01 in two dimensions: each z plane turned by one of eight flips and exchanges of x and y."""
    planes = views.vox(spark, sf_dir).select("id", "x", "y", (F.col("vol") * 8 + F.col("z")).alias("plane"))
    return augment.rotate_plane(planes, 8, 38).select("id", "x", "y")


def rotation_guarded(spark, sf_dir):
    """F-10: rotated about the section axis only, behind a guard of shapes and voxel sizes."""
    voxels = views.vox(spark, sf_dir).withColumn("size", F.array(F.lit(8.0), F.lit(8.0), F.lit(40.0)))
    return augment.rotate(voxels, 8, 31, fix_section=True, sizes="size").groupBy("vol").agg(F.count("*").alias("n"), F.sum("id").cast("long").alias("ids"), F.countDistinct("x", "y", "z").alias("places"))


def shifted(spark, sf_dir):
    """G-02: some sections rolled along the other axes."""
    return augment.shift_sections(views.vox(spark, sf_dir), 8, 32, 0.3, 2).select("id", "x", "y", "z")


def dropped(spark, sf_dir):
    """G-03, G-04: sections blanked, then intensity jitter."""
    rows = augment.drop_sections(views.vox(spark, sf_dir), 33, 0.2)
    return augment.jitter(rows, 34, 0.1, 0.1).select("id", "label", F.round("img", 6).alias("img"))


def noisy(spark, sf_dir):
    """G-05: Gaussian noise of a width drawn for each volume."""
    return augment.noise(views.vox(spark, sf_dir), 35, 0.2).select("id", F.round("img", 6).alias("img"))


def recipes(spark, sf_dir):
    """G-06: the whole recipe; all voxels stay, labels go with their voxels."""
    return augment.recipe(views.vox(spark, sf_dir), 8, 36).select("id", "x", "y", "z", "label", F.round("img", 6).alias("img"))


def crops(spark, sf_dir):
    """G-07, G-10: two global and two local crops of each volume."""
    voxels = views.vox(spark, sf_dir)
    specs = augment.multi_crop(voxels.select("vol").distinct(), 2, 4, 3)
    return augment.resized_crop(voxels, specs, 8, 37).withColumn("img", F.round("img", 6) + 0.0)


def blurred(spark, sf_dir):
    """G-08: separable Gaussian blur with a width for each volume."""
    return augment.gaussian_blur(views.vox(spark, sf_dir), 8, 0.5 + uniform(38, "sigma", "vol")).withColumn("img", F.round("img", 6))


def photometric(spark, sf_dir):
    """G-09: contrast and brightness about the mean of each view."""
    rows = augment.photometric(views.vox(spark, sf_dir), ["vol"], 0.6 + 0.8 * uniform(39, "contrast", "vol"), 0.6 + 0.8 * uniform(39, "bright", "vol"), uniform(39, "on", "vol") < 0.8)
    return rows.select("id", F.round("img", 6).alias("img"))


def resized(spark, sf_dir):
    """G-11: multilinear resize to 12 x 5 x 8."""
    return augment.resize(views.vox(spark, sf_dir), {"x": (8, 12), "y": (8, 5), "z": (8, 8)}).withColumn("img", F.round("img", 6))


PATCH4 = "pt AS (SELECT vol, (x // 4) * 4 + (y // 4) * 2 + z // 4 AS patch, (x % 4) * 16 + (y % 4) * 4 + z % 4 AS o, img FROM vox)"
ERR = f"""{PATCH4}, er AS (SELECT vol, patch, avg(pow(abs(img * 0.5 + o / 256.0::DOUBLE - img), 2)) AS e2, avg(abs(img * 0.5 + o / 256.0::DOUBLE - img)) AS e1 FROM pt GROUP BY vol, patch), eh AS (SELECT *, {uniform_sql(25, "hide", "vol", "patch")} < 0.6 AS hidden, patch % 2 AS level FROM er)"""
PERM = "[[0, 1, 2], [1, 0, 2], [0, 2, 1], [1, 2, 0], [2, 0, 1], [2, 1, 0]]"


def _rotated_sql(seed: int, rows: str) -> str:
    flips = ", ".join(f"CASE WHEN {uniform_sql(seed, 'flip' + a, 'vol')} < 0.5 THEN 7 - {a} ELSE {a} END" for a in "xyz")
    return f"(SELECT * REPLACE (c[p[1] + 1] AS x, c[p[2] + 1] AS y, c[p[3] + 1] AS z) FROM (SELECT *, [{flips}] AS c, ({PERM})[floor({uniform_sql(seed, 'perm', 'vol')} * 6)::INT + 1] AS p FROM {rows}))"


def _shifted_sql(seed: int, rows: str, coin: str = "true") -> str:
    axis = f"floor({uniform_sql(seed, 'shift.axis', 'vol')} * 3)::INT"
    moved = ", ".join(f"CASE WHEN {coin} AND {uniform_sql(seed, 'shift.on', 'vol', 'sec')} < 0.3 AND ax <> {i} THEN ({a} + floor({uniform_sql(seed, f'shift.{a}', 'vol', 'sec')} * 5)::INT - 2 + 8) % 8 ELSE {a} END AS {a}" for i, a in enumerate("xyz"))
    return f"(SELECT * REPLACE ({moved}) FROM (SELECT *, [x, y, z][ax + 1] AS sec FROM (SELECT *, {axis} AS ax FROM {rows})))"


def _dropped_sql(seed: int, rows: str, coin: str = "true") -> str:
    section = f"[x, y, z][floor({uniform_sql(seed, 'drop.axis', 'vol')} * 3)::INT + 1]"
    return f"(SELECT * REPLACE (CASE WHEN {coin} AND {uniform_sql(seed, 'drop.on', 'vol', section)} < 0.2 THEN 0 ELSE img END AS img) FROM {rows})"


def _coin(seed: int, tag: str) -> str:
    return f"{uniform_sql(seed, 'coin.' + tag, 'vol')} < 0.5"


def _recipe_sql(seed: int) -> str:
    rows = _dropped_sql(seed, _shifted_sql(seed, _rotated_sql(seed, "vox"), _coin(seed, "shift")), _coin(seed, "drop"))
    jitter = f"CASE WHEN {_coin(seed, 'jitter')} THEN img * (0.9::DOUBLE + 0.2 * {uniform_sql(seed, 'jitter.m', 'vol')}) + (2 * {uniform_sql(seed, 'jitter.a', 'vol')} - 1) * 0.1 ELSE img END"
    noise = f"CASE WHEN {_coin(seed, 'noise')} THEN img + {uniform_sql(seed, 'noise.s', 'vol')} * 0.05 * {normal_sql(seed, 'noise.v', 'vol', 'x', 'y', 'z')} ELSE img END"
    return f"SELECT id, x, y, z, label, round({noise}, 6) AS img FROM (SELECT * REPLACE ({jitter} AS img) FROM {rows})"


def _crop_sql() -> str:
    k = ("vol", "view")
    f = f"(lo + {uniform_sql(37, 'crop.f', *k)} * (hi - lo))"
    sides = ", ".join(f"least(greatest(pow({f}, 1 / 3.0::DOUBLE) * exp(({uniform_sql(37, f'crop.s{a}', *k)} - 0.5) * 0.4), 0.05), 1) AS s{a}" for a in "xyz")
    rest = ", ".join(f"s{a} / 2 + {uniform_sql(37, f'crop.c{a}', *k)} * (1 - s{a}) AS c{a}, CASE WHEN {uniform_sql(37, f'crop.f{a}', *k)} < 0.5 THEN -1 ELSE 1 END AS f{a}" for a in "xyz")
    unit = {a: f"((g{a} + 0.5) / n - 0.5)" for a in "xyz"}
    pos = [f"(cx + (CASE WHEN turn THEN {unit['y']} ELSE {unit['x']} END) * fx * sx) * 8 - 0.5 AS px", f"(cy + (CASE WHEN turn THEN {unit['x']} ELSE {unit['y']} END) * fy * sy) * 8 - 0.5 AS py", f"(cz + {unit['z']} * fz * sz) * 8 - 0.5 AS pz"]
    corner = " AND ".join(f"v.{a} = CASE WHEN ((floor(p{a})::INT + k{a} + 32) % 16) >= 8 THEN 15 - ((floor(p{a})::INT + k{a} + 32) % 16) ELSE ((floor(p{a})::INT + k{a} + 32) % 16) END" for a in "xyz")
    weight = " * ".join(f"(CASE WHEN k{a} = 0 THEN 1 - (p{a} - floor(p{a})) ELSE p{a} - floor(p{a}) END)" for a in "xyz")
    axes = ", ".join(f"(SELECT unnest(range(0, 4)) AS g{a}) t{a}" for a in "xyz")
    ks = ", ".join(f"(SELECT unnest([0, 1]) AS k{a}) u{a}" for a in "xyz")
    return f"""WITH sp AS (SELECT vol, view, CASE WHEN view < 2 THEN 4 ELSE 3 END AS n, CASE WHEN view < 2 THEN 0.32::DOUBLE ELSE 0.05::DOUBLE END AS lo, CASE WHEN view < 2 THEN 1.0::DOUBLE ELSE 0.32::DOUBLE END AS hi FROM (SELECT DISTINCT vol FROM vox), (SELECT unnest(range(0, 4)) AS view)),
b1 AS (SELECT *, {sides} FROM sp), b AS (SELECT *, {rest}, {uniform_sql(37, "crop.turn", *k)} < 0.5 AS turn FROM b1), p AS (SELECT vol, view, gx, gy, gz, {', '.join(pos)} FROM b, {axes} WHERE gx < n AND gy < n AND gz < n)
SELECT p.vol, p.view::INT AS view, gx::INT AS x, gy::INT AS y, gz::INT AS z, round(sum(img * {weight}), 6) + 0.0 AS img FROM (SELECT * FROM p, {ks}) p JOIN vox v ON v.vol = p.vol AND {corner} GROUP BY p.vol, p.view, gx, gy, gz"""


def _blur_sql() -> str:
    out, rows = [], f"(SELECT vol, x, y, z, img AS v, 0.5 + {uniform_sql(38, 'sigma', 'vol')} AS s FROM vox)"
    for i, a in enumerate("xyz"):
        others = ", ".join(o for o in "xyz" if o != a)
        out.append(f"b{i} AS (SELECT vol, {others}, place AS {a}, sum(v * w) / any_value(norm) AS v, any_value(s) AS s FROM (SELECT r.*, place, exp(-0.5 * pow(t / s, 2)) AS w, list_sum(list_transform(range(-4, 5), lambda q: exp(-0.5 * pow(q / s, 2)))) AS norm FROM {rows} r, (SELECT unnest(range(0, 8)) AS place), (SELECT unnest(range(-4, 5)) AS t) WHERE r.{a} = CASE WHEN (place + t + 14) % 14 >= 8 THEN 14 - (place + t + 14) % 14 ELSE (place + t + 14) % 14 END) GROUP BY vol, {others}, place)")
        rows = f"b{i}"
    return f"WITH {', '.join(out)} SELECT vol, x, y, z, round(v, 6) AS img FROM b2"


def _resize_sql() -> str:
    out, rows = [], "(SELECT vol, x, y, z, img AS v FROM vox)"
    for i, (a, want) in enumerate((("x", 12), ("y", 5), ("z", 8))):
        others = ", ".join(o for o in "xyz" if o != a)
        src = f"greatest((d + 0.5) * 8 / {want} - 0.5, 0)"
        out.append(f"r{i} AS (SELECT vol, {others}, d AS {a}, sum(v * ((CASE WHEN {a} = low THEN 1 - part ELSE 0 END) + (CASE WHEN {a} = least(low + 1, 7) THEN part ELSE 0 END))) AS v FROM (SELECT r.*, d, floor({src})::INT AS low, {src} - floor({src}) AS part FROM {rows} r, (SELECT unnest(range(0, {want})) AS d)) GROUP BY vol, {others}, d)")
        rows = f"r{i}"
    return f"WITH {', '.join(out)} SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, round(v, 6) AS img FROM r2"


MASK = f"mk AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY {uniform_sql(21, 'mask', 'sample', 'token')}, token) > greatest(1, round_even(count(*) OVER (PARTITION BY sample) * (1 - 0.63::DOUBLE), 0)) AS hidden FROM tokens)"
ALPHA = 0.5  # concentration of the level weights
DIR = f"lv AS (SELECT sample, (token // 20)::INT AS level, token FROM tokens), g AS (SELECT sample, level, {gamma_sql(ALPHA, 23, 'dir', 'sample', 'level')} AS g FROM (SELECT DISTINCT sample, level FROM lv)), w AS (SELECT sample, level, greatest(g / sum(g) OVER (PARTITION BY sample), 1e-9) AS w FROM g)"
UNIT = "((patch // 16) // 3) * 4 + (((patch // 4) % 4) // 3) * 2 + (patch % 4) // 3"

QUERIES = {
    "m01_patchify": (
        patchified,
        views.sql("vox", f"WITH {PATCH4}, m AS (SELECT vol, patch, avg(img) AS m, var_samp(img) AS s FROM pt GROUP BY vol, patch) SELECT vol, patch::INT AS patch, round(max(img) FILTER (o = 7), 6) AS v7, round((max(img) FILTER (o = 9) - any_value(m)) / sqrt(any_value(s) + 1e-6), 6) AS s9 FROM pt JOIN m USING (vol, patch) GROUP BY vol, patch"),
    ),
    "m02_unpatchify": (folded, views.sql("vox", "SELECT vol, x::INT AS x, y::INT AS y, z::INT AS z, round(img, 9) AS value FROM vox")),
    "m03_coordinates": (
        coordinates,
        """WITH b AS (SELECT p_partkey // 3 AS sample, p_partkey % 3 AS level, list_transform([0, 1, 2], lambda k: (p_size + k)::DOUBLE) AS lo, list_transform([0, 1, 2], lambda k: (2 * p_size + 10 + k * (1 + p_partkey % 3))::DOUBLE) AS hi FROM part)
, c AS (SELECT sample, arg_min(list_transform([1, 2, 3], lambda k: (lo[k] + hi[k]) / 2), level) AS c FROM b GROUP BY sample), m AS (SELECT sample, level, list_transform([1, 2, 3], lambda k: lo[k] - c[k]) AS lo, list_transform([1, 2, 3], lambda k: hi[k] - c[k]) AS hi FROM b JOIN c USING (sample)), p AS (SELECT *, unnest(range(0, 8)) AS patch FROM m)
SELECT sample, level, patch::INT AS patch, (patch // 4)::INT AS i0, (patch % 4)::INT AS i1, 0 AS i2, round(lo[1] + (patch // 4) * (hi[1] - lo[1]), 6) AS w0, round(lo[2] + (patch % 4) / 3.0::DOUBLE * (hi[2] - lo[2]), 6) AS w1, round(lo[3], 6) AS w2 FROM p""",
    ),
    "m05_random_mask": (random_masks, views.sql("tokens", f"WITH {MASK} SELECT sample, token, hidden FROM mk")),
    "m06_granular_mask": (
        granular_masks,
        views.sql("vox", f"WITH p AS (SELECT DISTINCT vol, (x // 2) * 16 + (y // 2) * 4 + z // 2 AS patch FROM vox), u AS (SELECT vol, patch, {UNIT} AS unit FROM p), d AS (SELECT vol, unit, row_number() OVER (PARTITION BY vol ORDER BY {uniform_sql(22, 'unit', 'vol', 'unit')}, unit) <= 5 AS hidden FROM (SELECT DISTINCT vol, unit FROM u)) SELECT vol, patch::INT AS patch, hidden FROM u JOIN d USING (vol, unit)"),
    ),
    "m07_level_weighted_mask": (weighted_masks, views.sql("tokens", f"WITH {DIR} SELECT sample, level, token, row_number() OVER (PARTITION BY sample ORDER BY ln(1 - {uniform_sql(23, 'gumbel', 'sample', 'level', 'token')}) / w DESC, level, token) > 15 AS hidden FROM lv JOIN w USING (sample, level)")),
    "m08_block_masks": (block_masks, None),
    "m09_restore": (restored, views.sql("tokens", f"WITH {MASK} SELECT sample, token, round(CASE WHEN NOT hidden THEN list_sum(vec) WHEN token % 2 = 0 THEN 0 ELSE 32 END, 6) AS total FROM mk")),
    "m11_masked_losses": (
        losses,
        views.sql("vox", f"WITH {ERR} SELECT vol, round(coalesce(sum(e2) FILTER (hidden), 0) / greatest(count(*) FILTER (hidden), 1), 6) AS l2, round(avg(hidden::INT), 6) AS share, round(coalesce(sum(e1) FILTER (hidden), 0) / greatest(count(*) FILTER (hidden), 1), 6) AS l1, round(coalesce(sum(e1) FILTER (NOT hidden), 0) / greatest(count(*) FILTER (NOT hidden), 1), 6) AS visible_l1 FROM eh GROUP BY vol"),
    ),
    "m13_level_balanced_loss": (balanced_loss, views.sql("vox", f"WITH {ERR}, q AS (SELECT vol, level, avg(e2) FILTER (hidden) AS l, avg((NOT hidden)::INT) AS vis FROM eh GROUP BY vol, level) SELECT round(avg(l), 6) AS loss, count(l) AS pairs, round(avg(vis) FILTER (level = 0), 6) AS finest_visible FROM q")),
    "g01_rotate": (rotated, views.sql("vox", f"SELECT id, x::INT AS x, y::INT AS y, z::INT AS z, label FROM {_rotated_sql(31, 'vox')}")),
    "g01_rotate_plane": (
        rotated_planes,
        views.sql(
            "vox",
            f"WITH p AS (SELECT id, vol * 8 + z AS plane, x, y FROM vox), f AS (SELECT id, plane, CASE WHEN {uniform_sql(38, 'flipx', 'plane')} < 0.5 THEN 7 - x ELSE x END AS x, CASE WHEN {uniform_sql(38, 'flipy', 'plane')} < 0.5 THEN 7 - y ELSE y END AS y FROM p) SELECT id, CASE WHEN {uniform_sql(38, 'perm', 'plane')} < 0.5 THEN y ELSE x END::INT AS x, CASE WHEN {uniform_sql(38, 'perm', 'plane')} < 0.5 THEN x ELSE y END::INT AS y FROM f",
        ),
    ),
    "f10_rotation_guard": (rotation_guarded, views.sql("vox", "SELECT vol, count(*) AS n, sum(id)::BIGINT AS ids, 512::BIGINT AS places FROM vox GROUP BY vol")),
    "g02_shift_sections": (shifted, views.sql("vox", f"SELECT id, x::INT AS x, y::INT AS y, z::INT AS z FROM {_shifted_sql(32, 'vox')}")),
    "g03_drop_jitter": (dropped, views.sql("vox", f"SELECT id, label, round(img * (0.9::DOUBLE + 0.2 * {uniform_sql(34, 'jitter.m', 'vol')}) + (2 * {uniform_sql(34, 'jitter.a', 'vol')} - 1) * 0.1, 6) AS img FROM {_dropped_sql(33, 'vox')}")),
    "g05_noise": (noisy, views.sql("vox", f"SELECT id, round(img + {uniform_sql(35, 'noise.s', 'vol')} * 0.2 * {normal_sql(35, 'noise.v', 'vol', 'x', 'y', 'z')}, 6) AS img FROM vox")),
    "g06_recipe": (recipes, views.sql("vox", _recipe_sql(36))),
    "g07_multi_crop": (crops, views.sql("vox", _crop_sql())),
    "g08_blur": (blurred, views.sql("vox", _blur_sql())),
    "g09_photometric": (
        photometric,
        views.sql("vox", f"WITH m AS (SELECT *, avg(img) OVER (PARTITION BY vol) AS m FROM vox) SELECT id, round(CASE WHEN {uniform_sql(39, 'on', 'vol')} < 0.8 THEN (img - m) * (0.6 + 0.8 * {uniform_sql(39, 'contrast', 'vol')}) + m * (0.6 + 0.8 * {uniform_sql(39, 'bright', 'vol')}) ELSE img END, 6) AS img FROM m"),
    ),
    "g11_resize": (resized, views.sql("vox", _resize_sql())),
}
