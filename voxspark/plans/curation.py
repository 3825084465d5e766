"""Queries that choose, draw and deal rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.draws import uniform_sql
from voxspark.operators import curation, sampling
from voxspark.sources import views

HELD = ["BUILDING", "MACHINERY"]
LEVELS = [(0, [4.0, 4.0, 33.0]), (1, [8.0, 8.0, 33.0]), (2, [16.0, 16.0, 33.0]), (3, [32.0, 32.0, 33.0]), (4, [64.0, 64.0, 66.0])]
LEVEL_SQL = "levels AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {size[0]}::DOUBLE, {size[1]}::DOUBLE, {size[2]}::DOUBLE)" for k, size in LEVELS) + ") AS l(level, sx, sy, sz))"
CHOICE = "SELECT id, coalesce(max(level) FILTER (sx <= wx AND sy <= wy AND sz <= wz), min(level)) AS level FROM req CROSS JOIN levels GROUP BY id"


def _levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, size array<double>")


def allowed(spark, sf_dir):
    """F-01: an allow list over two columns."""
    return curation.allow(views.table(spark, sf_dir, "customer"), {"c_mktsegment": HELD, "c_nationkey": [1, 2, 3, 5, 8, 13]}).select("c_custkey", "c_mktsegment", "c_nationkey")


def group_keys(spark, sf_dir):
    """F-02: groups by the first one and two parts of a name."""
    name = F.col("name")
    return views.volumes(spark, sf_dir).select("vid", curation.group_key(name, 1).alias("g1"), curation.group_key(name, 2).alias("g2"))


def split(spark, sf_dir):
    """F-03: train and val volumes by held-out groups."""
    volumes = views.volumes(spark, sf_dir)
    parts = [curation.hold_out(volumes, "name", 1, HELD, s).select("vid", F.lit(s).alias("split")) for s in ("train", "val")]
    return parts[0].union(parts[1])


def class_bound(spark, sf_dir):
    """F-04, F-08: labels below the number of classes, one level, counted by volume."""
    voxels = curation.level_gate(curation.check_class_bound(views.vox(spark, sf_dir), "label", 3), [0])
    return voxels.groupBy("vol").agg(F.max("label").alias("top"), F.count("*").alias("n"))


def levels_declared(spark, sf_dir):
    """F-08: a pyramid that has the levels it declares, counted by volume and level."""
    return curation.level_gate(views.pyramid(spark, sf_dir), [0, 1, 2]).groupBy("vol", "level").agg(F.count("*").alias("n"), F.round(F.avg("img"), 6).alias("img"))


def known_voxels(spark, sf_dir):
    """F-05, F-06: known labels with normalised intensity."""
    voxels = views.vox(spark, sf_dir).withColumn("raw", F.round(F.col("img") * 255))
    return curation.without_ignored(voxels, "label").select("id", "label", (F.col("raw") / 255.0).alias("img"))


def axes(spark, sf_dir):
    """F-07: voxels in the order of a layout string."""
    return curation.by_axes(views.vox(spark, sf_dir), "lczyx").select("id", "a0", "a1", "a2")


def registration(spark, sf_dir):
    """F-09: image and label grids compared by volume (some labels are cut short)."""
    voxels = views.vox(spark, sf_dir)
    return curation.registration(voxels, voxels.where("not (vol % 3 = 0 and z = 7)"), ["vol"]).select("vol", "agree", F.col("label_shape")[2].alias("label_nz"))


def isotropy(spark, sf_dir):
    """F-10: may the first two axes, or all three, be exchanged at a level?"""
    size = F.when(F.col("p_partkey") % 10 != 0, F.array((F.col("p_partkey") % 3 + 1).cast("double"), (F.col("p_partkey") % 3 + 1 + F.col("p_partkey") % 2 * 1e-10).cast("double"), (F.col("p_size") % 3 + 1).cast("double")))
    part = views.table(spark, sf_dir, "part").select("p_partkey", size.alias("size"))
    return part.select("p_partkey", curation.isotropic(F.slice("size", 1, 2)).alias("in_plane"), curation.isotropic(F.col("size")).alias("all_axes"))


def box(spark, sf_dir):
    """F-11, I-04: voxels of a box of some volumes."""
    return views.vox(spark, sf_dir).where(F.col("vol") % 2 == 0).where(curation.in_box({"x": 2, "y": 0, "z": 3}, {"x": 6, "y": 5, "z": 8})).select("vol", "x", "y", "z", "img")


def sparse(spark, sf_dir):
    """F-12: labels of which a fifth was never written."""
    voxels = views.vox(spark, sf_dir)
    return curation.sparse_default(voxels.where("id % 5 <> 0").select("id", "label"), voxels.select("id"), ["id"])


def level_choice(spark, sf_dir):
    """I-05: the pyramid level of each requested voxel size."""
    want = F.array((4 + F.col("p_partkey") % 70).cast("double"), (2 + F.col("p_size")).cast("double"), F.lit(33.0) + F.col("p_partkey") % 2 * 33)
    return curation.choose_level(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), want.alias("want")), _levels(spark))


def drawn(spark, sf_dir):
    """P-01: draws with replacement, as many as rows."""
    return sampling.draw_rows(views.table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], None, 3)


def mixed(spark, sf_dir):
    """P-02: volumes drawn by weight, three for each row."""
    volumes = views.volumes(spark, sf_dir)
    return sampling.draw_weighted(volumes, 3 * volumes.count(), 5)


def share(spark, sf_dir):
    """P-03: shares of ground truth and pseudo labels."""
    return sampling.shares(views.volumes(spark, sf_dir), 0.3).select("vid", "origin", F.round("share", 9).alias("share"))


def ranks(spark, sf_dir):
    """P-04: a seeded permutation dealt to seven ranks, padded."""
    return sampling.deal_ranks(sampling.shuffle_rows(views.volumes(spark, sf_dir).select("vid"), "vid", 9, 2), 7)


def batch(spark, sf_dir):
    """P-05: batches of 16 in each rank, the short one dropped."""
    return sampling.batches(ranks(spark, sf_dir), 16)


def steps(spark, sf_dir):
    """P-06: batches over epochs until a number of steps."""
    return sampling.endless(views.volumes(spark, sf_dir).select("vid"), "vid", 9, 7, 4, 16)


def crops(spark, sf_dir):
    """P-07: random windows, one axis longer than the volume."""
    return sampling.crop(views.vox(spark, sf_dir), {"x": 5, "y": 10, "z": 6}, 4, ["img", "label"])


def arms(spark, sf_dir):
    """P-08: nested arms of 1, 3 and 5 volumes in each group."""
    volumes = views.volumes(spark, sf_dir).withColumn("grp", curation.group_key(F.col("name"), 1))
    return sampling.nested_arms(volumes, ["vid"], [1, 3, 5], "grp").select("grp", "vid", "arm")


def shards(spark, sf_dir):
    """P-09: shards of a list in version order."""
    rows = views.table(spark, sf_dir, "part").select(F.concat(F.lit("cube"), F.col("p_partkey").cast("string")).alias("name"))
    return sampling.shard_of(rows, "name", 8)


def todo(spark, sf_dir):
    """P-10, P-11: items left to do, behind a gate: those done are all the others, each of them once."""
    rows = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") > 10).alias("is_done"))
    done = rows.where("is_done")
    left = sampling.unfinished(rows.select("p_partkey"), done, "p_partkey")
    return curation.guarded(left, sampling.completeness(done, rows.count() - left.count()))


def resolutions(spark, sf_dir):
    """P-12: log-uniform voxel sizes and their pyramid level."""
    part = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sampling.log_uniform(6, "res", 4.0, 128.0, "p_partkey").alias("w"))
    return curation.choose_level(part.select("id", F.array("w", "w", F.col("w") * 2).alias("want")), _levels(spark)).join(part.select("id", F.round("w", 6).alias("size")), "id")


RANKED = f"perm AS (SELECT vid, row_number() OVER (ORDER BY {uniform_sql(9, 'epoch{e}', 'vid')}, vid) - 1 AS pos FROM volumes), n AS (SELECT count(*) AS n FROM perm), dealt AS (SELECT vid, pos FROM perm UNION ALL SELECT vid, pos + n FROM perm, n WHERE pos < (7 - n % 7) % 7), r AS (SELECT vid, pos, (pos % 7)::INT AS rank FROM dealt), b AS (SELECT *, (pos // 7) // 16 AS batch, count(*) OVER (PARTITION BY rank, (pos // 7) // 16) AS c FROM r)"


def _steps_sql() -> str:
    # the epoch is a column: one permutation for each
    draw = uniform_sql(9, "epoch0", "vid").replace("'epoch0'", "'epoch' || e")
    return (
        f"WITH n AS (SELECT count(*) AS n FROM volumes), per AS (SELECT greatest(1, ((n + 6) // 7) // 16) AS per FROM n), ep AS (SELECT unnest(range(0, (SELECT (4 + per - 1) // per FROM per))) AS e), "
        f"perm AS (SELECT e, vid, row_number() OVER (PARTITION BY e ORDER BY {draw}, vid) - 1 AS pos FROM volumes, ep), dealt AS (SELECT e, vid, pos FROM perm UNION ALL SELECT e, vid, pos + n FROM perm, n WHERE pos < (7 - n % 7) % 7), "
        "b AS (SELECT e, vid, (pos % 7)::INT AS rank, (pos // 7) // 16 AS batch, count(*) OVER (PARTITION BY e, pos % 7, (pos // 7) // 16) AS c FROM dealt) SELECT batch + e * per AS step, rank, vid FROM b, per WHERE c = 16 AND batch + e * per < 4"
    )


CROP = ", ".join(f"floor({uniform_sql(4, f'crop.{a}', 'vol')} * (greatest(8 - {w}, 0) + 1))::INT AS s{a}" for a, w in (("x", 5), ("y", 10), ("z", 6)))

QUERIES = {
    "f01_allow_list": (allowed, "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey IN (1, 2, 3, 5, 8, 13)"),
    "f02_group_keys": (group_keys, views.sql("volumes", "SELECT vid, split_part(name, '/', 1) AS g1, split_part(name, '/', 1) || '/' || split_part(name, '/', 2) AS g2 FROM volumes")),
    "f03_hold_out": (split, views.sql("volumes", "SELECT vid, CASE WHEN split_part(name, '/', 1) IN ('BUILDING', 'MACHINERY') THEN 'val' ELSE 'train' END AS split FROM volumes")),
    "f04_class_bound": (class_bound, views.sql("vox", "SELECT vol, max(label) AS top, count(*) AS n FROM vox GROUP BY vol")),
    "f08_level_gate": (levels_declared, views.sql("pyramid", "SELECT vol, level, count(*) AS n, round(avg(img), 6) AS img FROM pyramid GROUP BY vol, level")),
    "f05_known_voxels": (known_voxels, views.sql("vox", "SELECT id, label, round(img * 255) / 255.0::DOUBLE AS img FROM vox WHERE label <> -1")),
    "f07_axes": (axes, views.sql("vox", "SELECT id, z AS a0, y AS a1, x AS a2 FROM vox")),
    "f09_registration": (registration, views.sql("vox", "SELECT DISTINCT vol, vol % 3 <> 0 AS agree, CASE WHEN vol % 3 = 0 THEN 7 ELSE 8 END::BIGINT AS label_nz FROM vox")),
    "f10_isotropy": (
        isotropy,
        "WITH s AS (SELECT p_partkey, CASE WHEN p_partkey % 10 <> 0 THEN [p_partkey % 3 + 1.0::DOUBLE, p_partkey % 3 + 1 + p_partkey % 2 * 1e-10::DOUBLE, p_size % 3 + 1.0::DOUBLE] END AS s FROM part) SELECT p_partkey, coalesce(greatest(s[1], s[2]) - least(s[1], s[2]) <= 1e-9 + 1e-6 * greatest(s[1], s[2]), true) AS in_plane, coalesce(list_max(s) - list_min(s) <= 1e-9 + 1e-6 * list_max(s), true) AS all_axes FROM s",
    ),
    "f11_box": (box, views.sql("vox", "SELECT vol, x, y, z, img FROM vox WHERE vol % 2 = 0 AND x BETWEEN 2 AND 5 AND y < 5 AND z >= 3")),
    "f12_sparse_default": (sparse, views.sql("vox", "SELECT id, CASE WHEN id % 5 = 0 THEN -1 ELSE label END AS label FROM vox")),
    "i05_level_choice": (level_choice, f"WITH {LEVEL_SQL}, req AS (SELECT p_partkey AS id, (4 + p_partkey % 70)::DOUBLE AS wx, (2 + p_size)::DOUBLE AS wy, 33.0::DOUBLE + p_partkey % 2 * 33 AS wz FROM part) {CHOICE}"),
    "p01_draw_rows": (drawn, f"WITH n AS (SELECT count(*) AS n FROM customer), d AS (SELECT unnest(range(0, (SELECT n FROM n))) AS draw) SELECT draw, c_custkey FROM d, n JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) ON r = floor({uniform_sql(3, 'row', 'draw')} * n)"),
    "p02_draw_weighted": (
        mixed,
        views.sql(
            "volumes",
            f"WITH s AS (SELECT vid, sum(weight) OVER (ORDER BY vid) AS hi, weight FROM volumes), d AS (SELECT unnest(range(0, (SELECT 3 * count(*) FROM volumes))) AS draw), a AS (SELECT draw, {uniform_sql(5, 'volume', 'draw')} * (SELECT sum(weight) FROM volumes) AS u FROM d) SELECT draw, vid FROM a JOIN s ON u >= hi - weight AND u < hi",
        ),
    ),
    "p03_shares": (share, views.sql("volumes", "SELECT vid, origin, round(CASE WHEN origin = 'gt' THEN 0.3::DOUBLE ELSE 1 - 0.3::DOUBLE END / count(*) OVER (PARTITION BY origin), 9) AS share FROM volumes")),
    "p04_rank_partition": (ranks, views.sql("volumes", f"WITH {RANKED.replace('{e}', '2')} SELECT vid, pos, rank FROM r")),
    "p05_batches": (batch, views.sql("volumes", f"WITH {RANKED.replace('{e}', '2')} SELECT vid, pos, rank, batch FROM b WHERE c = 16")),
    "p06_endless": (steps, views.sql("volumes", _steps_sql())),
    "p07_crop": (
        crops,
        views.sql(
            "vox",
            f"WITH s AS (SELECT vol, {CROP} FROM (SELECT DISTINCT vol FROM vox)), g AS (SELECT vol, sx, sy, sz, a.a AS x, b.b AS y, c.c AS z FROM s, (SELECT unnest(range(0, 5)) AS a) a, (SELECT unnest(range(0, 10)) AS b) b, (SELECT unnest(range(0, 6)) AS c) c) SELECT g.vol, g.x, g.y, g.z, coalesce(img, 0) AS img, coalesce(label, 0) AS label FROM g LEFT JOIN vox v ON v.vol = g.vol AND v.x = g.x + sx AND v.y = g.y + sy AND v.z = g.z + sz",
        ),
    ),
    "p08_nested_arms": (arms, views.sql("volumes", "WITH p AS (SELECT split_part(name, '/', 1) AS grp, vid, row_number() OVER (PARTITION BY split_part(name, '/', 1) ORDER BY vid) AS k FROM volumes) SELECT grp, vid, arm FROM p, (SELECT unnest([1, 3, 5]) AS arm) WHERE k <= arm")),
    "p09_shards": (shards, "SELECT 'cube' || p_partkey AS name, (row_number() OVER (ORDER BY p_partkey) % 8)::INT AS shard FROM part"),
    "p10_unfinished": (todo, "SELECT p_partkey FROM part WHERE p_size <= 10"),
    "p12_resolutions": (
        resolutions,
        f"WITH {LEVEL_SQL}, u AS (SELECT p_partkey AS id, exp(ln(4.0::DOUBLE) + {uniform_sql(6, 'res', 'p_partkey')} * (ln(128.0::DOUBLE) - ln(4.0::DOUBLE))) AS w FROM part), req AS (SELECT id, w AS wx, w AS wy, 2 * w AS wz FROM u) SELECT id, level, round(w, 6) AS size FROM ({CHOICE}) JOIN u USING (id)",
    ),
}
