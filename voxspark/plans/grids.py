"""Queries on label volumes and tiled scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.draws import uniform, uniform_sql
from voxspark.operators import labels, merge_trees, metrics, tiles
from voxspark.sources import views

OFFSETS = labels.offset_rows(3, 1, 3)
THRESHOLDS = [2 + k / 16 for k in range(50)]  # of the sweep
DRAW = uniform_sql(11, "logit", "id", "channel")
TILE_STARTS = """WITH p AS (SELECT p_partkey, p_size::BIGINT AS extent, 1 + p_partkey % 16 AS tile, p_partkey % 5 AS overlap FROM part)
SELECT DISTINCT p_partkey, unnest(CASE WHEN tile >= extent THEN [0::BIGINT] ELSE list_append(range(0, extent - tile + 1, greatest(tile - overlap, 1)), extent - tile) END) AS start FROM p"""
NEAR = """offsets AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1), (3, 3, 0, 0), (4, 0, 3, 0), (5, 0, 0, 3)) AS o(channel, dx, dy, dz)
), aff AS (
  SELECT a.vol, a.level, a.x, a.y, a.z, a.id, channel, coalesce(a.label = b.label AND a.label > 0, false) AS affinity, coalesce(a.label >= 0 AND b.label >= 0, false) AS mask
  FROM vox a CROSS JOIN offsets LEFT JOIN vox b ON b.vol = a.vol AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz
)"""


def _with_logits(voxels: DataFrame) -> DataFrame:
    """The logits of the three short steps as an array."""
    return voxels.withColumn("logits", F.array(*[10 * uniform(11, "logit", F.col("id"), F.lit(k)) - 5 for k in range(3)]))


def offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-01: voxels inside the volume for every offset of the table."""
    voxels = views.vox(spark, sf_dir)
    table = labels.offset_table(spark, 3, 1, 3)
    size = voxels.groupBy("vol").agg(*[(F.max(a) + 1).alias(f"n{a}") for a in "xyz"])
    kept = F.lit(1)
    for a in "xyz":
        kept = kept * (F.col(f"n{a}") - F.col(f"d{a}"))
    return size.join(F.broadcast(table)).select("vol", "channel", "dx", "dy", "dz", kept.cast("long").alias("kept"))


def affinity_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02: targets and masks of all voxels and six offsets."""
    return labels.affinities(views.vox(spark, sf_dir), OFFSETS).select("vol", "x", "y", "z", "channel", "affinity", "mask")


def affinity_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-02 with slanted and negative offsets, in blocks smaller than a volume."""
    out = labels.affinities(views.vox(spark, sf_dir), [(0, (1, 1, 0)), (1, (-1, 0, 2)), (2, (-1, 0, 0))], side=5)
    return out.groupBy("vol", "channel").agg(F.count(F.when(F.col("affinity"), 1)).alias("n_same"), F.count(F.when(F.col("mask"), 1)).alias("n_known"))


def affinity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-06, the flagship: same-object, cut and unknown pairs, and how good the logits are."""
    # a voxel carries its logits of all channels, so that no join is needed
    logits = F.array(*[10 * uniform(11, "logit", "id", F.lit(channel)) - 5 for channel, _ in OFFSETS])
    pairs = labels.affinities(views.vox(spark, sf_dir).withColumn("logits", logits), OFFSETS, keep=("logits",)).withColumn("logit", F.col("logits")[F.col("channel")])
    return labels.affinity_scores(pairs, ["vol", "channel"])


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-03: face-neighbour edges of equal positive ids."""
    return labels.adjacency(views.vox(spark, sf_dir), "lab_noise").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-04, L-05: every id split into its connected pieces."""
    return labels.split_components(views.vox(spark, sf_dir).select("vol", "level", "x", "y", "z", "id", "lab_noise"), "lab_noise").select("id", "vol", F.col("piece").cast("long").alias("piece"))


def components_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-04 in two levels: blocks by themselves, then the graph of pieces that touch across faces."""
    return labels.split_components_by_block(views.vox(spark, sf_dir), 3, "lab_noise").select("id", "vol", F.col("piece").cast("long").alias("piece"))


def level_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-05: the ids of a pyramid split into pieces at each level by itself."""
    return labels.split_components(views.pyramid(spark, sf_dir).select("vol", "level", "x", "y", "z", "id", "lab_noise"), "lab_noise").select("id", "vol", "level", F.col("piece").cast("long").alias("piece"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-07: pieces of the kept short edges; fewer than four voxels are dropped."""
    return labels.segment(_with_logits(views.vox(spark, sf_dir)), 2.0, 4).select("id", F.col("segment").cast("long").alias("segment"))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-08: pseudo labels with background only where the score agrees, else unknown."""
    voxels = views.vox(spark, sf_dir).withColumn("segment", F.col("pred"))
    out = labels.abstain(voxels, F.col("pred") > 0, F.col("img"), uniform(12, "far", "id"), 0.4, 0.9)
    return out.select("id", "pseudo")


def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-09: pair precision and recall, merges and splits of a prediction in each volume."""
    return labels.overlap(views.vox(spark, sf_dir), ["vol"])


def enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-09: how much abstention prefers the boundaries of objects, in each volume."""
    voxels = views.vox(spark, sf_dir).withColumn("segment", F.col("pred"))
    pseudo = labels.abstain(voxels, F.col("pred") > 0, F.col("img"), uniform(12, "far", "id"), 0.4, 0.9)
    return labels.boundary_enrichment(pseudo, ["vol"], "pseudo", "label")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-10: coverage, merges, splits and score of pairs (F1) at fifty logits from one build, the first without a merge and the best."""
    # truth is the object of one volume: ids of different volumes are different objects
    voxels = _with_logits(views.vox(spark, sf_dir)).withColumn("truth", F.when(F.col("label") > 0, F.col("vol") * 10 + F.col("label")).otherwise(F.col("label")))
    return labels.choose_threshold(labels.threshold_sweep(merge_trees.build(voxels, keep=("truth",)), THRESHOLDS, 2, "truth"))


def same_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L-11: does a labeling cut the foreground as another does?"""
    voxels = views.vox(spark, sf_dir).withColumn("renamed", F.when(F.col("lab_noise") > 0, 7 - F.col("lab_noise")).otherwise(F.col("lab_noise")))
    one = labels.same_partition(voxels, ["vol"], "lab_noise", "renamed").select("vol", F.col("same").alias("same_renamed"))
    return one.join(labels.same_partition(voxels, ["vol"], "lab_noise", "pred").select("vol", F.col("same").alias("same_pred")), "vol")


def _tilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("long").alias("extent"), (1 + F.col("p_partkey") % 16).alias("tile"), (F.col("p_partkey") % 5).alias("overlap"))


def tile_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01: tile starts over the extents, tiles and overlaps of a table."""
    part = _tilings(spark, sf_dir)
    return part.select("p_partkey", F.explode(tiles.tile_starts(F.col("extent"), F.col("tile"), F.col("overlap"))).alias("start"))


def tile_start_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-01 as a table function in SQL, joined laterally."""
    name = tiles.register_tile_starts(spark)
    return spark.sql(f"SELECT p_partkey, start FROM {{part}}, LATERAL {name}(extent, tile, overlap)", part=_tilings(spark, sf_dir))


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-02: the blend weight of every voxel of a tile as large as its volume."""
    return views.vox(spark, sf_dir).select("id", tiles.blend_weight(8, F.col("x"), F.col("y"), F.col("z")).cast("long").alias("weight"))


def tiled_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-03: scores of overlapping tiles blended back to voxels."""
    rows = tiles.cut_tiles(views.scores(views.vox(spark, sf_dir)), 4, 2, {"x": 8, "y": 8, "z": 8})
    rows = rows.withColumn("score", F.col("score") + (F.col("x0") + 2 * F.col("y0") + 3 * F.col("z0")) * 0.125)
    return tiles.blend(rows, 4, ["vol", "x", "y", "z", "cls"]).withColumn("score", F.round("score", 6) + 0.0)


def orthoplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-04: plane scores along each axis averaged in the frame of the volume."""
    rows = views.scores(views.vox(spark, sf_dir))
    planes = {}
    for k, axis in enumerate("xyz"):
        others = [a for a in "xyz" if a != axis]
        planes[axis] = rows.select("vol", "cls", F.col(axis).alias("slice"), F.col(others[0]).alias("row"), F.col(others[1]).alias("col"), (F.col("score") * (k + 1)).alias("score"))
    return tiles.orthoplane_mean(planes, ["vol", "x", "y", "z", "cls"]).withColumn("score", F.round("score", 6))


def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-05: the best class of each voxel, the lowest on ties."""
    return tiles.argmax_class(views.scores(views.vox(spark, sf_dir)), ["id"])


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-06: the full confusion matrix of a prediction."""
    return metrics.confusion(views.vox(spark, sf_dir), 3)


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-07: accuracy, IoU and Dice from the totals of each volume."""
    return metrics.segmentation_metrics(metrics.confusion(views.vox(spark, sf_dir), 3, by=("vol",)), ("vol",))


def batch_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-08: IoU and accuracy of each batch of voxels; NaN where all are unknown."""
    return metrics.batch_metrics(views.vox(spark, sf_dir).withColumn("batch", F.expr("id div 37")).withColumn("label", F.when(F.col("batch") % 9 == 0, -1).otherwise(F.col("label"))), ["batch"])


def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-09: class-weighted cross-entropy of known voxels in each volume."""
    voxels = views.vox(spark, sf_dir).withColumn("scores", F.expr("transform(sequence(0, 3), c -> img * (c + 1) - (x + c) % 4)"))
    return metrics.weighted_cross_entropy(voxels, ["vol"], [0.5, 1.0, 2.0]).withColumn("loss", F.round("loss", 6))


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-10: unweighted mean over batches of rank-averaged metrics."""
    log = views.metric_log(spark, sf_dir).withColumn("batch", F.expr("step div 10"))
    return metrics.validation_average(log, ["run"]).withColumn("value", F.round("value", 6))


def _tile_means(batch):
    return batch.mean(axis=(2, 3, 4), keepdims=True) + 0 * batch


def predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-11: a user predictor over tiles of each volume (here the tile's mean in every voxel)."""
    from voxspark.functions.workers import ship

    ship(spark)
    rows = tiles.cut_tiles(views.vox(spark, sf_dir), 4, 2, {"x": 8, "y": 8, "z": 8})
    cell = F.struct((F.col("tx") * 16 + F.col("ty") * 4 + F.col("tz")).alias("at"), F.round(F.col("img") * 255).alias("img"))
    blocks = rows.groupBy("vol", "x0", "y0", "z0").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["img"]).alias("values"))
    out = tiles.predict_tiles(blocks, _tile_means, (4, 4, 4))
    return out.select("vol", "x0", "y0", "z0", F.size("scores").alias("voxels"), F.round(F.col("scores")[0], 4).alias("mean"))


BOTH = """pairs AS (SELECT {by}, {p} AS p, {t} AS t, count(*) AS n FROM {rows} WHERE {p} IS NOT NULL AND {t} IS NOT NULL GROUP BY {by}, {p}, {t}
), known AS (SELECT * FROM pairs WHERE p > 0 AND t > 0
), byp AS (SELECT {by}, sum(n * (n - 1) / 2) AS pred_pairs, count(*) FILTER (ids > 1) AS merges FROM (SELECT {by}, p, sum(n) AS n, count(*) AS ids FROM known GROUP BY {by}, p) GROUP BY {by}
), byt AS (SELECT {by}, sum(n * (n - 1) / 2) AS true_pairs, count(*) FILTER (ids > 1) AS splits FROM (SELECT {by}, t, sum(n) AS n, count(*) AS ids FROM known GROUP BY {by}, t) GROUP BY {by}
), com AS (SELECT {by}, sum(n * (n - 1) / 2) AS c FROM known GROUP BY {by}
), tot AS (SELECT {by}, sum(n) AS voxels, coalesce(sum(n) FILTER (p > 0), 0) AS inst, coalesce(sum(n) FILTER (p < 0), 0) AS ign FROM pairs GROUP BY {by})"""
GRAPH = """reach AS (SELECT id AS u, id AS v FROM nodes UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u)"""
FACES = "(b.vol = a.vol AND abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z) = 1)"


def _segment_sql(threshold: float, least: int, tag: str) -> str:
    """CTEs seg{tag}(id, segment) of segments above a threshold."""
    draw = uniform_sql(11, "logit", "a.id", "channel")
    return f"""half{tag} AS (
  SELECT a.id AS u, b.id AS v FROM vox a CROSS JOIN (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) AS o(channel, dx, dy, dz) JOIN vox b ON b.vol = a.vol AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz WHERE 10 * {draw} - 5 > {threshold}
), e{tag} AS (SELECT u, v FROM half{tag} UNION ALL SELECT v, u FROM half{tag}
), reach{tag} AS (SELECT id AS u, id AS v FROM vox UNION SELECT r.u, e.v FROM reach{tag} r JOIN e{tag} e ON r.v = e.u
), roots{tag} AS (SELECT u, min(v) AS root FROM reach{tag} GROUP BY u
), seg{tag} AS (SELECT u AS id, CASE WHEN count(*) OVER (PARTITION BY root) >= {least} THEN root + 1 ELSE 0 END AS segment FROM roots{tag})"""


def _sweep_sql() -> str:
    draw = uniform_sql(11, "logit", "a.id", "channel")
    return f"""WITH th AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold
), half AS (
  SELECT a.id AS u, b.id AS v, 10 * {draw} - 5 AS w FROM vox a CROSS JOIN (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)) AS o(channel, dx, dy, dz) JOIN vox b ON b.vol = a.vol AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz
), e AS (SELECT threshold, u, v FROM half JOIN th ON w > threshold UNION ALL SELECT threshold, v, u FROM half JOIN th ON w > threshold
), reach AS (SELECT threshold, id AS u, id AS v FROM vox, th UNION SELECT r.threshold, r.u, e.v FROM reach r JOIN e ON r.threshold = e.threshold AND r.v = e.u
), roots AS (SELECT threshold, u, min(v) AS root FROM reach GROUP BY threshold, u
), seg AS (SELECT threshold, u AS id, CASE WHEN count(*) OVER (PARTITION BY threshold, root) >= 2 THEN root + 1 ELSE 0 END AS segment FROM roots
), cuts AS (SELECT threshold, segment, CASE WHEN label > 0 THEN vol * 10 + label ELSE label END AS truth FROM vox JOIN seg USING (id)), {BOTH.format(by='threshold', p='segment', t='truth', rows='cuts')}, sweep0 AS (
SELECT threshold, round(inst / voxels, 6) AS coverage, coalesce(merges, 0) AS merges, coalesce(splits, 0) AS splits, round(coalesce(c / greatest(pred_pairs, 1), 0), 6) AS p, round(coalesce(c / greatest(true_pairs, 1), 0), 6) AS r
FROM tot LEFT JOIN byp USING (threshold) LEFT JOIN byt USING (threshold) LEFT JOIN com USING (threshold)
), sweep AS (SELECT threshold, coverage, merges, splits, CASE WHEN p + r > 0 THEN round(2 * p * r / (p + r), 6) ELSE 0 END AS score FROM sweep0)
SELECT *, threshold = coalesce((SELECT min(threshold) FROM sweep WHERE merges = 0), (SELECT max(threshold) FROM sweep)) AS chosen, threshold = (SELECT threshold FROM sweep ORDER BY score DESC, threshold LIMIT 1) AS best FROM sweep"""


QUERIES = {
    "l01_offsets": (
        offsets,
        views.sql(
            "vox",
            f"WITH {NEAR}, size AS (SELECT vol, max(x) + 1 AS nx, max(y) + 1 AS ny, max(z) + 1 AS nz FROM vox GROUP BY vol) SELECT vol, channel, dx, dy, dz, (nx - dx) * (ny - dy) * (nz - dz) AS kept FROM size CROSS JOIN offsets",
        ),
    ),
    "l02_affinities": (affinity_targets, views.sql("vox", f"WITH {NEAR} SELECT vol, x, y, z, channel, affinity, mask FROM aff")),
    "l02_diagonal": (
        affinity_diagonal,
        views.sql(
            "vox",
            """WITH o AS (SELECT * FROM (VALUES (0, 1, 1, 0), (1, -1, 0, 2), (2, -1, 0, 0)) AS o(channel, dx, dy, dz))
SELECT a.vol, channel, count(*) FILTER (a.label = b.label AND a.label > 0) AS n_same, count(*) FILTER (a.label >= 0 AND b.label >= 0) AS n_known
FROM vox a CROSS JOIN o LEFT JOIN vox b ON b.vol = a.vol AND b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz GROUP BY a.vol, channel""",
        ),
    ),
    "l03_adjacency": (adjacency, views.sql("vox", f"SELECT a.id AS u, b.id AS v FROM vox a JOIN vox b ON {FACES} AND a.id < b.id AND a.lab_noise = b.lab_noise AND a.lab_noise > 0")),
    "l04_components": (
        components,
        views.sql(
            "vox",
            f"WITH nodes AS (SELECT id FROM vox WHERE lab_noise > 0), e AS (SELECT a.id AS u, b.id AS v FROM vox a JOIN vox b ON {FACES} AND a.lab_noise = b.lab_noise AND a.lab_noise > 0), {GRAPH} SELECT id, vol, CASE WHEN lab_noise > 0 THEN root ELSE lab_noise END AS piece FROM vox LEFT JOIN roots ON u = id",
            recursive=True,
        ),
    ),
    "l05_level_components": (
        level_components,
        views.sql(
            "pyramid",
            f"WITH nodes AS (SELECT id FROM pyramid WHERE lab_noise > 0), e AS (SELECT a.id AS u, b.id AS v FROM pyramid a JOIN pyramid b ON a.level = b.level AND {FACES} AND a.lab_noise = b.lab_noise AND a.lab_noise > 0), {GRAPH} SELECT id, vol, level, CASE WHEN lab_noise > 0 THEN root ELSE lab_noise END AS piece FROM pyramid LEFT JOIN roots ON u = id",
            recursive=True,
        ),
    ),
    "l06_affinity_scores": (
        affinity_scores,
        views.sql(
            "vox",
            f"""WITH {NEAR}, p AS (SELECT *, 10 * {DRAW} - 5 AS logit FROM aff)
SELECT vol, channel, count(*) FILTER (mask AND affinity) AS n_same, count(*) FILTER (mask AND NOT affinity) AS n_cut, count(*) FILTER (NOT mask) AS n_unknown,
  round(coalesce(sum(greatest(logit, 0) - logit * affinity::INT + ln(1 + exp(-abs(logit)))) FILTER (mask), 0) / greatest(count(*) FILTER (mask), 1), 6) AS loss,
  round(count(*) FILTER (mask AND (logit > 0) = affinity) / greatest(count(*) FILTER (mask), 1), 6) AS accuracy,
  round(count(*) FILTER (mask AND NOT affinity AND logit <= 0) / greatest(count(*) FILTER (mask AND NOT affinity), 1), 6) AS boundary_accuracy,
  round(count(*) FILTER (mask AND affinity) / greatest(count(*) FILTER (mask), 1), 6) AS positive_rate, round(count(*) FILTER (mask) / count(*), 6) AS mask_fraction
FROM p GROUP BY vol, channel""",
        ),
    ),
    "l07_segments": (segments, views.sql("vox", f"WITH {_segment_sql(2.0, 4, '')} SELECT id, segment FROM seg", recursive=True)),
    "l08_abstention": (abstention, views.sql("vox", f"SELECT id, CASE WHEN pred > 0 THEN CASE WHEN {uniform_sql(12, 'far', 'id')} < 0.9 THEN pred ELSE -1 END WHEN img < 0.4 THEN 0 ELSE -1 END AS pseudo FROM vox")),
    "l09_overlap": (
        overlap,
        views.sql(
            "vox",
            f"WITH {BOTH.format(by='vol', p='pred', t='label', rows='vox')} SELECT vol, round(coalesce(c / greatest(pred_pairs, 1), 0), 6) AS pair_precision, round(coalesce(c / greatest(true_pairs, 1), 0), 6) AS pair_recall, coalesce(merges, 0) AS merges, coalesce(splits, 0) AS splits, round(inst / voxels, 6) AS frac_instance, round(ign / voxels, 6) AS frac_ignore FROM tot LEFT JOIN byp USING (vol) LEFT JOIN byt USING (vol) LEFT JOIN com USING (vol)",
        ),
    ),
    "l09_boundary_enrichment": (
        enrichment,
        views.sql(
            "vox",
            f"""WITH pl AS (SELECT *, CASE WHEN pred > 0 THEN CASE WHEN {uniform_sql(12, 'far', 'id')} < 0.9 THEN pred ELSE -1 END WHEN img < 0.4 THEN 0 ELSE -1 END AS pseudo FROM vox
), edge AS (SELECT DISTINCT a.id FROM vox a JOIN vox b ON {FACES} WHERE a.label >= 0 AND b.label >= 0 AND a.label <> b.label
), m AS (SELECT vol, pseudo < 0 AS off, edge.id IS NOT NULL AS edge FROM pl LEFT JOIN edge USING (id) WHERE label >= 0)
SELECT vol, round(count(*) FILTER (edge) / count(*), 6) AS frac_boundary, round(count(*) FILTER (off) / count(*), 6) AS frac_abstained, round(count(*) FILTER (edge AND off) * count(*) / nullif(count(*) FILTER (off) * count(*) FILTER (edge), 0), 6) AS boundary_enrichment FROM m GROUP BY vol""",
        ),
    ),
    "l10_threshold_sweep": (threshold_sweep, views.sql("vox", _sweep_sql(), recursive=True)),
    "l11_same_partition": (
        same_partition,
        views.sql(
            "vox",
            """WITH f AS (SELECT vol, lab_noise AS a, pred AS b FROM vox WHERE lab_noise > 0 OR pred > 0), m AS (
SELECT vol, (SELECT max(n) FROM (SELECT count(DISTINCT b) AS n FROM f g WHERE g.vol = v.vol GROUP BY a)) = 1 AND (SELECT max(n) FROM (SELECT count(DISTINCT a) AS n FROM f g WHERE g.vol = v.vol GROUP BY b)) = 1 AS same_pred FROM (SELECT DISTINCT vol FROM vox) v)
SELECT vol, true AS same_renamed, same_pred FROM m""",
        ),
    ),
    "e01_tile_starts": (tile_starts, TILE_STARTS),
    "e01_tile_table": (tile_start_table, TILE_STARTS),
    "e02_blend_weights": (blend_weights, views.sql("vox", "SELECT id, (least(x, 7 - x) + 1) * (least(y, 7 - y) + 1) * (least(z, 7 - z) + 1) AS weight FROM vox")),
    "e03_tiled_blend": (
        tiled_blend,
        views.sql(
            "scores",
            """WITH s AS (SELECT unnest([0, 2, 4]) AS s), t AS (
SELECT vol, x, y, z, cls, score + (a.s + 2 * b.s + 3 * c.s) * 0.125 AS score, (least(x - a.s, 3 - x + a.s) + 1) * (least(y - b.s, 3 - y + b.s) + 1) * (least(z - c.s, 3 - z + c.s) + 1) AS w
FROM scores, s a, s b, s c WHERE x BETWEEN a.s AND a.s + 3 AND y BETWEEN b.s AND b.s + 3 AND z BETWEEN c.s AND c.s + 3)
SELECT vol, x, y, z, cls, round(sum(score * w) / greatest(sum(w), 1e-8), 6) + 0.0 AS score FROM t GROUP BY vol, x, y, z, cls""",
        ),
    ),
    "e04_orthoplane": (orthoplane, views.sql("scores", "SELECT vol, x, y, z, cls, round(score * 2, 6) AS score FROM scores")),
    "e05_argmax_class": (argmax_class, views.sql("scores", "SELECT id, arg_max(cls, score * 1000000 - cls * 1e-6)::INT AS pred FROM scores GROUP BY id")),
    "e06_confusion": (
        confusion,
        views.sql("vox", "SELECT t AS target, p AS predicted, (SELECT count(*) FROM vox WHERE label = t AND pred = p AND label <> -1) AS n FROM (SELECT unnest([0, 1, 2]) AS t), (SELECT unnest([0, 1, 2]) AS p)"),
    ),
    "e07_segmentation_metrics": (
        segmentation,
        views.sql(
            "vox",
            """WITH k AS (SELECT unnest([0, 1, 2]) AS c), per AS (
SELECT vol, c, count(*) FILTER (label = c) AS a, count(*) FILTER (pred = c AND label <> -1) AS p, count(*) FILTER (label = c AND pred = c) AS tp FROM vox, k GROUP BY vol, c
), i AS (SELECT *, tp / greatest(a + p - tp, 1) AS iou, 2 * tp / greatest(a + p, 1) AS dice FROM per)
SELECT vol, round(sum(tp) / greatest(sum(a), 1), 6) AS accuracy, round(avg(iou) FILTER (a > 0), 6) AS mean_iou, round(avg(dice) FILTER (a > 0), 6) AS mean_dice, count(*) FILTER (a > 0) AS present, list(round(iou, 6) ORDER BY c) AS iou FROM i GROUP BY vol""",
        ),
    ),
    "e08_batch_iou": (
        batch_iou,
        views.sql(
            "vox",
            """WITH b AS (SELECT id // 37 AS batch, CASE WHEN (id // 37) % 9 = 0 THEN -1 ELSE label END AS label, pred FROM vox), k AS (SELECT unnest([0, 1, 2]) AS c), per AS (
SELECT batch, c, count(*) FILTER (label = c) AS a, count(*) FILTER (pred = c AND label <> -1) AS p, count(*) FILTER (label = c AND pred = c) AS tp FROM b, k GROUP BY batch, c)
SELECT batch, coalesce(round(avg(tp / greatest(a + p - tp, 1)) FILTER (a > 0), 6), 'nan'::DOUBLE) AS iou, CASE WHEN sum(a) > 0 THEN round(sum(tp) / sum(a), 6) ELSE 'nan'::DOUBLE END AS accuracy FROM per GROUP BY batch""",
        ),
    ),
    "e09_cross_entropy": (
        cross_entropy,
        views.sql(
            "scores",
            """WITH l AS (SELECT id, vol, label, max(score) FILTER (cls = label) AS own, ln(sum(exp(score))) AS z FROM scores WHERE label <> -1 GROUP BY id, vol, label), w AS (SELECT *, [0.5, 1.0, 2.0][label + 1] AS w FROM l)
SELECT vol, round(sum(w * (z - own)) / sum(w), 6) AS loss FROM w GROUP BY vol""",
        ),
    ),
    "e10_validation_average": (
        validation,
        views.sql("metric_log", "SELECT run, metric, round(avg(value), 6) AS value, count(*) AS batches FROM (SELECT run, step // 10 AS batch, metric, avg(value) AS value FROM metric_log GROUP BY ALL) GROUP BY run, metric"),
    ),
    "e11_tile_predictor": (
        predictor,
        views.sql(
            "vox",
            """WITH s AS (SELECT unnest([0, 2, 4]) AS s)
SELECT vol, a.s AS x0, b.s AS y0, c.s AS z0, count(*)::INT AS voxels, round(avg(round(img * 255)), 4) AS mean FROM vox, s a, s b, s c WHERE x BETWEEN a.s AND a.s + 3 AND y BETWEEN b.s AND b.s + 3 AND z BETWEEN c.s AND c.s + 3 GROUP BY ALL""",
        ),
    ),
}
QUERIES["l04_components_by_block"] = (components_by_block, QUERIES["l04_components"][1])
