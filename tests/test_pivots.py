"""Pivot search against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxspark.operators import pivots, representation


def table(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "key long, vec array<double>").repartition(3)


def unit(vectors):
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def best_dots(vectors):
    dots = unit(vectors) @ unit(vectors).T
    np.fill_diagonal(dots, -np.inf)
    return dots


def clusters(seed, n, k, size=16, noise=0.02):
    draw = np.random.default_rng(seed)
    return draw.normal(size=(k, size))[draw.integers(0, k, n)] + noise * draw.normal(size=(n, size))


def found(spark, vectors, **options):
    return representation.nearest_neighbours(table(spark, vectors), "key", "vec", **options).collect()


@pytest.mark.parametrize("kind", ["clustered", "even", "odd"])
def test_exact_by_brute_force(spark, kind):
    draw = np.random.default_rng(4)
    vectors = {"clustered": clusters(1, 300, 12), "even": draw.normal(size=(200, 8)), "odd": np.concatenate([np.tile(draw.normal(size=(1, 6)), (120, 1)), np.zeros((7, 6)), draw.normal(size=(60, 6)), np.eye(6)])}[kind]
    dots, rows = best_dots(vectors), found(spark, vectors, block_rows=25)
    assert sorted(r.key for r in rows) == list(range(len(vectors)))
    for r in rows:
        assert r.dot == pytest.approx(dots[r.key].max(), abs=1e-9) and dots[r.key, r.neighbour] == pytest.approx(r.dot, abs=1e-9)
        if kind != "odd":
            assert r.neighbour == dots[r.key].argmax()


def test_few_rows(spark):
    assert found(spark, np.ones((1, 4))) == [] and found(spark, np.zeros((0, 4))) == []
    assert {(r.key, r.neighbour) for r in found(spark, np.array([[1.0, 0], [0, 0]]))} == {(0, 1), (1, 0)}
    assert found(spark, np.zeros((3, 4)))[0].dot == 0.0


def test_blocks_are_skipped_and_a_crowd_is_cut(spark):
    """On clustered rows few pairs of blocks are visited, a smaller share at a larger size; no block is larger than asked."""
    shares = []
    for n in (400, 1600):
        units = table(spark, clusters(2, n, n // 20)).withColumn("vec", representation.normalised(F.col("vec")))
        out = pivots.search(units, 20)
        assert out.found.count() == n
        shares.append(out.visited / out.blocks**2)
    assert shares[0] < 0.3 and shares[1] < 0.8 * shares[0]
    crowd = table(spark, np.concatenate([clusters(3, 50, 5), np.ones((100, 16))])).withColumn("vec", representation.normalised(F.col("vec")))
    assert pivots.partition(crowd, 30).rows.groupBy("block").count().agg(F.max("count")).first()[0] <= 30


def test_recall_of_probes(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", F.expr("transform(embedding, v -> cast(v as double))").alias("vec"))
    for vectors, probes in ((np.stack(rows.orderBy("vec_id").toPandas()["vec"]), 6), (clusters(6, 600, 40), 3)):
        best = best_dots(vectors).argmax(axis=1)
        near = {r.key: r.neighbour for r in representation.approximate_neighbours(table(spark, vectors), "key", "vec", 128, probes).collect()}
        assert np.mean([near[k] == best[k] for k in range(len(vectors))]) >= 0.9


def test_rows_are_sent_once_a_tile_and_askers_are_dealt(spark, monkeypatch):
    """Few tiles of many blocks, and blocks that more rows ask than one task answers, give the same."""
    monkeypatch.setattr(pivots, "TILES", 3)
    monkeypatch.setattr(pivots, "ASKERS", 40)
    vectors = np.random.default_rng(8).normal(size=(240, 6))
    best = best_dots(vectors).argmax(axis=1)
    assert {r.key: r.neighbour for r in found(spark, vectors, block_rows=20)} == dict(enumerate(best))
    asked = pivots.search(table(spark, vectors).withColumn("vec", representation.normalised(F.col("vec"))), 20, 1000)
    assert {r.key: r.neighbour for r in asked.found.collect()} == dict(enumerate(best))
