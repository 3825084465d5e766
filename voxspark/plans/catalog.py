"""All queries of the grid operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxspark.plans import curation, grids, learning, runs, vectors

MODULES = [grids, curation, runs, learning, vectors]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are same-object, cut or unknown in each volume and channel, and how good the logits are."""
    return grids.affinity_scores(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name -> query over the tables in a folder."""
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
