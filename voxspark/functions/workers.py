"""Python workers: the package on any cluster, calls over many small groups, caches."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LEAST_ROWS = 1 << 16  # of a call that small groups share
MOST_ROWS = 1 << 16  # of a batch that goes back

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="voxspark-"), "voxspark_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(top, "voxspark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def group_numbers(table: pa.Table, keys: list[str]) -> np.ndarray:
    """The number of each row's group, from 0; rows of a group are next to each other."""
    new = np.zeros(table.num_rows, dtype=bool)
    for key in keys:
        codes = pc.dictionary_encode(table[key].chunk(0), null_encoding="encode").indices.to_numpy()
        new[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = LEAST_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, of about ``least`` rows or one larger group, with the number of each row's group."""
    held: list[pa.Table] = []
    rows, wanted = 0, least
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= wanted:
            table = pa.concat_tables(held).combine_chunks()
            number = group_numbers(table, keys)
            end = int(np.searchsorted(number, number[-1]))  # the last group may go on
            if end:
                yield table.slice(0, end).combine_chunks(), number[:end]
            held, rows = [table.slice(end)], rows - end
            wanted = max(least, 2 * rows)
    if rows:
        table = pa.concat_tables(held).combine_chunks()
        yield table, group_numbers(table, keys)


def map_groups(rows: DataFrame, keys: list[str], run: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: str | T.StructType) -> DataFrame:
    """``applyInArrow`` for groups that may be small: a call of ``run`` takes many whole groups and their rows' numbers."""
    ship(rows.sparkSession)

    def calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole_groups(batches, keys):
            for out in run(table, number):
                yield from out.to_batches(max_chunksize=MOST_ROWS)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(calls, schema)


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, release: Callable[[], None]) -> None:
    """Called by a task that keeps a cache in its worker: the caches of other operators go.

    Workers outlive tasks and stages, so what one operator kept would take
    memory from the next.
    """
    for other in [n for n in _HELD if n != name]:
        _HELD.pop(other)()
    _HELD[name] = release
