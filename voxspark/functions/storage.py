"""Shared storage: the folder that every executor of a cluster can reach.

Loops cut their lineage with ``checkpoint()`` and multi-pass operators keep
intermediate tables as Parquet.  Both go to the folder named by the session's
``spark.checkpoint.dir``; only where that is unset on a local master (tests,
notebooks on one machine) a temporary folder is chosen.
"""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """Return the shared folder of this session, setting one if it has none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="voxspark-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """Return a path below the shared folder that nothing has used yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to shared Parquet and return the table read back.

    Unlike ``cache()`` the rows survive the loss of every executor, and later
    passes scan only the columns they use.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder made by :func:`new_path` (a no-op if it is gone)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`stored` that nothing reads any more."""
    for table in tables:
        path = _PATHS.pop(table)
        drop_path(table.sparkSession, path)
        _MADE.remove(path)


def clean(spark: SparkSession) -> int:
    """Delete all intermediate tables of this program; results that still read them must be written first."""
    n = len(_MADE)
    while _MADE:
        drop_path(spark, _MADE.pop())
    return n
