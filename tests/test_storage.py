"""Intermediate tables live in the shared folder until they are dropped or cleaned."""

import os
from types import SimpleNamespace

import pytest

from voxspark.functions import storage


def test_stored_and_cleaned(spark):
    df = storage.stored(spark.range(5), "five")
    assert df.count() == 5 and storage.shared_dir(spark).startswith("file:")
    path = storage.new_path(spark, "none")
    assert path.startswith(storage.shared_dir(spark)) and storage.clean(spark) >= 2 and storage._MADE == []


def test_dropped(spark):
    one, two = storage.stored(spark.range(5), "one"), storage.stored(spark.range(6), "two")
    path = storage._PATHS[one].removeprefix("file://")
    storage.drop(one)
    assert not os.path.exists(path) and two.count() == 6


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=context))
