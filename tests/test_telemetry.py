"""Configurations as they are."""

import json

from pyspark.sql import functions as F

from voxspark.operators import telemetry


def leaves(spark, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "run long, config string")
    return {(r.run, r.path): (r.value, r.kind) for r in telemetry.flatten(rows, "config", "run", **options).collect()}


def test_nothing_is_lost(spark):
    found = leaves(spark, '{"a":{},"b":null,"c":[1,{"x":2}],"d":"{not json"}', "{broken", None, "[1, 2]", "{}", '{"a.b": 1, "a": {"b": 2}, "é": {"": "x"}}')
    assert found == {
        (0, "a"): ("{}", "object"), (0, "b"): (None, "null"), (0, "c"): ('[1,{"x":2}]', "array"), (0, "d"): ("{not json", "string"),
        (1, ""): ("{broken", "invalid"), (3, ""): ("[1,2]", "array"), (5, "a.b"): ("2", "number"), (5, "é."): ("x", "string"),
    }
    assert (0, "a") not in leaves(spark, '{"a":{}}', empty=False)


def test_any_depth(spark):
    value = {"end": True}
    for _ in range(300):
        value = {"k": value}
    assert leaves(spark, json.dumps(value)) == {(0, "k." * 300 + "end"): ("true", "boolean")}


def test_differences_know_the_kinds(spark):
    rows = spark.createDataFrame([(1, '{"a":1,"b":"1","c":null,"model":{"d":1},"e":true}', '{"a":1.0,"b":1,"model":{"d":2},"e":true,"f":null}')], "run long, old string, new string")
    old, new = (telemetry.flatten(rows, c, "run") for c in ("old", "new"))
    out = {r.path: (r.old, r.new, r.incompatible) for r in telemetry.config_diff(old, new, "run").collect()}
    assert out == {"b": ("1", "1", False), "model.d": ("1", "2", True)}
    assert telemetry.flatten(rows.where(F.lit(False)), "old", "run").collect() == []
