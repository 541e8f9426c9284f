import os

import pytest
from pyspark.sql import functions as F

from fusewright.errors import SinkError
from fusewright.plans.sinks import manifest, publish, published


def test_all_or_nothing(spark, tmp_path):
    """A task that fails leaves the old outputs whole and nothing of its own."""
    path = f"{tmp_path}/out"
    assert manifest(spark, path) is None
    with pytest.raises(SinkError):
        published(spark, path, "a")
    one = spark.range(5).select("id", F.lit("x").alias("v"))
    publish({"a": one, "b.json": one.limit(0)}, path)
    first = manifest(spark, path)
    assert {k: x["rows"] for k, x in first["outputs"].items()} == {"a": 5, "b.json": 0} and first["before"] is None
    broken = one.repartition(4).withColumn("v", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise("y"))
    for outputs in ({"a": broken, "b.json": one}, {"a": one.withColumn("v", F.lit("y")), "b.json": broken}):
        with pytest.raises(SinkError):
            publish(outputs, path)
        assert manifest(spark, path) == first and os.listdir(f"{path}/versions") == [first["version"]]
        assert sorted(map(tuple, published(spark, path, "a").collect())) == [(i, "x") for i in range(5)]


def test_versions(spark, tmp_path):
    """The version before stays for those who read it; older ones go."""
    seen = []
    for n in range(1, 5):
        seen.append(publish({"a": spark.range(n)}, str(tmp_path))["version"])
        assert published(spark, str(tmp_path), "a", "id long").count() == n
    assert set(os.listdir(f"{tmp_path}/versions")) == set(seen[-2:]) and manifest(spark, str(tmp_path))["before"] == seen[-2]
