"""Paths and small files, by Hadoop's file systems: a path that only Spark can reach works too."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..errors import ConfigError


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, or anything that the pattern stands for, is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def load_config(spark: SparkSession, path: str | None, strict: bool = False) -> dict:
    """A JSON object; unless ``strict``, nothing or nonsense there is an empty one."""
    if path is None:
        return {}
    try:
        if not exists(spark, path):
            raise ConfigError(f"no configuration at {path}")
        found = json.loads(spark.read.text(path, wholetext=True).first()[0])
        if not isinstance(found, dict):
            raise ConfigError(f"{path} holds no JSON object")
        return found
    except (ConfigError, ValueError, TypeError) as e:
        if strict:
            raise e if isinstance(e, ConfigError) else ConfigError(f"{path}: {e}") from e
        return {}


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares; without one in its warehouse, or locally in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local"):
        base = tempfile.mkdtemp(prefix="fusewright-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{(base or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Removes a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
