"""JSON output: one pretty file for one entity, folders of JSON lines for many, published together by one manifest."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import SinkError
from ..sources.files import drop, exists

MANIFEST = "manifest.json"


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text with its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lines(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any of Hadoop's file systems; folders are made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
        out.write(bytearray(text.encode()))
        out.close()
    except Exception as e:
        raise SinkError(f"cannot write {path}: {e}") from e


def pretty(df: DataFrame, indent: int = 2, ensure_ascii: bool = False) -> str:
    """The first row as indented JSON."""
    row = as_json(df).first()
    return json.dumps(json.loads(row[0]) if row else {}, indent=indent, ensure_ascii=ensure_ascii)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    """Puts a file in another's place in one step."""
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jvm.org.apache.hadoop.fs.Path(new).toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    files.rename(files.makeQualified(jvm.org.apache.hadoop.fs.Path(old)), files.makeQualified(jvm.org.apache.hadoop.fs.Path(new)), options)


def manifest(spark: SparkSession, path: str) -> dict | None:
    """What is published at a path, {version, before, outputs: {name: {path, rows}}}; None for nothing."""
    if not exists(spark, f"{path.rstrip('/')}/{MANIFEST}"):
        return None
    return json.loads(spark.read.text(f"{path.rstrip('/')}/{MANIFEST}", wholetext=True).first()[0])


def publish(outputs: dict[str, DataFrame], path: str) -> dict:
    """Writes all outputs as JSON lines into a folder of their own, then the manifest that names them; returns it.

    Readers see all of them or what was there before: the manifest is put in place by one rename once every
    output is committed.  If a job fails, its folder goes and the old outputs stay whole.  The version before
    stays until the next one, for readers that hold it; older ones go.  One writer a path.
    """
    spark = next(iter(outputs.values())).sparkSession
    base, version = path.rstrip("/"), uuid.uuid4().hex
    folder = f"{base}/versions/{version}"
    old, told = manifest(spark, base), {}
    try:
        for name, df in outputs.items():
            seen = Observation(f"{name} {version}")
            as_json(df).observe(seen, F.count(F.lit(1)).alias("rows")).write.text(f"{folder}/{name}")
            told[name] = {"path": f"versions/{version}/{name}", "rows": seen.get["rows"]}
    except Exception as e:
        drop(spark, folder)
        raise SinkError(f"nothing published at {path}: {str(e).splitlines()[0]}") from e
    new = {"version": version, "before": old and old["version"], "outputs": told}
    write_text(spark, f"{folder}/{MANIFEST}", json.dumps(new))
    _rename(spark, f"{folder}/{MANIFEST}", f"{base}/{MANIFEST}")
    if old and old["before"]:
        drop(spark, f"{base}/versions/{old['before']}")
    return new


def published(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """An output of the version that the manifest names."""
    found = manifest(spark, path)
    if not found or name not in found["outputs"]:
        raise SinkError(f"no {name} published at {path}")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(f"{path.rstrip('/')}/{found['outputs'][name]['path']}")
