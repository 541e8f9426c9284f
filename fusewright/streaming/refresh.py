"""Profiles kept up to date from a stream of source records.

Each micro-batch is stored once, under its number and in buckets of entities, and only entities it touches are fused again: of the
history only their buckets are read.  Both writes replace the batch's own folder, so a batch that is run again after a
failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..pipeline import fuse
from ..sources.files import exists

_SPAN = 1 << 40  # more rows than a batch has
BUCKETS = 256


def refuse_touched(batch: DataFrame, number: int, base: str) -> None:
    """Stores a batch of source records and the new profiles of its entities.  A source's newest record counts."""
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("fusion_id"), F.lit(BUCKETS)).cast("int")
    newest_first = batch.where(F.col("fusion_id").isNotNull()).withColumn("seq", F.coalesce("seq", F.lit(0)) - F.lit(number) * F.lit(_SPAN))
    newest_first.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/records/batch={number}")
    schema = StructType([*newest_first.schema.fields, StructField("batch", LongType()), StructField("bucket", IntegerType())])
    stored = spark.read.schema(schema).parquet(f"{base}/records")
    mine = stored.where(F.col("batch") == number)
    buckets = [r[0] for r in mine.select("bucket").distinct().collect()]  # BUCKETS at most; they prune the folders that are read
    touched = mine.select("fusion_id").distinct()
    history = stored.where(F.col("bucket").isin(buckets) & (F.col("batch") <= number))
    fuse(history.join(touched, "fusion_id", "left_semi").select(newest_first.columns)).write.mode("overwrite").parquet(f"{base}/profiles/batch={number}")


def refresh(records: DataFrame, base: str, **trigger):
    """Starts the query that keeps ``base`` up to date; ``trigger`` as for ``DataStreamWriter.trigger``."""
    return records.writeStream.foreachBatch(lambda df, n: refuse_touched(df, n, base)).option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, base: str) -> DataFrame:
    """The newest profile of every entity."""
    if not exists(spark, f"{base}/profiles"):
        raise FileNotFoundError(f"{base}/profiles")
    stored = spark.read.parquet(f"{base}/profiles")
    whole = F.struct(*(c for c in stored.columns if c not in ("fusion_id", "batch")))
    return stored.groupBy("fusion_id").agg(F.max_by(whole, "batch").alias("p")).select("fusion_id", "p.*")
