"""Profiles kept up to date by state: every entity's best record of each source lives in the state store.

A batch reads and writes the state of the entities it touches, and fuses those whose records changed: its work follows the batch, not the
history.  Of a source's records the one of the latest event time counts, then of the least ``seq``, so a record that comes late, but before the
watermark, changes nothing unless it is the newest.  Later ones go.  A timer at the end of the delay marks an entity as settled: no record can change it any
more without being newer.  Every batch replaces its own folder, so one that runs again after a failure leaves the same profiles.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..pipeline import fuse
from ..schema import SOURCE_RECORD
from ..sources.files import exists

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "fusion_id string, record string, settled boolean"
BEST = "at long, seq long, record string"


class BestRecords(StatefulProcessor):
    """Best record of each source; gives all of an entity's when one of them changes, and once more when it settles."""

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getMapState("best", "source string", BEST)
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest: dict[str, tuple] = {}
        for r in rows:
            here = (r.at, -(r.seq or 0), r.record)
            if r.source not in newest or here > newest[r.source]:
                newest[r.source] = here
        changed = False
        for source, (at, minus, record) in newest.items():
            if self.best.containsKey((source,)):
                held = self.best.getValue((source,))
                if (held[0], -held[1], held[2]) >= (at, minus, record):
                    continue
            self.best.updateValue((source,), (at, -minus, record))
            changed = True
        if changed:
            due = max(at for at, _, _ in newest.values()) + self.delay
            old = self.due.get()[0] if self.due.exists() else None
            if old is None or due > old:
                if old is not None:
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(due)
                self.due.update((due,))
            yield from self._all(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()
        yield from self._all(key, True)

    def _all(self, key, settled: bool) -> Iterator[Row]:
        for value in list(self.best.values()):
            yield Row(fusion_id=key[0], record=value[2], settled=settled)

    def close(self) -> None:
        pass


def best_records(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(fusion_id, record, settled) of changed or settled entities, from a stream of source records with ``event_time``."""
    spark = records.sparkSession
    columns = [f.name for f in spark.createDataFrame([], SOURCE_RECORD).schema]
    ms = int(spark.sql(f"SELECT unix_millis(timestamp '1970-01-01 00:00:00 UTC' + interval {delay})").first()[0])
    rows = records.where(F.col("fusion_id").isNotNull() & F.col("source").isNotNull()).withWatermark("event_time", delay)
    told = rows.select("event_time", "fusion_id", "source", F.unix_millis("event_time").alias("at"), F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), F.to_json(F.struct(*columns)).alias("record"))
    return told.groupBy("fusion_id").transformWithState(BestRecords(ms), OUT, "Update", "EventTime")


def _write(batch: DataFrame, number: int, base: str) -> None:
    """The profiles of a batch's entities, settled or not."""
    held = batch.withColumn("r", F.from_json("record", SOURCE_RECORD)).persist()  # read twice
    settled = held.groupBy("fusion_id").agg(F.bool_and("settled").alias("settled"))
    # an entity that changed and settled in one batch comes twice with the same records
    fused = fuse(held.select("r.*").distinct())
    fused.join(settled, "fusion_id").write.mode("overwrite").parquet(f"{base}/profiles/batch={number}")
    held.unpersist()


def keep_fused(records: DataFrame, base: str, delay: str = "1 hour", **trigger):
    """Starts the query that keeps ``base`` up to date from a stream of source records with ``event_time``."""
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return (
        best_records(records, delay).writeStream.foreachBatch(lambda df, n: _write(df, n, base)).outputMode("update")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    )


def current(spark: SparkSession, base: str) -> DataFrame:
    """The newest profile of every entity, and whether it is settled."""
    if not exists(spark, f"{base}/profiles"):
        raise FileNotFoundError(f"{base}/profiles")
    stored = spark.read.parquet(f"{base}/profiles")
    whole = F.struct(*(c for c in stored.columns if c not in ("fusion_id", "batch")))
    return stored.groupBy("fusion_id").agg(F.max_by(whole, "batch").alias("p")).select("fusion_id", "p.*")
