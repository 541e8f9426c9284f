"""Questions of blocks to hash shards, and the answers.

A block sends each shard that concerns it one message about its distinct items; a shard merges the messages,
resolves them and answers every block in the order of its message.  A message holds one item at least, so
the work follows the items, not blocks times shards.  Where more than ``fan`` blocks could speak to
one shard, teams of blocks merge first (and teams of teams): an item that every block holds reaches
its shard once for each team, so no group grows with the corpus.

What is said depends on a protocol of six functions: ``unpack(bytes)`` and ``pack(message)``; ``merge(messages)``
gives one message and, for each given one, the places of its items there; ``resolve(message)`` gives the
answers and a note for the driver or None; ``pick(answers, places, message)`` the bytes of one message's answers; and
``read(bytes, message)`` the answers again.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors as A
from .common import groupwise, rows_of, store

SENT = pa.schema([("shard", pa.int64()), ("block_id", pa.int64()), ("data", pa.binary())])
SENT_SQL = "shard long, block_id long, data binary"
FAN = 1 << 16
SHARDS_EACH = 4
NOTE = -1  # block_id of notes


def _messages(protocol, table: pa.Table):
    return [protocol.unpack(x.as_py()) for x in table.column("data")]


def _merge(protocol):
    def run(key, table):
        merged, _ = protocol.merge(_messages(protocol, table))
        return pa.table([[key[0].as_py()], [key[1].as_py()], [protocol.pack(merged)]], schema=SENT)

    return run


def _resolve(protocol):
    def run(table: pa.Table) -> pa.Table:
        said = _messages(protocol, table)
        merged, places = protocol.merge(said)
        answers, note = protocol.resolve(merged)
        shard, block = table.column("shard").to_pylist(), table.column("block_id").to_pylist()
        data = [protocol.pick(answers, p, m) for p, m in zip(places, said)]
        if note is not None:
            shard, block, data = [*shard, shard[0]], [*block, NOTE], [*data, note]
        return pa.table([shard, block, data], schema=SENT)

    return run


def _split(protocol):
    def run(table, told):
        said = _messages(protocol, table)
        merged, places = protocol.merge(said)
        answers = protocol.read(told.column("data")[0].as_py(), merged)
        return pa.table([table.column("shard"), table.column("block_id"), pa.array([protocol.pick(answers, p, m) for p, m in zip(places, said)], pa.binary())], schema=SENT)

    return run


def ask(sent: DataFrame, blocks: int, shards: int, protocol, fan: int = FAN) -> DataFrame:
    """Answers (shard, block_id, data) to messages (shard, block_id, data) of so many blocks to so many shards."""
    if fan < 2:
        raise ValueError("a team has two blocks at least")
    if blocks <= fan:
        # tasks of a few shards each, so that the largest task does not grow with the input
        return sent.repartition(-(-shards // SHARDS_EACH), "shard").groupBy("shard").applyInArrow(groupwise(_resolve(protocol)), SENT_SQL)
    teams = -(-blocks // fan)
    held = store(sent, "sent").withColumn("team", F.pmod(F.xxhash64("block_id"), F.lit(teams)))
    merged = held.groupBy("shard", "team").applyInArrow(_merge(protocol), SENT_SQL)
    told = store(ask(merged, teams, shards, protocol, fan), "told")
    own = told.where(F.col("block_id") >= 0).withColumnRenamed("block_id", "team")
    back = held.groupBy("shard", "team").cogroup(own.groupBy("shard", "team")).applyInArrow(_split(protocol), SENT_SQL)
    return back.unionByName(told.where(F.col("block_id") == NOTE))


def by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block_id").agg(F.collect_list(F.struct("shard", "data")).alias(name))


def messages(block_id: int, shard, begin, end, pack) -> pa.RecordBatch:
    """One row for each shard: ``pack(a, b)`` of the items from a to b."""
    return rows_of(SENT, [pa.array(shard, pa.int64()), [block_id] * len(shard), [pack(a, b) for a, b in zip(begin.tolist(), end.tolist())]])


def by_shard(hashes, shards: int):
    """(shard, begin, end) of the stretches of sorted hashes."""
    return A.slices(A.shard_of(hashes, shards))
