"""Shared pieces: scratch tables in the cluster's shared folder, packed blocks of documents, components.

Scratch tables live under ``spark.checkpoint.dir``, so they survive the loss of any executor; the setting is
read from the session.  A session without it uses its warehouse, or in local mode a temporary folder.

Columns are found by their exact name and travel by position, so other columns may have any names, also
dotted, repeated or different in case only.
"""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

BLOCK_BYTES = 4 << 20  # text in a block, unless a single document is longer
BLOCK_DOCS = 1 << 16  # and rows in it; a row of a block is numbered block_id * BLOCK_DOCS + its place
NULL_ID = np.iinfo(np.int64).max  # stands for a null doc_id inside blocks: later than every real id
LET_GO = 5.0
BLOCK_SCHEMA = "block_id long, n_docs long, n_bytes long, ids binary, sizes binary, body binary"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local"):
            base = tempfile.mkdtemp(prefix="fusewright-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def picked(df: DataFrame, **types: str) -> DataFrame:
    """The named columns only, cast to their types; of several columns that match a name the exact one, else the first."""
    flat, out = df.toDF(*(f"c{i}" for i in range(len(df.columns)))), []
    for name, kind in types.items():
        at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name]
        if not at:
            raise ValueError(f"the table has no column {name}")
        out.append(F.col(f"c{at[0]}").cast(kind).alias(name))
    return flat.select(*out)


def store(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and returns the reread table (lineage is cut)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _let_go_now_and_then(spark)
    return out


_last = [0.0]


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage: Spark then removes the shuffle files of plans that nothing refers to any more."""
    spark._jvm.System.gc()
    _last[0] = time.monotonic()


def _let_go_now_and_then(spark: SparkSession) -> None:
    if time.monotonic() - _last[0] > LET_GO:
        let_go(spark)


def discard(df: DataFrame) -> None:
    """Removes a table made by ``store`` which no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Gives freed memory back to the system: workers live on from stage to stage and would keep their peak."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def batchwise(run):
    """``run`` for mapInArrow, with memory released after every batch it gives and at the end."""

    def released(batches):
        for out in run(batches):
            yield out
            del out
            release()
        release()

    return released


def groupwise(run):
    """``run`` for applyInArrow, with memory released after every group."""

    def released(table: pa.Table) -> pa.Table:
        out = run(table)
        release()
        return out

    return released


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def utf8_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, sizes, is_null) of a string column; null texts have size 0."""
    wide = texts.cast(pa.large_string())
    null = np.asarray(wide.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    filled = wide.fill_null("") if null.any() else wide
    ends = np.frombuffer(filled.buffers()[1], dtype=np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = filled.buffers()[2]
    body = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return body, np.diff(ends), null


def id_array(ids: pa.Array) -> np.ndarray:
    return ids.cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def id_column(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, type=pa.int64(), mask=ids == NULL_ID)


class Block:
    """Documents of one block: ``ids``, byte ``sizes``, ``starts`` and the concatenated UTF-8 ``body``."""

    def __init__(self, block_id: int, ids: np.ndarray, sizes: np.ndarray, body: bytes):
        self.block_id, self.ids, self.sizes, self.body = block_id, ids, sizes, body
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.bytes = np.frombuffer(body, dtype=np.uint8)
        self.rest: pa.Table | None = None

    def __len__(self) -> int:
        return len(self.ids)


def _pack(carry: bool):
    """carry: the batch's other columns go along, in Arrow's stream format, under ``rest``."""

    def run(batches):
        from pyspark import TaskContext

        base, seq = TaskContext.get().partitionId() << 20, 0  # a million blocks a partition, 2^27 partitions
        held: list[tuple] = []
        room = n_held = 0

        def emit():
            nonlocal held, room, n_held, seq
            ids, sizes, body = (np.concatenate([h[k] for h in held]) for k in range(3))
            row = {"block_id": base + seq, "n_docs": len(ids), "n_bytes": len(body), "ids": ids.tobytes(), "sizes": sizes.astype(np.int64).tobytes(), "body": squeeze(body.tobytes())}
            if carry:
                table = pa.Table.from_batches([h[3] for h in held])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.combine_chunks())
                row["rest"] = squeeze(sink.getvalue().to_pybytes())
            held, room, n_held, seq = [], 0, 0, seq + 1
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([(k, pa.binary() if isinstance(v, bytes) else pa.int64()) for k, v in row.items()]))

        for batch in batches:
            ids = id_array(batch.column(0))
            body, sizes, _ = utf8_parts(batch.column(1))
            rest = batch.select(range(2, batch.num_columns)) if carry else None
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                begun = ends[at] - sizes[at]
                to = min(at + BLOCK_DOCS - n_held, max(at + 1, int(np.searchsorted(ends, begun + BLOCK_BYTES - room, side="right"))))
                if room and ends[to - 1] - begun + room > BLOCK_BYTES:  # the next document alone does not fit
                    yield emit()
                    continue
                held.append((ids[at:to], sizes[at:to], body[begun : ends[to - 1]], carry and rest.slice(at, to - at)))
                room += int(ends[to - 1] - begun)
                n_held += to - at
                at = to
                if room >= BLOCK_BYTES or n_held >= BLOCK_DOCS or at < len(ids):
                    yield emit()
        if held:
            yield emit()

    return run


def pack_blocks(docs: DataFrame) -> DataFrame:
    """Documents as stored rows of about 4 MB of text each, compressed; a block keeps its id for good."""
    return store(picked(docs, doc_id="long", text="string").mapInArrow(batchwise(_pack(False)), BLOCK_SCHEMA), "blocks")


def open_blocks(batch: pa.RecordBatch | pa.Table):
    """Yields (row number, Block) of a batch, one decompressed at a time."""
    for i in range(batch.num_rows):
        ids = np.frombuffer(batch.column("ids")[i].as_py(), dtype=np.int64)
        sizes = np.frombuffer(batch.column("sizes")[i].as_py(), dtype=np.int64)
        block = Block(batch.column("block_id")[i].as_py(), ids, sizes, unsqueeze(batch.column("body")[i].as_py()))
        if "rest" in batch.schema.names:
            block.rest = pa.ipc.open_stream(unsqueeze(batch.column("rest")[i].as_py())).read_all()
        yield i, block


def pack_rows(docs: DataFrame) -> DataFrame:
    """``pack_blocks`` with all columns (the others by position, in ``Block.rest``), for ``block_rows``."""
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = docs.columns.index
    rest = [F.col(f"c{i}").cast("long").alias(f"c{i}") if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(docs.columns) if i not in (at("doc_id"), at("text"))]
    text = F.col(f"c{at('text')}").cast("string")
    plain = flat.select(F.col(f"c{at('doc_id')}").cast("long").alias("doc_id"), text.alias("text"), *rest, text.isNull().alias("null"))
    return store(plain.mapInArrow(batchwise(_pack(True)), BLOCK_SCHEMA + ", rest binary"), "blocks")


def block_rows(block: Block, names: list[str], which: np.ndarray | None = None, texts: list[str] | None = None) -> pa.RecordBatch:
    """Rows of a block of ``pack_rows`` with all columns, by position; with ``texts`` instead of their own, and n_chars to suit."""
    which = np.arange(len(block)) if which is None else which
    rest = block.rest.take(pa.array(which, pa.int64())).combine_chunks()
    null = rest.column("null").to_pylist()
    if texts is None:
        texts = [block.body[block.starts[i] : block.ends[i]].decode() for i in which.tolist()]
        recount = False
    else:
        recount = "n_chars" in names
    texts = [None if n else t for n, t in zip(null, texts)]
    columns = {names.index("doc_id"): id_column(block.ids[which]), names.index("text"): pa.array(texts, pa.string())}
    if recount:
        columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
    out = [columns[i] if i in columns else column(rest, f"c{i}") for i in range(len(names))]
    return pa.RecordBatch.from_arrays(out, names=[f"c{i}" for i in range(len(names))])


def rows_schema(docs: DataFrame) -> StructType:
    """The schema of ``block_rows`` for these documents."""
    fixed = {docs.columns.index(c): t for c, t in (("doc_id", LongType()), ("text", StringType()), ("n_chars", LongType())) if c in docs.columns}
    return StructType([StructField(f"c{i}", fixed.get(i, f.dataType)) for i, f in enumerate(docs.schema.fields)])


def as_before(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows by position under the names and types of ``docs``."""
    return rows.select(*(F.col(f"c{i}").cast(f.dataType).alias(f.name) for i, f in enumerate(docs.schema.fields)))


def shard_count(blocks: DataFrame, bytes_each: int = 8 << 20) -> tuple[int, int]:
    """(blocks, shards): shards in proportion to the text, so that what one shard gathers stays bounded as the input grows."""
    n, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return n, max(12, -(-total // bytes_each))


def rows_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def components(nodes: DataFrame, links: DataFrame, node: str = "id") -> DataFrame:
    """Smallest reachable id of every node, by hooking to the smallest neighbour and jumping pointers.

    nodes: one column ``node`` (distinct, not null); links: columns a, b in either direction.
    Rounds grow with the logarithm of the longest path; every round is written to the shared folder, so
    no state is kept in executors and nothing is sent to the driver but one count.  The members of a giant component have one
    pointer in common; the join that follows it has one row for each pointer on its other side, so adaptive execution may split it.
    """
    both = store(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    touched = both.select(F.col("a").alias(node)).distinct()
    label = store(touched.withColumn("label", F.col(node)), "labels")
    while True:
        # least label among the neighbours, then the label of that label
        near = both.join(label.select(F.col(node).alias("b"), "label"), "b").groupBy(F.col("a").alias(node)).agg(F.min("label").alias("near"))
        stepped = label.join(near, node, "left").select(node, "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        # the node that is a label learns the least label its members have seen, and they learn it from that node: one row a label
        hooks = stepped.groupBy(F.col("label").alias(node)).agg(F.min("next").alias("hook"))
        hooked = stepped.join(hooks, node, "left").select(node, "label", F.least("next", F.coalesce("hook", "next")).alias("next"))
        jump = hooked.select(F.col(node).alias("next"), F.col("next").alias("far"))
        new = store(hooked.join(jump, "next", "left").select(node, F.col("label").alias("old"), F.least("next", F.coalesce("far", "next")).alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(label)
        label = new.select(node, "label")
        label._scratch_path = new._scratch_path
        if not changed:
            break
    discard(both)
    return nodes.join(label, node, "left").select(node, F.coalesce("label", node).alias("component_id"))
