"""Readers that keep bad rows: every line of a text source is good, or bad with a reason, its file and its byte offset.

A scan is one pass over the files in pieces: (file, split, place, reason, text), where ``place`` counts the bytes of the
split's lines before this one.  ``divide`` writes a scan once and gives both sides; ``located`` adds the offset in the
file.  A line is judged alone, so a row that is broken costs itself only.  Lines end with \\n or \\r\\n; the last one may lack it.
"""

from __future__ import annotations

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import AtsError, CsvError
from ..functions.lookups import HEADERS
from ..functions.text import coerce, let, strip
from . import ats, table
from .files import exists, scratch

SCAN = "file string, split long, place long, reason string, text string"
_LINE = "file string, split long, place long, value binary"
_LINE_ARROW = pa.schema([("file", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("value", pa.binary())])


def _running(batches):
    """Adds the bytes of a split's lines before each; a task reads splits one after the other, each in order."""
    last, reached = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column(0).dictionary_encode()
        split = batch.column(1).to_numpy()
        code = names.indices.to_numpy()
        size = pc.binary_length(batch.column(2)).to_numpy().astype(np.int64) + 1
        before = np.cumsum(size) - size
        first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (split[1:] != split[:-1])))
        start = before[first].copy()
        if last == (names.dictionary[code[0]].as_py(), split[0]):
            start[0] -= reached
        place = before - np.repeat(start, np.diff(np.append(first, len(size))))
        last, reached = (names.dictionary[code[-1]].as_py(), split[-1]), int(place[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(1), pa.array(place), batch.column(2).cast(pa.binary())], schema=_LINE_ARROW)


def _raw(spark: SparkSession, path: str) -> DataFrame:
    meta = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("split"), meta["file_size"].alias("size"), F.col("value").cast("binary").alias("value"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, place, value) of every line of the files at a path, as bytes without the line's end."""
    return _raw(spark, path).drop("size").mapInArrow(_running, _LINE)


def _scanned(rows: DataFrame, reason) -> DataFrame:
    """The scan of lines; ``reason(text)`` judges those that are UTF-8.  Others are shown as Latin-1."""
    fine = F.is_valid_utf8(F.col("value").cast("string"))
    text = F.regexp_replace(F.when(fine, F.col("value").cast("string")).otherwise(F.decode("value", "ISO-8859-1")), "\r$", "")
    read = rows.select("file", "split", "place", fine.alias("fine"), text.alias("text"))
    return read.select("file", "split", "place", F.when(~F.col("fine"), "no UTF-8").otherwise(reason(F.col("text"))).alias("reason"), "text")


def good(scan: DataFrame) -> DataFrame:
    return scan.where("reason is null")


def bad(scan: DataFrame) -> DataFrame:
    return scan.where("reason is not null")


def divide(scan: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of a scan that is run once and stored, at the path or in the cluster's shared folder."""
    spark = scan.sparkSession
    path = path or scratch(spark)
    scan.withColumn("ok", F.col("reason").isNull()).write.partitionBy("ok").parquet(path)
    kept = spark.read.schema(SCAN + ", ok boolean").parquet(path)
    return kept.where("ok").drop("ok"), kept.where("not ok").drop("ok")


def located(rows: DataFrame, path: str) -> DataFrame:
    """Rows of a scan with ``offset``, the line's first byte in its file: (file, offset, reason, text).

    Where a split begins in the middle of a line is known only from the splits before it, so their bytes are
    counted; that reads no text to the driver and moves one row a split.
    """
    kept = _raw(rows.sparkSession, path).groupBy("file", "split").agg(F.sum(F.octet_length("value") + 1).alias("n"), F.max("size").alias("size"))
    file = Window.partitionBy("file")
    before = F.coalesce(F.sum("n").over(file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    mark = F.when((F.col("size") - F.sum("n").over(file)).isin(2, 3), 3).otherwise(0)  # the reader skips a byte order mark; the last line may lack its end
    base = kept.select("file", "split", before.alias("before"), mark.alias("mark"))
    first = (F.col("split") == 0) & (F.col("place") == 0)
    return rows.join(base, ["file", "split"]).select("file", F.when(first, 0).otherwise(F.col("before") + F.col("place") + F.col("mark")).cast("long").alias("offset"), "reason", "text")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The cells of the first file's first line."""
    if not exists(spark, path):
        raise CsvError(f"no table at {path}")
    first = spark.read.option("lineSep", "\n").text(path).select("value").first()  # as text: folders of partitions add no cell
    names = next(csv.reader([first[0].lstrip("﻿").rstrip("\r")]), []) if first else []
    if not any(names):
        raise CsvError(f"no header in {path}")
    return names


def _cells(text: Column, n: int) -> Column:
    return F.from_csv(text, ", ".join(f"`{i}` string" for i in range(n)), {"escape": '"'})


def scan_csv(spark: SparkSession, path: str, header: list[str] | None = None) -> DataFrame:
    """Scan of CSV files with one header.  Bad: no UTF-8, open quote (also a cell over two lines), too many cells, no filled cell of a known field, a first line that is no such header."""
    names = header or csv_header(spark, path)
    known = {table.field_of(n): i for i, n in enumerate(names) if table.field_of(n)}
    bare = lambda c: F.regexp_replace(c, '"(?:[^"]|"")*"', "")

    def reason(text):
        some = lambda row: F.coalesce(*(coerce(row[str(i)]) for i in known.values()))
        filled = let(_cells(text, len(names)), some) if known else F.lit(None)
        return (
            F.when((F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))) % 2 == 1, "open quote")
            .when(F.size(F.split(bare(text), ",")) > len(names), "too many cells")
            .when(filled.isNull(), "no known cell")
        )

    head = (F.col("place") == 0) & (F.col("split") == 0)
    same = F.size(F.split(bare(F.col("text")), ",")) == len(names)
    first = _cells(F.regexp_replace("text", "^﻿", ""), len(names))
    same &= F.concat_ws("\n", *(F.coalesce(first[str(i)], F.lit("")) for i in range(len(names)))) == "\n".join(names)
    scan = _scanned(lines(spark, path), reason).withColumn("head", F.when(head, F.when(F.coalesce(same, F.lit(False)), "header").otherwise("other header")))
    return scan.where(F.coalesce("head", F.lit("")) != "header").select("file", "split", "place", F.coalesce("head", "reason").alias("reason"), "text")


def csv_records(rows: DataFrame, header: list[str]) -> DataFrame:
    """Source records of a CSV scan's good rows."""
    last = {table.field_of(n) or f"_other{i}": str(i) for i, n in enumerate(header)}
    read = rows.select(F.monotonically_increasing_id().alias("_row"), _cells(F.col("text"), len(header)).alias("c"))
    return table.parse(read.select("_row", *(F.col("c")[c].alias(f) for f, c in last.items())))


def scan_ats(spark: SparkSession, path: str) -> DataFrame:
    """Scan of exports, one JSON object a line.  Bad: no UTF-8, blank, no JSON, no object."""
    if not exists(spark, path):
        raise AtsError(f"no export at {path}")

    def reason(text):
        parsed = F.try_parse_json(text)
        return F.when(strip(text) == "", "blank").when(parsed.isNull(), "no JSON").when(~ats._is(parsed, "OBJECT"), "no object")

    return _scanned(lines(spark, path), reason)


def ats_records(rows: DataFrame) -> DataFrame:
    """Source records of an export scan's good rows."""
    return ats.parse(rows, "text")
