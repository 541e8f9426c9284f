"""WARC fixity audit with Merkle trees over records and ordered offset ranges.

Pages become WARC response records in archives; a record's leaf is the SHA-256 of its bytes.  Leaves in
offset order are hashed in groups of ``FANOUT`` up to one root for each archive, and archives in the same way up to one
root for the replica.  Replicas compare roots, and only below mismatching nodes are further levels compared, until
the records that differ are located.  Below these nodes records are matched by what they are (archive, page_id,
url), not by place: first those of equal digest, then the rest in order.  Every step is a DataFrame join or
aggregation of groups of bounded size; what matches is never compared record by record.  Digests and lengths are
taken before anything is shuffled, so texts stay where they are read; every level of a tree is stored once.

Defined cases: null fields are empty in the record; pages of equal id are ordered by url, then by content;
pages with a null page_id are dealt to ``NULL_ARCHIVES`` archives of their own (below 0) by url; empty tables have no archives, no root
and no findings; other columns are not read; very long pages are records like others.  A record that one replica lacks is ``missing`` or
``extra``, wherever it stood; records that only moved are intact.  All pages of one id are in one archive, which one task
sorts by digests (with Spark's spilling sort).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, picked, store

FANOUT, ARCHIVE_PAGES, NULL_ARCHIVES = 16, 4096, 4096


def raw_records(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """archive, page_id, url and record (text) of every page."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"), html)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    stray = -1 - F.conv(F.substring(F.md5(url), 1, 3), 16, 10).cast("long") % NULL_ARCHIVES
    archive = F.when(F.col("page_id").isNull(), stray).otherwise(F.floor(F.col("page_id") / archive_pages).cast("long"))
    return picked(pages, page_id="long", url="string", html="string").select(archive.alias("archive"), "page_id", url.alias("url"), F.concat(head, body, F.lit("\r\n\r\n")).alias("record"))


def _laid_out(rows: DataFrame) -> DataFrame:
    """Adds place and record_offset to rows with archive, page_id, url, digest and record_length."""
    order = Window.partitionBy("archive").orderBy(F.asc_nulls_first("page_id"), "url", "digest")
    place = (F.row_number().over(order) - 1).cast("long")
    offset = F.sum("record_length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("record_length")
    return rows.withColumns({"node": place, "record_offset": offset})


def _digested(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"digest": F.sha2("record", 256), "record_length": F.octet_length("record").cast("long")})


def warc_records(pages: DataFrame, archive_pages: int = ARCHIVE_PAGES) -> DataFrame:
    """archive, place, page_id, record_offset, record_length, record and url of every page: what an archive's file holds, in order."""
    out = _laid_out(_digested(raw_records(pages, archive_pages)))
    return out.select("archive", F.col("node").alias("place"), "page_id", "record_offset", "record_length", "record", "url")


def leaves(raw: DataFrame) -> DataFrame:
    """Leaves of the trees of a replica: archive, node (place), page_id, url, record_offset, record_length, digest."""
    return _laid_out(_digested(raw).drop("record")).select("archive", "node", "page_id", "url", "record_offset", "record_length", "digest")


def _above(level: DataFrame) -> DataFrame:
    """Nodes over groups of ``FANOUT`` nodes: the digest of the ordered digests and of the range they cover."""
    members = F.array_sort(F.collect_list(F.struct("node", "record_offset", "record_length", "digest")))
    grouped = level.groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node")).agg(members.alias("m"))
    said = F.concat_ws(",", F.transform("m", lambda x: F.concat_ws(":", x["record_offset"], x["record_length"], x["digest"])))
    start = F.array_min(F.transform("m", lambda x: x["record_offset"]))
    end = F.array_max(F.transform("m", lambda x: x["record_offset"] + x["record_length"]))
    return grouped.select("archive", "node", start.alias("record_offset"), (end - start).alias("record_length"), F.sha2(said, 256).alias("digest"))


def _over_archives(level: DataFrame) -> DataFrame:
    members = F.array_sort(F.collect_list(F.struct("node", "digest")))
    grouped = level.groupBy(F.floor(F.col("node") / FANOUT).alias("node")).agg(members.alias("m"))
    return grouped.select("node", F.sha2(F.concat_ws(",", F.transform("m", lambda x: F.concat_ws(":", x["node"], x["digest"]))), 256).alias("digest"))


def merkle_levels(leaf: DataFrame) -> list[DataFrame]:
    """Stored leaves, then each level above, up to one node for each archive (node 0)."""
    out = [store(leaf, "leaves")]
    width = (out[0].agg(F.max("node")).first()[0] or 0) + 1
    while width > 1 or len(out) == 1:
        out.append(store(_above(out[-1]), "level"))
        width = -(-width // FANOUT)
    return out


def archive_levels(roots: DataFrame, first: int, last: int) -> list[DataFrame]:
    """Archives' roots by number from ``first`` on, then each level above, up to the replica's root (node 0)."""
    out = [roots.select((F.col("archive") - first).alias("node"), "digest")]
    width = last - first + 1
    while width > 1 or len(out) == 1:
        out.append(store(_over_archives(out[-1]), "archives"))
        width = -(-width // FANOUT)
    return out


def replica_root(raw: DataFrame) -> str | None:
    """The digest that stands for all records of a replica; none for an empty one."""
    roots = merkle_levels(leaves(raw))[-1]
    first, last = roots.agg(F.min("archive"), F.max("archive")).first()
    return None if first is None else archive_levels(roots, first, last)[-1].first()["digest"]


def _differing(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    on = reduce(Column.__and__, (F.col(f"x.{k}") == F.col(f"y.{k}") for k in keys))
    found = x.alias("x").join(y.alias("y"), on, "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    return found.select(*(F.coalesce(f"x.{k}", f"y.{k}").alias(k) for k in keys))


def _matched(x: DataFrame, y: DataFrame) -> DataFrame:
    """Leaves x and y of two replicas side by side, as structs ``x`` and ``y``; those of equal digest are left out.

    What is not below a suspect node is the same in both, so nothing in x has its match outside y.
    """
    both = x.withColumn("side", F.lit(0)).unionByName(y.withColumn("side", F.lit(1))).repartition("archive", "page_id", "url")
    who = ["archive", "page_id", "url"]
    both = both.withColumn("nth", F.row_number().over(Window.partitionBy(*who, "digest", "side").orderBy("node")))
    rest = both.withColumn("sides", F.count(F.lit(1)).over(Window.partitionBy(*who, "digest", "nth"))).where("sides = 1")
    rest = rest.withColumn("nth", F.row_number().over(Window.partitionBy(*who, "side").orderBy("node")))
    leaf = F.struct("archive", "node", "page_id", "record_offset", "record_length", "digest")
    return rest.groupBy(*who, "nth").agg(*(F.max(F.when(F.col("side") == k, leaf)).alias(name) for k, name in enumerate("xy"))).select("x", "y")


def audit(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Records in which replica ``other`` differs from ``mine``: archive, place, page_id, offsets, digests, status.

    Both are tables of ``raw_records``.
    """
    a, b = merkle_levels(leaves(mine)), merkle_levels(leaves(other))
    # trees of one height, so that nodes of a level stand for ranges of equal size
    for low, high in ((a, b), (b, a)):
        while len(low) < len(high):
            low.append(store(_above(low[-1]), "level"))
    ends = [x for t in (a, b) for x in t[-1].agg(F.min("archive"), F.max("archive")).first() if x is not None]
    first, last = (min(ends), max(ends)) if ends else (0, 0)
    up, vp = archive_levels(a[-1], first, last), archive_levels(b[-1], first, last)
    suspects = None
    for x, y in zip(reversed(up), reversed(vp)):
        if suspects is not None:
            x, y = (t.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(suspects, "parent", "left_semi") for t in (x, y))
        suspects = _differing(x, y, ["node"]).withColumnRenamed("node", "parent")
    archives = suspects.select((F.col("parent") + first).alias("archive"))
    suspects = archives.withColumn("parent", F.lit(0).cast("long"))  # the root of each of these archives

    def below(level: DataFrame) -> DataFrame:  # only below nodes that mismatch
        return level.withColumn("parent", F.floor(F.col("node") / FANOUT)).join(suspects, ["archive", "parent"], "left_semi")

    for x, y in zip(reversed(a[1:-1]), reversed(b[1:-1])):
        suspects = _differing(below(x), below(y), ["archive", "node"]).withColumnRenamed("node", "parent")
    found = _matched(below(a[0]), below(b[0]))
    status = F.when(F.col("y.digest").isNull(), "missing").when(F.col("x.digest").isNull(), "extra").otherwise("corrupt")
    pick = lambda c: F.coalesce(f"x.{c}", f"y.{c}").alias(c)
    out = store(found.select(pick("archive"), pick("node"), pick("page_id"), pick("record_offset"), pick("record_length"), F.col("x.digest").alias("digest_here"), F.col("y.digest").alias("digest_there"), status.alias("status")).withColumnRenamed("node", "place"), "findings")
    for table in (*a, *b, *up[1:], *vp[1:]):
        discard(table)
    return out


def damaged(raw: DataFrame, every: int = 97) -> DataFrame:
    """A replica for drills: of ``every`` page ids that with remainder 5 has one byte changed, with 6 is lost, with 7 has a second record."""
    rest = F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(every))
    broken = F.concat(F.expr("substring(record, 1, length(record) - 5)"), F.lit("?"), F.expr("substring(record, length(record) - 3, 4)"))
    kept = raw.where(rest != 6).withColumn("record", F.when(rest == 5, broken).otherwise(F.col("record")))
    return kept.unionByName(raw.where(rest == 7).withColumn("url", F.concat("url", F.lit("#again"))))
