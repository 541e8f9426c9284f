"""Records of one entity found by what they share: an email, a phone number or a link.

Records and identifiers form a bipartite graph.  An identifier that more than ``most`` records have says nothing about one entity
(a switchboard, a company's site): it links none of them and is reported.  The others link each of their records to the least of these, and
rounds of large stars and small stars contract the graph: every node's greater, then its smaller neighbours move to the least neighbour, until
each component is a star around its least record.  The number of rounds grows with the logarithm of the longest chain.  Each
round is a table in the shared folder, so lineage stays short and a lost executor costs its tasks only; the driver sees two numbers a round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..sources.files import drop, scratch

MOST_SHARED = 100


def identifiers(records: DataFrame, record: str = "record_id") -> DataFrame:
    """(record, kind, identifier): normalised emails, phones and links of source records, each once."""
    kinds = {"email": ("emails", lambda x: N.email(x)), "phone": ("phones", lambda x: N.phone(x)), "link": ("links", lambda x: _plain(N.url(x["url"])))}
    told = lambda kind, change: lambda x: F.struct(F.lit(kind).alias("kind"), change(x).alias("identifier"))
    each = [F.transform(F.col(c), told(kind, change)) for kind, (c, change) in kinds.items()]
    found = F.concat(*(F.coalesce(x, F.array().cast("array<struct<kind:string,identifier:string>>")) for x in each))
    return records.select(record, F.explode(found).alias("x")).select(record, "x.*").where(F.col("identifier").isNotNull() & F.col(record).isNotNull()).distinct()


def _plain(url: Column) -> Column:
    """A link without scheme, www and slashes at the end, in lower case."""
    return F.regexp_replace(F.lower(url), r"^https?://(www\.)?|/+$", "")


def shared(found: DataFrame, record: str = "record_id", most: int = MOST_SHARED) -> DataFrame:
    """(kind, identifier, n, first, hub) of identifiers that several records have; ``first`` is the least of the records."""
    counted = found.groupBy("kind", "identifier").agg(F.count(F.lit(1)).alias("n"), F.min(record).alias("first"))
    return counted.where("n > 1").withColumn("hub", F.col("n") > most)


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def connected(edges: DataFrame) -> DataFrame:
    """(a, root) for every node ``a`` of edges (a, b) that is no root itself; the root is the component's least node."""
    spark = edges.sparkSession
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, path = _written(ordered)
    before = None
    while True:
        # large star: neighbours greater than a node go to the least node around it
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        # small star: a node and its smaller neighbours go to the least of these
        small = large.where("a <> b").groupBy("a").agg(F.min("b").alias("least"))
        rest = large.where("a <> b").join(small, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        new, new_path = _written(rest.unionByName(small.select("a", F.col("least").alias("b"))).distinct())
        # the same edges again: both the number and the sum of hashes stay
        mark = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        drop(spark, path)
        now, path = new, new_path
        if mark == before:
            return now.select("a", F.col("b").alias("root"))
        before = mark


def resolve(records: DataFrame, record: str = "record_id", most: int = MOST_SHARED) -> tuple[DataFrame, DataFrame]:
    """(record, entity_id, n_identifiers, n_hubs) of every row, and the hubs (kind, identifier, n).

    entity_id is the least record of those that are linked, directly or through others; a record without identifiers, or with hubs only, is its own.
    """
    found, _ = _written(identifiers(records, record))
    several = shared(found, record, most)
    joined = found.join(several.select("kind", "identifier", "first", "hub"), ["kind", "identifier"], "left")
    star = joined.where("not hub").select(F.col(record).alias("a"), F.col("first").alias("b"))
    roots = connected(star)
    counts = joined.groupBy(record).agg(F.count(F.lit(1)).alias("n_identifiers"), F.count_if(F.col("hub")).alias("n_hubs"))
    out = records.select(record).join(roots.withColumnRenamed("a", record), record, "left").join(counts, record, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(record, F.coalesce("root", record).alias("entity_id"), zero("n_identifiers"), zero("n_hubs")), several.where("hub").select("kind", "identifier", "n")
