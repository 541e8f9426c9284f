"""Names replaced by alias tables of any size.

A table that is measured to be small is broadcast.  A larger one is joined by shuffle: names that hold a thousandth of
the rows or more, of which there can be a thousand at most, go by a broadcast of these alone, so no task gets a hot name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

SMALL = 8 << 20  # bytes of an alias table that is broadcast
SHARES = 1000  # a name with one of so many parts of the rows is hot
_KEY, _TO, _HOT = "_alias_key", "_alias_to", "_alias_hot"


def alias_key(c: Column) -> Column:
    """What names are compared by: stripped, in lower case."""
    return F.lower(strip(c))


def alias_table(pairs: DataFrame) -> DataFrame:
    """Pairs (alias, canonical) by key; of several canonical names for one alias the smallest counts, nulls go."""
    return pairs.select(alias_key(F.col("alias")).alias(_KEY), F.col("canonical").alias(_TO)).where(F.col(_KEY).isNotNull() & F.col(_TO).isNotNull()).groupBy(_KEY).agg(F.min(_TO).alias(_TO))


def is_small(pairs: DataFrame, small: int = SMALL) -> bool:
    """Measured by one sum over the pairs."""
    return (pairs.agg(F.sum(F.octet_length("alias") + F.octet_length("canonical") + 48)).first()[0] or 0) <= small


def canonical(rows: DataFrame, column: str, pairs: DataFrame, out: str = "canonical", small: int = SMALL) -> DataFrame:
    """The rows with ``out``, the canonical name that the column is an alias of, else null.  All rows stay, equal ones too."""
    keyed, known = rows.withColumn(_KEY, alias_key(F.col(f"`{column}`"))), alias_table(pairs)
    done = lambda df: df.drop(_KEY, _HOT).withColumnRenamed(_TO, out)
    if is_small(pairs, small):
        return done(keyed.join(F.broadcast(known), _KEY, "left"))
    counts = keyed.where(F.col(_KEY).isNotNull()).groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.where(F.col("n") * SHARES >= total).join(known.hint("merge"), _KEY, "left").select(_KEY, _TO, F.lit(True).alias(_HOT))
    marked = keyed.join(F.broadcast(hot), _KEY, "left")
    apart = F.col(_HOT).isNotNull() | F.col(_KEY).isNull()
    rest = marked.where(~apart).drop(_TO).join(known.hint("merge"), _KEY, "left")
    return done(marked.where(apart)).unionByName(done(rest))


def unknown(rows: DataFrame, column: str, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(name, n): the names, as compared, that no alias has, and how many rows hold each.  Names are counted before they are joined."""
    counts = rows.select(alias_key(F.col(f"`{column}`")).alias(_KEY)).where(F.col(_KEY) != "").groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"))
    known = alias_table(pairs).select(_KEY)
    missing = counts.join(F.broadcast(known) if is_small(pairs, small) else known.hint("merge"), _KEY, "left_anti")
    return missing.select(F.col(_KEY).alias("name"), "n")
