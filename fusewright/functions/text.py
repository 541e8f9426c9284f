"""String functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lookups import NULL_WORDS


def let(value: Column, f) -> Column:
    """f(value), with the value worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def quoted(text: str) -> str:
    """The text as an SQL literal."""
    return f"r'{text}'" if "'" not in text else "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(name: str, value: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for the value, which is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def let_sql(value: Column, body: str) -> Column:
    """``body``, SQL of ``x``, with x for the value.

    For large expressions: the driver parses one text, where building them from columns calls the JVM for every node.
    """
    return F.get(F.call_function("transform", F.array(value), F.expr(f"x -> {body}")), F.lit(0))


def sql_map(table: dict[str, str]) -> str:
    """SQL of a map from texts to texts."""
    return f"map({', '.join(quoted(x) for pair in table.items() for x in pair)})"


def sql_strip(x: str) -> str:
    """SQL of ``strip``."""
    return f"regexp_replace({x}, {quoted(_ENDS)}, '')"


_ENDS = r"(?U)^\s+|\s+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, _ENDS, "")


def title(c: Column) -> Column:
    """Each run of letters with its first letter in upper case, the others in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")


def coerce(c: Column) -> Column:
    """Stripped text; null for blank text and the words that mean nothing."""
    return let_sql(c, bind("s", sql_strip("x"), f"CASE WHEN lower(s) NOT IN ({', '.join(map(quoted, NULL_WORDS))}) THEN s END"))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def split_multi(c: Column, pattern: str) -> Column:
    """Parts between matches of ``pattern``, stripped, without empty ones."""
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: x != "")


def truncate(c: Column, size: int = 200, suffix: str = "...") -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size - len(suffix)), F.lit(suffix))).otherwise(c)


def slugify(c: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), "-+", "-")


def entity_id(seed: Column) -> Column:
    """First 16 hexadecimal digits of the seed's SHA-256."""
    return F.substring(F.sha2(seed, 256), 1, 16)


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def _runs(items: Column, key, make) -> Column:
    """make(items, sorted (k, i), starts, start, number) for every run of equal keys.

    One sort puts equal keys together, so the work is that of sorting, not items times keys.
    """
    same = lambda sorted_, p, j: F.get(sorted_, j - 1)["k"].eqNullSafe(p["k"])

    def placed(xs, sorted_):
        marked = F.transform(sorted_, lambda p, j: F.when((j == 0) | ~same(sorted_, p, j), j))
        return let(F.array_compact(marked), lambda starts: F.transform(starts, lambda s, r: make(xs, sorted_, starts, s, r)))

    pairs = lambda xs: F.array_sort(F.transform(xs, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
    return let(items, lambda xs: let(pairs(xs), lambda sorted_: placed(xs, sorted_)))


def first_by(items: Column, key) -> Column:
    """Items with keys not seen before, in order; null is a key like others."""
    firsts = lambda xs: F.array_sort(_runs(xs, key, lambda _, sorted_, starts, s, r: F.get(sorted_, s)["i"]))
    return let(items, lambda xs: F.transform(firsts(xs), lambda i: F.get(xs, i)))


def grouped_by(items: Column, key) -> Column:
    """Arrays of the items with equal keys, by first appearance, each in order; items must be of a type that can be sorted."""

    def group(xs, sorted_, starts, s, r):
        members = F.slice(sorted_, s + 1, F.coalesce(F.get(starts, r + 1), F.size(sorted_)) - s)
        return F.struct(F.get(sorted_, s)["i"].alias("i"), F.transform(members, lambda p: F.get(xs, p["i"])).alias("x"))

    return F.transform(F.array_sort(_runs(items, key, group)), lambda g: g["x"])
