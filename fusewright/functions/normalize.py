"""Normalisers as columns: null in, or nothing usable in, is null out; none of them fails on bad data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import sql_free_date
from .lookups import EMAIL, PLACES, PRESENT, SKILLS
from .phones import phone  # noqa: F401  one of the normalisers
from .text import bind, blank_to_null, first_by, let, let_sql, quoted, sql_map, sql_strip, strip, title


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.expr(sql_map(table)), key)


def email(c: Column) -> Column:
    s = F.lower(strip(c))
    return F.when(s.rlike(EMAIL), s)


def sql_date(x: str, this_year: int | None = None) -> str:
    """SQL of ``date``."""
    month = lambda m: f"lpad({m}, 2, '0')"
    like = lambda pattern: f"s RLIKE {quoted(pattern)}"
    first, last = "substring_index(s, '/', 1)", "substring_index(s, '/', -1)"
    # year, or month and year by a slash: their digits say which; other spellings are longer or have letters
    read = (
        f"CASE WHEN {like(PRESENT)} THEN 'Present' WHEN {like(r'^\d{4}$')} THEN concat(s, '-01') WHEN {like(r'^\d{1,2}/\d{4}$')} THEN concat({last}, '-', {month(first)})"
        f" WHEN {like(r'^\d{4}/\d{1,2}$')} THEN concat({first}, '-', {month(last)}) ELSE {sql_free_date('s', this_year)} END"
    )
    return f"CASE WHEN {x} != '' THEN {bind('s', sql_strip(x), read)} END"


def date(c: Column, this_year: int | None = None) -> Column:
    """YYYY-MM, or Present; months of M/YYYY and YYYY/M are not checked, other spellings are read token by token."""
    return let_sql(c, sql_date("x", this_year))


def name(c: Column) -> Column:
    return let(strip(F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z\s\-']", ""), r"\s+", " ")), lambda s: title(blank_to_null(s)))


def skill(c: Column) -> Column:
    return F.coalesce(_lookup(SKILLS, F.lower(strip(c))), title(strip(c)))


def skills_list(c: Column) -> Column:
    return first_by(F.transform(c, skill), F.lower)


def location(c: Column) -> Column:
    parts = lambda s: F.array_join(F.transform(F.split(s, ","), lambda x: title(strip(x))), ", ")
    read = lambda s: F.coalesce(_lookup(PLACES, F.lower(s)), parts(s))
    return let(c, lambda x: F.when(x != "", let(strip(x), read)))


def url(c: Column) -> Column:
    s = strip(c)
    return F.when(c != "", F.when(s.rlike("^https?://"), s).when(s.contains("."), F.concat(F.lit("https://"), s)))


def years(c: Column) -> Column:
    """A number, or the mean of the first two."""
    at = lambda numbers, i: F.get(numbers, F.lit(i)).try_cast("double")
    return let(F.regexp_extract_all(c, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda n: F.when(F.size(n) >= 2, (at(n, 0) + at(n, 1)) / 2).otherwise(at(n, 0)))
