"""Confidence of fields and profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lookups as L
from ..functions.lookups import BASELINE, OTHER_BASELINE, WEIGHTS
from ..functions.text import let_sql, quoted


def clamp(c: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


def baseline(source: Column, table: dict[str, float] = BASELINE) -> Column:
    return let_sql(source, f"CASE x {' '.join(f'WHEN {quoted(name)} THEN {value}D' for name, value in table.items())} ELSE {OTHER_BASELINE}D END")


def _quality(field: str, v: str) -> str:
    """SQL: sum of the rules' deltas for one value; emails and skills are judged as single strings."""
    number = f"try_cast({v} AS DOUBLE)"
    rules = {
        "full_name": [(f"size(split({v}, {quoted(r'\s+')})) >= 2", L.NAME_OF_TWO_WORDS), (f"length({v}) > 30", L.LONG_NAME)],
        "emails": [(f"length({v}) > 0", L.EMAIL_PRESENT), (f"length({v}) > 3", L.LONG_EMAIL)],
        "phones": [(f"length({v}) > 0", L.PHONE_PRESENT)],
        "location": [(f"contains({v}, ',')", L.PLACE_WITH_COMMA)],
        "years_experience": [(f"{number} > 0 AND {number} < 50", L.YEARS_PLAUSIBLE), (f"{number} > 40", L.MANY_YEARS)],
        "skills": [(f"length({v}) >= 3", L.SKILL_OF_THREE), (f"length({v}) >= 10", L.SKILL_OF_TEN)],
    }
    return " + ".join(["0D", *(f"CASE WHEN {holds} THEN {delta}D ELSE 0D END" for holds, delta in rules.get(field, []))])


def field_confidence(field: str, value: Column, source: Column, agreeing: Column | int = 1) -> Column:
    agreeing = F.lit(agreeing) if isinstance(agreeing, int) else agreeing
    given = F.struct(value.alias("v"), baseline(source).alias("base"), agreeing.alias("n"))
    total = f"x.base + ({_quality(field, 'x.v')}) + (x.n - 1) * 0.02D"
    return let_sql(given, f"CASE WHEN x.v IS NULL OR x.v = '' THEN 0D ELSE round(greatest(0D, least(1D, {total})), 4) END")


def list_confidence(field: str, size: Column, source: Column) -> Column:
    """Confidence of a list of emails or phones as a whole."""
    rules = {"emails": [(size > 0, L.EMAIL_PRESENT), (size > 3, L.LONG_EMAIL)], "phones": [(size > 0, L.PHONE_PRESENT)]}
    return clamp(sum((F.when(holds, delta).otherwise(0.0) for holds, delta in rules[field]), baseline(source)))


def by_source_count(confidence: Column, n: Column) -> Column:
    return clamp(F.round(confidence + F.when(n == 1, -0.08).when(n == 2, -0.03).when(n >= 3, 0.02).otherwise(0.0), 4))


def overall(confidence_of: dict[str, Column], n_sources: Column) -> Column:
    """Weighted mean of eight fields, a bonus for further sources, penalties for no name and no email."""
    total = sum((F.coalesce(confidence_of[f], F.lit(0.0)) * w for f, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    missing = lambda f, p: F.when(F.coalesce(confidence_of[f], F.lit(0.0)) == 0, p).otherwise(0.0)
    return clamp(total + F.least((n_sources - 1) * 0.015, F.lit(0.05)) - missing("full_name", 0.10) - missing("emails", 0.08))


def tier(c: Column, high: float = 0.75, medium: float = 0.50) -> Column:
    return F.when(c >= high, "High").when(c >= medium, "Medium").otherwise("Low")
