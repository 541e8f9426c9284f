"""Validation: bad values become null or are dropped, each with a warning; no row fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lookups import EMAIL
from ..functions.text import entity_id, strip
from .score import clamp


def _blank(c):
    return strip(F.coalesce(c, F.lit(""))) == ""


def validate(profiles: DataFrame) -> DataFrame:
    """Profiles with only valid values, and ``validator_warnings``."""
    no_id = F.coalesce("candidate_id", F.lit("")) == ""
    short = F.length(strip(F.col("full_name"))) < 2
    bad_years = ~F.col("years_experience").between(0, 60)
    rules = {
        "emails": lambda x: x.rlike(EMAIL), "phones": lambda x: x.startswith("+"), "skills": lambda x: ~_blank(x["canonical_name"]),
        "experience": lambda x: ~(_blank(x["company"]) & _blank(x["title"])), "education": lambda x: ~_blank(x["institution"]),
    }

    def dropped_from(c, ok):
        return F.when(F.size(F.filter(c, lambda x: ~ok(x))) > 0, F.lit(f"invalid {c} dropped"))

    dropped = [dropped_from(c, ok) for c, ok in rules.items()]
    warnings = F.array_compact(F.array(F.when(no_id, F.lit("empty id replaced")), F.when(short, F.lit("short name removed")), F.when(bad_years, F.lit("years out of range removed")), *dropped))
    return profiles.withColumns(
        {
            "validator_warnings": warnings,
            "candidate_id": F.when(no_id, entity_id(F.coalesce(F.get("emails", F.lit(0)), "full_name", "fusion_id"))).otherwise(F.col("candidate_id")),
            "full_name": F.when(~short, F.col("full_name")),
            "years_experience": F.when(~bad_years, F.col("years_experience")),
            "overall_confidence": clamp(F.coalesce("overall_confidence", F.lit(0.0))),
            **{c: F.filter(c, ok) for c, ok in rules.items()},
        }
    )
