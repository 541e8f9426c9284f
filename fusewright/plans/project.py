"""Projection of profiles by a run-time configuration, and the report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lookups import DEFAULT_PROJECTION, REPORT_VERSION
from ..operators.score import tier


def project(profiles: DataFrame, config: dict | None = None) -> DataFrame:
    """Hides, renames and drops columns; renamed ones move to the end, and exclusions name the new names.

    Without a configuration the profile stays as it is; ``DEFAULT_PROJECTION`` is the one that whole runs take.
    """
    if config is None:
        return profiles
    out = profiles
    if config.get("hide_provenance"):
        out = out.drop("provenance")
    if config.get("hide_confidence"):
        out = out.drop("overall_confidence").withColumn("skills", F.transform("skills", lambda s: s.dropFields("confidence")))
    aliases = {a: b for a, b in config.get("field_aliases", {}).items() if a in out.columns}
    renamed = set(aliases.values())
    columns = [F.col(c) for c in out.columns if c not in aliases and c not in renamed] + [F.col(a).alias(b) for a, b in aliases.items()]
    return out.select(*columns).drop(*config.get("exclude_fields", []))


def report(profiles: DataFrame, include: dict | None = None, warnings: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """One report row per profile; ``include`` turns parts off.  warnings: of the run, such as sources that failed; names: what each source read, such as a file's name."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.lit(None).cast("map<string,string>")
    logged = lambda p: F.struct(
        p["field"].alias("field"), p["selected_source"].alias("selected_source"),
        F.transform(p["entries"], lambda e: F.struct(e["source"].alias("source"), e["raw_value"].alias("raw_value"), e["confidence"].alias("confidence"))).alias("all_sources"),
    )
    parts = {
        "include_source_summary": [F.transform("sources", lambda s: F.concat_ws(":", s, F.try_element_at(known, s))).alias("sources_used")],
        "include_field_confidences": [F.map_from_entries(F.transform("provenance", lambda p: F.struct(p["field"], p["confidence"]))).alias("field_confidences"), F.col("overall_confidence")],
        "include_conflict_log": [F.transform(F.filter("provenance", lambda p: F.size(p["entries"]) > 1), logged).alias("conflict_log")],
        "include_validation_warnings": [F.array(*map(F.lit, warnings or [])).cast("array<string>").alias("validation_warnings")],
    }
    chosen = [c for k, cs in parts.items() if (include or {}).get(k, True) for c in cs]
    validator = [c for c in ("validator_warnings",) if c in profiles.columns]
    return profiles.select(F.lit(REPORT_VERSION).alias("pipeline_version"), "fusion_id", "candidate_id", *chosen, *validator)


def identity_view(profiles: DataFrame) -> DataFrame:
    """Header of a profile with words in place of what is missing."""
    or_ = lambda c, word: F.coalesce(c, F.lit(word))
    return profiles.select("fusion_id", or_(F.col("full_name"), "Unnamed Candidate").alias("display_name"), or_(F.get("emails", F.lit(0)), "—").alias("email"), or_(F.get("phones", F.lit(0)), "—").alias("phone"), or_(F.col("location"), "—").alias("location"), "overall_confidence")


def experience_view(profiles: DataFrame) -> DataFrame:
    x = profiles.select("fusion_id", F.explode_outer("experience").alias("x"))
    return x.select("fusion_id", "x.title", "x.company", "x.start_date", F.coalesce("x.end_date", F.lit("Present")).alias("end_date"))


def github_links(profiles: DataFrame) -> DataFrame:
    return profiles.select("fusion_id", F.explode(F.filter("links", lambda x: F.lower(x["label"]) == "github")).alias("x")).select("fusion_id", "x.url")


def skill_view(profiles: DataFrame) -> DataFrame:
    """Skills with a tier of their own bounds; ``place`` orders them by confidence, then as in the profile."""
    x = profiles.select("fusion_id", F.posexplode("skills").alias("pos", "s")).select("fusion_id", "pos", F.col("s.canonical_name").alias("skill"), F.col("s.confidence").alias("confidence"))
    place = F.row_number().over(Window.partitionBy("fusion_id").orderBy(F.desc("confidence"), "pos"))
    return x.select("fusion_id", place.alias("place"), "skill", "confidence", tier(F.col("confidence"), 0.90, 0.75).alias("tier"))


def education_view(profiles: DataFrame) -> DataFrame:
    """Studies, with the grade to two decimals."""
    x = profiles.select("fusion_id", F.explode_outer("education").alias("x"))
    return x.select("fusion_id", "x.institution", "x.degree", "x.field_of_study", "x.start_date", "x.end_date", F.format_number("x.gpa", 2).alias("gpa"))
