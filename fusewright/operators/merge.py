"""Fusion of source records: one row per entity, by source priority.

Two aggregations make one exchange each: the first record of every (entity, source), which is at most five
rows an entity, and the ordered array of these.  All unions, picks and scores are then narrow expressions
over short arrays, so nothing else is shuffled and no entity can outgrow its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions.lookups import ENTRY_CONFIDENCE, PRIORITY, WEIGHTS
from ..functions.text import blank_to_null, entity_id, first_by, grouped_by, let, strip
from . import score

SCALARS = {"full_name": N.name, "location": N.location, "headline": lambda c: c, "years_experience": lambda c: c}
_ENTRY = "struct<source:string,method:string,raw_value:string,confidence:double>"


def priority(source: Column) -> Column:
    out = F.lit(99)
    for name, rank in PRIORITY.items():
        out = F.when(source == name, rank).otherwise(out)
    return out


def gather(records: DataFrame) -> DataFrame:
    """fusion_id and ``recs``: an entity's records, one per source, best source first.  Records without id are left out."""
    fields = [c for c in records.columns if c not in ("fusion_id", "seq")]
    packed = records.where(F.coalesce("fusion_id", F.lit("")) != "").select("fusion_id", "source", "seq", F.struct(*fields).alias("rec"))
    first = packed.groupBy("fusion_id", "source").agg(F.min_by("rec", "seq").alias("rec"))
    ranked = F.struct(priority(F.col("source")).alias("rank"), F.col("source").alias("source"), F.col("rec").alias("rec"))
    grouped = first.groupBy("fusion_id").agg(F.array_sort(F.collect_list(ranked), lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(a["source"] < b["source"], -1).otherwise(1)).alias("r"))
    return grouped.select("fusion_id", F.transform("r", lambda x: x["rec"]).alias("recs"))


def _entry(source: Column, method: str, raw: Column, confidence: Column) -> Column:
    return F.struct(source.alias("source"), F.lit(method).alias("method"), raw.alias("raw_value"), confidence.alias("confidence")).cast(_ENTRY)


def _spread(field: str, make) -> Column:
    """``make(source, item)`` for every item of a list field, best source first, in order."""
    return F.flatten(F.filter(F.transform("recs", lambda r: F.transform(r[field], lambda x: make(r["source"], x))), lambda a: a.isNotNull()))


def _item(change):
    return lambda s, x: F.struct(s.alias("source"), x.alias("raw"), change(x).alias("v"))


def _filled(field: str, change) -> Column:
    """A scalar's sources that have a value, before and after the change."""
    some = F.filter("recs", lambda r: F.coalesce(r[field], F.lit("")) != "")
    return F.transform(some, lambda r: F.struct(r["source"].alias("source"), r[field].alias("raw"), change(r[field]).alias("v")))


def _found() -> dict[str, Column]:
    """Every value of every field with its source, normalised."""
    text = lambda c: F.lower(strip(F.coalesce(c, F.lit(""))))
    key = lambda x, a, b: F.concat(text(x[a]), F.lit("||"), text(x[b]))
    out = {}
    for field, change in SCALARS.items():
        out[field] = _filled(field, change)
    for field, change in (("emails", N.email), ("phones", N.phone)):
        out[field] = F.filter(_spread(field, _item(change)), lambda x: x["v"].isNotNull())
    skills = _spread("skills", lambda s, x: F.struct(s.alias("source"), strip(x).alias("raw"), N.skill(x).alias("v")))
    out["skills"] = F.filter(skills, lambda x: F.coalesce(x["raw"], F.lit("")) != "")
    out["links"] = F.filter(_spread("links", lambda s, x: F.struct(N.url(x["url"]).alias("url"), x["label"].alias("label"))), lambda x: x["url"].isNotNull())
    dated = lambda x: x.withField("start_date", N.date(x["start_date"])).withField("end_date", N.date(x["end_date"]))
    out["experience"] = _spread("experience", lambda s, x: F.struct(s.alias("source"), key(x, "company", "title").alias("raw"), dated(x).withField("location", N.location(x["location"])).alias("v")))
    out["education"] = _spread("education", lambda s, x: F.struct(s.alias("source"), key(x, "institution", "degree").alias("raw"), dated(x).withField("gpa", F.when(x["gpa"] != 0, x["gpa"])).alias("v")))
    return out


def _latest_first(c: Column, sort_by: str) -> Column:
    """By a date as text, latest first, null last, else as before."""

    def later(a, b):
        p, q = (F.coalesce(z["v"][sort_by], F.lit("0000-00")) for z in (a, b))
        return F.when(p > q, -1).when(p < q, 1).when(a["i"] < b["i"], -1).otherwise(1)

    placed = F.transform(c, lambda x, i: F.struct(x["v"].alias("v"), i.alias("i")))
    return F.transform(F.array_sort(placed, later), lambda x: x["v"])


def _skill(mine: Column, place: Column) -> Column:
    """One skill from all that was found under its name."""
    sources = F.array_distinct(F.transform(mine, lambda x: x["source"]))
    top = F.array_max(F.transform(mine, lambda x: x["c"]))
    confidence = F.round(F.least(F.lit(1.0), top + (F.size(sources) - 1) * 0.02), 4)
    return F.struct(
        (-F.size(sources)).alias("a"), (-confidence).alias("b"), place.alias("i"),
        F.struct(F.get(mine, F.lit(0))["raw"].alias("name"), F.get(mine, F.lit(0))["v"].alias("canonical_name"), sources.alias("sources"), confidence.alias("confidence")).alias("x"),
    )


def _first(c: str | Column) -> Column:
    return F.get(c, F.lit(0))


def merge(records: DataFrame) -> DataFrame:
    """Profiles: one row per fusion_id with all fused fields, ``provenance`` (an array by field) and scores.

    Arrays are built in steps, each a column of its own, so that no expression is repeated inside another.
    """
    unique = ["emails", "phones", "links", "experience", "education"]
    key = {"emails": "v", "phones": "v", "links": "url", "experience": "raw", "education": "raw"}
    method = {"emails": "email_normalize", "phones": "phone_e164", "skills": "skill_normalize", "experience": "experience_merge", "education": "education_merge"}
    step = gather(records)
    step = step.select("fusion_id", "recs", *(c.alias(f"f_{f}") for f, c in _found().items()))

    def of(field):
        return first_by(F.col(f"f_{field}"), lambda x: x[key[field]])

    def scored(field, c, value):
        return F.transform(c, lambda x: x.withField("c", score.field_confidence(field, x[value], x["source"])))

    step = step.withColumns(
        {f"n_{f}": of(f) for f in unique}
        | {f"n_{f}": scored(f, F.filter(f"f_{f}", lambda x: x["v"].isNotNull() & (x["v"] != "")), "v") for f in SCALARS}
        | {"n_skills": scored("skills", F.col("f_skills"), "v")}
    )
    step = step.withColumn("by_name", grouped_by(F.col("n_skills"), lambda x: F.lower(x["v"])))
    step = step.withColumn("ranked", F.array_sort(F.transform("by_name", _skill)))  # by sources, confidence and place, which is its own

    def entries(field):
        c = F.col(f"n_{field}")
        if field in SCALARS:
            return F.transform(c, lambda x: _entry(x["source"], "direct_field", x["raw"], x["c"]))
        if field in ("emails", "phones"):
            return F.transform(c, lambda x: _entry(x["source"], method[field], x["raw"], score.field_confidence(field, x["v"], x["source"])))
        if field == "skills":
            return F.transform(c, lambda x: _entry(x["source"], method[field], x["raw"], x["c"]))
        return F.transform(c, lambda x: _entry(x["source"], method[field], x["raw"], F.lit(ENTRY_CONFIDENCE)))

    told = [*SCALARS, *method]
    step = step.withColumns({f"e_{f}": entries(f) for f in told})

    def account(field):
        mine = F.col(f"e_{field}")
        if field in SCALARS:
            # the winner is the best source with a raw value, scored with the value that was picked
            source = _first(f"f_{field}")["source"]
            confidence = score.field_confidence(field, _first(f"n_{field}")["v"], source)
        elif field in ("emails", "phones"):
            # the field is scored by how many values it has, each entry by its own text
            source = _first(mine)["source"]
            confidence = score.list_confidence(field, F.size(mine), source)
        else:
            confidence = F.array_max(F.transform(mine, lambda e: e["confidence"]))
            source = let(confidence, lambda top: _first(F.filter(mine, lambda e: e["confidence"] == top))["source"])
        n = F.size(F.array_distinct(F.transform(mine, lambda e: e["source"])))
        return F.when(F.size(mine) > 0, F.struct(F.lit(field).alias("field"), source.alias("selected_source"), confidence.alias("confidence"), score.by_source_count(confidence, n).alias("adjusted"), n.alias("n_sources"), mine.alias("entries")))

    step = step.withColumns({f"p_{f}": account(f) for f in told})
    ats = _first(F.filter("recs", lambda r: r["source"] == "ats"))["candidate_id"]
    values = {
        "full_name": _first("n_full_name")["v"], "emails": F.transform("n_emails", lambda x: x["v"]), "phones": F.transform("n_phones", lambda x: x["v"]), "location": _first("n_location")["v"],
        "links": F.col("n_links"), "headline": _first("n_headline")["v"], "years_experience": N.years(_first("n_years_experience")["v"]), "skills": F.transform("ranked", lambda x: x["x"]),
        "experience": _latest_first(F.col("n_experience"), "start_date"), "education": _latest_first(F.col("n_education"), "end_date"),
    }
    seed = F.coalesce(_first("n_emails")["v"], _first("n_full_name")["v"], "fusion_id")
    return step.select(
        "fusion_id", F.coalesce(blank_to_null(ats), entity_id(seed)).alias("candidate_id"), *(c.alias(f) for f, c in values.items()),
        F.array_compact(F.array(*(F.col(f"p_{f}") for f in told))).alias("provenance"), F.transform("recs", lambda r: r["source"]).alias("sources"),
        score.overall({f: F.col(f"p_{f}.adjusted") for f in WEIGHTS}, F.size("recs")).alias("overall_confidence"),
    )


def spread(profiles: DataFrame, field: str) -> DataFrame:
    """(fusion_id, ord, x): the elements of a field.

    An inner explode would have the optimiser repeat the field's whole expression in a filter; an outer one does not.
    """
    return profiles.select("fusion_id", F.posexplode_outer(field).alias("ord", "x")).where("ord is not null").withColumn("ord", F.col("ord").cast("long"))


def provenance_rows(profiles: DataFrame) -> DataFrame:
    """fusion_id, field, selected_source, ord, source, method, raw_value, confidence: every value considered."""
    fields = spread(profiles, "provenance").select("fusion_id", F.col("x.field").alias("field"), F.col("x.selected_source").alias("selected_source"), F.col("x.entries").alias("entries"))
    return fields.select("fusion_id", "field", "selected_source", F.posexplode_outer("entries").alias("ord", "e")).select("fusion_id", "field", "selected_source", "ord", "e.*")


def conflict_log(profiles: DataFrame) -> DataFrame:
    """Fields with more than one entry."""
    fields = spread(profiles, "provenance").where(F.size("x.entries") > 1)
    return fields.select("fusion_id", F.col("x.field").alias("field"), F.size("x.entries").alias("n_values"), F.col("x.selected_source").alias("selected_source"))
