"""Exports of applicant tracking systems: JSON objects whose keys and shapes differ from one to the next.

A document is a VARIANT, so one key may hold text in one and a list or an object in another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AtsError
from ..functions import normalize as N
from ..functions.lookups import ATS_KEYS, JOB_KEYS, STUDY_KEYS, WRAPPERS
from ..functions.text import bind, blank_to_null, coerce, entity_id, first_by, let, let_sql, quoted, split_multi, strip
from ..schema import JOB, STUDY
from .files import exists


def _sql_is(v: str, kind: str) -> str:
    return f"coalesce(startswith(schema_of_variant({v}), '{kind}'), false)"


def _sql_text(v: str) -> str:
    return f"CASE WHEN NOT {_sql_is(v, 'ARRAY')} AND NOT {_sql_is(v, 'OBJECT')} THEN try_cast({v} AS STRING) END"


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _key(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _sql_key(name: str, kind: str = "variant") -> str:
    return f"try_variant_get(x, {quoted('$.' + name)}, '{kind}')"


def first_of(v: Column, keys: list[str]) -> Column:
    """The first key's value that is there and not JSON's null; blank text counts."""
    return let_sql(v, f"coalesce({', '.join(bind('found', _sql_key(k), 'CASE WHEN NOT is_variant_null(found) THEN found END') for k in keys)})")


def text(v: Column) -> Column:
    """Text, number or truth value as text; null for lists and objects."""
    return let_sql(v, _sql_text("x"))


def _some_text(v: Column, keys: list[str]) -> Column:
    """The first key's text that is not blank; of an object its name."""
    told = "CASE WHEN startswith(kind, 'OBJECT') THEN try_variant_get(found, '$.name', 'string') WHEN NOT startswith(kind, 'ARRAY') THEN try_cast(found AS STRING) END"
    filled = bind("told", bind("kind", "schema_of_variant(found)", told), "CASE WHEN told != '' THEN told END")
    some = lambda k: bind("found", _sql_key(k), f"CASE WHEN found IS NOT NULL THEN {filled} END")
    return let_sql(v, f"coalesce({', '.join(map(some, keys))})")


def items(v: Column) -> Column:
    """A list's items; one item for anything else, none for null."""
    listed = F.try_variant_get(v, "$", "array<variant>")
    return F.when(v.isNull(), F.array().cast("array<variant>")).when(_is(v, "ARRAY"), F.coalesce(listed, F.array().cast("array<variant>"))).otherwise(F.array(v))


def values(v: Column, keys: list[str], pattern: str, every: bool = False) -> Column:
    """Texts of a text (parted by ``pattern``), or of a list of texts and objects that have one of the keys; every: listed texts are parted too."""
    plain = lambda x: F.coalesce(split_multi(text(x), pattern), F.array().cast("array<string>")) if every else F.array(text(x))
    listed = lambda v: F.flatten(F.transform(items(v), lambda x: F.when(_is(x, "OBJECT"), F.array(_some_text(x, keys))).otherwise(plain(x))))
    some = lambda v: F.filter(F.transform(listed(v), strip), lambda x: F.coalesce(x, F.lit("")) != "")
    return let(v, lambda v: F.when(_is(v, "ARRAY"), some(v)).when(~_is(v, "OBJECT") & v.isNotNull(), split_multi(text(v), pattern)).otherwise(F.array().cast("array<string>")))


def place(v: Column) -> Column:
    """A text, or an object's city, state and country."""
    parts = lambda v: F.concat_ws(", ", _some_text(v, ["city", "locality"]), _some_text(v, ["state", "region"]), _some_text(v, ["country"]))
    return let(let(v, lambda v: F.when(_is(v, "OBJECT"), parts(v)).otherwise(text(v))), blank_to_null)


def _links(v: Column) -> Column:
    short = F.array(*(F.struct(N.url(text(first_of(v, ATS_KEYS[k]))).alias("url"), F.lit(label).alias("label")) for k, label in (("linkedin", "LinkedIn"), ("github", "GitHub"), ("portfolio", "Portfolio"))))
    listed = F.transform(
        let(first_of(v, ATS_KEYS["links"]), items),
        lambda x: F.struct(N.url(F.coalesce(text(x), _some_text(x, ["url", "href", "link"]))).alias("url"), F.coalesce(F.when(_is(x, "OBJECT"), _some_text(x, ["label", "type", "name"])), F.lit("Link")).alias("label")),
    )
    return first_by(F.filter(F.concat(short, listed), lambda x: x["url"].isNotNull()), lambda x: x["url"])


def _entries(v: Column, make) -> Column:
    """Entries made of a list's objects; anything but a list has none."""
    return let(v, lambda v: F.when(_is(v, "ARRAY"), F.transform(F.filter(items(v), lambda x: _is(x, "OBJECT")), make)))


def _jobs(v: Column) -> Column:
    def job(x):
        part = {k: coerce(_some_text(x, keys)) for k, keys in JOB_KEYS.items()}
        now = lambda k: F.coalesce(_key(x, k, "boolean"), F.lit(False))
        part |= {"start_date": N.date(part["start_date"]), "end_date": F.when(now("current") | now("is_current"), F.lit("Present")).otherwise(N.date(part["end_date"]))}
        part["location"] = N.location(part["location"])
        return F.struct(*(c.alias(k) for k, c in part.items()))

    return F.coalesce(F.filter(_entries(v, job), lambda x: x["title"].isNotNull() | x["company"].isNotNull()), F.array().cast(f"array<{JOB}>"))


def _studies(v: Column) -> Column:
    def study(x):
        part = {k: coerce(_some_text(x, keys)) for k, keys in STUDY_KEYS.items()}
        part |= {k: N.date(part[k]) for k in ("start_date", "end_date")} | {"gpa": part["gpa"].try_cast("double")}
        return F.struct(*(c.alias(k) for k, c in part.items()))

    return F.coalesce(F.filter(_entries(v, study), lambda x: x["institution"].isNotNull()), F.array().cast(f"array<{STUDY}>"))


def parse(docs: DataFrame, column: str = "value") -> DataFrame:
    """Source records from texts of one JSON object each; others are left out (``broken`` has them).

    fusion_id: the export's id, else made from the first email or the name.
    """
    whole = docs.select(F.monotonically_increasing_id().alias("seq"), F.try_parse_json(column).alias("v")).where(_is(F.col("v"), "OBJECT"))
    inner = F.coalesce(*(F.when(_is(_key(F.col("v"), k), "OBJECT"), _key(F.col("v"), k)) for k in WRAPPERS), F.col("v"))
    v = F.col("v")
    pick = lambda field: first_of(v, ATS_KEYS[field])
    plain = lambda field: text(pick(field))
    normal = lambda c, f: F.array_distinct(F.filter(F.transform(c, f), lambda x: x.isNotNull()))
    composed = let(F.concat_ws(" ", coerce(plain("first")), coerce(plain("last"))), blank_to_null)
    name = N.name(let(plain("full_name"), lambda x: F.when(F.coalesce(x, F.lit("")) != "", coerce(x)).otherwise(composed)))
    return whole.select("seq", inner.alias("v")).select(
        "seq", coerce(plain("candidate_id")).alias("candidate_id"), name.alias("full_name"), normal(values(pick("emails"), ["value", "email", "address"], r"[;|,\s]+", every=True), N.email).alias("emails"),
        normal(values(pick("phones"), ["value", "number", "phone"], r"[;|]"), lambda x: N.phone(x)).alias("phones"), N.location(coerce(place(pick("location")))).alias("location"), coerce(plain("headline")).alias("headline"),
        normal(values(pick("skills"), ["name", "skill", "value"], r"[;|,]"), N.skill).alias("skills"), _links(v).alias("links"), _jobs(pick("experience")).alias("experience"), _studies(pick("education")).alias("education"), N.years(plain("years_experience")).cast("string").alias("years_experience"),
    ).select(F.coalesce("candidate_id", entity_id(F.coalesce(F.get("emails", F.lit(0)), "full_name"))).alias("fusion_id"), F.lit("ats").alias("source"), "seq", "candidate_id", "full_name", "emails", "phones", "location", "headline", "skills", "links", "experience", "education", "years_experience")


def broken(docs: DataFrame, column: str = "value") -> DataFrame:
    """Texts that are no JSON object."""
    return docs.where(~_is(F.try_parse_json(column), "OBJECT"))


def read(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Source records of JSON files of one object each, or of one on every line."""
    if not exists(spark, path):
        raise AtsError(f"no export at {path}")
    docs = spark.read.text(path, wholetext=not lines)
    if docs.where(_is(F.try_parse_json("value"), "OBJECT")).isEmpty():
        raise AtsError(f"no JSON object in {path}")
    return parse(docs)
