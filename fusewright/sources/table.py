"""Candidate tables in CSV: headers by alias, cells with several values, bad rows left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CsvError
from ..functions import normalize as N
from ..functions.lookups import HEADERS
from ..functions.text import coerce, entity_id, split_multi
from ..schema import JOB, STUDY
from .files import exists

EXTRA = "_extra"  # the text of a row that has not as many cells as the header
LINKS = {"linkedin": "LinkedIn", "github_url": "GitHub", "portfolio": "Portfolio"}


def field_of(header: str) -> str | None:
    """The field that a header means."""
    plain = header.strip().lower().replace("-", "_")
    return next((field for field, names in HEADERS.items() if plain == field or plain in names), None)


def parse(rows: DataFrame) -> DataFrame:
    """Source records from rows of text under the file's own headers, ``_row`` in order of the file.

    The last of several headers of one field counts; unknown ones are ignored.  Rows without a filled cell of
    a known field go.  fusion_id: the id's column if the table has one, else the first email or the name.
    """
    by_field = {field_of(c): c for c in rows.columns if c not in (EXTRA, "_row")}
    cell = lambda f: coerce(F.col(f"`{by_field[f]}`")) if f in by_field else F.lit(None).cast("string")
    fields = rows.select("_row", *(cell(f).alias(f) for f in HEADERS)).where(F.coalesce(*HEADERS).isNotNull())
    link = lambda f: F.struct(N.url(F.col(f)).alias("url"), F.lit(LINKS[f]).alias("label"))
    several = lambda f, pattern: F.coalesce(split_multi(F.col(f), pattern), F.array().cast("array<string>"))
    valid = lambda c, change: F.filter(F.transform(c, change), lambda x: x.isNotNull())
    none = lambda t: F.array().cast(f"array<{t}>")
    made = {
        "emails": valid(several("emails", r"[;|,\s]+"), N.email), "phones": valid(several("phones", r"[;|]"), lambda x: N.phone(x)), "full_name": N.name(F.col("full_name")), "location": N.location(F.col("location")),
        "years_experience": N.years(F.col("years_experience")).cast("string"), "skills": F.array_distinct(F.transform(several("skills", r"[;|,]"), N.skill)),
        "links": F.filter(F.array(*(link(f) for f in LINKS)), lambda x: x["url"].isNotNull()),
    }
    return fields.withColumns(made).select(
        F.coalesce("candidate_id", entity_id(F.coalesce(F.get("emails", F.lit(0)), "full_name"))).alias("fusion_id"), F.lit("csv").alias("source"), F.col("_row").alias("seq"), "candidate_id", "full_name", "emails", "phones", "location", "headline",
        "skills", "links", none(JOB).alias("experience"), none(STUDY).alias("education"), "years_experience",
    )


def _encodings(spark: SparkSession, path: str) -> list[tuple[str | list[str], str]]:
    """(path, encoding) of the files: those that are no UTF-8 are Latin-1."""
    seen = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.bool_and(F.is_valid_utf8("value")).alias("ok"))
    odd = {r.file: r.ok for r in seen.collect()}  # one row a file, as a listing has
    if all(odd.values()):
        return [(path, "UTF-8")]
    return [(files, e) for e, files in (("UTF-8", [f for f, ok in odd.items() if ok]), ("ISO-8859-1", [f for f, ok in odd.items() if not ok])) if files]


def read(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """Source records of the CSV files at a path, which share the header of the first.

    Short rows are filled up with nulls; rows with more cells than the header are left out, also when the cells too many are
    blank.  Without ``encoding`` files that are no UTF-8 are read as Latin-1.  multi_line: quoted cells may hold line ends; without it
    large files are split among tasks.
    """
    if not exists(spark, path):
        raise CsvError(f"no table at {path}")
    parts = []
    for files, e in [(path, encoding)] if encoding else _encodings(spark, path):
        reader = spark.read.option("encoding", e).option("multiLine", multi_line).option("escape", '"')
        header = reader.csv(files).first()
        names = [(c or "").lstrip("\ufeff") for c in header or ()]
        if not any(names):
            raise CsvError(f"no header in {path}")
        unique = [f"{i}" for i in range(len(names))]
        schema = ", ".join(f"`{c}` string" for c in [*unique, EXTRA])
        rows = reader.option("header", True).option("enforceSchema", True).option("columnNameOfCorruptRecord", EXTRA).schema(schema).csv(files)
        # a row of another length comes with its whole text: its commas outside quotes tell whether it is short or long
        cells = F.size(F.split(F.regexp_replace(EXTRA, '"(?:[^"]|"")*"', ""), ","))
        rows = rows.where(F.coalesce(cells, F.lit(0)) <= len(names))
        last = {field_of(n) or f"_other{i}": c for i, (n, c) in enumerate(zip(names, unique))}
        parts.append(parse(rows.select(F.monotonically_increasing_id().alias("_row"), *(F.col(c).alias(f) for f, c in last.items()))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
