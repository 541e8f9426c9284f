"""Résumé text: sections, contacts, entries of sections, years of experience.  All of it is expressions over one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ResumeError
from ..functions import normalize as N
from ..functions.lookups import DEGREE_IN_TEXT, GPA_IN_TEXT, MAIL_IN_TEXT, PHONE_IN_TEXT, RANGE_IN_TEXT, ROLES, SECTIONS, URL_IN_TEXT, YEARS_IN_TEXT
from ..functions.text import blank_to_null, entity_id, let, split_multi, strip
from .files import exists

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
HEADER = "_header"


def heading(line: Column) -> Column:
    """Section that a line names, or null."""
    s = F.regexp_replace(strip(F.lower(line)), ":+$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for name, words in SECTIONS.items() for w in words for x in (w, name)]), s)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, LINE_END)).alias("pos", "line"))


def sections(rows: DataFrame, key: str) -> DataFrame:
    """Lines (key, pos, line) with the section they are in; ``_header`` before the first heading, headings left out."""
    named = rows.withColumn("heading", heading(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return named.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit(HEADER))).where("heading is null").drop("heading")


def segmented(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a text column for each section and the header, null where there is none.

    Stretches between headings are cut out of the row's own lines, so nothing is shuffled.
    """
    places = F.filter(F.transform("_lines", lambda x, i: F.struct(heading(x).alias("name"), i.alias("at"))), lambda x: x["name"].isNotNull())
    marks = F.concat(F.array(F.struct(F.lit(HEADER).alias("name"), F.lit(-1).alias("at"))), F.col("_places"))
    body = lambda m, k: F.struct(
        m["name"].alias("name"), F.slice("_lines", m["at"] + 2, F.coalesce(F.get("_marks", k + 1)["at"], F.size("_lines")) - m["at"] - 1).alias("body")
    )
    of = lambda name: F.filter("_parts", lambda p: p["name"] == name)
    # a section counts once it has a line, blank or not
    whole = lambda name: let(F.flatten(F.transform(of(name), lambda p: p["body"])), lambda b: F.when(F.size(b) > 0, F.array_join(b, "\n")))
    step = docs.withColumn("_lines", F.split(text, LINE_END)).withColumn("_places", places).withColumn("_marks", marks).withColumn("_parts", F.transform("_marks", body))
    return step.withColumns({name: whole(name) for name in (HEADER, *SECTIONS)}).drop("_lines", "_places", "_marks", "_parts")


def link_label(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("github.com"), "GitHub").when(low.contains("linkedin.com"), "LinkedIn").when(low.contains("gitlab.com"), "GitLab").otherwise("Link")


def scan(text: Column) -> dict[str, Column]:
    """Emails, phones and links found anywhere in a text."""
    found = lambda p: F.regexp_extract_all(text, F.lit(p), F.lit(0))
    some = lambda c: F.array_distinct(F.filter(c, lambda x: x.isNotNull()))
    urls = some(F.transform(found(URL_IN_TEXT), lambda u: N.url(F.regexp_replace(u, r"^\.+|\.+$", ""))))
    return {
        "emails": some(F.transform(found(MAIL_IN_TEXT), N.email)), "phones": some(F.transform(found(PHONE_IN_TEXT), lambda x: N.phone(strip(x)))),
        "links": F.transform(urls, lambda u: F.struct(u.alias("url"), link_label(u).alias("label"))),
    }


def _filled(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def _words(line: Column) -> Column:
    return F.size(F.split(line, r"(?U)\s+"))


def _contact(line: Column) -> Column:
    return line.rlike(MAIL_IN_TEXT) | line.rlike(URL_IN_TEXT)


def name_of(header: Column) -> Column:
    """First of six filled lines that looks like a name: two to five words of letters, no contact, no long number."""
    fits = lambda x: ~_contact(x) & ~x.rlike(r"\d{5,}") & x.rlike(r"^[A-Za-z\-'.]+(?:\s+[A-Za-z\-'.]+){1,4}$")
    return N.name(F.get(F.filter(F.slice(_filled(header), 1, 6), fits), F.lit(0)))


def headline_of(header: Column, name: Column) -> Column:
    """First of eight lines with the noun of a role, ten words at most, that is neither the name nor a contact."""
    # the name is compared last, as most lines have no role
    fits = lambda x, n: x.rlike(rf"(?i)\b(?:{ROLES})\b") & ~_contact(x) & ~x.rlike(PHONE_IN_TEXT) & (_words(x) <= 10) & ~F.coalesce(N.name(x) == n, F.lit(False))
    return let(name, lambda n: F.get(F.filter(F.slice(_filled(header), 1, 8), lambda x: fits(x, n)), F.lit(0)))


def location_of(header: Column) -> Column:
    """First of ten lines of the form ``Words, words``, six words at most."""
    fits = lambda x: ~_contact(x) & x.rlike(r"^[A-Za-z\s]+,\s*[A-Za-z\s]+$") & (_words(x) <= 6)
    return N.location(F.get(F.filter(F.slice(_filled(header), 1, 10), fits), F.lit(0)))


def skills_of(text: Column) -> Column:
    """Parts between bullets, hyphens, bars, commas and line ends, of 2 to 39 characters, that do not begin with a year."""
    ok = lambda x: (F.length(x) > 1) & (F.length(x) < 40) & ~x.rlike(r"^\d{4}")
    return F.array_distinct(F.transform(F.filter(split_multi(text, r"[•\-|,\n\r]+"), ok), N.skill))


def _blocks(text: Column) -> Column:
    """Filled lines of each block between blank lines."""
    whole = F.filter(F.transform(F.split(strip(text), r"\n{2,}"), strip), lambda b: F.length(b) >= 5)
    return F.transform(whole, lambda b: F.struct(b.alias("block"), _filled(b).alias("rows")))


def _dates(block: Column) -> tuple[Column, Column]:
    """(start, end) as written, of the first range of dates."""
    return tuple(blank_to_null(F.regexp_extract(block, RANGE_IN_TEXT, k)) for k in (1, 2))


def _without_year(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"\s*\d{4}.*", ""))


def experience_of(text: Column) -> Column:
    """Entries between blank lines: title and company in the first line or the first two, dates anywhere, the rest as description."""

    def entry(b):
        rows = b["rows"]
        start, end = _dates(b["block"])
        second = F.when(~F.get(rows, F.lit(1)).rlike(RANGE_IN_TEXT), _without_year(F.get(rows, F.lit(1))))
        rest = F.filter(F.slice(rows, 3, F.greatest(F.size(rows), F.lit(1))), lambda x: ~x.rlike(RANGE_IN_TEXT))
        company = lambda first: F.coalesce(blank_to_null(first), second, first)
        return let(
            F.split(F.get(rows, F.lit(0)), r"\s+(?:at|@|–|-)\s+|\s*\|\s*", 2),
            lambda head: F.struct(
                strip(F.get(head, F.lit(0))).alias("title"), let(_without_year(F.get(head, F.lit(1))), company).alias("company"), N.date(start).alias("start_date"), N.date(end).alias("end_date"),
                let(F.array_join(rest, " "), blank_to_null).alias("description"), F.lit(None).cast("string").alias("location"),
            ),
        )

    kept = lambda x: (F.coalesce(x["title"], F.lit("")) != "") | (F.coalesce(x["company"], F.lit("")) != "")
    return F.filter(F.transform(_blocks(text), entry), kept)


def education_of(text: Column) -> Column:
    """Entries between blank lines; the first three lines tell degree, field and institution."""
    nothing = F.lit(None).cast("string")
    blank = F.struct(nothing.alias("institution"), nothing.alias("degree"), nothing.alias("field"))

    def with_degree(a, line, found):
        after = strip(F.regexp_replace(strip(F.regexp_extract(line, DEGREE_IN_TEXT + "(.*)$", 2)), "^[in]+", ""))
        field = let(after, lambda x: F.when((x != "") & ~x.rlike(r"^\d"), strip(F.get(F.split(x, ","), F.lit(0)))))
        return F.struct(a["institution"].alias("institution"), found.alias("degree"), F.coalesce(field, a["field"]).alias("field"))

    def without_degree(a, line):
        names = (F.coalesce(a["institution"], F.lit("")) == "") & (_words(line) >= 2) & ~line.rlike(RANGE_IN_TEXT)
        return F.struct(F.when(names, _without_year(line)).otherwise(a["institution"]).alias("institution"), a["degree"].alias("degree"), a["field"].alias("field"))

    def read(a, line):
        found = F.when(a["degree"].isNull(), F.regexp_extract(line, DEGREE_IN_TEXT, 0))
        return let(found, lambda x: F.when(x != "", with_degree(a, line, x)).otherwise(without_degree(a, line)))

    def entry(b):
        start, end = _dates(b["block"])
        return let(
            F.aggregate(F.slice(b["rows"], 1, 3), blank, read),
            lambda told: F.struct(
                told["institution"].alias("institution"), told["degree"].alias("degree"), told["field"].alias("field_of_study"), N.date(start).alias("start_date"),
                let(end, lambda e: F.when(~e.rlike("(?i)^(present|current|now)"), N.date(e))).alias("end_date"), F.regexp_extract(b["block"], GPA_IN_TEXT, 1).try_cast("double").alias("gpa"),
            ),
        )

    kept = lambda x: (F.coalesce(x["institution"], F.lit("")) != "") | x["degree"].isNotNull()
    return F.filter(F.transform(_blocks(text), entry), kept)


def experience_months(jobs: Column, as_of: str) -> Column:
    """Years of experience: months of all entries (open ones until ``as_of``, YYYY-MM), in years to one decimal, halves to even."""
    month = lambda c: F.substring(c, 1, 4).try_cast("int") * 12 + F.substring(c, 6, 2).try_cast("int")
    spans = F.transform(jobs, lambda j: month(F.when(F.coalesce(j["end_date"], F.lit("Present")) == "Present", F.lit(as_of)).otherwise(j["end_date"])) - month(j["start_date"]))
    total = F.aggregate(F.filter(spans, lambda m: (m > 0) & (m < 600)), F.lit(0), lambda a, m: a + m)
    return F.when(total > 0, F.bround(total / 12, 1))


def parse(docs: DataFrame, as_of: str = "2025-01", key: str = "doc_id") -> DataFrame:
    """Source records from (key, text)."""
    step = segmented(docs.select(F.col(key).cast("string").alias("fusion_id"), F.coalesce("text", F.lit("")).alias("text")))
    header = F.coalesce(F.col(HEADER), F.substring("text", 1, 1500))
    thin = F.size(F.filter(F.split(F.coalesce("skills", F.lit("")), r"\s+"), lambda x: x != "")) < 5
    found = scan(F.col("text"))
    none = lambda c: F.coalesce(c, F.filter(c, lambda x: F.lit(False)))
    step = step.withColumns(
        {
            "full_name": name_of(header), "location": location_of(header), "emails": found["emails"], "phones": found["phones"], "_links": found["links"],
            "_skills": skills_of(F.when(thin, F.concat(F.coalesce("skills", F.lit("")), F.lit("\n"), F.coalesce("summary", F.lit("")))).otherwise(F.col("skills"))),
            "_jobs": experience_of(F.coalesce("experience", F.lit(""))), "_studies": education_of(F.coalesce("education", F.lit(""))),
            "_stated": N.years(blank_to_null(F.regexp_extract(F.concat(F.coalesce("summary", F.lit("")), header), YEARS_IN_TEXT, 1))),
        }
    )
    return step.select(
        "fusion_id", F.lit("resume").alias("source"), F.lit(0).cast("long").alias("seq"), entity_id(F.coalesce(F.get("emails", F.lit(0)), "full_name")).alias("candidate_id"), "full_name", "emails", "phones", "location",
        headline_of(header, F.col("full_name")).alias("headline"), none(F.col("_skills")).alias("skills"), F.col("_links").alias("links"), F.col("_jobs").alias("experience"), F.col("_studies").alias("education"),
        F.coalesce(F.col("_stated"), experience_months(F.col("_jobs"), as_of)).cast("string").alias("years_experience"),
    )


def read(spark: SparkSession, path: str, as_of: str = "2025-01") -> DataFrame:
    """Source records of résumés in plain text, one to a file."""
    if not exists(spark, path):
        raise ResumeError(f"no résumé at {path}")
    docs = spark.read.text(path, wholetext=True).select(F.sha2(F.col("_metadata.file_path"), 256).alias("doc_id"), F.col("value").alias("text")).where(strip(F.col("value")) != "")
    if docs.isEmpty():
        raise ResumeError(f"no text in {path}")
    return parse(docs, as_of)
