"""Source records made from the star-schema tables, by one SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import JOB, LINK, STUDY

#: Flat records: lists are text with separators.  k is a customer's key plus the source's rank.
_RECORDS = """
SELECT 'C' || CAST(c_custkey AS STRING) AS fusion_id, source, prio,
  CASE WHEN source = 'ats' AND c_custkey % 3 <> 0 THEN 'A' || CAST(c_custkey AS STRING) END AS candidate_id,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 7 = 1 THEN '12345' WHEN k % 7 = 2 THEN '  mary-jane   o''neil ' ELSE lower(c_mktsegment) || ' ' || n_name || ' 3' END AS full_name,
  CASE WHEN k % 6 = 0 THEN 'NYC' WHEN k % 6 = 1 THEN NULL WHEN k % 6 = 2 THEN '' ELSE lower(n_name) || ' , india' END AS location,
  CASE WHEN k % 4 = 0 THEN NULL ELSE c_mktsegment || ' engineer' END AS headline,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN '5+ years' WHEN k % 5 = 2 THEN '3-5' WHEN k % 5 = 3 THEN 'none' ELSE CAST(c_custkey % 70 AS STRING) END AS years_experience,
  CASE WHEN k % 8 = 0 THEN NULL ELSE ' User' || CAST(c_custkey % 9 AS STRING) || '@Example.com;broken@;p' || CAST(k % 3 AS STRING) || '@mail.org' END AS emails,
  CASE WHEN k % 5 = 4 THEN NULL ELSE '+91 98765-4' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0') || ';98765 4000' || CAST(k % 10 AS STRING) || ';+1 (212) 555-010' || CAST(prio AS STRING) || ';12' END AS phones,
  CASE WHEN k % 9 = 0 THEN NULL ELSE 'py;k8s;' || CASE WHEN k % 2 = 0 THEN 'Python;sql' ELSE 'REST;data lakes' END || CASE WHEN k % 3 = 0 THEN ';machine learning;ML' ELSE ';o''reilly x2y' END END AS skills,
  CASE WHEN k % 4 = 1 THEN NULL ELSE 'example.com/u' || CAST(c_custkey AS STRING) || '|Site;https://example.com/u' || CAST(c_custkey AS STRING) || '|Again;nothing|None' END AS links,
  CASE WHEN k % 5 = 1 THEN NULL ELSE 'Engineer|Acme|' || CAST(2010 + k % 9 AS STRING) || '|Present;Lead|' || c_mktsegment || '|0' || CAST(1 + k % 9 AS STRING) || '/2015|' || CAST(2016 + k % 3 AS STRING) || '/2;Clerk|Other||' END AS experience,
  CASE WHEN k % 6 = 5 THEN NULL ELSE n_name || ' university|BSc|2008|' || CAST(2012 + k % 2 AS STRING) || '|' || CAST(k % 3 AS STRING) || ';Open school|MSc|2013|2015|8' END AS education
FROM (SELECT c.*, n.n_name, s.source, s.prio, c_custkey + s.prio AS k FROM customer c {nation} nation n ON c.c_nationkey = n.n_nationkey
  JOIN (VALUES ('resume', 0), ('ats', 1), ('github', 2), ('csv', 3)) AS s(source, prio) ON {told}) t
"""

#: Four in five pairs of a customer and a source, of customers with a nation.
RECORDS = _RECORDS.format(nation="JOIN", told="(c_custkey + s.prio) % 5 <> 0")

#: All sources of every customer, whatever the nation; without a key there is no entity.
ALL_RECORDS = _RECORDS.format(nation="LEFT JOIN", told="c_custkey IS NOT NULL")


#: Rows of a task: at most, and at least while cores are idle.
MOST_ROWS, LEAST_ROWS = 5_000, 500


#: A customer's entity, as RECORDS writes it.
ENTITY = "'C' || CAST(c_custkey AS STRING)"


def dealt(rows: DataFrame, key: Column) -> DataFrame:
    """Rows with a unique key, dealt to tasks of a bounded number of rows.

    A file of one row group is read by one task however large it is; what is made of its rows would all be that task's work and memory.
    """
    n = rows.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(1, -(-n // MOST_ROWS), min(cores, n // LEAST_ROWS)), key)


def _views(spark, sf_dir: str) -> None:
    """The tables that the SQL texts read.

    Customers are dealt by the entity of their records: these then lie together already, so the merge groups them in the tasks
    that make them, however many shuffle partitions a session has.
    """
    dealt(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.expr(ENTITY)).createOrReplaceTempView("customer")
    spark.read.parquet(f"{sf_dir}/nation.parquet").createOrReplaceTempView("nation")


def flat_records(spark, sf_dir: str, records: str = RECORDS) -> DataFrame:
    _views(spark, sf_dir)
    return spark.sql(records)


def _items(c: str, struct: str):
    """Structs from text like a|b;c|d; blank parts are null."""
    names = [x.split(":")[0] for x in struct[len("struct<") : -1].split(",")]
    types = [x.split(":")[1] for x in struct[len("struct<") : -1].split(",")]
    at = lambda x, i: F.nullif(F.get(F.split(x, r"\|"), F.lit(i)), F.lit(""))
    return lambda order: F.transform(F.split(c, ";"), lambda x: F.struct(*((at(x, order.index(n)) if n in order else F.lit(None).cast("string")).cast(t).alias(n) for n, t in zip(names, types))))


def source_records(spark, sf_dir: str, records: str = RECORDS) -> DataFrame:
    """The flat records with arrays and structs."""
    flat = flat_records(spark, sf_dir, records)
    return flat.select(
        "fusion_id", "source", F.lit(0).cast("long").alias("seq"), "candidate_id", "full_name", F.split("emails", ";").alias("emails"), F.split("phones", ";").alias("phones"),
        "location", "headline", F.split("skills", ";").alias("skills"), _items("links", LINK)(["url", "label"]).alias("links"),
        _items("experience", JOB)(["title", "company", "start_date", "end_date"]).alias("experience"),
        _items("education", STUDY)(["institution", "degree", "start_date", "end_date", "gpa"]).alias("education"), "years_experience",
    )


def _parts(c: str, names: list[str]):
    """Structs of text parts from a|b;c|d; blank parts are null."""
    at = lambda x, i: F.nullif(F.get(F.split(x, r"\|"), F.lit(i)), F.lit(""))
    return F.transform(F.split(c, ";"), lambda x: F.struct(*(at(x, i).alias(n) for i, n in enumerate(names))))


def exports(spark, sf_dir: str) -> DataFrame:
    """The records of source ats as JSON exports of three shapes, by the key's remainder by 3."""
    r = flat_records(spark, sf_dir).where("source = 'ats'").withColumn("k", F.substring("fusion_id", 2, 20).cast("long") % 3)
    mails, phones, skills = (F.split(c, ";") for c in ("emails", "phones", "skills"))
    named = lambda c, n: F.transform(c, lambda x: F.struct(x.alias(n)))
    ident = F.concat(F.lit("A"), F.col("fusion_id"))
    shapes = [
        F.struct(F.struct(ident.alias("id"), F.col("full_name"), named(mails, "value").alias("emails"), F.col("phones").alias("phone"), F.struct(F.col("location").alias("city")).alias("location"), F.col("headline"), named(skills, "name").alias("skills"),
                          _parts("experience", ["title", "company", "start_date", "end_date"]).alias("experience"), _parts("education", ["institution", "degree", "start_date", "end_date", "gpa"]).alias("education"), F.col("years_experience")).alias("candidate")),
        F.struct(ident.alias("applicantId"), F.col("full_name").alias("name"), mails.alias("emailAddresses"), named(phones, "number").alias("phoneNumbers"), F.col("location").alias("current_location"), F.col("headline").alias("jobTitle"), F.array_join(skills, ", ").alias("skills"),
                 _parts("experience", ["role", "employer", "startDate", "to"]).alias("workExperience"), _parts("education", ["school", "qualification", "startDate", "graduation_date", "grade"]).alias("qualifications"), F.col("years_experience").alias("yearsOfExperience")),
        F.struct(F.struct(ident.alias("candidate_id"), F.col("full_name").alias("display_name"), F.get(mails, F.lit(0)).alias("email"), phones.alias("phones"), F.col("location").alias("address"), F.col("headline").alias("title"), skills.alias("tags"),
                          _parts("experience", ["job_title", "organization", "from", "endDate"]).alias("jobs"), _parts("education", ["university", "degree_type", "start_date", "graduationDate", "gpa"]).alias("education"), F.col("years_experience").alias("experienceYears")).alias("data")),
    ]
    return r.select(F.coalesce(*(F.when(F.col("k") == i, F.to_json(x)) for i, x in enumerate(shapes))).alias("value"))


#: Texts of résumés, with the values they are made of.  One in three has no blank line between jobs and one no stated years.
RESUMES = """
SELECT c_custkey AS doc_id, c_custkey % 3 AS k, lower(c_mktsegment) || ' ' || translate(lower(n_name), '_ 0123456789', '--abcdefghij') AS person, 'u' || CAST(c_custkey AS STRING) || '@Example.com' AS mail,
  '+91 9' || lpad(CAST(c_custkey % 1000000000 AS STRING), 9, '0') AS phone, translate(lower(n_name), '_0123456789', ' abcdefghij') || ', India' AS place, 'Senior ' || c_mktsegment || ' engineer' AS role,
  CAST(2000 + c_custkey % 7 AS STRING) AS y1, CAST(2008 + c_custkey % 5 AS STRING) AS y2, CAST(1 + c_custkey % 12 AS STRING) AS m
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""


def resumes(spark, sf_dir: str) -> DataFrame:
    """(doc_id, text)"""
    _views(spark, sf_dir)
    c = F.col
    glue = lambda *parts: F.concat(*(F.lit(p[1:]) if p.startswith("~") else c(p) for p in parts))
    jobs = F.concat(
        glue("~Data Engineer at Acme ", "y1", "~\n", "m", "~/", "y1", "~ - ", "m", "~/", "y2", "~\nbuilt things\nfor many"), F.when(c("k") == 1, "\n").otherwise("\n\n"),
        glue("~Lead | Other Inc\n", "y2", "~ to Present\nran it\n"),
    )
    return spark.sql(RESUMES).select(
        "doc_id",
        F.concat(
            glue("person", "~\n", "mail", "~ | ", "phone", "~ | https://github.com/u.\n", "role", "~\n", "place", "~\n\nPROFILE\n"), F.when(c("k") == 2, "plain words").otherwise(glue("m", "~+ years of experience")),
            F.lit("\n\nTechnical Skills:\nTools: py, SQL | k8s\n• data lakes - go\n2019 dates\n\nWORK EXPERIENCE\n"), jobs,
            glue("~\nEDUCATION\nB.Tech in Computer Science, honours\nOpen University of ", "place", "~ ", "y1", "~\n", "y1", "~ - ", "y2", "~\nGPA: 8.", "m", "~\n\nMIT Boston\nMaster of Arts\n"),
        ).alias("text"),
    )
