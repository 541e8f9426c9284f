"""Queries of the fusion engine over the star-schema tables, each with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import normalize as N
from .functions import text as T
from .functions.lookups import MAIL_IN_TEXT, NANP, PHONES, PLACES, SKILLS
from .operators import merge as M
from .operators import score as S
from .operators.alias import canonical, unknown
from .operators.resolve import resolve
from .operators.validate import validate
from .plans import project as P
from .plans.sinks import manifest, publish, published, write_lines, write_text
from .sources import ats, profile, quarantine, resume, table
from .sources.files import scratch
from .synth import ALL_RECORDS, RECORDS, RESUMES, exports, flat_records, resumes, source_records

QUERIES, ORACLE_SQL = {}, {}
_TITLE = r"array_to_string(list_transform(regexp_extract_all({0}, '\p{{L}}+|\P{{L}}+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _title(x):
    return _TITLE.format(x)


def _strip(x):
    return _STRIP.format(x)


def _case(table, key):
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return f"CASE {key} " + " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items()) + " END"


_SKILL = lambda x: f"coalesce({_case(SKILLS, f'lower({_strip(x)})')}, {_title(_strip(x))})"
_PLACE = lambda x: f"CASE WHEN {x} <> '' THEN coalesce({_case(PLACES, f'lower({_strip(x)})')}, array_to_string(list_transform(string_split({_strip(x)}, ','), lambda p: {_title(_strip('p'))}), ', ')) END"
_NAME = lambda x: _title(f"nullif({_strip(rf'''regexp_replace(regexp_replace({x}, '[^a-zA-Z\s\-'']', '', 'g'), '\s+', ' ', 'g')''')}, '')")
_EMAIL = lambda x: rf"CASE WHEN regexp_matches(lower({_strip(x)}), '^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{{2,}}$') THEN lower({_strip(x)}) END"
_DIGITS = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _plan(code):
    """A regular expression for the national numbers of a plan."""
    parts = [(rule.split(":")[0], [int(n) for n in rule.split(":")[1].split("-")]) for rule in PHONES[code].split()]
    fourth = (NANP[1] - 2, f"[{NANP[2]}-9]")
    return "(" + "|".join(f"[{first}]" + (rf"\d{{{fourth[0]}}}{fourth[1]}\d{{{n[0] - NANP[1]}}}" if code == NANP[0] else rf"\d{{{n[0] - 1},{n[-1] - 1}}}") for first, n in parts) + ")"


_RULES = "|".join(code + _plan(code) for code in PHONES)
_HOME = _plan("91")
_PHONE = lambda x: rf"CASE WHEN {_strip(x)} LIKE '+%' THEN CASE WHEN regexp_matches({_DIGITS(x)}, '^({_RULES})$') THEN '+' || {_DIGITS(x)} END WHEN regexp_matches(regexp_replace({_DIGITS(x)}, '^0', ''), '^{_HOME}$') THEN '+91' || regexp_replace({_DIGITS(x)}, '^0', '') WHEN regexp_matches({_DIGITS(x)}, '^91{_HOME}$') THEN '+' || {_DIGITS(x)} END"
_YEARS = lambda x: rf"(list_transform([regexp_extract_all({x}, '\d+(?:\.\d+)?')], lambda n: CASE WHEN len(n) >= 2 THEN (n[1]::DOUBLE + n[2]::DOUBLE) / 2 WHEN len(n) = 1 THEN n[1]::DOUBLE END))[1]"
_DATE = lambda x: rf"CASE WHEN regexp_matches({x}, '^(present|current|now|ongoing|-+)$', 'i') THEN 'Present' WHEN regexp_matches({x}, '^\d{{4}}$') THEN {x} || '-01' WHEN regexp_matches({x}, '^\d{{1,2}}/\d{{4}}$') THEN split_part({x}, '/', 2) || '-' || lpad(split_part({x}, '/', 1), 2, '0') WHEN regexp_matches({x}, '^\d{{4}}/\d{{1,2}}$') THEN split_part({x}, '/', 1) || '-' || lpad(split_part({x}, '/', 2), 2, '0') ELSE strftime(coalesce(try_strptime({x}, '%Y-%m-%d'), try_strptime({x}, '%b %Y'), try_strptime({x}, '%B %-d, %Y')), '%Y-%m') END"
_BASE = "CASE source WHEN 'resume' THEN 0.92 WHEN 'ats' THEN 0.90 WHEN 'csv' THEN 0.80 WHEN 'github' THEN 0.86 ELSE 0.70 END::DOUBLE"
_R = f"WITH r AS ({RECORDS}) "


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(_R + f"SELECT fusion_id, source, {_NAME('full_name')} AS name, {_PLACE('location')} AS location, {_YEARS('years_experience')} AS years FROM r")
def norm_scalars(spark, sf_dir):
    return flat_records(spark, sf_dir).select("fusion_id", "source", N.name(F.col("full_name")).alias("name"), N.location(F.col("location")).alias("location"), N.years(F.col("years_experience")).alias("years"))


@query(_R + f", e AS (SELECT fusion_id, source, unnest(string_split(emails, ';')) AS raw FROM r) SELECT fusion_id, source, raw, {_EMAIL('raw')} AS email FROM e")
def norm_email(spark, sf_dir):
    return flat_records(spark, sf_dir).select("fusion_id", "source", F.explode(F.split("emails", ";")).alias("raw")).withColumn("email", N.email(F.col("raw")))


@query(_R + f", e AS (SELECT fusion_id, source, unnest(string_split(phones, ';')) AS raw FROM r) SELECT fusion_id, source, raw, {_PHONE('raw')} AS phone FROM e")
def norm_phone(spark, sf_dir):
    return flat_records(spark, sf_dir).select("fusion_id", "source", F.explode(F.split("phones", ";")).alias("raw")).withColumn("phone", N.phone(F.col("raw")))


@query(_R + f", e AS (SELECT fusion_id, source, unnest(string_split(skills, ';')) AS raw FROM r) SELECT fusion_id, source, raw, {_SKILL('raw')} AS skill FROM e")
def norm_skill(spark, sf_dir):
    return flat_records(spark, sf_dir).select("fusion_id", "source", F.explode(F.split("skills", ";")).alias("raw")).withColumn("skill", N.skill(F.col("raw")))


@query(f"WITH d AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y') WHEN 2 THEN strftime(o_orderdate, '%m/%Y') WHEN 3 THEN strftime(o_orderdate, '%b %Y') WHEN 4 THEN strftime(o_orderdate, '%B %-d, %Y') ELSE 'Present' END AS raw FROM orders) SELECT o_orderkey, {_DATE('raw')} AS month FROM d")
def norm_date(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 5, "Present")
    for i, f in enumerate(("yyyy-MM-dd", "yyyy", "MM/yyyy", "MMM yyyy", "MMMM d, yyyy")):
        raw = F.when(k == i, F.date_format("o_orderdate", f)).otherwise(raw)
    return _t(spark, sf_dir, "orders").select("o_orderkey", N.date(raw).alias("month"))


#: Spellings of a date made of y(ear), y2 (its last two digits), m(onth), d(ay) with zeros, m1 and d1 without, mon(th), weekday, ...
_SPELLINGS = [
    "y || '-' || m || '-' || d", "y || '/' || m || '/' || d", "y || '.' || m || '.' || d", "m || '/' || d || '/' || y", "m1 || '/' || d1 || '/' || y", "m || '-' || d || '-' || y", "m || '.' || d || '.' || y",
    "mon || ' ' || y", "month || ' ' || y", "month || ', ' || y", "mon || '. ' || d1 || ', ' || y", "month || ' ' || d1 || 'th, ' || y", "d1 || ' ' || month || ' ' || y", "d || '-' || mon || '-' || y", "d || mon || y",
    "upper(mon) || '-' || y", "lower(month) || ' ' || y", "y || ' ' || month", "y || '-' || m", "m || '-' || y", "m || ' ' || y", "mon || ' ' || d1 || ' ' || y2", "d1 || ' of ' || month || ', ' || y", "wd || ', ' || d || ' ' || mon || ' ' || y || ' 10:30:00 GMT'",
    "wday || ' ' || month || ' ' || d1 || ', ' || y || ' at 3 pm'", "y || m || d", "y || m || d || '101500'", "y || '-' || m || '-' || d || 'T23:59:59Z'", "y || '-' || m || '-' || d || ' 08:15:00.123'", "m || '/' || d || '/' || y2",
    "month", "wd || ' ' || mon", "y2 || '-' || mon || '-' || d", "'31 02 ' || y", "'somewhen ' || y", "y || '-13-45'", "mon || ' ' || d1 || ' ' || y || ' 7'", "'(' || y || ')'",
]
_READ = {30: "'2000-' || m", 31: "'2000-' || m", 32: "CASE WHEN y2::INT > 31 THEN y || '-' || m WHEN y2 <> '00' THEN '20' || d || '-' || m END"} | dict.fromkeys(range(33, 38), "NULL")
_SPELLED = "CASE o_orderkey % " + str(len(_SPELLINGS)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_SPELLINGS)) + " END"
_MEANT = "CASE o_orderkey % " + str(len(_SPELLINGS)) + " " + " ".join(f"WHEN {i} THEN {x}" for i, x in _READ.items()) + " ELSE y || '-' || m END"


@query(
    f"""WITH p AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%y') AS y2, strftime(o_orderdate, '%m') AS m, strftime(o_orderdate, '%d') AS d, strftime(o_orderdate, '%-m') AS m1, strftime(o_orderdate, '%-d') AS d1,
    strftime(o_orderdate, '%b') AS mon, strftime(o_orderdate, '%B') AS month, strftime(o_orderdate, '%a') AS wd, strftime(o_orderdate, '%A') AS wday FROM orders) SELECT o_orderkey, {_SPELLED} AS raw, {_MEANT} AS read_as FROM p"""
)
def norm_date_free(spark, sf_dir):
    """The dates of all orders, each in one of 38 spellings; six of them cannot be read or name no date."""
    form = lambda f: F.date_format("o_orderdate", f)
    parts = {"y": form("yyyy"), "y2": form("yy"), "m": form("MM"), "d": form("dd"), "m1": form("M"), "d1": form("d"), "mon": form("MMM"), "month": form("MMMM"), "wd": form("EEE"), "wday": form("EEEE")}
    raw = _t(spark, sf_dir, "orders").select("o_orderkey", *(v.alias(k) for k, v in parts.items())).select("o_orderkey", F.expr(_SPELLED).alias("raw"))
    return raw.withColumn("read_as", N.date(F.col("raw"), 2025))


@query(rf"""WITH p AS (SELECT c_custkey, [{", ".join(f"'{x}'" for x in PHONES)}][c_custkey % {len(PHONES)} + 1] AS code, sha256(c_custkey::VARCHAR) AS h FROM customer),
    n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '+' || code || ' ' END || '(' || translate(h, 'abcdef', '123456')[1:3] || ') ' || translate(h, 'abcdef', '123456')[4:5 + c_custkey % 8] AS raw FROM p)
    SELECT c_custkey, raw, {_PHONE("raw")} AS phone FROM n""")
def norm_phone_regions(spark, sf_dir):
    """Numbers under all calling codes, of five to twelve national digits; one in seven has no code."""
    k = F.col("c_custkey")
    digits = F.translate(F.sha2(k.cast("string"), 256), "abcdef", "123456")
    code = F.get(F.array(*map(F.lit, PHONES)), (k % len(PHONES)).cast("int"))
    raw = F.concat(F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("+"), code, F.lit(" "))), F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substr(digits, F.lit(4), (k % 8 + 2).cast("int")))
    return _t(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("phone", N.phone(F.col("raw")))


@query(f"SELECT p_partkey, {_title('p_name')} AS titled, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\\w\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-+', '-', 'g')) AS slug, CASE WHEN length(p_name) > 12 THEN left(p_name, 9) || '...' ELSE p_name END AS short, sha256(p_name)[1:16] AS id, CASE WHEN lower(p_brand) IN ('nan', 'none', 'null', 'n/a', 'na', '-', '') THEN NULL ELSE p_brand END AS brand FROM part")
def string_functions(spark, sf_dir):
    c = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", T.title(c).alias("titled"), T.slugify(c).alias("slug"), T.truncate(c, 12).alias("short"), T.entity_id(c).alias("id"), T.coerce(F.col("p_brand")).alias("brand"))


@query(rf"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '{MAIL_IN_TEXT}'), lambda x: lower(x)))) AS email FROM documents")
def scan_emails(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(resume.scan(F.col("text"))["emails"]).alias("email"))


@query(rf"WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\+?[\d\-()\s]{{7,16}}')) AS raw FROM documents) SELECT DISTINCT doc_id, phone FROM (SELECT doc_id, {_PHONE('raw')} AS phone FROM p) WHERE phone IS NOT NULL")
def scan_phones(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.explode(resume.scan(F.col("text"))["phones"]).alias("phone"))


_LABEL = "CASE WHEN contains(lower(url), 'github.com') THEN 'GitHub' WHEN contains(lower(url), 'linkedin.com') THEN 'LinkedIn' WHEN contains(lower(url), 'gitlab.com') THEN 'GitLab' ELSE 'Link' END"
_URL = "CASE WHEN regexp_matches({0}, '^https?://') THEN {0} WHEN contains({0}, '.') THEN 'https://' || {0} END"


@query(rf"""WITH u AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)(?:https?://|www\.)[^\s)\],"'']+|(?:linkedin\.com|github\.com|gitlab\.com)[^\s)\],"'']*')) AS found FROM pages),
    t AS (SELECT page_id, regexp_replace(found, '^\.+|\.+$', '', 'g') AS found FROM u), n AS (SELECT DISTINCT page_id, {_URL.format('found')} AS url FROM t) SELECT page_id, url, {_LABEL} AS label FROM n WHERE url IS NOT NULL""")
def scan_urls(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.explode(resume.scan(F.col("html"))["links"]).alias("x")).select("page_id", "x.url", "x.label")


@query(f"SELECT page_id, {_URL.format('url')} AS url, {_LABEL} AS label FROM pages")
def norm_url(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", N.url(F.col("url")).alias("url"), resume.link_label(F.col("url")).alias("label"))


@query(_R + f", e AS (SELECT fusion_id, source, i, {_SKILL('raw')} AS v FROM (SELECT fusion_id, source, unnest(string_split(skills, ';')) AS raw, generate_subscripts(string_split(skills, ';'), 1) AS i FROM r)), f AS (SELECT fusion_id, source, arg_min(v, i) AS v, min(i) AS i FROM e GROUP BY fusion_id, source, lower(v)) SELECT fusion_id, source, skills FROM (SELECT fusion_id, source FROM r) LEFT JOIN (SELECT fusion_id, source, string_agg(v, ',' ORDER BY i) AS skills FROM f GROUP BY ALL) USING (fusion_id, source)")
def skills_list(spark, sf_dir):
    return flat_records(spark, sf_dir).select("fusion_id", "source", F.array_join(N.skills_list(F.split("skills", ";")), ",").alias("skills"))


@query(_R + f", m AS (SELECT fusion_id, source, list_filter(list_transform(string_split_regex(emails || ' | ; ' || coalesce(location, ''), '[;|,\\s]+'), lambda x: {_strip('x')}), lambda x: x <> '') AS p FROM r) SELECT fusion_id, source, len(p) AS n, array_to_string(p, '/') AS parts FROM m")
def split_multi(spark, sf_dir):
    parts = T.split_multi(F.concat("emails", F.lit(" | ; "), F.coalesce("location", F.lit(""))), r"[;|,\s]+")
    return flat_records(spark, sf_dir).select("fusion_id", "source", F.size(parts).cast("long").alias("n"), F.array_join(parts, "/").alias("parts"))


def _agg(raw, change, keep="v IS NOT NULL", distinct=False):
    """SQL for the items of a text with semicolons, changed, kept and joined; distinct: the first of equal ones."""
    items = f"list_filter(list_transform(string_split({raw}, ';'), lambda x: {change('x')}), lambda v: {keep})"
    return f"array_to_string(list_filter({items}, lambda v, i: {f'list_position({items}, v) = i' if distinct else 'true'}), ',')"


@query(_R + f" SELECT 'R' || fusion_id AS fusion_id, {_NAME('full_name')} AS full_name, coalesce({_agg('emails', _EMAIL)}, '') AS emails, coalesce({_agg('phones', _PHONE)}, '') AS phones, {_PLACE('location')} AS location, headline, coalesce({_agg('skills', _SKILL, distinct=True)}, '') AS skills, CASE WHEN links IS NOT NULL THEN 'https://' || split_part(links, '|', 1) ELSE '' END AS links, {_YEARS('years_experience')} AS years FROM r WHERE source = 'csv'")
def scan_csv(spark, sf_dir):
    """A table with odd headers, two columns of one field and rows without a cell, written and read again."""
    r = flat_records(spark, sf_dir).where("source = 'csv'")
    written = r.select(
        F.concat(F.lit("R"), "fusion_id").alias("Applicant_ID"), F.col("full_name").alias("Candidate Name"), F.lit("lost@example.com").alias("Email"), F.col("emails").alias("Email-Address"), F.regexp_replace("phones", ";", "|").alias(" Mobile Number"),
        F.col("location").alias("City"), F.col("headline").alias("Current Title"), F.col("skills").alias("Skill Set"), F.split("links", r"\|")[0].alias("Website"), F.lit("odd").alias("Unknown"), F.col("years_experience").alias("YOE"),
    )
    blank = r.select(*(F.lit(None).cast("string").alias(c) for c in written.columns))
    path = scratch(spark)
    written.unionByName(blank).write.option("header", True).option("quoteAll", True).option("emptyValue", "").csv(path)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return table.read(spark, path).select("fusion_id", "full_name", joined("emails"), joined("phones"), "location", "headline", joined("skills"), F.array_join(F.transform("links", lambda x: x["url"]), ",").alias("links"), F.col("years_experience").cast("double").alias("years"))


def _entries_sql(field, dates=(3, 4)):
    """SQL for entries like a|b|c|d;... with four parts joined by slashes, dates made plain."""
    part = lambda i: f"nullif(string_split(x, '|')[{i}], '')"
    parts = " || '/' || ".join(f"coalesce({_DATE(part(i)) if i in dates else part(i)}, '')" for i in range(1, 5))
    return f"coalesce(array_to_string(list_transform(string_split({field}, ';'), lambda x: {parts}), ';'), '')"


_COERCED = lambda x: f"CASE WHEN lower({_strip(x)}) NOT IN ('nan', 'none', 'null', 'n/a', 'na', '-', '') THEN {_strip(x)} END"


@query(_R + f", a AS (SELECT *, fusion_id[2:]::BIGINT % 3 AS k FROM r WHERE source = 'ats') SELECT 'A' || fusion_id AS fusion_id, {_NAME(_COERCED('full_name'))} AS full_name, coalesce(CASE WHEN k = 2 THEN {_EMAIL("split_part(emails, ';', 1)")} ELSE {_agg('emails', _EMAIL, distinct=True)} END, '') AS emails, coalesce({_agg('phones', _PHONE, distinct=True)}, '') AS phones, {_PLACE('location')} AS location, {_COERCED('headline')} AS headline, coalesce({_agg('skills', _SKILL, distinct=True)}, '') AS skills, {_entries_sql('experience')} AS experience, {_entries_sql('education')} AS education, {_YEARS('years_experience')} AS years FROM a")
def scan_ats(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    of = lambda c, names: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *(F.coalesce(x[n], F.lit("")) for n in names))), ";").alias(c)
    return ats.parse(exports(spark, sf_dir)).select(
        "fusion_id", "full_name", joined("emails"), joined("phones"), "location", "headline", joined("skills"), of("experience", ["title", "company", "start_date", "end_date"]), of("education", ["institution", "degree", "start_date", "end_date"]),
        F.col("years_experience").cast("double").alias("years"),
    )


@query(f"WITH r AS ({RESUMES}) SELECT doc_id, {_NAME('person')} AS full_name, lower(mail) AS emails, '+91' || phone[5:] AS phones, {_PLACE('place')} AS location, role AS headline, 'Tools: Py,SQL,Kubernetes,Data Lakes,Go' AS skills, 'https://github.com/u GitHub' AS links, CASE WHEN k = 2 THEN 2025 - y1::INT ELSE m::INT END::DOUBLE AS years, sha256(lower(mail))[1:16] AS candidate_id FROM r")
def scan_resume(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return resume.parse(resumes(spark, sf_dir)).select(
        F.col("fusion_id").cast("long").alias("doc_id"), "full_name", joined("emails"), joined("phones"), "location", "headline", joined("skills"), F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["url"], x["label"])), ",").alias("links"),
        F.col("years_experience").cast("double").alias("years"), "candidate_id",
    )


@query(f"""WITH r AS ({RESUMES}) SELECT doc_id, 0::BIGINT AS ord, 'Data Engineer' AS title, 'Acme' AS company, y1 || '-' || lpad(m, 2, '0') AS start_date, y2 || '-' || lpad(m, 2, '0') AS end_date, 'built things for many' || CASE WHEN k = 1 THEN ' Lead | Other Inc ran it' ELSE '' END AS description FROM r
    UNION ALL SELECT doc_id, 1, 'Lead', 'Other Inc', y2 || '-01', 'Present', 'ran it' FROM r WHERE k <> 1""")
def resume_experience(spark, sf_dir):
    x = M.spread(resume.parse(resumes(spark, sf_dir)), "experience")
    return x.select(F.col("fusion_id").cast("long").alias("doc_id"), "ord", "x.title", "x.company", "x.start_date", "x.end_date", "x.description")


@query(f"""WITH r AS ({RESUMES}) SELECT doc_id, 0::BIGINT AS ord, 'Open University of ' || place AS institution, 'B.Tech' AS degree, 'Computer Science' AS field_of_study, y1 || '-01' AS start_date, y2 || '-01' AS end_date, ('8.' || m)::DOUBLE AS gpa FROM r
    UNION ALL SELECT doc_id, 1, 'MIT Boston', 'Master', 'of Arts', NULL, NULL, NULL FROM r""")
def resume_education(spark, sf_dir):
    x = M.spread(resume.parse(resumes(spark, sf_dir)), "education")
    return x.select(F.col("fusion_id").cast("long").alias("doc_id"), "ord", "x.institution", "x.degree", "x.field_of_study", "x.start_date", "x.end_date", "x.gpa")


@query(f"""WITH o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, CASE o_orderkey % 5 WHEN 0 THEN 'Jupyter Notebook' WHEN 1 THEN 'Shell' WHEN 2 THEN 'Rust' WHEN 3 THEN 'Python' END AS language, o_orderkey % 7 = 0 AS fork FROM orders),
    n AS (SELECT * FROM o WHERE NOT fork QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pos) <= 30),
    g AS (SELECT o_custkey, language, count(*) AS n, min(pos) AS first FROM n WHERE language IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT o_custkey, CASE language WHEN 'Shell' THEN 'Shell Scripting' WHEN 'Jupyter Notebook' THEN 'Python' ELSE language END AS skill, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first) AS rank FROM g),
    f AS (SELECT o_custkey, skill, min(rank) AS rank FROM k WHERE rank <= 10 GROUP BY 1, 2),
    s AS (SELECT o_custkey, string_agg(skill, ',' ORDER BY rank) AS skills FROM f GROUP BY 1)
    SELECT 'u' || c_custkey AS fusion_id, {_NAME('c_mktsegment')} AS full_name, CASE WHEN c_custkey % 3 = 0 THEN 'u' || c_custkey || '@x.org' ELSE '' END AS emails, 'https://github.com/u' || c_custkey || ' GitHub' || CASE c_custkey % 3 WHEN 1 THEN ',https://blog.org/' || c_custkey || ' Portfolio' WHEN 2 THEN ',http://b.org Portfolio' ELSE '' END AS links, {_PLACE("'nyc'")} AS location, coalesce(skills, '') AS skills, c_mktsegment AS headline FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def scan_profile(spark, sf_dir):
    k = F.col("c_custkey")
    blog = F.when(k % 3 == 1, F.concat(F.lit("blog.org/"), k.cast("string"))).when(k % 3 == 2, "http://b.org").otherwise(" ")
    users = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), k.cast("string")).alias("fusion_id"), F.concat(F.lit("u"), k.cast("string")).alias("login"), F.col("c_mktsegment").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("U"), k.cast("string"), F.lit("@x.org"))).otherwise("none").alias("email"),
        F.col("c_mktsegment").alias("bio"), blog.alias("blog"), F.lit("nyc").alias("location"),
    )
    o = F.col("o_orderkey")
    language = F.when(o % 5 == 0, "Jupyter Notebook").when(o % 5 == 1, "Shell").when(o % 5 == 2, "Rust").when(o % 5 == 3, "Python")
    repos = _t(spark, sf_dir, "orders").select(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("fusion_id"), o.alias("pos"), language.alias("language"), (o % 7 == 0).alias("fork"))
    p = profile.parse(users, repos)
    return p.select("fusion_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join(F.transform("links", lambda x: F.concat_ws(" ", x["url"], x["label"])), ",").alias("links"), "location", F.array_join("skills", ",").alias("skills"), "headline")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'plain' ELSE 'u' || c_custkey END AS username FROM customer")
def profile_username(spark, sf_dir):
    k = F.col("c_custkey")
    u = F.concat(F.lit("u"), k.cast("string"))
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://github.com/"), u, F.lit("?tab=x"))).when(k % 4 == 1, F.concat(F.lit(" github.com/"), u, F.lit("/repo"))).when(k % 4 == 2, F.concat(u, F.lit("/ "))).otherwise("@plain")
    return _t(spark, sf_dir, "customer").select("c_custkey", profile.username(raw).alias("username"))


@query(_R + f", e AS (SELECT fusion_id, prio, i, {_EMAIL('raw')} AS v FROM (SELECT fusion_id, prio, unnest(string_split(emails, ';')) AS raw, generate_subscripts(string_split(emails, ';'), 1) AS i FROM r)), f AS (SELECT fusion_id, v, min(prio * 100 + i) AS o FROM e WHERE v IS NOT NULL GROUP BY ALL) SELECT fusion_id, v AS email, row_number() OVER (PARTITION BY fusion_id ORDER BY o) - 1 AS ord FROM f")
def merge_emails(spark, sf_dir):
    return M.spread(M.merge(source_records(spark, sf_dir)), "emails").withColumnRenamed("x", "email")


@query(_R + f", e AS (SELECT fusion_id, prio, i, {_PHONE('raw')} AS v FROM (SELECT fusion_id, prio, unnest(string_split(phones, ';')) AS raw, generate_subscripts(string_split(phones, ';'), 1) AS i FROM r)), f AS (SELECT fusion_id, v, min(prio * 100 + i) AS o FROM e WHERE v IS NOT NULL GROUP BY ALL) SELECT fusion_id, v AS phone, row_number() OVER (PARTITION BY fusion_id ORDER BY o) - 1 AS ord FROM f")
def merge_phones(spark, sf_dir):
    return M.spread(M.merge(source_records(spark, sf_dir)), "phones").withColumnRenamed("x", "phone")


@query(_R + ", e AS (SELECT fusion_id, prio, unnest(string_split(links, ';')) AS raw, generate_subscripts(string_split(links, ';'), 1) AS i FROM r), u AS (SELECT fusion_id, prio * 100 + i AS o, split_part(raw, '|', 2) AS label, CASE WHEN starts_with(raw, 'http') THEN split_part(raw, '|', 1) WHEN contains(split_part(raw, '|', 1), '.') THEN 'https://' || split_part(raw, '|', 1) END AS url FROM e) SELECT fusion_id, url, arg_min(label, o) AS label, row_number() OVER (PARTITION BY fusion_id ORDER BY min(o)) - 1 AS ord FROM u WHERE url IS NOT NULL GROUP BY fusion_id, url")
def merge_links(spark, sf_dir):
    return M.spread(M.merge(source_records(spark, sf_dir)), "links").select("fusion_id", "x.url", "x.label", "ord")


@query(
    f"WITH r AS ({ALL_RECORDS}) "
    + f""", e AS (SELECT fusion_id, prio, source, i, raw, {_SKILL('raw')} AS v FROM (SELECT fusion_id, prio, source, unnest(string_split(skills, ';')) AS raw, generate_subscripts(string_split(skills, ';'), 1) AS i FROM r)),
    c AS (SELECT *, round({_BASE} + CASE WHEN length(v) >= 3 THEN 0.03 ELSE 0 END + CASE WHEN length(v) >= 10 THEN 0.02 ELSE 0 END, 4) AS c FROM e),
    g AS (SELECT fusion_id, lower(v) AS k, arg_min(raw, prio * 100 + i) AS name, arg_min(v, prio * 100 + i) AS canonical_name, count(DISTINCT source) AS n_sources, array_to_string(list_transform(list_sort(list(DISTINCT prio)), lambda p: ['resume', 'ats', 'github', 'csv'][p + 1]), ',') AS sources, round(least(1, max(c) + (count(DISTINCT source) - 1) * 0.02), 4) AS confidence, min(prio * 100 + i) AS o FROM c GROUP BY 1, 2)
    SELECT fusion_id, name, canonical_name, sources, n_sources, confidence, row_number() OVER (PARTITION BY fusion_id ORDER BY n_sources DESC, confidence DESC, o) - 1 AS ord FROM g"""
)
def merge_skills(spark, sf_dir):
    x = M.spread(M.merge(source_records(spark, sf_dir, ALL_RECORDS)), "skills")
    return x.select("fusion_id", "x.name", "x.canonical_name", F.array_join("x.sources", ",").alias("sources"), F.size("x.sources").cast("long").alias("n_sources"), "x.confidence", "ord")


def _keyed_sql(field, parts, sort):
    a, b, start, end = parts
    return (
        _R
        + f""", e AS (SELECT fusion_id, prio * 100 + i AS o, string_split(raw, '|') AS p FROM (SELECT fusion_id, prio, unnest(string_split({field}, ';')) AS raw, generate_subscripts(string_split({field}, ';'), 1) AS i FROM r)),
    n AS (SELECT fusion_id, o, nullif(p[{a}], '') AS a, nullif(p[{b}], '') AS b, {_DATE(f"nullif(p[{start}], '')")} AS start_date, {_DATE(f"nullif(p[{end}], '')")} AS end_date FROM e),
    f AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY fusion_id, lower(coalesce(a, '')) || '||' || lower(coalesce(b, '')) ORDER BY o) = 1)
    SELECT fusion_id, a, b, start_date, end_date, row_number() OVER (PARTITION BY fusion_id ORDER BY coalesce({sort}, '0000-00') DESC, o) - 1 AS ord FROM f"""
    )


@query(_keyed_sql("experience", (2, 1, 3, 4), "start_date"))
def merge_experience(spark, sf_dir):
    x = M.spread(M.merge(source_records(spark, sf_dir)), "experience")
    return x.select("fusion_id", F.col("x.company").alias("a"), F.col("x.title").alias("b"), "x.start_date", "x.end_date", "ord")


@query(_keyed_sql("education", (1, 2, 3, 4), "end_date"))
def merge_education(spark, sf_dir):
    x = M.spread(M.merge(source_records(spark, sf_dir)), "education")
    return x.select("fusion_id", F.col("x.institution").alias("a"), F.col("x.degree").alias("b"), "x.start_date", "x.end_date", "ord")


_ENTRIES = f""", y AS (SELECT * FROM r),
    scal AS (
      SELECT fusion_id, 'full_name' AS field, source, prio, 0 AS i, v, {_BASE} + CASE WHEN contains(v, ' ') THEN 0.05 ELSE 0 END - CASE WHEN length(v) > 30 THEN 0.05 ELSE 0 END AS c, full_name AS raw FROM (SELECT *, {_NAME('full_name')} AS v FROM y) WHERE v <> ''
      UNION ALL SELECT fusion_id, 'location', source, prio, 0, v, {_BASE} + CASE WHEN contains(v, ',') THEN 0.03 ELSE 0 END, location FROM (SELECT *, {_PLACE('location')} AS v FROM y) WHERE v <> ''
      UNION ALL SELECT fusion_id, 'headline', source, prio, 0, headline, {_BASE}, headline FROM y WHERE headline <> ''
      UNION ALL SELECT fusion_id, 'years_experience', source, prio, 0, years_experience, {_BASE} + CASE WHEN try_cast(years_experience AS DOUBLE) > 0 AND try_cast(years_experience AS DOUBLE) < 50 THEN 0.03 ELSE 0 END - CASE WHEN try_cast(years_experience AS DOUBLE) > 40 THEN 0.1 ELSE 0 END, years_experience FROM y WHERE years_experience <> ''),
    em AS (SELECT fusion_id, source, prio, i, {_EMAIL('raw')} AS v, raw FROM (SELECT fusion_id, source, prio, unnest(string_split(emails, ';')) AS raw, generate_subscripts(string_split(emails, ';'), 1) AS i FROM y)),
    ph AS (SELECT fusion_id, source, prio, i, {_PHONE('raw')} AS v, raw FROM (SELECT fusion_id, source, prio, unnest(string_split(phones, ';')) AS raw, generate_subscripts(string_split(phones, ';'), 1) AS i FROM y)),
    sk AS (SELECT fusion_id, source, prio, i, {_SKILL('raw')} AS v, {_strip('raw')} AS raw FROM (SELECT fusion_id, source, prio, unnest(string_split(skills, ';')) AS raw, generate_subscripts(string_split(skills, ';'), 1) AS i FROM y)),
    ex AS (SELECT fusion_id, source, prio, i, lower(split_part(raw, '|', 2) || '||' || split_part(raw, '|', 1)) AS v FROM (SELECT fusion_id, source, prio, unnest(string_split(experience, ';')) AS raw, generate_subscripts(string_split(experience, ';'), 1) AS i FROM y)),
    ed AS (SELECT fusion_id, source, prio, i, lower(split_part(raw, '|', 1) || '||' || split_part(raw, '|', 2)) AS v FROM (SELECT fusion_id, source, prio, unnest(string_split(education, ';')) AS raw, generate_subscripts(string_split(education, ';'), 1) AS i FROM y)),
    ent AS (
      SELECT * FROM scal
      UNION ALL SELECT fusion_id, 'emails', source, prio, i, v, {_BASE} - CASE WHEN length(v) > 3 THEN 0.02 ELSE -0.03 END, raw FROM em WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fusion_id, v ORDER BY prio, i) = 1
      UNION ALL SELECT fusion_id, 'phones', source, prio, i, v, {_BASE} + 0.02, raw FROM ph WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fusion_id, v ORDER BY prio, i) = 1
      UNION ALL SELECT fusion_id, 'skills', source, prio, i, v, {_BASE} + CASE WHEN length(v) >= 3 THEN 0.03 ELSE 0 END + CASE WHEN length(v) >= 10 THEN 0.02 ELSE 0 END, raw FROM sk
      UNION ALL SELECT fusion_id, 'experience', source, prio, i, v, 0.85, v FROM ex QUALIFY row_number() OVER (PARTITION BY fusion_id, v ORDER BY prio, i) = 1
      UNION ALL SELECT fusion_id, 'education', source, prio, i, v, 0.85, v FROM ed QUALIFY row_number() OVER (PARTITION BY fusion_id, v ORDER BY prio, i) = 1),
    fld AS (SELECT fusion_id, field, count(*) AS n_values, count(DISTINCT source) AS n_sources, arg_min(source, prio * 100 + i) AS first_source, arg_min(c, prio * 100 + i) AS first_c, max(c) AS top_c, arg_min(source, -round(c, 4) * 1e6 + prio * 100 + i) AS top_source FROM ent GROUP BY 1, 2),
    rawwin AS (
      SELECT fusion_id, 'full_name' AS field, arg_min(source, prio) AS s FROM y WHERE full_name <> '' GROUP BY 1
      UNION ALL SELECT fusion_id, 'location', arg_min(source, prio) FROM y WHERE location <> '' GROUP BY 1),
    sel AS (SELECT fld.*, CASE WHEN field IN ('skills', 'experience', 'education') THEN top_source WHEN rawwin.s IS NOT NULL THEN rawwin.s ELSE first_source END AS selected_source,
      CASE WHEN field IN ('skills', 'experience', 'education') THEN round(least(1, top_c), 4)
        WHEN rawwin.s IS NOT NULL AND rawwin.s <> first_source THEN round(first_c - (CASE first_source WHEN 'resume' THEN 0.92 WHEN 'ats' THEN 0.90 WHEN 'csv' THEN 0.80 ELSE 0.86 END) + (CASE rawwin.s WHEN 'resume' THEN 0.92 WHEN 'ats' THEN 0.90 WHEN 'csv' THEN 0.80 ELSE 0.86 END), 4)
        WHEN field = 'emails' THEN round(CASE first_source WHEN 'resume' THEN 0.92 WHEN 'ats' THEN 0.90 WHEN 'csv' THEN 0.80 ELSE 0.86 END::DOUBLE + 0.03 - CASE WHEN n_values > 3 THEN 0.05 ELSE 0 END, 4)
        ELSE round(least(1, first_c), 4) END AS confidence
      FROM fld LEFT JOIN rawwin USING (fusion_id, field)),
    adj AS (SELECT *, round(greatest(0, least(1, confidence + CASE WHEN n_sources = 1 THEN -0.08 WHEN n_sources = 2 THEN -0.03 ELSE 0.02 END)), 4) AS adjusted FROM sel),
    w(field, weight) AS (VALUES ('full_name', 0.20::DOUBLE), ('emails', 0.20), ('phones', 0.10), ('location', 0.05), ('skills', 0.15), ('experience', 0.15), ('education', 0.10), ('years_experience', 0.05)),
    n AS (SELECT fusion_id, count(*) AS n FROM r GROUP BY 1),
    tot AS (SELECT n.fusion_id, n.n, coalesce(sum(adjusted * weight), 0) AS s, coalesce(max(adjusted) FILTER (adj.field = 'full_name'), 0) AS nm, coalesce(max(adjusted) FILTER (adj.field = 'emails'), 0) AS e FROM n LEFT JOIN adj ON n.fusion_id = adj.fusion_id LEFT JOIN w ON w.field = adj.field GROUP BY 1, 2),
    overall AS (SELECT fusion_id, n, round(greatest(0, least(1, s + least((n - 1) * 0.015, 0.05) - CASE WHEN nm = 0 THEN 0.10 ELSE 0 END - CASE WHEN e = 0 THEN 0.08 ELSE 0 END)), 4) AS overall_confidence FROM tot)"""


_FIELD = lambda c, f: f"max({c}) FILTER (field = '{f}')"
_SCALARS = ", ".join(f"{_FIELD('v', f)} AS {f}, {_FIELD('selected_source', f)} AS {f}_source" for f in ("full_name", "location", "headline")) + f", {_YEARS(_FIELD('v', 'years_experience'))} AS years_experience, {_FIELD('selected_source', 'years_experience')} AS years_experience_source"


@query(_R + _ENTRIES + f", best AS (SELECT fusion_id, field, arg_min(v, prio) AS v FROM scal GROUP BY 1, 2), both_ AS (SELECT best.*, adj.selected_source FROM best JOIN adj USING (fusion_id, field)) SELECT n.fusion_id, {_SCALARS} FROM n LEFT JOIN both_ USING (fusion_id) GROUP BY n.fusion_id")
def merge_scalar(spark, sf_dir):
    p = M.merge(source_records(spark, sf_dir))
    source = lambda f: F.get(F.filter("provenance", lambda x: x["field"] == f), F.lit(0))["selected_source"].alias(f"{f}_source")
    return p.select("fusion_id", *(c for f in M.SCALARS for c in (f, source(f))))


@query(_R + _ENTRIES + """ SELECT fusion_id, field, adj.selected_source, row_number() OVER (PARTITION BY fusion_id, field ORDER BY prio, i) - 1 AS ord, source,
    CASE field WHEN 'emails' THEN 'email_normalize' WHEN 'phones' THEN 'phone_e164' WHEN 'skills' THEN 'skill_normalize' WHEN 'experience' THEN 'experience_merge' WHEN 'education' THEN 'education_merge' ELSE 'direct_field' END AS method,
    raw AS raw_value, round(greatest(0, least(1, c)), 4) AS confidence FROM ent JOIN adj USING (fusion_id, field)""")
def provenance_long(spark, sf_dir):
    return M.provenance_rows(M.merge(source_records(spark, sf_dir))).withColumn("ord", F.col("ord").cast("long"))


@query(_R + _ENTRIES + " SELECT fusion_id, field, n_values, selected_source FROM adj WHERE n_values > 1")
def conflict_log(spark, sf_dir):
    return M.conflict_log(M.merge(source_records(spark, sf_dir))).withColumn("n_values", F.col("n_values").cast("long"))


@query(_R + _ENTRIES + " SELECT fusion_id, field, n_sources, confidence, adjusted FROM adj")
def field_confidence(spark, sf_dir):
    p = M.spread(M.merge(source_records(spark, sf_dir)), "provenance")
    return p.select("fusion_id", "x.field", F.col("x.n_sources").cast("long").alias("n_sources"), "x.confidence", "x.adjusted")


@query(_R + _ENTRIES + " SELECT fusion_id, n AS n_sources, overall_confidence, CASE WHEN overall_confidence >= 0.75 THEN 'High' WHEN overall_confidence >= 0.5 THEN 'Medium' ELSE 'Low' END AS tier FROM overall")
def overall_confidence(spark, sf_dir):
    p = M.merge(source_records(spark, sf_dir))
    return p.select("fusion_id", F.size("sources").cast("long").alias("n_sources"), "overall_confidence", S.tier(F.col("overall_confidence")).alias("tier"))


_JOINED = f""", yr AS (SELECT fusion_id, {_YEARS('v')} AS y FROM (SELECT fusion_id, arg_min(years_experience, prio) AS v FROM r WHERE years_experience <> '' GROUP BY 1)),
    sca AS (SELECT fusion_id, arg_min(v, prio) FILTER (field = 'full_name') AS full_name, arg_min(v, prio) FILTER (field = 'location') AS location, arg_min(v, prio) FILTER (field = 'headline') AS headline FROM scal GROUP BY 1),
    ems AS (SELECT fusion_id, string_agg(v, ',' ORDER BY prio, i) AS emails, arg_min(v, prio * 100 + i) AS first_email FROM ent WHERE field = 'emails' GROUP BY 1),
    phs AS (SELECT fusion_id, string_agg(v, ',' ORDER BY prio, i) AS phones FROM ent WHERE field = 'phones' GROUP BY 1),
    lk AS (SELECT fusion_id, prio * 100 + i AS o, split_part(raw, '|', 2) AS label, {_URL.format("split_part(raw, '|', 1)")} AS url FROM (SELECT fusion_id, prio, unnest(string_split(links, ';')) AS raw, generate_subscripts(string_split(links, ';'), 1) AS i FROM r)),
    lks AS (SELECT fusion_id, string_agg(url || ' ' || label, ',' ORDER BY o) AS links FROM (SELECT * FROM lk WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fusion_id, url ORDER BY o) = 1) GROUP BY 1),
    sg AS (SELECT fusion_id, lower(v) AS k, arg_min(v, prio * 100 + i) AS name, count(DISTINCT source) AS n, round(least(1, max(round(least(1, c), 4)) + (count(DISTINCT source) - 1) * 0.02), 4) AS conf, min(prio * 100 + i) AS o FROM ent WHERE field = 'skills' GROUP BY 1, 2),
    skl AS (SELECT fusion_id, string_agg(name || ' ' || n, ',' ORDER BY n DESC, conf DESC, o) AS skills, string_agg(name, ',' ORDER BY conf DESC, n DESC, o) AS by_confidence FROM sg GROUP BY 1),
    exq AS (SELECT fusion_id, prio * 100 + i AS o, string_split(raw, '|') AS p FROM (SELECT fusion_id, prio, unnest(string_split(experience, ';')) AS raw, generate_subscripts(string_split(experience, ';'), 1) AS i FROM r)),
    exs AS (SELECT fusion_id, string_agg(concat_ws('/', nullif(p[1], ''), nullif(p[2], ''), d), ',' ORDER BY coalesce(d, '0000-00') DESC, o) AS experience, count(*) AS n FROM (SELECT *, {_DATE("nullif(p[3], '')")} AS d FROM exq QUALIFY row_number() OVER (PARTITION BY fusion_id, lower(p[2]) || '||' || lower(p[1]) ORDER BY o) = 1) GROUP BY 1),
    edq AS (SELECT fusion_id, prio * 100 + i AS o, string_split(raw, '|') AS p FROM (SELECT fusion_id, prio, unnest(string_split(education, ';')) AS raw, generate_subscripts(string_split(education, ';'), 1) AS i FROM r)),
    eds AS (SELECT fusion_id, string_agg(concat_ws('/', nullif(p[1], ''), nullif(p[2], ''), d), ',' ORDER BY coalesce(d, '0000-00') DESC, o) AS education, max(nullif(try_cast(p[5] AS DOUBLE), 0)) AS best_gpa FROM (SELECT *, {_DATE("nullif(p[4], '')")} AS d FROM edq QUALIFY row_number() OVER (PARTITION BY fusion_id, lower(p[1]) || '||' || lower(p[2]) ORDER BY o) = 1) GROUP BY 1),
    ids AS (SELECT fusion_id, max(candidate_id) AS id FROM r GROUP BY 1),
    whole AS (SELECT o.fusion_id, coalesce(ids.id, sha256(coalesce(first_email, full_name, o.fusion_id))[1:16]) AS candidate_id, full_name, coalesce(emails, '') AS emails, coalesce(phones, '') AS phones, location, coalesce(links, '') AS links, headline,
      CASE WHEN y BETWEEN 0 AND 60 THEN y END AS years_experience, y, coalesce(skills, '') AS skills, by_confidence, coalesce(experience, '') AS experience, coalesce(education, '') AS education, best_gpa, o.n AS n_sources, o.overall_confidence
    FROM overall o LEFT JOIN ids USING (fusion_id) LEFT JOIN yr USING (fusion_id) LEFT JOIN sca USING (fusion_id) LEFT JOIN ems USING (fusion_id) LEFT JOIN phs USING (fusion_id) LEFT JOIN lks USING (fusion_id) LEFT JOIN skl USING (fusion_id) LEFT JOIN exs USING (fusion_id) LEFT JOIN eds USING (fusion_id))"""


_BLANK_3, _BLANK_4 = ("nullif(p[3], '')", "nullif(p[4], '')")


def _joined(c, f):
    return F.coalesce(F.array_join(F.transform(c, f) if f else F.col(c), ","), F.lit("")).alias(c)


_LISTS = {
    "links": lambda x: F.concat_ws(" ", x["url"], x["label"]), "experience": lambda x: F.concat_ws("/", x["title"], x["company"], x["start_date"]), "education": lambda x: F.concat_ws("/", x["institution"], x["degree"], x["end_date"]),
    "skills": lambda x: F.concat_ws(" ", x["canonical_name"], F.size(x["sources"]).cast("string")),
}


@query(_R + _ENTRIES + _JOINED + " SELECT * EXCLUDE (y, by_confidence, best_gpa) FROM whole")
def flagship_fusion(spark, sf_dir):
    p = validate(M.merge(source_records(spark, sf_dir)))
    lists = {c: _joined(c, f) for c, f in (_LISTS | {"emails": None, "phones": None}).items()}
    return p.select("fusion_id", "candidate_id", "full_name", "location", "headline", "years_experience", F.size("sources").cast("long").alias("n_sources"), "overall_confidence", *lists.values())


@query(
    """WITH c AS (SELECT *, c_custkey AS k FROM customer) SELECT 'C' || k AS fusion_id, CASE WHEN k % 11 = 0 THEN sha256(CASE WHEN k % 7 = 0 THEN 'bad@' ELSE 'ok@example.com' END)[1:16] ELSE 'x' END AS candidate_id,
    CASE WHEN k % 5 <> 0 THEN c_name END AS full_name, CASE WHEN k % 7 = 0 THEN '' ELSE 'ok@example.com' END AS emails, CASE WHEN k % 6 = 0 THEN '' ELSE '+919876543210' END AS phones, CASE WHEN k % 3 = 0 THEN NULL ELSE 5.0 END::DOUBLE AS years_experience,
    CASE WHEN k % 4 = 0 THEN 'Go' ELSE 'Go,SQL' END AS skills, CASE WHEN k % 9 = 0 THEN '/T' ELSE 'A/T,/T' END AS experience, CASE WHEN k % 10 = 0 THEN '' ELSE 'U' END AS education, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 ELSE 0.5 END::DOUBLE AS overall_confidence,
    array_to_string(list_filter([CASE WHEN k % 11 = 0 THEN 'empty id replaced' END, CASE WHEN k % 5 = 0 THEN 'short name removed' END, CASE WHEN k % 3 = 0 THEN 'years out of range removed' END, CASE WHEN k % 7 = 0 THEN 'invalid emails dropped' END, CASE WHEN k % 6 = 0 THEN 'invalid phones dropped' END,
      CASE WHEN k % 4 = 0 THEN 'invalid skills dropped' END, CASE WHEN k % 9 = 0 THEN 'invalid experience dropped' END, CASE WHEN k % 10 = 0 THEN 'invalid education dropped' END], lambda x: x IS NOT NULL), ';') AS warnings FROM c"""
)
def validate_profile(spark, sf_dir):
    """Each of the ten rules is broken by the keys that a number of its own divides."""
    k = F.col("c_custkey")
    named = lambda *parts: F.struct(*(v.alias(n) for n, v in parts))
    null = F.lit(None).cast("string")
    job = lambda company, title: named(("company", company), ("title", title))
    p = _t(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("fusion_id"), F.when(k % 11 == 0, "").otherwise("x").alias("candidate_id"), F.when(k % 5 == 0, " a ").otherwise(F.col("c_name")).alias("full_name"),
        F.array(F.when(k % 7 == 0, "bad@").otherwise("ok@example.com")).alias("emails"), F.array(F.when(k % 6 == 0, "919876543210").otherwise("+919876543210")).alias("phones"), F.when(k % 3 == 0, F.when(k % 2 == 0, 75.0).otherwise(-1.0)).otherwise(5.0).alias("years_experience"),
        F.array(named(("canonical_name", F.lit("Go"))), named(("canonical_name", F.when(k % 4 == 0, " ").otherwise("SQL")))).alias("skills"), F.array(job(F.when(k % 9 == 0, null).otherwise("A"), F.when(k % 9 == 0, " ").otherwise("T")), job(null, F.lit("T"))).alias("experience"),
        F.array(named(("institution", F.when(k % 10 == 0, null).otherwise("U")))).alias("education"), F.when(k % 3 == 0, 1.5).when(k % 3 == 1, -0.5).otherwise(0.5).alias("overall_confidence"),
    )
    lists = {"emails": None, "phones": None, "skills": lambda x: x["canonical_name"], "experience": lambda x: F.concat_ws("/", F.coalesce(x["company"], F.lit("")), x["title"]), "education": lambda x: x["institution"]}
    return validate(p).select("fusion_id", "candidate_id", "full_name", "years_experience", "overall_confidence", *(_joined(c, f) for c, f in lists.items()), F.array_join("validator_warnings", ";").alias("warnings"))


@query(_R + _ENTRIES + _JOINED + " SELECT fusion_id, candidate_id, location, links, skills, experience, education, full_name AS name, emails AS email_addresses, phones AS phone_numbers, y AS experience_years FROM whole")
def project_profile(spark, sf_dir):
    """All columns that the projection leaves: hidden, renamed (at the end) and excluded ones."""
    p = P.project(M.merge(source_records(spark, sf_dir)), P.DEFAULT_PROJECTION | {"hide_provenance": True, "hide_confidence": True, "exclude_fields": ["sources", "headline"]})
    lists = _LISTS | {"email_addresses": None, "phone_numbers": None}
    return p.select(*(_joined(c, lists[c]) if c in lists else F.col(c) for c in p.columns))


@query(_R + _ENTRIES + _JOINED + """, lists AS (SELECT fusion_id, string_agg(field || ':' || confidence, ',' ORDER BY field) AS field_confidences, string_agg(field || ':' || selected_source || ':' || n_values, ',' ORDER BY field) FILTER (n_values > 1) AS conflicts FROM adj GROUP BY 1),
    v AS (SELECT fusion_id, string_agg(source || '=' || raw, ';' ORDER BY field, prio, i) AS considered FROM ent JOIN adj USING (fusion_id, field) WHERE n_values > 1 GROUP BY 1), so AS (SELECT fusion_id, string_agg(source, ',' ORDER BY prio) AS sources_used FROM r GROUP BY 1)
    SELECT fusion_id, candidate_id, '1.0.0' AS pipeline_version, sources_used, field_confidences, overall_confidence, coalesce(conflicts, '') AS conflicts, coalesce(considered, '') AS considered, 'csv: late' AS validation_warnings FROM whole LEFT JOIN lists USING (fusion_id) LEFT JOIN v USING (fusion_id) LEFT JOIN so USING (fusion_id)""")
def pipeline_report(spark, sf_dir):
    r = P.report(M.merge(source_records(spark, sf_dir)), warnings=["csv: late"])
    conf = F.array_sort(F.map_entries("field_confidences"))
    log = F.array_sort("conflict_log", lambda a, b: F.when(a["field"] < b["field"], -1).otherwise(1))
    told = lambda c: F.array_join(F.transform(log, lambda x: F.concat_ws(":", x["field"], x["selected_source"], F.size(x["all_sources"]).cast("string"))), ",") if c else F.array_join(F.flatten(F.transform(log, lambda x: F.transform(x["all_sources"], lambda e: F.concat_ws("=", e["source"], e["raw_value"])))), ";")
    return r.select(
        "fusion_id", "candidate_id", "pipeline_version", F.array_join("sources_used", ",").alias("sources_used"), F.array_join(F.transform(conf, lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",").alias("field_confidences"), "overall_confidence",
        told(True).alias("conflicts"), told(False).alias("considered"), F.array_join("validation_warnings", ",").alias("validation_warnings"),
    )


@query(_R + _ENTRIES + _JOINED + " SELECT fusion_id, candidate_id, full_name AS name, emails, overall_confidence FROM whole")
def json_sink(spark, sf_dir):
    """Projected profiles written as JSON lines and read again."""
    path = scratch(spark)
    write_lines(P.project(M.merge(source_records(spark, sf_dir)), P.DEFAULT_PROJECTION), path)
    back = spark.read.schema("fusion_id string, candidate_id string, name string, email_addresses array<string>, overall_confidence double").json(path)
    return back.select("fusion_id", "candidate_id", "name", F.array_join("email_addresses", ",").alias("emails"), "overall_confidence")


@query(_R + _ENTRIES + _JOINED + " SELECT fusion_id, coalesce(full_name, 'Unnamed Candidate') AS display_name, coalesce(first_email, '—') AS email, coalesce(nullif(split_part(phones, ',', 1), ''), '—') AS phone, coalesce(location, '—') AS location, overall_confidence FROM whole LEFT JOIN (SELECT fusion_id, first_email FROM ems) USING (fusion_id)")
def identity_view(spark, sf_dir):
    return P.identity_view(M.merge(source_records(spark, sf_dir)))


@query(_R + _ENTRIES + _JOINED + " SELECT fusion_id, row_number() OVER (PARTITION BY fusion_id ORDER BY conf DESC, n DESC, o) AS place, name AS skill, conf AS confidence, CASE WHEN conf >= 0.9 THEN 'High' WHEN conf >= 0.75 THEN 'Medium' ELSE 'Low' END AS tier FROM sg")
def skill_view(spark, sf_dir):
    return P.skill_view(M.merge(source_records(spark, sf_dir))).withColumn("place", F.col("place").cast("long"))


@query(_R + _ENTRIES + _JOINED + f", j AS (SELECT * FROM exq QUALIFY row_number() OVER (PARTITION BY fusion_id, lower(p[2]) || '||' || lower(p[1]) ORDER BY o) = 1) SELECT n.fusion_id, nullif(p[1], '') AS title, nullif(p[2], '') AS company, {_DATE(_BLANK_3)} AS start_date, coalesce({_DATE(_BLANK_4)}, 'Present') AS end_date FROM n LEFT JOIN j USING (fusion_id)")
def experience_view(spark, sf_dir):
    return P.experience_view(M.merge(source_records(spark, sf_dir)))


@query(_R + _ENTRIES + _JOINED + f", j AS (SELECT * FROM edq QUALIFY row_number() OVER (PARTITION BY fusion_id, lower(p[1]) || '||' || lower(p[2]) ORDER BY o) = 1) SELECT n.fusion_id, nullif(p[1], '') AS institution, nullif(p[2], '') AS degree, NULL::VARCHAR AS field_of_study, {_DATE(_BLANK_3)} AS start_date, {_DATE(_BLANK_4)} AS end_date, format('{{:.2f}}', nullif(try_cast(p[5] AS DOUBLE), 0)) AS gpa FROM n LEFT JOIN j USING (fusion_id)")
def education_view(spark, sf_dir):
    return P.education_view(M.merge(source_records(spark, sf_dir)))


@query(_R + ", e AS (SELECT fusion_id, unnest(string_split(links, ';')) AS raw FROM r WHERE substr(fusion_id, 2)::BIGINT % 2 = 1) SELECT DISTINCT fusion_id, CASE WHEN starts_with(raw, 'http') THEN split_part(raw, '|', 1) ELSE 'https://' || split_part(raw, '|', 1) END AS url FROM e WHERE contains(split_part(raw, '|', 1), '.')")
def github_view(spark, sf_dir):
    """The links that are labelled as a developer's, in whatever case; every second customer's are."""
    labelled = F.transform("links", lambda x: x.withField("label", F.when(F.substring("fusion_id", 2, 20).cast("long") % 2 == 1, F.when(x["label"] == "Again", "github").otherwise("GitHub")).otherwise(x["label"])))
    return P.github_links(M.merge(source_records(spark, sf_dir).withColumn("links", labelled)))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type AS language, n, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM c QUALIFY rank <= 10")
def top_languages(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_type").alias("language"), F.col("event_id").alias("pos"))
    return profile.top_languages(e, "user_id").select("user_id", "language", "n", F.col("rank").cast("long").alias("rank"))


@query(r"WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'SKILLS:' WHEN turn % 3 = 1 THEN 'Education' ELSE 'line ' || turn::VARCHAR END AS line FROM conversations), h AS (SELECT *, CASE WHEN line = 'SKILLS:' THEN 'skills' WHEN line = 'Education' THEN 'education' END AS s FROM l), f AS (SELECT conv_id, turn, s, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), '_header') AS section FROM h) SELECT conv_id, section, count(*) AS n_lines FROM f WHERE s IS NULL GROUP BY 1, 2")
def segment_sections(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    line = F.when(F.col("role") == "user", "SKILLS:").when(F.col("turn") % 3 == 1, "Education").otherwise(F.concat(F.lit("line "), F.col("turn").cast("string")))
    return resume.sections(c.select(F.col("conv_id"), F.col("turn").alias("pos"), line.alias("line")), "conv_id").groupBy("conv_id", "section").agg(F.count(F.lit(1)).alias("n_lines"))


@query("WITH s AS (SELECT o_custkey, (year(max(o_orderdate)) - year(min(o_orderdate))) * 12 + month(max(o_orderdate)) - month(min(o_orderdate)) AS m FROM orders GROUP BY 1) SELECT o_custkey, CASE WHEN m > 0 AND m < 600 THEN round_even(m / 12, 1) END AS years FROM s")
def experience_years(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array(F.struct(F.date_format(F.min("o_orderdate"), "yyyy-MM").alias("start_date"), F.date_format(F.max("o_orderdate"), "yyyy-MM").alias("end_date"))).alias("jobs"))
    return o.select("o_custkey", resume.experience_months(F.col("jobs"), "2025-01").alias("years"))


_HUB = 40


@query(
    _R.replace("WITH r", "WITH RECURSIVE r", 1) + rf""", k AS (SELECT fusion_id || '/' || source AS record_id, emails, phones, links FROM r),
    i AS (SELECT DISTINCT record_id, kind, id FROM (
      SELECT record_id, 'email' AS kind, {_EMAIL('x')} AS id FROM (SELECT record_id, unnest(string_split(emails, ';')) AS x FROM k)
      UNION ALL SELECT record_id, 'phone', {_PHONE('x')} FROM (SELECT record_id, unnest(string_split(phones, ';')) AS x FROM k)
      UNION ALL SELECT record_id, 'link', regexp_replace(regexp_replace(lower({_URL.format('x')}), '^https?://(www\.)?', ''), '/+$', '') FROM (SELECT record_id, split_part(unnest(string_split(links, ';')), '|', 1) AS x FROM k)) WHERE id IS NOT NULL),
    n AS (SELECT kind, id, count(*) AS n, min(record_id) AS first FROM i GROUP BY kind, id),
    e AS MATERIALIZED (SELECT DISTINCT record_id AS a, first AS b FROM i JOIN n USING (kind, id) WHERE n.n BETWEEN 2 AND {_HUB} AND record_id <> first),
    s AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a, a AS o FROM (SELECT DISTINCT a FROM s) UNION SELECT reach.a, s.b FROM reach JOIN s ON s.a = reach.o),
    c AS (SELECT a AS record_id, min(o) AS entity_id FROM reach GROUP BY a)
    SELECT record_id, coalesce(entity_id, record_id) AS entity_id, coalesce(q.n, 0)::BIGINT AS n_identifiers, coalesce(q.h, 0)::BIGINT AS n_hubs FROM k LEFT JOIN c USING (record_id)
    LEFT JOIN (SELECT record_id, count(*) AS n, count(*) FILTER (n.n > {_HUB}) AS h FROM i JOIN n USING (kind, id) GROUP BY record_id) q USING (record_id)"""
)
def resolve_entities(spark, sf_dir):
    """All source records, without their customers' keys: which belong together by emails, phones and links."""
    records = source_records(spark, sf_dir).withColumn("record_id", F.concat_ws("/", "fusion_id", "source"))
    return resolve(records, most=_HUB)[0]


_CELLS = "Name,Email,Skills,City"
_BAD_LINES = """CASE c_custkey % 9 WHEN 0 THEN 'a,b@x.org,c,d,one more' WHEN 1 THEN '' WHEN 2 THEN ',,none,' WHEN 3 THEN c_name || ',"q,u@x.org' WHEN 4 THEN 'bad {odd}(,' || c_name
    ELSE c_name || ',U' || CAST(c_custkey AS STRING) || '@x.org,"py, sql",' || c_mktsegment END"""


@query(f"""WITH l AS (SELECT c_custkey, c_custkey // 5000 AS part, c_custkey % 9 AS k, {_BAD_LINES.format(odd="Ã")} AS text FROM customer), s AS (SELECT *, strlen(text) + 1 - (k = 4)::INT AS n FROM l),
    p AS (SELECT *, {len(_CELLS) + 1} + coalesce(sum(n) OVER (PARTITION BY part ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM s)
    SELECT CASE WHEN k < 5 THEN part END AS part, CASE WHEN k < 5 THEN pos::BIGINT END AS "offset", CASE k WHEN 0 THEN 'too many cells' WHEN 1 THEN 'no known cell' WHEN 2 THEN 'no known cell' WHEN 3 THEN 'open quote' WHEN 4 THEN 'no UTF-8' END AS reason,
    CASE WHEN k < 5 THEN text END AS text, CASE WHEN k >= 5 THEN 'u' || c_custkey || '@x.org' END AS email, CASE WHEN k >= 5 THEN 'Python,SQL' END AS skills FROM p""")
def quarantine_csv(spark, sf_dir):
    """A table of all customers in files of 5000, five lines of nine broken: the bad lines with their places, and the good ones' records."""
    odd = F.unhex(F.lit("C3")).cast("string")
    rows = _t(spark, sf_dir, "customer").withColumn("odd", odd)
    text = F.when(F.col("c_custkey") % 9 == 4, F.concat(F.lit("bad "), "odd", F.lit("(,"), "c_name")).otherwise(F.expr(_BAD_LINES.format(odd="")))
    part = F.expr("c_custkey div 5000")
    body = rows.select(part.alias("part"), "c_custkey", text.alias("value"))
    head = rows.select(part.alias("part")).distinct().select("part", F.lit(-1).alias("c_custkey"), F.lit(_CELLS).alias("value"))
    path = scratch(spark)
    body.unionByName(head).repartition("part").sortWithinPartitions("part", "c_custkey").select("part", "value").write.partitionBy("part").text(path)
    header = quarantine.csv_header(spark, path)
    fine, bad = quarantine.divide(quarantine.scan_csv(spark, path, header))
    told = quarantine.located(bad, path).select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "offset", "reason", "text", F.lit(None).cast("string").alias("email"), F.lit(None).cast("string").alias("skills"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    read = quarantine.csv_records(fine, header).select(none("long", "part"), none("long", "offset"), none("string", "reason"), none("string", "text"), F.array_join("emails", ",").alias("email"), F.array_join("skills", ",").alias("skills"))
    return told.unionByName(read)


_BAD_EXPORTS = """CASE o_orderkey % 7 WHEN 0 THEN '{"id": "A' || CAST(o_orderkey AS STRING) || '", "email": ' WHEN 1 THEN '["A' || CAST(o_orderkey AS STRING) || '"]' WHEN 2 THEN '  ' WHEN 3 THEN CAST(o_orderkey AS STRING)
    ELSE '{"id": "A' || CAST(o_orderkey AS STRING) || '", "emails": ["U' || CAST(o_custkey AS STRING) || '@x.org", "no mail"], "tags": "sql, py"}' END"""


@query(f"""WITH l AS (SELECT o_orderkey, o_custkey, o_orderkey // 20000 AS part, o_orderkey % 7 AS k, {_BAD_EXPORTS} AS text FROM orders),
    p AS (SELECT *, coalesce(sum(strlen(text) + 1) OVER (PARTITION BY part ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM l)
    SELECT CASE WHEN k < 4 THEN part END AS part, CASE WHEN k < 4 THEN pos::BIGINT END AS "offset", CASE k WHEN 0 THEN 'no JSON' WHEN 1 THEN 'no object' WHEN 2 THEN 'blank' WHEN 3 THEN 'no object' END AS reason,
    CASE WHEN k < 4 THEN text END AS text, CASE WHEN k >= 4 THEN 'A' || o_orderkey END AS fusion_id, CASE WHEN k >= 4 THEN 'u' || o_custkey || '@x.org' END AS email FROM p""")
def quarantine_ats(spark, sf_dir):
    """Exports made of all orders in files of 20,000 lines, four of seven broken: the bad lines with their places, and the good ones' records."""
    part = F.expr("o_orderkey div 20000")
    path = scratch(spark)
    _t(spark, sf_dir, "orders").select(part.alias("part"), "o_orderkey", F.expr(_BAD_EXPORTS).alias("value")).repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value").write.partitionBy("part").text(path)
    fine, bad = quarantine.divide(quarantine.scan_ats(spark, path))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    told = quarantine.located(bad, path).select(F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part"), "offset", "reason", "text", none("string", "fusion_id"), none("string", "email"))
    return told.unionByName(quarantine.ats_records(fine).select(none("long", "part"), none("long", "offset"), none("string", "reason"), none("string", "text"), "fusion_id", F.array_join("emails", ",").alias("email")))


_MENTION = "CASE WHEN o_orderkey % 3 = 0 THEN ' CUSTOMER#000000001 ' WHEN o_orderkey % 50 = 1 THEN NULL ELSE '  customer#' || lpad(CAST(o_custkey AS STRING), 9, '0') END"


@query(f"WITH m AS (SELECT o_orderkey, {_MENTION} AS mention FROM orders), a AS (SELECT lower(c_name) AS k, min(c_mktsegment || c_custkey % 4) AS v FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1) SELECT o_orderkey, mention, v AS canonical FROM m LEFT JOIN a ON lower(trim(mention)) = k")
def alias_join(spark, sf_dir):
    """All orders' mentions of customers, a third of them of one, by an alias table made of the customers."""
    names = _t(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").selectExpr("c_name AS alias", "c_mktsegment || CAST(c_custkey % 4 AS STRING) AS canonical")
    return canonical(_t(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_MENTION} AS mention"), "mention", names)


@query(_R + f", e AS (SELECT lower({_strip('unnest(string_split(skills, chr(59)))')}) AS name FROM r), a AS (SELECT unnest([{', '.join(repr(k) for k in SKILLS)}]) AS name) SELECT name, count(*) AS n FROM e ANTI JOIN a USING (name) WHERE name <> '' GROUP BY name")
def unknown_skills(spark, sf_dir):
    """Skills of all records that no alias has."""
    return unknown(flat_records(spark, sf_dir).select(F.explode(F.split("skills", ";")).alias("skill")), "skill", spark.createDataFrame(list(SKILLS.items()), "alias string, canonical string"))


@query("SELECT 'customers' AS output, c_custkey AS key, c_name AS name, n FROM customer, (SELECT count(*) AS n FROM customer) UNION ALL SELECT 'nations', n_nationkey, n_name, n FROM nation, (SELECT count(*) AS n FROM nation)")
def publish_outputs(spark, sf_dir):
    """Two outputs published together, three times at one place; what the manifest names is read, with the rows that were counted in writing."""
    path = scratch(spark)
    tables = {"customers": _t(spark, sf_dir, "customer").selectExpr("c_custkey AS key", "c_name AS name"), "nations": _t(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey AS LONG) AS key", "n_name AS name")}
    for name in ("", "older", None):
        publish(tables if name is None else {k: df.withColumn("name", F.lit(name)) for k, df in tables.items()}, path)
    rows = {k: x["rows"] for k, x in manifest(spark, path)["outputs"].items()}
    parts = [published(spark, path, k, "key long, name string").select(F.lit(k).alias("output"), "key", "name", F.lit(n).cast("long").alias("n")) for k, n in rows.items()]
    return parts[0].unionByName(parts[1])
