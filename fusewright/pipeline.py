"""A whole run: sources, fusion, validation, projection, report, output."""

from __future__ import annotations

import functools
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import FusionError, NoSourceError, ProfileError
from .functions.lookups import DEFAULT_PROJECTION
from .functions.text import entity_id
from .operators import merge as M
from .operators.resolve import MOST_SHARED, resolve
from .operators.validate import validate
from .plans.project import project, report
from .plans.sinks import pretty, publish, write_lines, write_text
from .schema import SOURCE_RECORD
from .sources import ats, fetch, profile, quarantine, resume, table
from .sources.files import load_config

CANDIDATE_FILE, REPORT_FILE = "candidate.json", "pipeline_report.json"
#: Readers by name, (spark, path) -> source records; add one to read a further source.
SOURCES = {"resume": resume.read, "ats": ats.read, "csv": table.read, "github": profile.read}


@dataclass
class PipelineResult:
    """profiles: validated, not projected.  warnings: of sources that failed or were cut to one row, and of bad rows.

    counters: of the profiles written, taken while they were; empty without output.
    """

    profiles: DataFrame
    report: DataFrame
    sources: list[str]
    warnings: list[str] = field(default_factory=list)
    candidate_path: str | None = None
    report_path: str | None = None
    elapsed_seconds: float = 0.0
    counters: dict = field(default_factory=dict)


@dataclass
class SafeResult:
    success: bool
    result: PipelineResult | None = None
    error: str | None = None


def fuse(records: DataFrame) -> DataFrame:
    """Validated profiles, one per fusion_id."""
    return validate(M.merge(records))


def counted(profiles: DataFrame) -> tuple[DataFrame, Observation]:
    """The profiles, and their counters once an action has read them: no job of their own."""
    seen = Observation("profiles")
    n = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    lists = {c: n(c).alias(c) for c in ("skills", "experience", "education")}
    return profiles.observe(seen, F.count(F.lit(1)).alias("profiles"), *lists.values(), n("validator_warnings").alias("validator_warnings"), F.round(F.avg("overall_confidence"), 4).alias("confidence")), seen


def read_apart(spark: SparkSession, name: str, path: str, folder: str) -> tuple[DataFrame, int]:
    """(records, number of bad rows) of a table or of exports by line; bad rows go to ``folder``/name as JSON lines with file, offset and reason."""
    header = quarantine.csv_header(spark, path) if name == "csv" else []
    scan = quarantine.scan_csv(spark, path, header) if name == "csv" else quarantine.scan_ats(spark, path)
    fine, bad = quarantine.divide(scan)
    told, seen = quarantine.located(bad, path), Observation("bad")
    write_lines(told.observe(seen, F.count(F.lit(1)).alias("n")), f"{folder.rstrip('/')}/{name}")
    return quarantine.csv_records(fine, header) if name == "csv" else quarantine.ats_records(fine), seen.get["n"]


def by_first_email(records: DataFrame) -> DataFrame:
    """The records with fusion_id made from the first email, else from the name; with neither it stays."""
    return records.withColumn("fusion_id", F.coalesce(entity_id(F.coalesce(F.get("emails", F.lit(0)), F.lower("full_name"))), "fusion_id"))


def by_any_identifier(records: DataFrame, most: int = MOST_SHARED) -> DataFrame:
    """The records with fusion_id of the entity that they are linked to by any email, phone or link; see ``resolve``."""
    whole = F.to_json(F.struct(*(c for c in records.columns)))
    named = records.withColumn("record_id", F.concat_ws("/", "source", F.sha2(whole, 256)))  # equal rows are one record
    entity, _ = resolve(named, most=most)
    return named.join(entity.select("record_id", "entity_id").distinct(), "record_id").withColumn("fusion_id", entity_id(F.col("entity_id"))).select(records.columns)


def fetch_profile(spark: SparkSession, who: str, **server) -> DataFrame:
    """Source records of one developer, by user name or profile link, fetched once."""
    row = fetch.fetched(spark.createDataFrame([(who,)], "username string"), **server).first()
    if row is None or row["status"] != 200:
        raise ProfileError(f"{who}: {row['error'] if row else 'no user name'}")
    return fetch.split(spark.createDataFrame([row], fetch.FETCHED))[0]


def run_pipeline(
    spark: SparkSession, *, resume_path: str | None = None, ats_path: str | None = None, csv_path: str | None = None, github_path: str | None = None, github_username: str | None = None, github_server: dict | None = None,
    output_dir: str | None = None, projection_config_path: str | None = None, one_entity: bool = True, link_any: bool = False, quarantine_dir: str | None = None,
) -> PipelineResult:
    """Reads the given sources, fuses them and writes profile and report.

    one_entity: all sources describe one candidate, of a table the first row counts, output is two JSON
    files.  Otherwise records meet by their first email, else by name (link_any: by any email, phone or link), and output is two folders of JSON
    lines, published together (``plans.sinks.published`` reads them).  github_username: a developer whose profile is fetched, from the server that github_server tells of (see ``fetch.Server``).  A source that cannot be read is a warning as long as another can.
    quarantine_dir: tables, and exports of one object a line, are read line by line, and their bad lines go there.
    """
    began = time.time()
    given = {k: p for k, p in (("resume", resume_path), ("ats", ats_path), ("github", github_path or github_username), ("csv", csv_path)) if p}
    if not given:
        raise NoSourceError("no source was given")
    config = load_config(spark, projection_config_path) if projection_config_path else DEFAULT_PROJECTION
    records, warnings = {}, []
    for name, path in given.items():
        try:
            fetch_it = name == "github" and not github_path
            if quarantine_dir and name in ("csv", "ats"):
                found, n_bad = read_apart(spark, name, path, quarantine_dir)
                if n_bad:
                    warnings.append(f"{name}: {n_bad} bad rows in {path}")
            else:
                found = fetch_profile(spark, path, **(github_server or {})) if fetch_it else SOURCES[name](spark, path)
            if found.isEmpty():  # readers are lazy: this reads their first row, so that what is broken shows here
                warnings.append(f"{name}: no record in {path}")
            else:
                records[name] = found
        except FusionError as e:
            warnings.append(f"{name}: {e}")
        except Exception as e:  # noqa: BLE001  whatever a source's file holds, the others go on
            warnings.append(f"{name}: {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
    if not records:
        raise NoSourceError("all sources failed: " + "; ".join(warnings))
    if one_entity and "csv" in records and (n := records["csv"].count()) > 1:
        warnings.append(f"csv: the first of {n} rows is used")
    columns = [x.name for x in spark.createDataFrame([], SOURCE_RECORD).schema]
    together = functools.reduce(DataFrame.unionByName, (r.select(columns) for r in records.values()))
    profiles = fuse(together.withColumn("fusion_id", F.lit("candidate")) if one_entity else by_any_identifier(together) if link_any else by_first_email(together))
    flags = config.get("report", {})
    told = report(profiles, flags, warnings, {k: given[k].rstrip("/").rsplit("/", 1)[-1] for k in records})
    out = PipelineResult(profiles, told, list(records), warnings)
    if output_dir:
        shape = config.get("output", {})
        base = output_dir.rstrip("/")
        out.candidate_path, out.report_path = f"{base}/{shape.get('candidate_json', CANDIDATE_FILE)}", f"{base}/{shape.get('pipeline_report', REPORT_FILE)}"
        observed, seen = counted(profiles)
        shown = project(observed.drop("sources", "validator_warnings"), config)
        out.elapsed_seconds = round(time.time() - began, 4)
        if flags.get("include_timing", True):
            out.report = told = told.withColumn("elapsed_seconds", F.lit(out.elapsed_seconds))
        if one_entity:
            style = (shape.get("indent", 2), shape.get("ensure_ascii", False))
            write_text(spark, out.candidate_path, pretty(shown, *style))
            write_text(spark, out.report_path, pretty(told, *style))
        else:
            names = [p[len(base) + 1 :] for p in (out.candidate_path, out.report_path)]
            made = publish(dict(zip(names, (shown, told))), base)["outputs"]
            out.candidate_path, out.report_path = (f"{base}/{made[n]['path']}" for n in names)
        out.counters = seen.get
    out.elapsed_seconds = round(time.time() - began, 4)
    return out


def safe_run(spark: SparkSession, **arguments) -> SafeResult:
    """``run_pipeline`` that reports every error and raises none."""
    try:
        return SafeResult(True, run_pipeline(spark, **arguments))
    except FusionError as e:
        return SafeResult(False, error=str(e))
    except Exception as e:  # noqa: BLE001  a caller's boundary
        return SafeResult(False, error=f"{type(e).__name__}: {e}")
