"""Command line: fuses the given sources and prints a summary."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .errors import FusionError
from .pipeline import run_pipeline


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fusewright", description="Consolidates records about candidates from several sources.")
    for name, what in (("csv", "table of candidates"), ("ats", "JSON export of a tracking system"), ("resume", "résumé as text"), ("github", "landed developer profile, JSON")):
        p.add_argument(f"--{name}", metavar="PATH", help=what)
    p.add_argument("--github-username", metavar="NAME", help="developer whose profile is fetched")
    p.add_argument("--github-token", metavar="TOKEN", help="for more calls an hour")
    p.add_argument("--github-api", metavar="URL", help="another server")
    p.add_argument("--output-dir", default="output", metavar="PATH")
    p.add_argument("--projection-config", metavar="PATH")
    p.add_argument("--many", action="store_true", help="the sources hold many candidates, which meet by their first email")
    p.add_argument("--link-any", action="store_true", help="with --many: candidates meet by any shared email, phone or link")
    p.add_argument("--quarantine-dir", metavar="PATH", help="bad lines of tables and exports go there")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    p = parser()
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING)
    if not any((a.csv, a.ats, a.resume, a.github, a.github_username)):
        p.print_help()
        return 1
    spark = SparkSession.builder.appName("fusewright").getOrCreate()
    server = {k: v for k, v in (("token", a.github_token), ("base", a.github_api)) if v}
    try:
        r = run_pipeline(spark, resume_path=a.resume, ats_path=a.ats, csv_path=a.csv, github_path=a.github, output_dir=a.output_dir, projection_config_path=a.projection_config, one_entity=not a.many, quarantine_dir=a.quarantine_dir, link_any=a.link_any, github_username=a.github_username, github_server=server)
    except FusionError as e:
        print(f"failed: {e}", file=sys.stderr)
        return 1
    print("\n".join(f"{k}: {v}" for k, v in (r.counters | {"sources": ", ".join(r.sources), "candidate": r.candidate_path, "report": r.report_path, "seconds": r.elapsed_seconds}).items()))
    for w in r.warnings:
        print(f"warning: {w}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
