import json

import pytest
from pyspark.sql import functions as F

from fusewright.__main__ import main
from fusewright.errors import CsvError
from fusewright.operators import alias
from fusewright.pipeline import run_pipeline
from fusewright.sources import quarantine as Q

HEAD = "﻿Name,E-mail,Email,Skills\r\n".encode()
GOOD = [b'Jane Doe,x,jane@x.org,"py, sql"\r\n', "Zoë,,z@x.org,\n".encode(), b"short row\n"]
BAD = [(b"a,b,c,d,e\n", "too many cells"), (b"\n", "no known cell"), (b'Ann,"open,ann@x.org\n', "open quote"), (b"S\xe3o,,s@x.org,go\n", "no UTF-8"), (b",odd,,nan\r\n", "no known cell")]


def written(path, n):
    """A file of n rounds of good and bad lines, and the offsets of the bad ones."""
    body, expected = HEAD, []
    for i in range(n):
        for k, g in enumerate(GOOD):
            body += g
            line, reason = BAD[(i + k) % len(BAD)]
            expected.append((len(body), reason))
            body += line
    path.write_bytes(body)
    return expected


@pytest.mark.parametrize("split", [None, 61])
def test_csv_lines(spark, tmp_path, split):
    """Offsets are exact, also where splits begin within lines."""
    expected = {(f"{name}.csv", *x) for name, n in (("a", 30), ("b", 7)) for x in written(tmp_path / f"{name}.csv", n)}
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        path = str(tmp_path)
        header = Q.csv_header(spark, path)
        scan = Q.scan_csv(spark, path, header)
        fine, bad = Q.divide(scan)
        got = [(x.file.rsplit("/", 1)[-1], x.offset, x.reason) for x in Q.located(bad, path).collect()]
        assert set(got) == expected and len(got) == len(expected)
        names = sorted(x.full_name for x in Q.csv_records(fine, header).collect())
        assert names == ["Jane Doe"] * 37 + ["Short Row"] * 37 + ["Zo"] * 37
        if split:
            assert scan.select("file", "split").distinct().count() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_corners(spark, tmp_path):
    (tmp_path / "h.csv").write_bytes(b"name,odd\n")
    assert Q.scan_csv(spark, f"{tmp_path}/h.csv").count() == 0
    (tmp_path / "u.csv").write_bytes(b"one,two\na,b")
    assert [(x.reason, x.text) for x in Q.scan_csv(spark, f"{tmp_path}/u.csv").collect()] == [("no known cell", "a,b")]
    fine, bad = Q.divide(Q.scan_csv(spark, f"{tmp_path}/h.csv"))
    assert fine.count() == bad.count() == 0
    for name, content in (("e.csv", b""), ("gone.csv", None)):
        if content is not None:
            (tmp_path / name).write_bytes(content)
        with pytest.raises(CsvError):
            Q.scan_csv(spark, f"{tmp_path}/{name}")


def test_run_apart(spark, tmp_path, capsys):
    """A run goes on without its bad rows, tells of them, and counts what it writes while it writes."""
    written(tmp_path / "c.csv", 1)
    (tmp_path / "a.json").write_text("\n".join([json.dumps({"id": "A1", "email": "jane@x.org", "skills": ["go"]}), "{", "[1]", "  ", "7"]))
    r = run_pipeline(spark, csv_path=f"{tmp_path}/c.csv", ats_path=f"{tmp_path}/a.json", output_dir=f"{tmp_path}/out", one_entity=False, quarantine_dir=f"{tmp_path}/bad")
    assert r.sources == ["ats", "csv"] and [w.split(" in ")[0] for w in r.warnings] == ["ats: 4 bad rows", "csv: 3 bad rows"]
    reasons = [x.reason for x in spark.read.json(f"{tmp_path}/bad/ats").orderBy("offset").collect()]
    assert reasons == ["no JSON", "no object", "blank", "no object"] and spark.read.json(f"{tmp_path}/bad/csv").count() == 3
    kept = spark.read.json(r.candidate_path)
    plain = kept.agg(F.count(F.lit(1)).alias("profiles"), *(F.sum(F.size(c)).alias(c) for c in ("skills", "experience", "education"))).first().asDict()
    assert {k: r.counters[k] for k in plain} == plain and plain["profiles"] == 3 and plain["skills"] == 3


def test_counters_cost_no_job(spark, tmp_path):
    from fusewright.pipeline import counted

    tracker, p = spark.sparkContext.statusTracker(), spark.createDataFrame([("a", ["x", "y"], [], [], [], 0.5), ("b", ["z"], [], [], ["w"], 0.75)], "fusion_id string, skills array<string>, experience array<string>, education array<string>, validator_warnings array<string>, overall_confidence double")
    observed, seen = counted(p)
    spark.sparkContext.setJobGroup("counted", "")
    try:
        observed.select("fusion_id").write.parquet(f"{tmp_path}/p")
        jobs = len(tracker.getJobIdsForGroup("counted"))
        assert seen.get == {"profiles": 2, "skills": 3, "experience": 0, "education": 0, "validator_warnings": 1, "confidence": 0.625}
        assert len(tracker.getJobIdsForGroup("counted")) == jobs == 1
    finally:
        spark.sparkContext.setJobGroup("", "")


ALIASES = [("PY ", "Python"), ("py", "Pyrex"), ("js", "JavaScript"), (None, "x"), ("y", None), ("hot", "Heat")]


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_aliases(spark, small):
    """The broadcast and the shuffled way give the same rows, with a name that holds most of them and one that has no alias."""
    names = [" Py", "JS", "none", None, "", "y"] + ["hot"] * 3000 + ["warm"] * 1500 + [f"rare{i}" for i in range(3000)]
    rows = spark.createDataFrame([(i, n, "kept") for i, n in enumerate(names)], "id int, name string, alias string")
    pairs = spark.createDataFrame(ALIASES + [(f"RARE{i}", f"r{i % 5}") for i in range(0, 3000, 2)], "alias string, canonical string")
    got = {r.id: r.to for r in alias.canonical(rows, "name", pairs, "to", small).collect()}
    table = {"py": "Pyrex", "js": "JavaScript", "hot": "Heat"} | {f"rare{i}": f"r{i % 5}" for i in range(0, 3000, 2)}
    assert got == {i: table.get(n.strip().lower()) if n else None for i, n in enumerate(names)}
    assert alias.canonical(rows, "name", pairs, "to", small).columns == ["id", "name", "alias", "to"]
    missing = {r.name: r.n for r in alias.unknown(rows, "name", pairs, small).collect()}
    assert missing == {"none": 1, "y": 1, "warm": 1500} | {f"rare{i}": 1 for i in range(1, 3000, 2)}
    empty = spark.createDataFrame([], "alias string, canonical string")
    assert alias.canonical(rows, "name", empty, "to", small).where("to is null").count() == len(names) and alias.unknown(rows.limit(0), "name", pairs, small).count() == 0
