import json

import pytest
from pyspark.sql import functions as F

from fusewright.__main__ import main
from fusewright.errors import ConfigError, CsvError
from fusewright.pipeline import by_first_email, run_pipeline, safe_run
from fusewright.operators.score import tier
from fusewright.plans.project import education_view, skill_view
from fusewright.sources import ats, profile, resume, table
from fusewright.sources.files import load_config
from fusewright.streaming.refresh import current, refresh

RESUME = """Jane Doe
Senior Data Engineer
jane@x.org | +91 98765 43210 | Pune, India

SKILLS
Languages: Python, SQL, Docker, Kubernetes, Rust

EXPERIENCE
Data Engineer
Acme | Pune | Jan 2020 – Jan 2022
• built things
"""
EXPORT = {"candidate": {"id": "A7", "full_name": "JANE DOE", "email": "Jane@X.org", "location": {"city": "Pune", "state": "MH", "country": "India"}, "skills": [{"name": "py"}, "k8s", {"skill": "Python"}],
          "experience": [{"title": "Lead", "company": {"name": "Acme"}, "startDate": "2020", "current": True}, {"description": "nobody"}],
          "education": [{"school": "Open University", "degree": "BSc", "gpa": "8.5"}, {"degree": "MSc"}], "links": [{"href": "x.org/j", "type": "Blog"}, "x.org/j"], "linkedin": "linkedin.com/in/j"}}


@pytest.fixture
def files(tmp_path):
    (tmp_path / "c.csv").write_text("﻿Candidate Name,Email,Email Address,Phone,Skills,GitHub URL,Odd\njane doe,no@x.org,JANE@x.org;j@y.org,98765 43210,py|SQL,github.com/j,1\nshort row,s@x.org\n,,,,,,\na,b,c,d,e,f,g,too long\na,b,c,d,e,f,g,\n")
    (tmp_path / "a.json").write_text(json.dumps(EXPORT, indent=1))
    (tmp_path / "r.txt").write_text(RESUME)
    (tmp_path / "g.json").write_text(json.dumps({"user": {"login": "j", "name": "Jane", "bio": "dev", "blog": ""}, "repos": [{"language": "Rust"}, {"language": "Jupyter Notebook"}, {"language": "Rust"}, {"language": "C", "fork": True}]}))
    return tmp_path


def test_table(spark, files):
    rows = table.read(spark, f"{files}/c.csv").orderBy("seq").collect()
    assert [r.full_name for r in rows] == ["Jane Doe", "Short Row"]
    assert rows[0].emails == ["jane@x.org", "j@y.org"] and rows[0].skills == ["Python", "SQL"]  # the last of two columns counts
    assert [tuple(x) for x in rows[0].links] == [("https://github.com/j", "GitHub")] and rows[1].emails == []
    (files / "l.csv").write_bytes("name,location,skills\nAnn Lee,S\xe3o Paulo,\"go,\npy\"\n".encode("latin-1"))
    latin = table.read(spark, f"{files}/l.csv").first()
    assert (latin.location, latin.skills) == ("São Paulo", ["Go", "Python"])
    (files / "e.csv").write_text("")
    for name in ("none.csv", "e.csv"):
        with pytest.raises(CsvError):
            table.read(spark, f"{files}/{name}")


def test_export(spark, files):
    r = ats.read(spark, f"{files}/a.json").first()
    assert (r.candidate_id, r.emails, r.location, r.skills) == ("A7", ["jane@x.org"], "Pune, Mh, India", ["Python", "Kubernetes"])
    assert [(x.title, x.company, x.start_date, x.end_date) for x in r.experience] == [("Lead", "Acme", "2020-01", "Present")]
    assert [(x.institution, x.gpa) for x in r.education] == [("Open University", 8.5)]
    assert [tuple(x) for x in r.links] == [("https://linkedin.com/in/j", "LinkedIn"), ("https://x.org/j", "Blog")]
    shapes = [('{"firstName": "A", "emails": ["a@b.co", {"address": "c@d.co"}], "skills": "py, go", "phone": "98765 43210; 12"}',), ("[1]",), ("nonsense",), (None,), ('{"email": null, "name": ""}',)]
    docs = spark.createDataFrame(shapes, "value string").coalesce(1)
    got = ats.parse(docs).orderBy("seq").collect()
    assert [(x.full_name, x.emails, x.skills, x.phones) for x in got] == [("A", ["a@b.co", "c@d.co"], ["Python", "Go"], ["+919876543210"]), (None, [], [], [])]
    assert ats.broken(docs).count() == 3


def test_profile_and_resume(spark, files):
    g = profile.read(spark, f"{files}/g.json").first()
    assert (g.full_name, g.headline, g.skills) == ("Jane", "dev", ["Rust", "Python"])
    r = resume.read(spark, f"{files}/r.txt").first()
    assert (r.full_name, r.emails, r.phones) == ("Jane Doe", ["jane@x.org"], ["+919876543210"]) and "Rust" in r.skills and len(r.experience) == 1


RESUME_TWO = """ANN LEE
ann@x.org
Lead Analyst
Pune, India

SUMMARY
7+ years of experience

EXPERIENCE
Data Engineer at Acme Corp 2019
Jan 2020 – Present
built things
and more

Lead | Other Inc
2015 - 2016

Analyst
Some Company 2012
3/2012 to 5/2013
EDUCATION
B.Tech in Computer Science, honours
Open University 2010
2006 - 2010
GPA: 8.75

MIT Boston
Master of Arts
"""


def test_resume_entries(spark):
    r = resume.parse(spark.createDataFrame([(1, RESUME_TWO), (2, ""), (3, None)], "doc_id int, text string")).orderBy("fusion_id").collect()
    assert (r[0].full_name, r[0].headline, r[0].location, r[0].years_experience) == ("Ann Lee", "Lead Analyst", "Pune, India", "7.0")
    assert [tuple(x)[:5] for x in r[0].experience] == [("Data Engineer", "Acme Corp", "2020-01", "Present", "built things and more"), ("Lead", "Other Inc", "2015-01", "2016-01", None), ("Analyst", "Some Company", "2012-03", "2013-05", None)]
    assert [tuple(x) for x in r[0].education] == [("Open University", "B.Tech", "Computer Science", "2006-01", "2010-01", 8.75), ("MIT Boston", "Master", "of Arts", None, None, None)]
    assert all(x.emails == x.skills == x.experience == [] and x.full_name is None for x in r[1:])


def test_run(spark, files):
    (files / "p.json").write_text(json.dumps({"hide_provenance": True, "field_aliases": {"full_name": "name"}, "output": {"candidate_json": "one.json", "indent": 1}}, indent=1))
    r = run_pipeline(spark, resume_path=f"{files}/r.txt", ats_path=f"{files}/a.json", csv_path=f"{files}/c.csv", github_path=f"{files}/gone.json", output_dir=f"{files}/out", projection_config_path=f"{files}/p.json")
    one = json.loads((files / "out/one.json").read_text())
    assert one["candidate_id"] == "A7" and one["name"] == "Jane Doe" and "provenance" not in one and r.sources == ["resume", "ats", "csv"]
    assert len(r.warnings) == 2 and json.loads((files / "out/pipeline_report.json").read_text())["validation_warnings"] == r.warnings
    many = run_pipeline(spark, ats_path=f"{files}/a.json", csv_path=f"{files}/c.csv", output_dir=f"{files}/many", one_entity=False)
    assert many.profiles.count() == 2 and spark.read.json(many.candidate_path).count() == 2
    assert not safe_run(spark).success and "gone" in safe_run(spark, csv_path=f"{files}/gone.csv").error
    assert main([]) == 1 and main(["--csv", f"{files}/c.csv", "--output-dir", f"{files}/cli"]) == 0
    assert load_config(spark, f"{files}/gone") == {}
    with pytest.raises(ConfigError):
        load_config(spark, f"{files}/r.txt", strict=True)


def test_views(spark):
    rows = [("e", [("Go", 0.8), ("Python", 0.95), ("SQL", 0.8)], [("Open University", "BSc", None, "2010-01", None, 8.5)]), ("f", [], None)]
    p = spark.createDataFrame(rows, "fusion_id string, skills array<struct<canonical_name:string,confidence:double>>, education array<struct<institution:string,degree:string,field_of_study:string,start_date:string,end_date:string,gpa:double>>")
    assert [(x.place, x.skill, x.tier) for x in skill_view(p).orderBy("place").collect()] == [(1, "Python", tier_of(0.95)), (2, "Go", tier_of(0.8)), (3, "SQL", tier_of(0.8))]
    assert [(x.fusion_id, x.gpa) for x in education_view(p).orderBy("fusion_id").collect()] == [("e", "8.50"), ("f", None)]
    assert [x[0] for x in spark.createDataFrame([(0.8,), (0.5,), (0.1,), (None,)], "c double").select(tier(F.col("c"))).collect()] == ["High", "Medium", "Low", "Low"]


def tier_of(confidence):
    return "High" if confidence >= 0.9 else "Medium"


def test_refresh(spark, files):
    first = by_first_email(table.read(spark, f"{files}/c.csv"))
    schema = first.schema
    for k, name in enumerate(("Jane Doe", "Jane Roe")):
        first.withColumn("full_name", F.when(F.col("full_name") == "Jane Doe", name).otherwise(F.col("full_name"))).where(F.lit(k == 0) | (F.col("full_name") == name)).write.mode("append").parquet(f"{files}/in")
        refresh(spark.readStream.schema(schema).parquet(f"{files}/in"), f"{files}/state").awaitTermination(120)
        assert {x.full_name for x in current(spark, f"{files}/state").collect()} == {name, "Short Row"}
