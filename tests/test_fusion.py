import pytest
from pyspark.sql import functions as F

from fusewright.functions import normalize as N
from fusewright.functions import text as T
from fusewright.operators import merge as M
from fusewright.operators.validate import validate
from fusewright.plans.project import project, report
from fusewright.schema import SOURCE_RECORD
from fusewright.sources.profile import username

CASES = [
    (N.email, [(" Jane@Example.COM ", "jane@example.com"), ("jane@example.com", "jane@example.com"), ("bad@", None), ("janeexample.com", None), ("jane@@example.com", None), ("jane@example", None), ("jane+tag@example.com", "jane+tag@example.com"), ("u@mail.firm.co.uk", "u@mail.firm.co.uk"), ("", None), (None, None)]),
    (N.name, [("  mary-jane   o'neil ", "Mary-Jane O'Neil"), ("John 2nd", "John Nd"), ("JOHN DOE", "John Doe"), ("Ann 123 Lee", "Ann Lee"), ("123", None), ("", None), (None, None)]),
    (N.location, [("NYC", "New York, NY"), ("hyd", "Hyderabad, India"), (" BLR ", "Bengaluru, India"), ("hyderabad ,india", "Hyderabad, India"), ("new york, usa", "New York, Usa"), ("", None), (None, None)]),
    (N.url, [("example.com", "https://example.com"), ("www.example.com", "https://www.example.com"), ("https://a.b/c", "https://a.b/c"), ("http://a.b", "http://a.b"), ("nothing_at_all", None), ("", None), (None, None)]),
    (N.date, [("2019", "2019-01"), ("06/2019", "2019-06"), ("3/2020", "2020-03"), ("2020/7", "2020-07"), ("Present", "Present"), ("current", "Present"), ("NOW", "Present"), ("—", "Present"), ("--", "Present"), ("Sept 2018", "2018-09"), ("Jun. 2018", "2018-06"), ("January 2021", "2021-01"), ("Mar 5, 2021", "2021-03"), ("2021-04-30", "2021-04"), ("13/2019", "2019-13"), ("zzz", None), ("", None), (None, None)]),
    (lambda c: N.date(c, 2025), [  # any spelling; the month of what a text leaves open is January 2000
        ("5th of June, 2020", "2020-06"), ("JUNE 2020", "2020-06"), ("Sept. 2018", "2018-09"), ("2018 Sep", "2018-09"), ("Sep-2018", "2018-09"), ("Sep2018", "2018-09"), ("04.06.2020", "2020-04"), ("14.06.2020", "2020-06"), ("2020.06.14", "2020-06"),
        ("1/2/03", "2003-01"), ("25/12/1999", "1999-12"), ("12/25/99", "1999-12"), ("99-12-25", "1999-12"), ("Apr-2003-25", "2003-04"), ("25-Apr-76", "1976-04"), ("25-Apr-74", "2074-04"), ("Tue, 3 Mar 2020 10:20:30 GMT", "2020-03"),
        ("2020-03-04T05:06:07.89+05:30", "2020-03"), ("March 3 2020 at 5 pm", "2020-03"), ("20200314", "2020-03"), ("20200314101112", "2020-03"), ("200314", "2014-03"), ("Monday", "2000-01"), ("10:30", "2000-01"), ("7", "2000-01"), ("May", "2000-05"),
        ("29 Feb 2020", "2020-02"), ("29 Feb 2019", None), ("31 June 2020", None), ("13/13/2020", None), ("June July 2020", None), ("1 2 3 4", None), ("12345", None), ("2020-06-00", None), ("June 2020!", None), ("– 2020", None), ("06.2019", None), (" \t", None), (".,", None),
        ("June " * 1000, None), ("2020 2021", None), ("x" * 5000, None),
    ]),
    (N.phone, [  # numbering plans
        ("+49 30 123456", "+4930123456"), ("+49 30 12", None), ("+39 06 698 12345", "+390669812345"), ("+81 90-1234-5678", "+819012345678"), ("+55 (11) 91234-5678", "+5511912345678"), ("+880 1712 345678", "+8801712345678"), ("+880 17", None),
        ("+1 (212) 155-0100", None), ("+1 112 555 0100", None), ("+999 123456789", None), ("+", None), ("++91 98765 43210", "+919876543210"), ("+91 98765 43210 +", "+919876543210"), ("+971 4 123 4567", "+97141234567"), ("+353 86 123 4567", "+353861234567"),
        ("+35 812 3456789", "+358123456789"), ("+44 9123 456789", None), ("9" * 40, None), ("09876543210", "+919876543210"),
    ]),
    (lambda c: N.phone(c, "49"), [("030 123456", "+4930123456"), ("+1 212 555 0100", "+12125550100"), ("4930123456", "+494930123456")]),
    (N.years, [("5+ years", 5.0), ("3-5", 4.0), ("2.5", 2.5), ("1 2 9", 1.5), ("none", None), ("", None), (None, None)]),
    (N.phone, [("98765 43210", "+919876543210"), ("+91-9876543210", "+919876543210"), ("919876543210", "+919876543210"), ("+1 (212) 555-0100", "+12125550100"), ("+1-415-555-1234", "+14155551234"), ("+44 7911 123456", "+447911123456"), ("098765 43210", "+919876543210"), ("123", None), ("0" * 19, None), ("no number", None), ("", None), (None, None)]),
    (lambda c: N.phone(c, "1"), [("415-555-1234", "+14155551234"), ("98765", None)]),
    (N.skill, [("py", "Python"), (" K8S ", "Kubernetes"), ("PyThOn", "Python"), ("js", "JavaScript"), ("reactjs", "React"), ("ml", "Machine Learning"), ("nlp", "Natural Language Processing"), ("data lakes", "Data Lakes"), (None, None)]),
    (lambda c: F.array_join(N.skills_list(F.split(c, ",")), ","), [("python,Python,py", "Python"), ("python,docker,aws", "Python,Docker,AWS"), ("X y,x Y", "X Y")]),
    (T.coerce, [(" N/A ", None), ("None", None), ("-", None), (" \t", None), (" x ", "x"), (None, None)]),
    (T.slugify, [(" Hello, World_again ", "hello-world-again"), ("a -- b", "a-b")]),
    (lambda c: T.truncate(c, 5), [("abcdefgh", "ab..."), ("abcde", "abcde"), (None, None)]),
    (lambda c: F.array_join(T.split_multi(c, "[;|]"), "/"), [(" a ;; b|c ", "a/b/c"), (";", ""), (None, None)]),
    (T.title, [("x2y o'brien", "X2Y O'Brien"), ("", "")]),
    (username, [("octo", "octo"), ("@octo", "octo"), ("https://github.com/octo-cat/repo", "octo-cat"), ("github.com/octo.cat", "octo"), (" octo/ ", "octo")]),
]


@pytest.mark.parametrize("function,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_function(spark, function, cases):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, x string").select("i", function(F.col("x")).alias("y")).collect()
    assert {r.i: r.y for r in rows} == {i: c[1] for i, c in enumerate(cases)}


def test_merge(spark):
    rows = [
        ("e", "csv", 0, None, "jane doe", ["J@x.org", "a@x.org"], ["98765 43210"], "nyc", "dev", ["py", "SQL"], [("x.org", "Site")], None, None, "4"),
        ("e", "ats", 0, "A1", None, ["a@x.org"], None, None, None, ["python"], None, [("Eng", "Acme", "2019", "Present", None, None), ("eng", " acme", "2020", None, None, None)], None, "3-5"),
        (None, "csv", 0, None, "nobody", None, None, None, None, None, None, None, None, None),
    ]
    out = validate(M.merge(spark.createDataFrame(rows, SOURCE_RECORD))).collect()
    assert len(out) == 1
    p = out[0]
    assert (p.candidate_id, p.full_name, p.emails, p.phones, p.years_experience) == ("A1", "Jane Doe", ["a@x.org", "j@x.org"], ["+919876543210"], 4.0)
    assert [(s.canonical_name, s.sources) for s in p.skills] == [("Python", ["ats", "csv"]), ("SQL", ["csv"])] and len(p.experience) == 1
    assert p.sources == ["ats", "csv"] and 0 <= p.overall_confidence <= 1


def test_project_and_report(spark):
    rows = [("e", "csv", 0, None, "jane doe", ["J@x.org"], None, None, None, ["py"], None, None, None, "4")]
    p = M.merge(spark.createDataFrame(rows, SOURCE_RECORD))
    q = project(p, {"hide_provenance": True, "hide_confidence": True, "field_aliases": {"full_name": "name", "emails": "email_addresses"}, "exclude_fields": ["headline"]})
    assert {"name", "email_addresses"} <= set(q.columns) and not {"provenance", "overall_confidence", "headline", "full_name"} & set(q.columns)
    told = report(p, warnings=["late"]).first()
    assert told.validation_warnings == ["late"] and told.sources_used == ["csv"] and told.field_confidences["full_name"] == 0.85
    assert "overall_confidence" not in report(p, {"include_field_confidences": False}).columns and project(p).columns == p.columns
    assert "full_name" in project(p, {}).columns


PROFILE = "fusion_id string, candidate_id string, full_name string, emails array<string>, phones array<string>, years_experience double, skills array<struct<canonical_name:string>>, experience array<struct<company:string,title:string>>, education array<struct<institution:string>>, overall_confidence double"
VALID = {"fusion_id": "f", "candidate_id": "c1", "full_name": "Ann Lee", "emails": ["a@b.co"], "phones": ["+919876543210"], "years_experience": 5.0, "skills": [], "experience": [], "education": [], "overall_confidence": 0.85}
RULES = [
    ({}, {}), ({"full_name": "A"}, {"full_name": None}), ({"emails": ["a@b.co", "bad", "b@@c.co"]}, {"emails": ["a@b.co"]}), ({"phones": ["98765", "+1212"]}, {"phones": ["+1212"]}), ({"years_experience": 75.0}, {"years_experience": None}),
    ({"years_experience": -1.0}, {"years_experience": None}), ({"years_experience": 60.0}, {}), ({"skills": [(" ",), ("Go",)]}, {"skills": [("Go",)]}), ({"experience": [(None, ""), (None, "T")]}, {"experience": [(None, "T")]}),
    ({"education": [(None,), ("U",)]}, {"education": [("U",)]}), ({"overall_confidence": 1.5}, {"overall_confidence": 1.0}), ({"overall_confidence": -0.5}, {"overall_confidence": 0.0}), ({"overall_confidence": None}, {"overall_confidence": 0.0}),
]


@pytest.mark.parametrize("given,want", RULES, ids=str)
def test_rule(spark, given, want):
    before = VALID | given
    got = validate(spark.createDataFrame([tuple(before.values())], PROFILE)).first()
    for field, value in (before | want).items():
        assert [tuple(x) if not isinstance(x, str) else x for x in got[field]] == value if isinstance(value, list) else got[field] == value
    dropped = want and "overall_confidence" not in want
    assert bool(got.validator_warnings) == bool(dropped)


def test_empty_id(spark):
    got = [validate(spark.createDataFrame([tuple((VALID | {"candidate_id": i}).values())], PROFILE)).first() for i in ("", None)]
    assert all(len(r.candidate_id) == 16 and r.validator_warnings for r in got)


JOBS = [("Senior Engineer", "One", "Jan 2021", "Present", None, "Pune, India"), ("Scientist", "Two", "Jun 2019", "Dec 2020", None, None), ("Analyst", "Two", "Jun 2018", "May 2019", None, None)]
STUDIES = [("Institute", "M.Tech", None, "2016", "2018", 8.7), ("University", "B.E.", None, "2012", "2016", 9.1)]
ATS = ("e", "ats", 0, "A1", "Asha Rao", ["asha@x.org"], ["+919876543210"], "Pune, Maharashtra, India", "Engineer", ["Python", "Machine Learning", "TensorFlow", "PyTorch", "Kubernetes", "Docker", "AWS", "FastAPI", "PostgreSQL", "Python", "ml", "tensorflow"], None, JOBS, STUDIES, "6")
CSV = ("e", "csv", 0, None, "Asha Rao", ["asha@x.org"], ["98765 43210"], "Pune, India", "Engineer", ["Python", "ML", "TensorFlow", "Django", "AWS"], None, None, None, "6")


@pytest.mark.parametrize("records,overall,skills", [([ATS], 0.836, 9), ([CSV], 0.5685, 5), ([ATS, CSV], 0.8735, 10)], ids=["ats", "csv", "both"])
def test_worked_example(spark, records, overall, skills):
    p = M.merge(spark.createDataFrame(records, SOURCE_RECORD)).first()
    assert p.overall_confidence == overall and len(p.skills) == skills
    if len(records) == 2:
        assert [(s.canonical_name, s.confidence, len(s.sources)) for s in p.skills] == [
            ("Machine Learning", 0.97, 2), ("TensorFlow", 0.97, 2), ("Python", 0.95, 2), ("AWS", 0.95, 2), ("Kubernetes", 0.95, 1), ("PostgreSQL", 0.95, 1), ("PyTorch", 0.93, 1), ("Docker", 0.93, 1), ("FastAPI", 0.93, 1), ("Django", 0.83, 1),
        ]
        fields = {x.field: (x.confidence, x.adjusted) for x in p.provenance}
        assert fields["full_name"] == (0.95, 0.92) and fields["location"] == (0.93, 0.9) and fields["phones"] == (0.92, 0.84) and fields["experience"] == (0.85, 0.77)
