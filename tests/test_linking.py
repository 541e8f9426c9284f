"""Entity resolution, fetching and stateful streaming."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from fusewright.operators.resolve import connected, resolve
from fusewright.pipeline import by_any_identifier, run_pipeline, safe_run
from fusewright.schema import SOURCE_RECORD
from fusewright.sources import fetch
from fusewright.streaming.stateful import current, keep_fused

RECORDS = "record_id string, emails array<string>, phones array<string>, links array<struct<url:string,label:string>>"


def test_chain_and_hub(spark):
    chain = [(f"r{i:02}", [f"a{i}@x.org", f" A{i + 1}@X.org"], None, None) for i in range(10)]  # each shares one email with the next
    hub = [(f"s{i}", ["office@x.org"], [f"98765 4321{i}"], None) for i in range(5)]
    more = [("t1", None, None, [("https://www.x.org/me/", "Site")]), ("t2", [], ["+91 98765 43210"], [("x.org/Me", None)]), ("u1", None, None, None), ("u2", ["bad"], ["12"], [(None, None)]), ("u1", None, None, None)]
    got, hubs = resolve(spark.createDataFrame(chain + hub + more, RECORDS), most=4)
    rows = got.collect()
    entity = {r.record_id: r.entity_id for r in rows}
    assert len(rows) == 20 and all(entity[f"r{i:02}"] == "r00" for i in range(10))
    assert [tuple(r) for r in hubs.collect()] == [("email", "office@x.org", 5)]
    assert entity == entity | {"s0": "s0", "t1": "s0", "t2": "s0", "s1": "s1", "u1": "u1", "u2": "u2"}
    assert {(r.record_id, r.n_identifiers, r.n_hubs) for r in rows} >= {("s1", 2, 1), ("t2", 2, 0), ("u2", 0, 0)}
    linked, hubs = resolve(spark.createDataFrame(hub, RECORDS), most=5)
    assert {r.entity_id for r in linked.collect()} == {"s0"} and hubs.count() == 0
    empty, hubs = resolve(spark.createDataFrame([], RECORDS))
    assert empty.count() == hubs.count() == 0


def test_connected_against_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.a: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}


def test_any_identifier(spark):
    rows = [
        ("x", "csv", 0, None, "Ann Lee", ["a@x.org"], None, None, None, None, None, None, None, None),
        ("y", "ats", 0, "A1", "Ann Lee", ["b@x.org", "a@x.org"], None, None, None, None, None, None, None, None),
        ("z", "resume", 0, None, "Ann Lee", ["b@x.org"], None, None, None, None, None, None, None, None),
        (None, "csv", 1, None, "Bob", None, None, None, None, None, None, None, None, None),
    ]
    got = by_any_identifier(spark.createDataFrame(rows, SOURCE_RECORD)).collect()
    assert len(got) == 4 and len({r.fusion_id for r in got}) == 2 and len({r.fusion_id for r in got if r.full_name == "Ann Lee"}) == 1


class Api(BaseHTTPRequestHandler):
    asked: list = []

    def do_GET(self):
        name = self.path.split("/")[2]
        Api.asked.append(self.path)
        times = sum(p == self.path for p in Api.asked)
        status = {"nobody": 404, "busy": 403, "down": 500}.get(name, 502 if name == "slow" and times < 3 else 200)
        body = [{"language": "Go"}, {"language": None}, {"language": "Go", "fork": True}, "odd"] if "/repos" in self.path else {"login": name, "name": "Jane", "blog": 7, "email": "jane@x.org"}
        data = b"no json" if name == "odd" else json.dumps(body).encode()
        self.send_response(status)
        if status == 403:
            self.send_header("X-RateLimit-Reset", "123")
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *a):
        pass


@pytest.fixture(scope="module")
def api():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


NAMES = "jane nobody busy slow down odd"
STATUS = {"jane": 200, "nobody": 404, "busy": 403, "slow": 200, "down": 500, "odd": 0}


def test_fetch(spark, api):
    fetch.register(spark)
    Api.asked.clear()
    found = spark.read.format(fetch.FORMAT).options(users=NAMES, base=api, wait="0.01", perTask="2").load()
    assert found.rdd.getNumPartitions() == 3
    rows = {r.username: r for r in found.collect()}
    assert {k: r.status for k, r in rows.items()} == STATUS and "123" in rows["busy"].error and rows["slow"].user.blog == "7"
    assert sum("/users/down" in p for p in Api.asked) == 3 and sum("/users/nobody" in p for p in Api.asked) == 1
    good, bad = fetch.split(fetch.fetched(spark.createDataFrame([("https://github.com/jane",), ("@nobody",), ("jane",), ("",)], "username string"), base=api, wait=0.01))
    assert [(r.fusion_id, r.skills, r.emails) for r in good.collect()] == [("jane", ["Go"], ["jane@x.org"])] and [(r.username, r.status) for r in bad.collect()] == [("nobody", 404)]


def test_fetch_stream(spark, api, tmp_path):
    fetch.register(spark)
    for _ in range(2):  # the second run has nothing more to fetch
        Api.asked.clear()
        stream = spark.readStream.format(fetch.FORMAT).options(users=NAMES, base=api, wait="0.01", perBatch="4", attempts="4").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start(f"{tmp_path}/out")
        q.processAllAvailable()
        q.stop()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r.username: r.status for r in got} == STATUS and len(got) == len(STATUS) and not Api.asked


def test_run_fetches(spark, api, tmp_path):
    r = run_pipeline(spark, github_username="jane", github_server={"base": api}, output_dir=str(tmp_path))
    assert json.loads((tmp_path / "candidate.json").read_text())["name"] == "Jane"
    assert json.loads((tmp_path / "pipeline_report.json").read_text())["sources_used"] == ["github:jane"] and r.sources == ["github"]
    assert "404" not in (safe_run(spark, github_username="nobody", github_server={"base": api}).error or "") and not safe_run(spark, github_username="nobody", github_server={"base": api}).success


def test_safe_run(spark, tmp_path):
    (tmp_path / "h.csv").write_text("name,email\n")
    (tmp_path / "b.json.gz").write_bytes(b"no gzip")
    (tmp_path / "c.csv").write_text("name,email\nAnn Lee,a@x.org\n")
    (tmp_path / "p.json").write_text('{"field_aliases": ["a"]}')
    only = safe_run(spark, csv_path=f"{tmp_path}/h.csv")
    assert not only.success and "no record" in only.error
    both = safe_run(spark, csv_path=f"{tmp_path}/c.csv", ats_path=f"{tmp_path}/b.json.gz")
    assert both.success and len(both.result.warnings) == 1 and both.result.warnings[0].startswith("ats")
    assert not safe_run(spark, csv_path=f"{tmp_path}/c.csv", output_dir=f"{tmp_path}/o", projection_config_path=f"{tmp_path}/p.json").success


STREAMED = SOURCE_RECORD + ", event_time timestamp"


def _record(who, source, name, at, skills=()):
    return (who, source, 0, None, name, [f"{who}@x.org"], None, None, None, list(skills), None, None, None, None, at)


def test_stateful(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m=0: datetime(2024, 1, 1, h, m)
    schema = spark.createDataFrame([], STREAMED).schema

    def batch(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = keep_fused(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/state", delay="1 hour")
        assert q.awaitTermination(180)
        return {r.fusion_id: r for r in current(spark, f"{tmp_path}/state").collect()}, sum(p["stateOperators"][0]["numRowsUpdated"] for p in map(_plain, q.recentProgress) if p["stateOperators"])

    got, _ = batch(_record("a", "csv", "Ann One", at(10), ["py"]), _record("b", "csv", "Bob", at(10)), _record(None, "csv", "Nobody", at(10)))
    assert {k: r.full_name for k, r in got.items()} == {"a": "Ann One", "b": "Bob"}
    # restarted: a late record of the same source loses, another source joins what the state holds
    got, _ = batch(_record("a", "csv", "Ann Old", at(9, 30)), _record("a", "ats", "Ann Ats", at(9, 40), ["go"]))
    assert got["a"].full_name == "Ann Ats" and [s.canonical_name for s in got["a"].skills] == ["Go", "Python"] and got["a"].sources == ["ats", "csv"]
    got, _ = batch(_record("a", "csv", "Ann Two", at(10, 30), ["rust"]))
    assert sorted(s.canonical_name for s in got["a"].skills) == ["Go", "Rust"] and not got["a"].settled
    before = {p.name: p.stat().st_mtime for p in (tmp_path / "state/profiles").iterdir()}
    got, updated = batch(_record("c", "csv", "Cy", at(15)))  # the watermark passes: a and b settle
    got, updated = batch(_record("d", "csv", "Di", at(15, 5)), _record("a", "csv", "Ann Late", at(9)))  # behind the watermark
    assert got["a"].settled and got["b"].settled and not got["d"].settled and [s.canonical_name for s in got["a"].skills] == ["Go", "Rust"]
    assert updated <= 6  # of the batch's entities, not of all
    assert all((tmp_path / "state/profiles" / k).stat().st_mtime == t for k, t in before.items())


def _plain(progress):
    return progress if isinstance(progress, dict) else json.loads(progress.json)
