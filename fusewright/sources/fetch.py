"""Developer profiles fetched over HTTP, as a Python data source for batches and streams.

A partition is a range of user names, so a lost task fetches its own users again.  Every user gives one row whatever the server says: with
status 200 the profile and its repositories, else the status (0: no answer) and the reason.  Answers of 5xx, and none, are asked for again, after
waits that double; 403 (no calls left) and 404 (nobody) are not.  Repositories that cannot be had leave a profile without any.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .profile import LANDED, MOST_REPOS, from_landed, username

BASE = "https://api.github.com"
FORMAT = "developer_profiles"
FETCHED = f"username string, status int, error string, {LANDED}"
USER = ["login", "name", "email", "bio", "blog", "location", "html_url"]


@dataclass(frozen=True)
class Server:
    base: str = BASE
    token: str | None = None
    timeout: float = 10.0
    attempts: int = 3
    wait: float = 1.0  # seconds before the second attempt

    @classmethod
    def of(cls, options: dict) -> Server:
        kinds = {"base": str, "token": str, "timeout": float, "attempts": int, "wait": float}
        return cls(**{k: kind(options[k]) for k, kind in kinds.items() if k in options})

    def get(self, path: str):
        """(status, answer or reason)"""
        headers = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {self.token}"} if self.token else {})
        status, reason = 0, ""
        for k in range(max(1, self.attempts)):
            if k:
                time.sleep(self.wait * 2 ** (k - 1))
            try:
                with urllib.request.urlopen(urllib.request.Request(self.base.rstrip("/") + path, headers=headers), timeout=self.timeout) as r:
                    return r.status, json.loads(r.read())
            except urllib.error.HTTPError as e:
                status = e.code
                reason = {403: f"no calls left until {e.headers.get('X-RateLimit-Reset', 'an unknown time')}", 404: "no such user"}.get(status, f"answer {status}")
                if status < 500:
                    break
            except ValueError as e:  # no JSON
                status, reason = 0, f"no JSON: {e}"
            except OSError as e:  # no connection, no answer in time
                status, reason = 0, str(e)
        return status, reason

    def profile(self, name: str) -> tuple:
        """A row of ``FETCHED``."""
        quoted = urllib.parse.quote(name, safe="")
        status, user = self.get(f"/users/{quoted}")
        if status != 200 or not isinstance(user, dict):
            return name, status, user if isinstance(user, str) else "no JSON object", None, None
        _, repos = self.get(f"/users/{quoted}/repos?type=public&sort=updated&per_page={MOST_REPOS}")
        text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
        some = [(text(r.get("language")), bool(r.get("fork"))) for r in repos if isinstance(r, dict)] if isinstance(repos, list) else []
        return name, 200, None, tuple(text(user.get(k)) for k in USER), some


@dataclass
class Names(InputPartition):
    begin: int
    end: int


class _Reader:
    def __init__(self, options: dict):
        self.names = [n for n in options.get("users", "").replace(",", " ").split() if n]
        self.server, self.each = Server.of(options), int(options.get("pertask", 50))

    def ranges(self, begin: int, end: int) -> list[Names]:
        return [Names(i, min(end, i + self.each)) for i in range(begin, end, self.each)]

    def read(self, partition: Names) -> Iterator[tuple]:
        for name in self.names[partition.begin : partition.end]:
            yield self.server.profile(name)


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return self.ranges(0, len(self.names))


class _Stream(_Reader, DataSourceStreamReader):
    """Offsets count users; a batch takes the next ``perbatch`` of them, the same ones after a restart."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.per_batch, self.at = int(options.get("perbatch", 1000)), 0

    def initialOffset(self):
        return {"users": 0}

    def latestOffset(self):
        self.at = min(len(self.names), self.at + self.per_batch)
        return {"users": self.at}

    def partitions(self, start: dict, end: dict):
        self.at = max(self.at, end["users"])
        return self.ranges(start["users"], end["users"])


class ProfileSource(DataSource):
    """Options: users (names separated by blanks or commas), base, token, timeout, attempts, wait, perTask, perBatch."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return FETCHED

    def reader(self, schema):
        return _Batch(self._lower())

    def streamReader(self, schema):
        return _Stream(self._lower())

    def _lower(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProfileSource)


def fetched(users: DataFrame, column: str = "username", **server) -> DataFrame:
    """``FETCHED`` rows of a table of user names or profile links, each distinct one once; its partitions fetch side by side."""
    to = Server(**server)
    names = users.select(username(F.col(column)).alias("username")).where("username <> ''").distinct()
    user = pa.struct([(k, pa.string()) for k in USER])
    schema = pa.schema([("username", pa.string()), ("status", pa.int32()), ("error", pa.string()), ("user", user), ("repos", pa.list_(pa.struct([("language", pa.string()), ("fork", pa.bool_())])))])

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                n, status, error, who, repos = to.profile(name)
                row = {"username": n, "status": status, "error": error, "user": who and dict(zip(USER, who)), "repos": repos and [{"language": a, "fork": b} for a, b in repos]}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return names.mapInArrow(run, FETCHED)


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source records, rows that failed: username, status, error) of ``FETCHED`` rows, which should be stored before: both sides read them."""
    good = rows.where("status = 200 and user.login is not null")
    return from_landed(good.select("user", "repos"), drop_forks_first=False), rows.where("status <> 200 or user.login is null").select("username", "status", "error")
