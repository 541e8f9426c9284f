"""Developer profiles from landed JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ProfileError
from ..functions import normalize as N
from ..functions.lookups import LANGUAGE_SKILLS
from ..schema import JOB, STUDY
from ..functions.text import strip
from .files import exists

LANDED = "user struct<login:string,name:string,email:string,bio:string,blog:string,location:string,html_url:string>, repos array<struct<language:string,fork:boolean>>"

MOST_REPOS, MOST_LANGUAGES = 30, 10


def username(raw: Column) -> Column:
    """Name in a profile link, or the text itself without slashes and a leading at-sign."""
    found = F.nullif(F.regexp_extract(raw, r"github\.com/([A-Za-z0-9-]+)", 1), F.lit(""))
    return F.coalesce(found, F.regexp_replace(raw, r"^[\s/@]+|[\s/]+$", ""))


def top_languages(repos: DataFrame, key: str, most: int = MOST_LANGUAGES) -> DataFrame:
    """(key, language, n, rank) from (key, language, pos): most frequent first, then first seen."""
    counted = repos.where(F.col("language").isNotNull()).groupBy(key, "language").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("rank") <= most).drop("first")


def parse(users: DataFrame, repos: DataFrame, drop_forks_first: bool = True) -> DataFrame:
    """Source records from users (fusion_id, login, name, email, bio, blog, location) and repos (fusion_id, pos, language, fork)."""
    own = repos.where(~F.coalesce("fork", F.lit(False))) if drop_forks_first else repos
    newest = own.withColumn("_k", F.row_number().over(Window.partitionBy("fusion_id").orderBy("pos"))).where(F.col("_k") <= MOST_REPOS)
    newest = newest if drop_forks_first else newest.where(~F.coalesce("fork", F.lit(False)))
    skill = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in LANGUAGE_SKILLS.items() for x in p]), F.col("language")), F.col("language"))
    ranked = top_languages(newest, "fusion_id").groupBy("fusion_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", skill.alias("s")))), lambda x: x["s"])).alias("skills"))
    link = lambda url, label: F.struct(url.alias("url"), F.lit(label).alias("label"))
    home = F.coalesce("html_url", F.concat(F.lit("https://github.com/"), F.col("login"))) if "html_url" in users.columns else F.concat(F.lit("https://github.com/"), F.col("login"))
    blog = F.when(strip(F.col("blog")) != "", F.when(F.col("blog").startswith("http"), F.col("blog")).otherwise(F.concat(F.lit("https://"), F.col("blog"))))
    links = F.filter(F.array(link(home, "GitHub"), link(blog, "Portfolio")), lambda x: x["url"].isNotNull())
    none = lambda t: F.array().cast(f"array<{t}>")
    return users.join(ranked, "fusion_id", "left").select(
        "fusion_id", F.lit("github").alias("source"), F.lit(0).cast("long").alias("seq"), F.lit(None).cast("string").alias("candidate_id"), N.name(F.col("name")).alias("full_name"), F.array_compact(F.array(N.email(F.col("email")))).alias("emails"),
        none("string").alias("phones"), N.location(F.col("location")).alias("location"), F.col("bio").alias("headline"), F.coalesce("skills", none("string")).alias("skills"), links.alias("links"), none(JOB).alias("experience"), none(STUDY).alias("education"), F.lit(None).cast("string").alias("years_experience"),
    )


def read(spark: SparkSession, path: str, drop_forks_first: bool = True) -> DataFrame:
    """Source records of landed profiles: JSON objects ``user`` and ``repos`` (newest first), one to a file."""
    if not exists(spark, path):
        raise ProfileError(f"no profile at {path}")
    return from_landed(spark.read.schema(LANDED).option("multiLine", True).json(path), drop_forks_first)


def from_landed(rows: DataFrame, drop_forks_first: bool = True) -> DataFrame:
    """Source records of rows (user, repos); rows without a login go."""
    landed = rows.where(F.col("user.login").isNotNull()).select(F.col("user.login").alias("fusion_id"), "user", "repos")
    repos = landed.select("fusion_id", F.posexplode("repos").alias("pos", "r")).select("fusion_id", "pos", "r.language", "r.fork")
    return parse(landed.select("fusion_id", "user.*"), repos, drop_forks_first)
