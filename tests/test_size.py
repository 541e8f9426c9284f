"""Work and memory of one task, on tables whose file has a single row group."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fusewright import synth
from fusewright.operators import merge as M

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("made", [synth.resumes, synth.flat_records])
def test_rows_of_one_row_group_are_dealt_out(spark, made):
    key = "doc_id" if made is synth.resumes else "fusion_id"
    rows = [r.n for r in made(spark, SF).groupBy(F.spark_partition_id()).agg(F.count_distinct(key).alias("n")).collect()]
    assert sum(rows) <= 15_000 and len(rows) >= 3 and max(rows) <= synth.MOST_ROWS


def test_exports_are_dealt_out(spark):
    rows = [r["count"] for r in synth.exports(spark, SF).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 12_000 and len(rows) >= 3 and max(rows) <= synth.MOST_ROWS


def test_merged_entities_stay_dealt_out(spark):
    """A task's memory in the merge follows the entities it is dealt, not the session's number of shuffle partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        entities = M.gather(synth.source_records(spark, SF))
        rows = [r["count"] for r in entities.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(rows) == 15_000 and len(rows) >= 3 and max(rows) <= synth.MOST_ROWS


@pytest.mark.parametrize("name, once", [("resume_education", "aggregate("), ("resume_experience", "(?:at|@|–|-)")])
def test_lists_are_made_once(spark, name, once):
    """A filter that the optimiser adds before an inner explode, or a value used twice, repeats the whole expression of a list."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(once) == 1


MERGED = (
    "conflict_log education_view experience_view field_confidence flagship_fusion github_view identity_view merge_education merge_emails "
    "merge_experience merge_links merge_phones merge_scalar merge_skills overall_confidence pipeline_report project_profile"
)


@pytest.mark.parametrize("name", MERGED.split())
def test_queries_on_merged_records_shuffle_customers_only(spark, name):
    """The one exchange deals customers to tasks of a bounded number of rows; records are made, merged and told in these tasks."""
    plan = entry.queries()[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"(?<!Broadcast)Exchange .*", plan.split("Initial Plan")[-1])
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0] and "c_custkey" in dealt[0]


def test_json_sink_writes_from_the_tasks_that_merge(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        rows = [r["count"] for r in entry.queries()["json_sink"](spark, SF).groupBy(F.input_file_name()).count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sum(rows) == 15_000 and len(rows) >= 3 and max(rows) <= synth.MOST_ROWS
