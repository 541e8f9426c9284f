"""Queries that do the whole job: nothing that a table has is left out on the way."""

import shutil

import __spark_entry__ as entry

CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


def test_merge_skills_has_all_sources_of_every_customer(spark, tmp_path):
    """With a nation or without one; a record whose key plus rank is a multiple of nine has no skills, and without a key there is no entity."""
    keys = [*range(90), -7, -3, -9]
    rows = [(k, "c", (k % 25, None, 99)[k % 3], 1.0, "S") for k in keys] + [(None, "c", 1, 1.0, "S")]
    spark.createDataFrame(rows, CUSTOMER).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    shutil.copy("/root/testdata/sf0.001/nation.parquet", tmp_path)
    told = {(r.fusion_id, s) for r in entry.queries()["merge_skills"](spark, str(tmp_path)).collect() for s in r.sources.split(",")}
    assert told == {(f"C{k}", s) for k in keys for i, s in enumerate(("resume", "ats", "github", "csv")) if (k + i) % 9}
