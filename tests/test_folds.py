import time

from pyspark.sql import functions as F

from fusewright.functions.text import first_by, grouped_by

ROWS = [(1, ["b", "A", "a", None, "B", "c", None]), (2, []), (3, None), (4, ["x"])]


def test_first_and_groups(spark):
    df = spark.createDataFrame(ROWS, "k int, a array<string>")
    got = {r.k: (r.f, r.g) for r in df.select("k", first_by(F.col("a"), F.lower).alias("f"), grouped_by(F.col("a"), F.lower).alias("g")).collect()}
    assert got == {1: (["b", "A", None, "c"], [["b", "B"], ["A", "a"], [None, None], ["c"]]), 2: ([], []), 3: (None, None), 4: (["x"], [["x"]])}
    pairs = df.where("k = 1").select(F.transform("a", lambda x, i: F.struct(x.alias("v"), i.alias("i"))).alias("p"))
    assert [tuple(x) for x in pairs.select(first_by(F.col("p"), lambda x: x["v"]).alias("f")).first().f] == [("b", 0), ("A", 1), ("a", 2), (None, 3), ("B", 4), ("c", 5)]


def test_work_follows_the_items(spark):
    """An array of 400,000 items with as many keys: quadratic work would be 10^11 steps."""
    big = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(400_000)), lambda i: F.concat(F.lit("k"), (i % 300_000).cast("string"))).alias("a"))
    began = time.monotonic()
    row = big.select(F.size(first_by(F.col("a"), F.lower)).alias("f"), F.size(grouped_by(F.col("a"), F.lower)).alias("g"), F.array_max(F.transform(grouped_by(F.col("a"), F.lower), F.size)).alias("m")).first()
    assert tuple(row) == (300_000, 300_000, 2) and time.monotonic() - began < 60
