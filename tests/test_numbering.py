"""Gapless numbers against a plain sort."""

import datetime

from pyspark.sql import functions as F

from lodestone.operators.incremental import remember
from lodestone.operators.numbering import numbered


def test_numbers_follow_the_order(spark):
    rows = spark.range(0, 5000, numPartitions=7).select(F.pmod(F.xxhash64("id"), F.lit(97)).alias("score"), "id")
    got = numbered(rows, [F.desc("score"), F.col("id")], first=1).collect()
    want = sorted(rows.collect(), key=lambda r: (-r["score"], r["id"]))
    assert [(r["score"], r["id"]) for r in sorted(got, key=lambda r: r["number"])] == [(r["score"], r["id"]) for r in want]
    assert sorted(r["number"] for r in got) == list(range(1, 5001))


def test_equal_rows_nulls_and_empty_tables(spark):
    rows = spark.createDataFrame([(None,), (3,), (None,), (3,), (3,), (1,)], "k int")
    got = sorted((r["number"], r["k"]) for r in numbered(rows, [F.col("k").asc_nulls_first()], "number").collect())
    assert got == [(0, None), (1, None), (2, 1), (3, 3), (4, 3), (5, 3)]
    assert numbered(rows.limit(0), ["k"]).count() == 0


def test_equal_rows_are_spread(spark):
    """A key that all rows share is still dealt to several ranges."""
    rows = spark.range(0, 20_000, numPartitions=4).select(F.lit(1).alias("k"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        out = numbered(rows, ["k"])
    finally:
        spark.conf.unset(key)
    assert sorted(r["number"] for r in out.collect()) == list(range(20_000))
    assert out.select(F.input_file_name()).distinct().count() > 1


def test_remember_has_no_window_over_all_rows(spark):
    when = datetime.datetime(2024, 1, 1)
    old = spark.createDataFrame([("a", "fact", 7, "Ducks swim", when)], "scope string, kind string, seq long, text string, created timestamp")
    new = spark.range(0, 3000).select(F.lit("a").alias("scope"), F.lit("fact").alias("kind"), F.concat(F.lit("note "), F.col("id") % 1500).alias("text"), F.lit(when).alias("created"))
    out = remember(old, new.unionByName(old.drop("seq")))
    assert sorted(r["seq"] for r in out.collect()) == list(range(7, 1508))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
