"""Samples of labelled rows by hash."""

from pyspark.sql import functions as F

from depotflow.llm.common import smallest_hashes


def test_same_rows_as_sorting_all_of_them(spark):
    rows = spark.range(50_000).select("id", (F.col("id") % 7).alias("y"))
    for most in (0, 1, 300, 49_990, 60_000):
        found = smallest_hashes(rows, ["id"], most).collect()
        assert found == rows.orderBy(F.xxhash64("id")).limit(most).collect()


def test_no_task_sends_as_many_rows_as_the_limit(spark):
    rows = spark.range(0, 200_000, 1, 16).select("id")
    plan = smallest_hashes(rows, ["id"], 1_000)
    (kept,) = [f for f in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in f]
    edge = int(kept.split("<= ")[1].rstrip(")"))
    shares = rows.where(F.xxhash64("id") <= F.lit(edge)).groupBy(F.spark_partition_id()).count().collect()
    assert 1_000 <= sum(r["count"] for r in shares) < 1_600 and max(r["count"] for r in shares) < 200


def test_empty_null_and_repeated_rows(spark):
    rows = spark.createDataFrame([(None, 1), (None, 1), (3, 0)], "id long, y int")
    assert smallest_hashes(rows, ["id"], 10).count() == 3
    assert smallest_hashes(rows.limit(0), ["id"], 10).count() == 0
