"""What one task holds does not grow with the rows of a group."""

import pytest
from pyspark.sql import functions as F

from quadrat.operators import numbering as W


@pytest.fixture
def plain_plans(spark):
    """Plans as written, so that rows can be followed to their tasks."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n) for n in names}
    for n, value in zip(names, ("false", "-1"), strict=True):
        spark.conf.set(n, value)
    yield
    for n, value in old.items():
        spark.conf.set(n, value)


def test_one_hot_group_is_dealt_to_several_tasks(spark, plain_plans):
    df = spark.range(2000).select(F.col("id").alias("row_id"), F.lit("hot").alias("k"))
    rows = W.number_within(df, ["k"], hot_rows=20).withColumn("task", F.spark_partition_id()).collect()
    assert all(r["number"] == r["row_id"] + 1 for r in rows) and len(rows) == 2000
    assert len({r["task"] for r in rows}) > 1


def test_null_keys_are_one_group_across_runs_of_slices(spark):
    df = spark.range(30).select((F.col("id") * 7000).alias("row_id"), F.lit(None).cast("string").alias("k"))
    rows = W.number_within(df, ["k"], hot_rows=20).collect()
    assert {r["row_id"] // 7000: r["number"] for r in rows} == {i: i + 1 for i in range(30)}
