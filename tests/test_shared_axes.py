import signal

from pyspark.sql import functions as F

from quadrat.functions.numbers import uncertainty_metres
from quadrat.operators import generalise as G


def _late(*_):
    raise TimeoutError


def test_points_that_share_an_axis_are_not_joined_to_every_text(spark):
    n = 30_000
    lon = F.format_string("%d.%03d", F.expr("10 + id div 1000"), F.col("id") % 1000)
    points = spark.range(n).select(
        F.lit(-10.25).alias("lat"), lon.cast("double").alias("lon"), F.lit(0.1).alias("grid"),
        F.lit("-10.3").alias("pub_lat"), F.lit("0").alias("pub_lon"))
    none = F.lit(None).cast("double")
    cells = spark.range(n).select(
        F.col("id").alias("cell_id"), F.concat(F.lit("10.250 / "), lon).alias("text"), none.alias("own_lat"), none.alias("own_lon"))
    before = signal.signal(signal.SIGALRM, _late)
    signal.alarm(60)
    try:
        found = G.find_point_copies(cells, points).groupBy("cell_id").agg(F.count("*").alias("n"), F.max("published").alias("p"))
        assert found.groupBy("n", "p").count().collect() == [(2, "0", n)]
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_an_uncertainty_is_read_once(spark):
    assert uncertainty_metres(F.col("cell"))._jc.toString().count("cell") <= 2
