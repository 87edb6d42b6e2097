"""Ring answers of points at sea are as many as the points, so they are not broadcast."""

from quadrat.operators import spatial as S
from quadrat_queries.fixtures import CELL, points, polygon_index

SF = "/root/testdata/sf0.001"


def test_ring_answers_are_joined_by_sorting(spark):
    near = S.near_land(points(spark, SF), polygon_index(spark), "lon", "lat", 10_000.0, "on_land", CELL)
    plan = near._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [knownfloating" in line]
    assert len(joins) == 1 and "SortMergeJoin" in joins[0], joins
