"""The export works out each step once, and only what is asked for."""

from pyspark.sql import functions as F

from quadrat.functions import numbers as N
from quadrat.operators import generalise as G
from quadrat.operators import mapping as M
from quadrat.plans import publish as X
from quadrat.session import written
from quadrat_queries.fixtures import mapped, threatened
from quadrat_queries.sensitive import levels

SF = "/root/testdata/sf0.001"


def test_private_table_and_review_do_not_make_the_core(spark, monkeypatch):
    records = mapped(spark, SF).filter("row_id < 200")
    asked = []
    monkeypatch.setattr(M, "normalise_for_export", lambda df, *_: asked.append(1) or df)
    product = X.build_product(X.ExportInputs(records=records, levels=levels(spark), threatened=threatened(spark)))
    assert product.private.count() and X.rows_under_review(product).columns == ["row_id", "problem"] and not asked
    assert product.core.count() == records.count() and product.measurements is not None and asked == [1]


def test_written_tables_keep_names_types_and_rows(spark):
    df = spark.range(4).select(F.col("id").alias("a b"), F.col("id").alias("A b"), F.lit(None).alias("nothing [x], (y)"), F.lit("t").alias("c.d"))
    back = written(df)
    assert back.dtypes == df.dtypes
    assert sorted(map(tuple, back.collect())) == [(i, i, None, "t") for i in range(4)]


def test_each_uncertainty_text_is_read_once(spark, monkeypatch):
    """The parser sees a column of distinct texts, not the rows."""
    seen = []
    monkeypatch.setattr(N, "uncertainty_metres", lambda v: seen.append(v) or F.lit(7.0))
    texts = ["30 m", "30 m", "", None, "1.000"]
    rows = spark.createDataFrame([(i, "Panthera onca", "-10.25", "-50.25", t) for i, t in enumerate(texts)],
                                 "row_id long, scientificName string, decimalLatitude string, decimalLongitude string, coordinateUncertaintyInMeters string")
    plan = G.generalisation_plan(rows, levels(spark), threatened(spark))
    assert seen == ["__utext"]
    assert {r["row_id"]: r["p_prior"] for r in plan.collect()} == {0: 7.0, 1: 7.0, 2: None, 3: None, 4: 7.0}
