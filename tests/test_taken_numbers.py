"""The search for free numbers grows with the taken ones, not with the rows of a content."""

from pyspark.sql import functions as F

from quadrat.operators import ids as I


def test_search_grows_with_taken_numbers_not_rows(spark, monkeypatch):
    df = spark.range(1000).select(F.col("id").alias("row_id"), F.lit("Aus").alias("name"))
    first = I.generate_ids(df, ["name"]).filter("row_id IN (1, 2)").select(F.col("occurrenceID").alias("id"))
    made, real = [], I._minted
    monkeypatch.setattr(I, "_minted", lambda groups: made.append(real(groups)) or made[-1])
    rows = I.generate_ids(df, ["name"], first).collect()
    assert len({r["occurrenceID"] for r in rows}) == 1000
    assert sum(m.count() for m in made) < 100
