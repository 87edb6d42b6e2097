"""Row by row operators pass columns through as they are, also those named like internal ones."""

import pytest
from pyspark.sql import functions as F

from quadrat.llm import decontaminate, language, pii, similar, simhash

SF = "/root/testdata/sf0.001"
NAMES = ("spans", "base_spans", "__base", "__more", "__key", "__row_key", "row", "own_id", "own_key", "row_key", "root", "node",
         "words", "kept", "n_words", "doc", "key", "start", "lang_pred", "score")


def stages(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    return {
        "language": lambda d: language.keep_identified(d, language.fit(d)), "simhash": simhash.drop_near_duplicates,
        "similar": similar.drop_similar, "decontaminate": lambda d: decontaminate.drop_contaminated(d, bench),
        "redact": pii.redact,
    }


@pytest.mark.parametrize("name", ["language", "simhash", "similar", "decontaminate", "redact"])
def test_other_columns_keep_their_values(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs.select("*", *[F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")).alias(c) for c in NAMES])
    got = stages(spark)[name](wide)
    assert got.dtypes == wide.dtypes
    plain = {tuple(r) for r in stages(spark)[name](docs).collect()}
    rows = got.collect()
    assert {tuple(r)[:len(docs.columns)] for r in rows} == plain and len(rows) == len(plain)
    assert all(r[c] == f"{c} {r.doc_id}" for r in rows for c in NAMES)


@pytest.mark.parametrize("name", ["language", "simhash", "similar", "decontaminate", "redact"])
def test_empty_tables_and_odd_rows(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = stages(spark)[name]
    assert stage(docs.limit(0)).count() == 0
    odd = spark.createDataFrame(
        [(None, None, None), (90_001, None, "en"), (90_002, "", None), (90_003, "Dies ist ein Satz. " * 6000, "de"),
         (90_003, "Dies ist ein Satz. " * 6000, "de"), (90_004, "x", None)], "doc_id long, text string, lang string")
    got = stage(docs.select("doc_id", "text", "lang").unionByName(odd)).filter("doc_id IS NULL OR doc_id > 90000").collect()
    kept = sorted((r.doc_id or 0 for r in got))
    want = {"simhash": [90_001, 90_003, 90_004], "similar": [90_001, 90_003, 90_004]}
    assert kept == want.get(name, [0, 90_001, 90_002, 90_003, 90_003, 90_004]) or name == "language"
