"""The registered text queries against their SQL, and the pipeline against its stages' plain rules."""

import pytest

import corpus_pipeline
from quadrat.llm import decontaminate, language
from quadrat.llm.queries import ORACLES, QUERIES
from tests.compare import connect, mismatch
from tests.llm.test_similar_texts import plain_set, plain_similar
from tests.llm.test_text_operators import roots_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert mismatch(spark, QUERIES[name], ORACLES[name], SF, connect(SF)) is None


def test_pipeline_keeps_what_the_stages_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == docs.columns, name
        kept = out.cache()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    known = language.keep_identified(docs, language.fit(docs))
    rows = known.select("doc_id", "text").collect()
    sets = {s: i for i, s in enumerate(dict.fromkeys(plain_set(r.text) for r in rows))}
    by_number = list(sets)
    root = roots_of(range(len(sets)), lambda a, b: plain_similar(by_number[a], by_number[b]))
    first: dict = {}
    for r in rows:
        at = root[sets[plain_set(r.text)]]
        first[at] = min(r.doc_id, first.get(at, r.doc_id))
    bad = {r.doc_id for r in decontaminate.contamination(known, bench).filter("contaminated").collect()}
    want = set(first.values()) - bad
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want
