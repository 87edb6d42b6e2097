"""Overrides, fallbacks and learned aliases of the header mapping on small cases."""

import random

from pyspark.sql import functions as F

from quadrat.plans import automap as A

DECISION = "dataset string, term string, column string, candidate string, final_score double, status string, reason string, applied boolean, completeness double"


def test_losers_move_to_free_verbatim_terms(spark):
    rows = [
        ("a", "decimalLatitude", None, "lat", 0.92, "MANUAL", "conflict_lost", False, 1.0),
        ("a", "locality", "lat", "lat", 0.95, "AUTO", "known_synonym", True, 1.0),
        ("b", "eventDate", None, "data", 0.70, "MANUAL", "conflict_lost", False, 1.0),
        ("c", "decimalLatitude", None, "y", 0.80, "MANUAL", "conflict_lost", False, 1.0),
        ("c", "verbatimLatitude", "y0", "y0", 0.99, "AUTO", "exact_match", True, 1.0),
        ("d", "decimalLongitude", None, "x", 0.80, "MANUAL", "ambiguity_detected", False, 1.0),
    ]
    got = A.loser_fallback(spark.createDataFrame(rows, DECISION)).collect()
    assert [tuple(r) for r in got] == [("a", "verbatimLatitude", "lat", 0.92)]


def test_overrides_keep_one_term_per_column(spark):
    rows = [
        ("a", "country", "pais", "pais", 0.99, "AUTO", "known_synonym", True, 1.0),
        ("a", "county", "pais", "pais", 0.80, "ALIAS", "known_synonym", True, 1.0),
        ("a", "locality", "local", "local", 0.90, "AUTO", "exact_match", True, 1.0),
    ]
    got = {r.term: (r.column, r.candidate, r.applied, r.reason) for r in A.one_term_per_column(spark.createDataFrame(rows, DECISION)).collect()}
    assert got == {"country": (None, "pais", False, "conflict_lost"), "county": ("pais", "pais", True, "known_synonym"),
                   "locality": ("local", "local", True, "exact_match")}
    bad = [("a", "country", None, "pais", 1.2, "AUTO", "x", True, 1.0), ("a", "sex", None, "s", 0.5, "ODD", "x", False, 1.0),
           ("a", "day", None, "d", 0.5, "AUTO", "x", True, 1.0), ("a", "year", "y", "y", 0.5, "AUTO", "x", True, 1.0)]
    found = A.check_decisions(spark.createDataFrame(bad, DECISION)).collect()
    assert {(r.term, r.violation) for r in found} == {("country", "score"), ("sex", "status"), ("day", "column")}


def test_template_and_usable_templates(spark):
    catalogue = spark.createDataFrame(
        [("t1", "1.0", None, "", ""), ("t2", "2.0", None, "", ""), ("t3", "0.1", "0.9", "", ""), ("t4", None, None, "inst", "birds"), ("t5", None, None, "other", "")],
        "name string, valid_from string, valid_to string, institution string, use_case string")
    assert {r.name for r in A.usable_templates(catalogue, "1.5", "inst", "birds").collect()} == {"t1", "t4"}
    profile = spark.createDataFrame([("a", "quando"), ("a", "local"), ("b", "x")], "dataset string, column string")
    template = spark.createDataFrame([("eventDate", 1, ["data", "quando"])], "term string, priority int, columns array<string>")
    none = spark.createDataFrame([], DECISION + ", name_score double, value_score double")
    got = A.override_with_template(none, profile, template).collect()
    assert [(r.dataset, r.term, r.column, r.status, r.applied) for r in got] == [("a", "eventDate", "quando", "TEMPLATE", True)]


def test_alias_intervals_equal_run_by_run_learning(spark):
    chance = random.Random(3)
    log = [(run, "user", chance.choice("ab"), chance.choice(["h1", "h2"]), chance.choice("xyz")) for run in range(1, 40)]
    undone = {5, 12, 13, 30, 39}
    frame = spark.createDataFrame(log, "run long, scope string, owner string, column string, term string")
    gone = spark.createDataFrame([(r,) for r in undone], "run long")
    for runs, intervals in ((log, A.alias_intervals(frame)), ([x for x in log if x[0] not in undone], A.alias_intervals(frame, gone))):
        held, counts = {}, {}
        rows = {(r.owner, r.column, r.from_run): (r.term, r.confidence, r.to_run) for r in intervals.collect()}
        assert len(rows) == len(runs)
        for run, _, owner, column, term in runs:
            counts[owner, column, term] = counts.get((owner, column, term), 0) + 1
            held[owner, column] = (term, round(min(1.0, 0.75 + 0.05 * counts[owner, column, term]), 2))
            assert rows[owner, column, run][:2] == held[owner, column]
        now = {(r.owner, r.column): (r.term, r.confidence) for r in A.aliases_at(intervals, 1000).collect()}
        assert now == held


def test_learning_one_run_and_taking_it_back(spark):
    schema = "alias_id long, scope string, owner string, column string, term string, confidence double, reviewed boolean, updated_at string, active boolean"
    known = spark.createDataFrame([(1, "user", "me", "h", "sex", 0.9, True, "2026-01-01", True)], schema)
    accepted = spark.createDataFrame([("user", "me", "h", "day"), ("user", "me", "g", "year")], "scope string, owner string, column string, term string")
    after, events = A.learn_aliases(known, accepted, "run1", "2026-02-02")
    assert {(r.column, r.term, r.active) for r in after.collect()} == {("h", "sex", False), ("h", "day", True), ("g", "year", True)}
    assert {(r.term, r.event) for r in events.collect()} == {("sex", "superseded"), ("day", "created"), ("year", "created")}
    back = A.undo_run(after, events, "run1").collect()
    assert [(r.column, r.term, r.active) for r in back] == [("h", "sex", True)]


def test_an_even_sample_keeps_first_and_last(spark):
    from quadrat.operators.stats import sample_values

    df = spark.range(1, 3001).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), "id").alias("a"), F.when(F.col("id") < 50, "x").alias("b"))
    scores = spark.createDataFrame([("a", 0.2), ("b", 0.2)], "column string, name_score double")
    got = sample_values(df, scores, hot_rows=500).collect()
    a = sorted(r.row_id for r in got if r.column == "a")
    assert len(a) == 200 and a[0] == 1 and a[-1] == 3000 and max(y - x for x, y in zip(a, a[1:])) <= 16
    assert sum(r.column == "b" for r in got) == 49
