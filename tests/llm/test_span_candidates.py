"""Candidates of personal data that a gate or a failed check must not hide."""

from pyspark.sql import functions as F

from quadrat.llm import pii

PROPOSED = [
    ("please mail bob at example.com", pii.EMAIL, "bob at example.com"),
    ("mail bob (At) example.com", pii.EMAIL, "bob (At) example.com"),
    ("mail bob {at} example [Dot] com", pii.EMAIL, "bob {at} example [Dot] com"),
    ("mail bob@example. com", pii.EMAIL, "bob@example. com"),
    ("call +44 1234 567 now", pii.PHONE, "+44 1234 567"),
    ("call +1 23 today", pii.PHONE, "+1 23"),
    ("call 555-1234 today", pii.PHONE, "555-1234"),
    ("call +49 30 1234567 123456789 now", pii.PHONE, "+49 30 1234567"),
    ("host abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd", pii.IP, "abcd:abcd:abcd:abcd:abcd:abcd:abcd:abcd"),
]


def test_every_form_is_proposed_once(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PROPOSED)], "doc_id long, text string")
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.m] for r in
           pii.candidates(rows).select("doc_id", F.col("__more").alias("m")).collect()}
    for i, (text, kind, span) in enumerate(PROPOSED):
        at = text.index(span)
        assert got[i].count((kind, at, at + len(span))) == 1, (text, got[i])


def test_a_span_is_judged_alike_with_and_without_another_address(spark):
    made = [(i, f"please mail user{i}@site{i}.example.com today or mail me again") for i in range(200)]
    asked = [(900, "you can mail bob at example.com"), (901, "you can mail bob at example.com or x@y.de"),
             (902, "you can mail bob (At) example.com")]
    rows = spark.createDataFrame([*made, *asked], "doc_id long, text string")
    text = {r.doc_id: r.text for r in pii.redact(rows).filter("doc_id >= 900").collect()}
    assert text == {900: "you can mail [EMAIL]", 901: "you can mail [EMAIL] or [EMAIL]", 902: "you can mail [EMAIL]"}
