"""Free numbers of a content against a plain search."""

import random
import uuid

from quadrat.operators.ids import generate_ids

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def minted(content, number):
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{content}\u001e{number}')}"


def plain(rows, taken):
    """The next free number of each row's content, in row order."""
    last, out = {}, {}
    for row_id, content in sorted(rows):
        n = last.get(content, 0) + 1
        while minted(content, n) in taken:
            n += 1
        last[content], out[row_id] = n, minted(content, n)
    return out


def test_free_numbers_in_row_order(spark):
    chance = random.Random(4)
    rows = [(i, chance.choice("abcde")) for i in range(400)]
    numbers = {c: {n for n in range(1, 300) if chance.random() < p} for c, p in zip("abcde", (0, 0.05, 0.5, 0.95, 1))}
    taken = {minted(c, n) for c, ns in numbers.items() for n in ns} | {"OCC-1", "urn:uuid:none"}
    given = spark.createDataFrame([(t,) for t in taken], "id string")
    got = generate_ids(spark.createDataFrame(rows, "row_id long, a string"), ["a"], given, hot_rows=60)
    assert {r.row_id: r.occurrenceID for r in got.collect()} == plain(rows, taken)


def test_five_rows_against_ten_thousand_taken_numbers(spark):
    rows = [(i, "same") for i in range(5)]
    given = spark.range(1, 10_001).selectExpr("id AS n").collect()
    taken = {minted("same", r.n) for r in given} - {minted("same", 7000)}
    made = generate_ids(
        spark.createDataFrame(rows, "row_id long, a string"), ["a"], spark.createDataFrame([(t,) for t in taken], "id string"))
    want = {0: 7000, 1: 10_001, 2: 10_002, 3: 10_003, 4: 10_004}
    assert {r.row_id: r.occurrenceID for r in made.collect()} == {i: minted("same", n) for i, n in want.items()}


def test_no_rows_and_nothing_taken(spark):
    none = spark.createDataFrame([], "row_id long, a string")
    assert generate_ids(none, ["a"], spark.createDataFrame([], "id string")).count() == 0
    one = spark.createDataFrame([(1, None)], "row_id long, a string")
    assert generate_ids(one, ["a"], spark.createDataFrame([], "id string")).first().occurrenceID == minted("NA", 1)
