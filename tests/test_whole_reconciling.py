"""Protected points and repeated identifiers: the rows that simpler queries leave out."""

import re

from quadrat_queries import load_all, sensitive
from quadrat_queries.registry import ORACLES, QUERIES
from tests.compare import connect, mismatch

load_all()
SF = "/root/testdata/sf0.001"


def test_shared_identifier_is_reconciled(spark):
    name = "archive_shared_ids_reconciled"
    assert mismatch(spark, QUERIES[name], ORACLES[name], SF, connect(SF)) is None


def plain_redaction(text, lat, lon, grid, pub_lat, pub_lon):
    """The decimals of the point, written finer than the grid, replaced by the published ones; signs and commas stay."""
    def one(found):
        sign, number = found.groups()
        size, decimals = float(number.replace(",", ".")), len(re.split("[.,]", number)[1])
        if 10.0**-decimals >= grid * 0.999:
            return found.group(0)
        for own, shown in ((lat, pub_lat), (lon, pub_lon)):
            if abs(size - abs(own)) < grid:
                plain = shown.removeprefix("-")
                return (sign if plain else "") + (plain.replace(".", ",") if "," in number else plain)
        return found.group(0)

    return re.sub(r"(-?)([0-9]+[.,][0-9]+)", one, text)


def test_own_points_are_redacted_in_all_rows(spark):
    got = {r.row_id: r.occurrenceRemarks for r in QUERIES["own_point_redacted_all_rows"](spark, SF).collect()}
    given = sensitive.mapped(spark, SF).withColumn("given", sensitive.texted()).select("row_id", "given")
    rows = sensitive.own_points_redacted(spark, SF).join(given, "row_id").collect()
    assert len(rows) == len(got) == sensitive.mapped(spark, SF).count()
    hard = 0
    for r in rows:
        coarse = r.p_target and r.p_eff_grid > 0.01
        want = plain_redaction(r.given, r.p_lat, r.p_lon, r.p_eff_grid, r.decimalLatitude, r.decimalLongitude) if coarse else r.given
        hard += bool(coarse and (abs(r.p_lat) <= 14 or abs(r.p_lon) <= 14 or abs(abs(r.p_lat) - abs(r.p_lon)) <= 2.5))
        assert got[r.row_id] == want, (r.given, r.p_lat, r.p_lon, r.p_eff_grid, r.decimalLatitude, r.decimalLongitude)
    assert hard > 0
