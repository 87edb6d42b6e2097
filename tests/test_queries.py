"""Registered queries against their SQL. QUERY_TESTS=all runs every one of them."""

import os

import pytest

from quadrat_queries import load_all
from quadrat_queries.registry import ORACLES, QUERIES
from tests.compare import connect, mismatch

load_all()
SF = os.environ.get("QUERY_TESTS_SF", "/root/testdata/sf0.001")
CORE = (
    "text_match_form", "columns_join_filled", "coordinate_pair_cell", "date_text_to_iso", "json_from_row", "id_resolved", "rows_exact_copies",
    "country_iso3", "name_parsed", "problem_cells", "point_in_country", "coordinates_validated", "corrections_applied", "mapped_terms",
    "measurements_unpivoted", "generalisation_plan", "locations_masked", "names_cascade_report", "map_marker_sample", "camera_observations",
)
CHOSEN = sorted(ORACLES) if os.environ.get("QUERY_TESTS") == "all" else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_agrees_with_sql(spark, con, name):
    assert mismatch(spark, QUERIES[name], ORACLES[name], SF, con) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
