"""Headline queries, warm, written to the noop sink. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from quadrat.session import build_session
from quadrat_queries import load_all
from quadrat_queries.registry import QUERIES

HEADLINE = (
    "date_text_to_iso", "coordinate_numbers", "country_iso3", "name_parsed", "id_resolved", "vocabulary_mapped",
    "json_from_row", "columns_join_filled", "problem_type_counts", "point_in_country", "coordinates_validated",
    "generalisation_plan", "measurements_unpivoted", "rows_exact_copies",
)
RUNS = 1


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    load_all()
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
