"""Streaming use: row-local operators run unchanged, keyed state is merged per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import numbers as M
from quadrat.functions.coords import coord_number, coord_parse_failed
from quadrat.functions.dates import dates_to_iso
from quadrat.functions.text import clean_invisible
from quadrat.operators.cascade import upsert_status
from quadrat.operators.vocabularies import map_vocabulary, occurrence_status


def clean_records(stream: DataFrame, day_first: bool | None = None, as_of_year: int | None = None) -> DataFrame:
    """Row-local cleaning of a record stream. A stream cannot vote on the field order of its dates, so
    the order is a parameter; without it ambiguous dates stay as they are."""
    out = stream.withColumns({c: clean_invisible(F.col(c)) for c, t in stream.dtypes if t == "string"})
    if "eventDate" in out.columns:
        out = dates_to_iso(out, ["eventDate"], as_of_year, day_first)
        out = out.withColumn("eventDate", F.coalesce("eventDate_iso", "eventDate")).drop("eventDate_iso")
    if "occurrenceStatus" in out.columns:
        out = out.withColumn("occurrenceStatus", map_vocabulary("occurrenceStatus", occurrence_status("occurrenceStatus")))
    for c in ("decimalLatitude", "decimalLongitude"):
        if c in out.columns:
            out = out.withColumn(f"{c}_failed", coord_parse_failed(c)).withColumn(c, coord_number(c))
    if "coordinateUncertaintyInMeters" in out.columns:
        out = out.withColumn("coordinateUncertaintyInMeters", M.suggest_uncertainty("coordinateUncertaintyInMeters"))
    return out


def status_sink(folder: str, earlier: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that keeps the latest status per name as versioned Parquet in `folder`.

    A batch reads version n and writes n + 1, so a replayed batch gives the same version again. A query with a new
    checkpoint counts from zero and takes a folder of its own; `earlier` is the version (a path) it goes on from, so
    that no name is lost."""
    def merge(batch: DataFrame, epoch: int) -> None:
        before = f"{folder}/version={epoch - 1}" if epoch else earlier
        if before is None:
            state = batch.limit(0).select("query_name", "validation_status", "provider", "display_order")
        else:
            state = batch.sparkSession.read.parquet(before)
        upsert_status(state, batch).write.mode("overwrite").parquet(f"{folder}/version={epoch}")

    return merge
