"""Backfill: segment a period, take each posting once and ingest it as one run."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobspectra.operators.segments import SPLIT_AT, segment_stats, time_segments
from jobspectra.plans.ingest import ingest_batch
from jobspectra.sources.tables import Store


def backfill(store: Store, raw: DataFrame, run_id: str, end: dt.datetime, days_back: int = 30, *,
             split_at: int = SPLIT_AT, snapshots: bool = True) -> DataFrame:
    """Ingests the postings of the last ``days_back`` days; returns the segment statistics.

    ``raw`` carries ``seq``; a posting found in several places counts once, by its first
    sighting. The statistics come back as one row.
    """
    start = end - dt.timedelta(days=days_back)
    lower, upper = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
    window = raw.where((F.col("published_at") >= lower) & (F.col("published_at") < upper))
    leaves = time_segments(window, "published_at", start, end, split_at=split_at)
    columns = [c for c in window.columns if c != "posting_id"]
    once = (window.groupBy("posting_id").agg(F.min_by(F.struct(*columns), "seq").alias("first"))
            .select("posting_id", "first.*"))
    ingest_batch(store, once, run_id, end,
                 meta={"type": "backfill", "source": "landed", "days_back": days_back}, snapshots=snapshots)
    return segment_stats(leaves)
