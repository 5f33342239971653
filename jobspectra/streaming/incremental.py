"""Incremental ingestion: landed files to stored tables as available-now micro-batches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame

from jobspectra.plans.ingest import ingest_batch, refresh_snapshots
from jobspectra.sources.tables import Store


def run_available(store: Store, landed: DataFrame, to_raw: Callable[[DataFrame], DataFrame], *,
                  checkpoint: str, batch_ts: dt.datetime, name: str = "landed", snapshots: bool = True,
                  split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> int:
    """Processes everything landed since the last call and stops.

    The batch number is the run id, so a batch repeated after a failure replaces its own
    audit and journal rows and merges to the same postings. Snapshots are built once, after
    the last batch. ``split`` (for example ``pages.split_blocked``) divides a batch into
    readable and blocked pages; the latter go to their own table and counter.
    """
    def one_batch(batch: DataFrame, number: int) -> None:
        readable, blocked = split(batch) if split else (batch, None)
        ingest_batch(store, to_raw(readable), f"{name}-{number:06d}", batch_ts, blocked=blocked,
                     meta={"type": "incremental", "source": name}, snapshots=False)

    query = (landed.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
             .foreachBatch(one_batch).start())
    query.awaitTermination()
    if snapshots:
        refresh_snapshots(store)
    return len(query.recentProgress)
