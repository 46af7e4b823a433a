"""Reviews as a stream: each sample's latest status, kept in state, and counts over windows of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame) -> DataFrame:
    """(sample_id, status, prev, n) of a stream (sample_id, ts, seq, status): a row for each sample that changed.

    State holds one status, its place in the order and a count for each sample; late events don't go back in time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ts, seq, status, n = state.get if state.exists else (None, -1, "pending", 0)
        prev = status
        for b in batches:
            n += len(b)
            last = b.sort_values(["ts", "seq"]).iloc[-1]
            if ts is None or (last["ts"].value, last["seq"]) > (ts, seq):
                ts, seq, status = int(last["ts"].value), int(last["seq"]), last["status"]
        state.update((ts, seq, status, n))
        yield pd.DataFrame({"sample_id": [key[0]], "status": [status], "prev": [prev], "n": [n]})

    return events.groupBy("sample_id").applyInPandasWithState(step, "sample_id long, status string, prev string, n long", "ts long, seq long, status string, n long", "update", GroupStateTimeout.NoTimeout)


def status_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, status, n) per window of event time; windows older than the watermark are closed."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), "status", "n")
