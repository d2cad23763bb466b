"""Admission over a sliding window: only admitted hits count, so each decision depends on those before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = "event_id long, user_id long, event_type string, at double, retry_after int"


def decide(hits: deque, at: float, limit: int, window: float) -> int:
    """0 and the hit is remembered, or the whole seconds until the oldest hit of a full window leaves it."""
    while hits and hits[0] <= at - window:
        hits.popleft()
    if len(hits) >= limit:
        left = hits[0] + window - at
        return max(1, int(left) + (left > int(left)))
    hits.append(at)
    return 0


def admitted(events: DataFrame, limit: int, window: float) -> DataFrame:
    """event_id, user_id, event_type, at, retry_after (0: admitted) of events, limited for each user and type.

    Keys are dealt by hash and read in order of time (ties by event_id); a task holds one key's window of at
    most `limit` hits, however many events the key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, hits = None, deque()
        for rows in batches:
            out = []
            for u, t, at in zip(rows.user_id, rows.event_type, rows["at"], strict=True):
                if (u, t) != key:
                    key, hits = (u, t), deque()
                out.append(decide(hits, at, limit, window))
            yield rows.assign(retry_after=out)[[x.split()[0] for x in FIELDS.split(", ")]]

    rows = events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").cast("double").alias("at"))
    return rows.repartition("user_id", "event_type").sortWithinPartitions("user_id", "event_type", "at", "event_id").mapInPandas(run, FIELDS)


def admitted_stream(events: DataFrame, limit: int, window: float, late: str = "1 minute") -> DataFrame:
    """The same over a stream; a key's state is its window, and goes when the watermark has passed the window's end."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        rows["retry_after"] = [decide(hits, at, limit, window) for at in rows["at"]]
        state.update((list(hits),))
        state.setTimeoutTimestamp(max(int((hits[-1] + window) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield rows[[x.split()[0] for x in FIELDS.split(", ")]]

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = timed.select("event_id", "user_id", "event_type", "ts", F.col("ts").cast("double").alias("at"))
    return rows.groupBy("user_id", "event_type").applyInPandasWithState(run, FIELDS, "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def unique_stream(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; state beyond it goes."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
