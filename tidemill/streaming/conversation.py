"""Conversations as streams: turns arrive, and the state after each is folded again from all of the conversation's turns so far."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemill.operators.state import Vocabulary, fold

FIELDS = "conv_id long, turn long, status string, chief string, present array<string>, missing array<string>"


def state_stream(turns: DataFrame, v: Vocabulary, idle: str = "1 hour") -> DataFrame:
    """FIELDS for each conversation that a batch has turns of (conv_id, turn, role, text, ts). A turn that comes again replaces itself.

    A conversation's state is its turns; it goes when the watermark is an hour (`idle`) behind its last one.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = {t: (r, x) for t, r, x in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches))
        held |= {int(t): (r, x or "") for t, r, x in zip(rows.turn, rows.role, rows.text, strict=True)}
        order = sorted(held)
        state.update((order, [held[t][0] for t in order], [held[t][1] for t in order]))
        state.setTimeoutTimestamp(max(int(rows["at"].max() * 1000), state.getCurrentWatermarkMs()) + 1)
        now = fold([held[t] for t in order], v)
        yield pd.DataFrame([(key[0], order[-1], now["status"], now["chief"], now["present"], now["missing"])], columns=[x.split()[0] for x in FIELDS.split(", ")])

    timed = turns.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", idle)
    rows = timed.select("conv_id", "turn", "role", "text", "ts", F.col("ts").cast("double").alias("at"))
    return rows.groupBy("conv_id").applyInPandasWithState(run, FIELDS, "turns array<long>, roles array<string>, texts array<string>", "append", GroupStateTimeout.EventTimeTimeout)
