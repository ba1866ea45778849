"""Rate limit on a stream of questions: the state is a client's counter per fixed window, dropped when the watermark has passed it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "event_id bigint, ts timestamp, client string, window_start timestamp, admitted boolean"


def rate_limited_stream(events: DataFrame, permits: int = 5, window: str = "minute", late: str = "10 minutes") -> DataFrame:
    """Events (event_id, ts, client) with `admitted`: the first `permits` of a client in a window, in order of arrival by batch and of time within one. An event id delivered twice within the watermark counts once; a null client is a client of its own."""

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        whole = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        whole["admitted"] = [used + i < permits for i in range(len(whole))]
        state.update((used + len(whole),))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + 60_000)
        yield whole[["event_id", "ts", "client", "window_start", "admitted"]]

    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "ts", "client", F.date_trunc(window, "ts").alias("window_start"), F.coalesce("client", F.lit("")).alias("who"))
    return once.groupBy("who", "window_start").applyInPandasWithState(count, OUT, "used int", "append", GroupStateTimeout.EventTimeTimeout)
