"""Directly-follows relations and temporal checks over streams of events.

A case's last event is state, kept by case and given up when the case is idle for longer than a bound (event time), so the
state doesn't grow with the stream.  Events of a case are taken in the order of their times inside a batch; one that is older
than the case's last event counts from that event, as it came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EDGES = "case_id string, a string, b string, ts timestamp, gap double"


def stream_edges(events: DataFrame, idle: str = "30 days", late: str = "1 hour") -> DataFrame:
    """(case_id, a, b, ts, gap in seconds) of each event and the one before it in its case; a is null for a case's first event.

    events has case_id, activity and ts (timestamp); rows that lack one of them are left out.  A watermark of ``late``
    on ts bounds the state: a case without an event for ``idle`` is forgotten and begins anew.
    """
    seconds = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = events.where("case_id IS NOT NULL AND activity IS NOT NULL AND ts IS NOT NULL").select(F.col("case_id").cast("string").alias("case_id"), "activity", F.col("ts").cast("timestamp").alias("ts"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        own = pd.concat(list(frames)).sort_values(["ts", "activity"], kind="stable")
        last, at = state.get if state.exists else (None, None)
        before = [last, *own["activity"][:-1]]
        times = own["ts"].astype("int64") // 1000 if str(own["ts"].dtype).endswith("ns]") else own["ts"].astype("int64")
        earlier = [at, *times[:-1]]
        gap = [None if x is None else (t - x) / 1e6 for x, t in zip(earlier, times, strict=True)]
        state.update((own["activity"].iloc[-1], int(times.iloc[-1])))
        state.setTimeoutTimestamp(max(int(times.iloc[-1]) // 1000, state.getCurrentWatermarkMs()) + seconds)
        yield pd.DataFrame({"case_id": key[0], "a": pd.Series(before, dtype=object), "b": own["activity"].to_numpy(), "ts": own["ts"].to_numpy(), "gap": pd.Series(gap, dtype=float)})

    return rows.withWatermark("ts", late).groupBy("case_id").applyInPandasWithState(step, EDGES, "activity string, us long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_deviations(edges: DataFrame, profile: DataFrame, zeta: float) -> DataFrame:
    """Rows of stream_edges() with ``deviation``: unknown (no such step in the profile), slow or fast, else null.

    profile is a table (a, b, mean_s, stdev_s) of directly-follows times; a step deviates where its gap is beyond
    mean_s +- zeta * stdev_s.  A case's first event never deviates.  A stream-static join: no state of its own.
    """
    known = profile.select("a", "b", "mean_s", F.coalesce("stdev_s", F.lit(0.0)).alias("stdev_s"))
    away, bound = F.col("gap") - F.col("mean_s"), zeta * F.col("stdev_s")
    kind = F.when(F.col("a").isNull(), None).when(F.col("mean_s").isNull(), "unknown").when(away > bound, "slow").when(away < -bound, "fast")
    rows = edges.where("b IS NOT NULL")  # all rows; the state operator's columnar rows can't be shuffled as they are
    return rows.join(known, ["a", "b"], "left").select(*edges.columns, kind.alias("deviation"))


def stream_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, activity, n): events by activity and tumbling window of event time, given out once the watermark passes."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), F.col("activity")).agg(F.count("*").alias("n"))
