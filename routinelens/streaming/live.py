"""Streaming forms: tumbling activity, sessions, deduplicated overrides and stateful correction detection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def activity(stream: DataFrame, width: str = "15 minutes", late: str = LATE) -> DataFrame:
    """Changes per domain and tumbling window of the event time ``ts``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "domain").agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, gap: str = "5 minutes", late: str = LATE) -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "entity_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_overrides(stream: DataFrame, late: str = LATE) -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["entity_id", "us", "human_state"])


def corrections(stream: DataFrame, window_us: int = 120_000_000) -> DataFrame:
    """Overrides per entity with one pending automated change as state; rows are ordered within a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pending = state.get if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values(["us", "sid"]).itertuples():
            if r.cause in ("automation", "script"):
                pending = (int(r.us), r.state)
            elif r.cause == "human" and pending is not None:
                if not 0 <= r.us - pending[0] <= window_us:
                    pending = None
                elif r.state != pending[1]:
                    out.append((key[0], int(r.us), pending[1], r.state, int(r.us) - pending[0]))
                    pending = None
        state.remove() if pending is None else state.update(pending)
        yield pd.DataFrame(out, columns=["entity_id", "us", "automation_state", "human_state", "delay_us"])

    return stream.groupBy("entity_id").applyInPandasWithState(step, "entity_id string, us long, automation_state string, human_state string, delay_us long", "us long, state string", "append", "NoTimeout")
