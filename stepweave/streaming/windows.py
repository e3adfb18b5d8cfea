"""Windowed aggregates and the stop rule as a stateful stream. The same functions take batch and streaming frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_windows(events: DataFrame, size: str, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling window and type; a stream drops rows later than ``late`` behind its newest."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))


def stop_stream(scores: DataFrame, tau: float = 0.35, delta: float = 0.15) -> DataFrame:
    """Per example the first step scored below tau or more than delta under the step before, emitted once.

    scores: a stream of example_id, step, score in order of steps; the state is the last score and whether it stopped.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, stopped = state.get if state.exists else (1.0, False)
        out = []
        for rows in frames:
            for step, score in rows.sort_values("step")[["step", "score"]].itertuples(index=False):
                if not stopped and (score < tau or last - score > delta):
                    stopped = True
                    out.append((key[0], int(step), float(score)))
                last = float(score)
        state.update((last, stopped))
        yield pd.DataFrame(out, columns=["example_id", "stop", "score"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return scores.groupBy("example_id").applyInPandasWithState(follow, "example_id long, stop int, score double", "last double, stopped boolean", "append", GroupStateTimeout.NoTimeout)
