"""Structured Streaming over events with an event time and a time of availability.

Rows that become available after their checkpoint are not dropped: they go to an
audit output of their own. Episodes are kept as state with a bounded number of
steps and a horizon after which they close.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "first_us bigint, steps int, closed boolean"
OUTPUT = "entity string, first_us bigint, steps int, status string"


def distinct_events(events: DataFrame, ident: str, available: str, delay: str = "1 day") -> DataFrame:
    """Each physical event once, however often it is delivered within the watermark."""
    return events.withWatermark(available, delay).dropDuplicatesWithinWatermark([ident])


def split_late(events: DataFrame, available: str, checkpoint: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) rows against a checkpoint column; a row without either time is late."""
    in_time = F.coalesce(F.col(available) <= F.col(checkpoint), F.lit(False))
    return events.where(in_time), events.where(~in_time).withColumn("reason", F.lit("not_available_by_checkpoint"))


def windowed(events: DataFrame, available: str, key: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts by key and window of availability, closed by the watermark."""
    return events.withWatermark(available, delay).groupBy(F.window(available, width), key).agg(F.count("*").alias("n"))


def episodes(events: DataFrame, entity: str, at: str, most_steps: int = 3, horizon_us: int = 30 * 86_400_000_000, delay: str = "1 day") -> DataFrame:
    """Episodes of an entity: opened by its first event, one step an event, closed at ``most_steps`` or beyond the horizon.

    Gives a row (entity, first_us, steps, status) per entity and batch that has
    news; status is waiting, depth_limit_reached or expired. Events of a closed
    episode are ignored. Once the watermark, ``delay`` behind the latest event, has
    passed an episode's horizon, an open one expires and its state is dropped; an
    entity that comes again later begins a new episode.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, steps, closed = state.get if state.exists else (None, 0, False)
        if state.hasTimedOut:
            state.remove()
            if not closed:
                yield pd.DataFrame({"entity": [key[0]], "first_us": [first], "steps": [steps], "status": ["expired"]})
            return
        fresh = not closed
        times = sorted(int(t) for batch in batches for t in batch["us"].dropna())
        status = "waiting"
        for t in times:
            if closed:
                break
            first = t if first is None else first
            if t - first > horizon_us:
                closed, status = True, "expired"
                break
            steps += 1
            if steps >= most_steps:
                closed, status = True, "depth_limit_reached"
        if first is None:
            return
        state.update((first, steps, closed))
        state.setTimeoutTimestamp(max((first + horizon_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if fresh:
            yield pd.DataFrame({"entity": [key[0]], "first_us": [first], "steps": [steps], "status": [status]})

    moment = F.col(at).cast("timestamp")
    rows = events.select(F.col(entity).cast("string").alias("entity"), moment.alias("moment"), F.unix_micros(moment).alias("us")).withWatermark("moment", delay)
    return rows.groupBy("entity").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
