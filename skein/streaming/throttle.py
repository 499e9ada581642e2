"""Throttling: an event counts only ``seconds`` after the last one of its key that counted."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle_batch(rows: DataFrame, key: str, time: str, tie: str, seconds: int) -> DataFrame:
    """The accepted events. Keys are streamed in order inside their partition: one event in memory at a time, however many a key has."""
    ordered = rows.repartition(key).sortWithinPartitions(key, time, tie)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for f in frames:
            keep = []
            for k, t in zip(f[key], f[time]):
                ok = k != last_key or (t - last).total_seconds() >= seconds
                if ok:
                    last_key, last = k, t
                keep.append(ok)
            yield f[keep]

    return ordered.mapInPandas(run, rows.schema)


def throttle_stream(rows: DataFrame, key: str, time: str, seconds: int, schema: str) -> DataFrame:
    """The same over a stream: the last accepted time is the state of a key and expires with the watermark."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for f in frames:
            keep = []
            for t in f[time].sort_values():
                stamp = t.value // 1000
                ok = last is None or stamp - last >= seconds * 1_000_000
                last = stamp if ok else last
                keep.append(ok)
            yield f.sort_values(time)[keep]
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))

    stamped = rows.withWatermark(time, f"{seconds} seconds")
    return stamped.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedup_stream(rows: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """First of each key within the watermark, by Spark's own operator."""
    return rows.withWatermark(time, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)

