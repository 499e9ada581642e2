"""Windows over event time, the same for streams and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(rows: DataFrame, time: str, late: str | None) -> DataFrame:
    return rows.withWatermark(time, late) if late else rows


def tumbling(rows: DataFrame, time: str, size: str, keys: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums per window; with ``slide`` windows overlap, with ``late`` streams drop what is later."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return _late(rows, time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(rows: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts per session: a gap of ``gap`` ends one."""
    return _late(rows, time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("session_window.start").alias("start"), "n")
