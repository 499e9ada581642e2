"""Task queue: states as the latest event of a task, and the order in which tasks run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_state(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each task: a maximum over a struct, combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s")).select(key, "_s.*")


def schedule(tasks: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The next ``limit`` tasks with their places: a bounded top-k, numbered afterwards."""
    head = tasks.orderBy(*order).limit(limit)
    return head.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # over ``limit`` rows


def recover(states: DataFrame, now: Column, stale: str = "1 hour") -> DataFrame:
    """Running tasks that have not been heard of for ``stale`` count as failed."""
    old = (F.col("status") == "running") & (F.col("ts") < now - F.expr(f"INTERVAL {stale}"))
    return states.withColumn("status", F.when(old, "failed").otherwise(F.col("status")))


def lanes(tasks: DataFrame, llm: Column, io_slots: int = 4) -> DataFrame:
    """Model tasks run one at a time, the others in ``io_slots`` lanes by a hash of their id."""
    return tasks.withColumn("lane", F.when(llm, F.lit(0)).otherwise(F.pmod(F.xxhash64("task_id"), F.lit(io_slots)) + 1))
