"""Aggregates: counts, first-wins sections, labels, caches, snapshots and searches over several databases."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def status_counts(rows: DataFrame, key: str, status: str, values: list[str]) -> DataFrame:
    """Counts of each status, 0 where there is none."""
    return rows.groupBy(key).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values))


def first_wins(rows: DataFrame, keys: list[str], order: str, source: str) -> DataFrame:
    """Items of sections by their first mention, with mentions and distinct sources."""
    return rows.groupBy(*keys).agg(F.count("*").alias("mentions"), F.min(order).alias("first_id"), F.count_distinct(source).alias("sources"))


def best_label(rows: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """The most frequent label of each key, ties to the one seen first."""
    counts = rows.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(key).agg(F.min_by(label, F.struct(-F.col("n"), F.col("first"), F.col(label))).alias(label))


def first_values(rows: DataFrame, key: str, value: str, order: str, most: int) -> DataFrame:
    """At most ``most`` distinct values of each key in the order of first mention."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("_o"))
    w = Window.partitionBy(key).orderBy("_o")
    ranked = first.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most)
    return ranked.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda x: x[value]).alias("values"))


def cache_stats(rows: DataFrame, hit: Column, time: str, now: datetime, days: int) -> DataFrame:
    """Hits, hit rate and entries that have not expired."""
    return rows.agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("hit_rate"), F.count_if(F.col(time) > F.lit(now - timedelta(days=days)).cast("timestamp_ntz")).alias("valid"))


def global_search(databases: list[DataFrame], word: str, limit: int) -> DataFrame:
    """Names that contain ``word``, at most ``limit`` per database and type."""
    rows = reduce(DataFrame.unionByName, databases).filter(F.col("name").ilike(f"%{word}%"))
    w = Window.partitionBy("db", "type").orderBy("name", "id")
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= limit).drop("_r")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """New, deleted, modified and unchanged keys of two snapshots."""
    b = after.select(F.col(key), F.col(digest).alias("_after"))
    a = before.select(F.col(key), F.col(digest).alias("_before"))
    change = F.when(F.col("_before").isNull(), "new").when(F.col("_after").isNull(), "deleted").when(F.col("_before") != F.col("_after"), "modified").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))
