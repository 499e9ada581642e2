"""What crawl outcomes teach: domain statistics, smoothed quality, reliability, patterns, boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def domain_stats(outcomes: DataFrame, key: str, success: Column, time: str, kind: str) -> DataFrame:
    """Counts, success rate, first and last time, and how many kinds each key has."""
    return outcomes.groupBy(key).agg(F.count("*").alias("total"), F.count_if(success).alias("successes"), F.round(F.avg(success.cast("double")), 6).alias("success_rate"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count_distinct(kind).alias("kinds"))


def kind_histogram(outcomes: DataFrame, key: str, kind: str) -> DataFrame:
    return outcomes.groupBy(key, kind).agg(F.count("*").alias("n"))


def ema(outcomes: DataFrame, key: str, value: Column, order: list[Column], alpha: float = 0.1) -> DataFrame:
    """Exponential mean in arrival order from 0: the r-th newest value weighs alpha * (1 - alpha) ** (r - 1).

    ``order`` is newest first. Weights below 1e-16 of the first are left out of the
    sum by nobody: the closed form needs the rank only, so it stays one window.
    """
    w = Window.partitionBy(key).orderBy(*order)
    ranked = outcomes.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(key).agg(F.round(F.sum(alpha * F.pow(F.lit(1 - alpha), F.col("_r") - 1) * value), 6).alias("quality"))


def reliability(success: Column, quality: Column, age_days: Column) -> Column:
    """Success and quality, fading over thirty days; .5 for what is unknown."""
    fresh = 0.8 + 0.2 * F.greatest(F.lit(0.0), 1 - age_days / 30)
    return F.coalesce(F.round((0.4 * success + 0.4 * quality) * fresh, 6), F.lit(0.5))


def pattern_confidence(outcomes: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """Success rate, full from ten outcomes on."""
    n = F.count("*")
    return outcomes.groupBy(*keys).agg(n.alias("n"), F.round(F.avg(success.cast("double")) * F.least(F.lit(1.0), n / 10), 6).alias("confidence"))


def successful_patterns(patterns: DataFrame, least: float, order: list[Column], top: int) -> DataFrame:
    return patterns.filter(F.col("confidence") > least).orderBy(*order).limit(top)


def strategy(confidence: Column, pattern_quality: Column, crawls: Column, domain_quality: Column) -> tuple[Column, Column]:
    """Timeout in seconds by a pattern's confidence, and expected quality; domains of five crawls or more tell their own."""
    timeout = F.when(confidence > 0.8, 90).when(confidence < 0.3, 150).otherwise(120)
    return timeout, F.coalesce(F.when(crawls >= 5, domain_quality), pattern_quality, F.lit(0.5))


def domain_boost(n: Column, quality: Column, success: Column) -> Column:
    return F.when(n < 3, 0.0).when(success >= 0.7, quality * 30).when(success >= 0.5, quality * 15).when(success < 0.3, -20.0).otherwise(0.0)


def pattern_boost(n: Column, success: Column) -> Column:
    return F.when(n < 5, 0.0).when(success >= 0.8, 10.0).when(success >= 0.6, 5.0).when(success < 0.3, -10.0).otherwise(0.0)


def frontier_adjustment(success: Column, quality: Column, confidence: Column, alpha: float = 1.0) -> Column:
    base = F.when(success, 20.0).otherwise(-15.0) + quality * 25
    return F.when(confidence > 0.6, base * alpha).otherwise(0.0)


def summary(stats: DataFrame, patterns: DataFrame) -> DataFrame:
    """One row: domains, patterns, trusted patterns, reliable domains."""
    a = stats.agg(F.count("*").alias("domains"), F.count_if(F.col("reliability") > 0.7).alias("reliable"))
    b = patterns.agg(F.count("*").alias("patterns"), F.count_if(F.col("confidence") > 0.7).alias("trusted"))
    return a.crossJoin(F.broadcast(b))  # one row each


def step_reward(patterns: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Rewards moved by the sum of their updates, never below 0."""
    delta = updates.groupBy(key).agg(F.sum("delta").alias("delta"))
    return patterns.join(delta, key, "left").select(key, F.round(F.greatest(F.lit(0.0), F.col("reward") + F.coalesce("delta", F.lit(0.0))), 6).alias("reward"))


def success_rate(logs: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return logs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(F.col(flag).cast("double")), F.lit(0.0)), 6).alias("success_rate"))
