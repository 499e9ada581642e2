"""The crawl frontier: rounds of best unvisited links with caps per domain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.urls import domain_key
from skein.operators.pages import frontier
from skein.sources.storage import cut


def crawl(seeds: DataFrame, links: DataFrame, score: Callable[[DataFrame], DataFrame], depth: int, cap: int, threshold: float) -> DataFrame:
    """Visited URLs with the round in which they were reached.

    ``links`` is (from_url, to_url); ``score`` adds ``score`` to (url, depth). Each
    round is one plan: join, score, rank per domain, cut.
    """
    step = cut(seeds.select("url", F.lit(0).alias("depth")).distinct(), "crawl")
    seen = step
    for d in range(1, depth + 1):
        found = links.join(step.select(F.col("url").alias("from_url")), "from_url").select(F.col("to_url").alias("url")).distinct().withColumn("depth", F.lit(d))
        ranked = frontier(score(found).withColumn("domain", domain_key("url")), "domain", cap, threshold, seen)
        step = cut(ranked.select("url", "depth"), "crawl")
        if not step.limit(1).count():
            break
        seen = cut(seen.unionByName(step), "crawl")
    return seen
