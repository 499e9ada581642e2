"""Keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyword_snippet(text: str | Column, word: str, before: int = 60, length: int = 200) -> Column:
    """``length`` characters around the first place of ``word``, from ``before`` characters ahead of it."""
    text = F.col(text) if isinstance(text, str) else text
    return F.substring(text, F.greatest(F.lit(1), F.instr(F.lower(text), word.lower()) - before), F.lit(length))


def keyword_search(df: DataFrame, word: str, text: str, keep: list[str], score: str, key: str, limit: int) -> DataFrame:
    """Rows whose text contains ``word`` in any case, best score first, with a snippet."""
    found = df.filter(F.col(text).ilike(f"%{word}%"))
    return found.select(*keep, keyword_snippet(text, word).alias("snippet")).orderBy(F.col(score).desc_nulls_last(), key).limit(limit)


def best_per_key(hits: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The best hit of each key; hits without a key are all kept."""
    from skein.operators.pages import latest

    return latest(hits.filter(F.col(key).isNotNull()), [key], order).unionByName(hits.filter(F.col(key).isNull()))


def fuse(vector_hits: DataFrame, graph_hits: DataFrame, key: str, vector_weight: float = 1.2, graph_weight: float = 0.5) -> DataFrame:
    """Scores of two searches over one key, weighted and summed."""
    a = vector_hits.select(key, (F.col("score") * vector_weight).alias("part"))
    b = graph_hits.select(key, (F.col("score") * graph_weight).alias("part"))
    return a.unionByName(b).groupBy(key).agg(F.round(F.sum("part"), 6).alias("score"))


def gather(sources: list[tuple[str, DataFrame]], k: int) -> DataFrame:
    """Hits of several searches: best per URL, earlier sources first on ties, the best ``k`` of all."""
    rows = None
    for place, (name, df) in enumerate(sources):
        part = df.withColumn("source", F.lit(name)).withColumn("_place", F.lit(place))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    return best_per_key(rows, "url", [F.desc("score"), F.asc("_place")]).orderBy(F.desc("score"), "_place", "url").limit(k).drop("_place")


def quality_decision(hits: DataFrame, least: float = 0.7, need: int = 2) -> DataFrame:
    """How many hits are good, and what to do next."""
    good = F.count_if(F.col("score") >= least)
    return hits.agg(F.count("*").alias("hits"), good.alias("good"), F.when(good >= need, "answer").when(F.count("*") > 0, "paraphrase").otherwise("crawl").alias("phase"))


def hybrid_entities(entities: DataFrame, word: str, semantic: DataFrame, key: str, name: str, limit: int, least: float = 0.7) -> DataFrame:
    """Substring matches first (score 1), then semantic hits of ``least`` or more up to ``limit``."""
    exact = entities.filter(F.lower(name).contains(word.lower())).select(key, F.lit(1.0).alias("score"), F.lit(0).alias("rank"))
    near = semantic.filter(F.col("score") >= least).select(key, "score", F.lit(1).alias("rank")).join(exact.select(key), key, "left_anti")
    return exact.unionByName(near).orderBy("rank", F.desc("score"), key).limit(limit).select(key, "score")
