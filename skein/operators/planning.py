"""What to embed, what to look up, and what agents decide from queries over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import is_truthy, sentences, uuid5, windows


# ---------------------------------------------------------------- embedding plans
def page_views(pages: DataFrame, key: str, title: str, text: str, findings: str | None = None, most_sentences: int = 40, most: int = 1200) -> DataFrame:
    """Texts of a page worth embedding: title, sentences, windows and findings, in that order, ``most`` at most."""
    s = F.slice(sentences(text), 1, most_sentences)
    w = F.slice(windows(sentences(text)), 1, 200)
    tagged = lambda kind, a: F.transform(a, lambda x: F.struct(F.lit(kind).alias("view"), x.alias("text")))
    parts = [tagged("title", F.array(F.col(title))), tagged("sentence", s), tagged("window", w)]
    if findings:
        parts.append(tagged("finding", F.col(findings)))
    views = F.slice(F.filter(F.concat(*parts), lambda x: F.length(x["text"]) >= 10), 1, most)
    rows = pages.select(key, F.posexplode(views).alias("pos", "x")).select(key, "pos", "x.view", "x.text")
    return rows.withColumn("point_id", uuid5(F.concat_ws("#", F.col(key).cast("string"), F.concat("view", F.lit("-"), "pos"))))


def entity_views(entities: DataFrame, key: str, name: str, data: str) -> DataFrame:
    """An entity's name and each attribute of ten characters or more."""
    rows = entities.select(key, name, F.explode_outer(data).alias("field", "value"))
    attributes = rows.filter((F.length("value") >= 10) & is_truthy("value")).select(key, F.col("field").alias("view"), F.concat_ws(": ", name, "value").alias("text"))
    return entities.select(key, F.lit("name").alias("view"), F.col(name).alias("text")).unionByName(attributes)


def snippet_views(snippets: DataFrame, key: str) -> DataFrame:
    """Snippets of ten characters or more with the ids of their points."""
    return snippets.filter(F.length("snippet") >= 10).withColumn("point_id", uuid5(F.concat(F.col(key).cast("string"), F.lit("#snippet-"), F.col("chunk_index"))))


def embedding_text(name: Column, kind: Column, fields: list[Column]) -> Column:
    return F.concat_ws(" ", name, F.concat(F.lit("("), kind, F.lit(")")), *fields)


def uncached(texts: DataFrame, cache: DataFrame, text: str, now: Column, days: int = 7) -> DataFrame:
    """Distinct texts that the cache has no valid entry for, with their keys."""
    keyed = texts.select(F.sha2(text, 256).alias("prompt_hash"), text).distinct()
    return keyed.join(cache.filter(F.col("created_at") > now - F.expr(f"INTERVAL {days} DAYS")).select("prompt_hash"), "prompt_hash", "left_anti")


# ---------------------------------------------------------------- searches composed of others
def word_starts(entities: DataFrame, question: str, key: str, name: str, per_word: int = 5, most: int = 3) -> DataFrame:
    """Entities that a question's words lead to: ``per_word`` each, ``most`` in all."""
    words = [w for w in dict.fromkeys(question.lower().split()) if len(w) > 2]
    if not words:
        return entities.select(key).limit(0)
    parts = [entities.filter(F.lower(name).contains(w)).select(key, F.lit(i).alias("word")).orderBy(key).limit(per_word) for i, w in enumerate(words)]
    return reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.min("word").alias("word")).orderBy("word", key).limit(most).select(key)


def seed_queries(scored: DataFrame, least: float = 0.5, most: int = 4) -> DataFrame:
    """Queries near enough to the topic, each once in order; the first ones where none is."""
    first = scored.groupBy("query").agg(F.min("pos").alias("pos"), F.max("score").alias("score"))
    good = first.filter(F.col("score") >= least)
    pick = good if good.limit(1).count() else first
    return pick.orderBy("pos").limit(most).select("query", "pos")


def dedup_hits(hits: DataFrame, point: str, url: str, kind: str, order: str) -> DataFrame:
    """First hit of each point, or of each URL and kind where the point has no id."""
    k = F.coalesce(F.col(point).cast("string"), F.concat_ws("|", url, kind))
    w = Window.partitionBy(k).orderBy(order)
    return hits.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def hydrate(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def unseen(hits: DataFrame, more: list[DataFrame], url: str, need: int = 2) -> DataFrame:
    """Hits, with those of query variants whose URLs are new where there are fewer than ``need``."""
    if hits.limit(need).count() >= need:
        return hits
    extra = reduce(DataFrame.unionByName, more)
    return hits.unionByName(extra.join(hits.select(url), url, "left_anti").dropDuplicates([url]))


# ---------------------------------------------------------------- agents
def investigation_tasks(gaps: DataFrame, pairs: DataFrame, priorities: list[str], top: int) -> DataFrame:
    """Tasks from gaps of the wanted priorities and from likely relations, best first."""
    a = gaps.filter(F.col("priority").isin(*priorities)).select(F.lit("gap").alias("task"), F.col("id").cast("string").alias("subject"), F.col("field").alias("what"), "score")
    b = pairs.select(F.lit("relation").alias("task"), F.col("a").cast("string").alias("subject"), F.col("b").cast("string").alias("what"), (F.col("confidence") * 10).alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "task", "subject", "what").limit(top)


def reflect(entities: DataFrame, edges: DataFrame, key: str, name: Column, rank: Column, richness: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Duplicates chosen and mapped, edges after the merge, and counts before and after."""
    from skein.operators.resolve import canonical_choice, id_map, merge_edges

    chosen = canonical_choice(entities.withColumn("_name", name), name, key, rank, richness, "_name")
    ids = id_map(entities, name, key)
    moved = merge_edges(edges, ids, "source_id", "target_id", "relation_type", "edge_id")
    report = entities.agg(F.count("*").alias("before")).crossJoin(F.broadcast(ids.agg(F.count("*").alias("merged"))))  # one row each
    return chosen, moved, report.withColumn("after", F.col("before") - F.col("merged"))


def discover(dead_ends: DataFrame, gaps: DataFrame, name: str) -> DataFrame:
    """Names worth exploring: dead ends first, then entities with gaps, each once."""
    both = dead_ends.select(name, F.lit(0).alias("o")).unionByName(gaps.select(name, F.lit(1).alias("o")))
    return both.groupBy(name).agg(F.min("o").alias("from_list")).orderBy("from_list", name)


def field_upsert(known: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Field definitions after a discovery: counts added, importance raised to critical where it was found so."""
    k = known.select(*keys, F.col("discovery_count").alias("_k"), F.col("importance").alias("_i"))
    n = found.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.col("importance") == "critical").alias("_c"), F.min("importance").alias("_f"))
    rows = k.join(n, keys, "full")
    return rows.select(*keys, (F.coalesce("_k", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("discovery_count"), F.when(F.col("_c"), "critical").otherwise(F.coalesce("_i", "_f")).alias("importance"))


#: Extraction strategies by entity type (fixed values).
STRATEGIES = {"company": "company", "organization": "company", "person": "person", "news": "news", "product": "product", "topic": "topic"}


def extraction_strategy(kind: Column) -> Column:
    return reduce(lambda acc, k: acc.when(kind == k, STRATEGIES[k]), STRATEGIES, F.when(F.lit(False), "")).otherwise("company")


def step_ok(tool: Column, hits: Column, answer: Column) -> Column:
    """Whether a planner's step gave what its tool is for."""
    from skein.functions.text import is_sufficient

    return F.when(tool.isin("search", "crawl", "lookup"), hits > 0).when(tool == "answer", is_sufficient(answer)).otherwise(True)


def completeness_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How much each entity gained, and which gaps were filled."""
    j = before.select(key, F.col("completeness").alias("b"), F.col("gaps").alias("gb")).join(after.select(key, F.col("completeness").alias("a"), F.col("gaps").alias("ga")), key)
    return j.select(key, F.round(F.col("a") - F.col("b"), 2).alias("gain"), F.array_except("gb", "ga").alias("filled"))
