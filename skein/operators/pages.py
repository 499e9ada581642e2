"""Operators over pages, links and media."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import urls as U
from skein.functions.text import uuid5


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first by ``order``: what an upsert leaves."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Incoming rows replace stored ones with the same key; one shuffle, no window."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (key, "_new")]
    return both.groupBy(key).agg(F.max_by(F.struct(*cols), "_new").alias("_row")).select(key, "_row.*")


def media(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """All media of all pages with score and whether they are worth processing."""
    rows = pages.select(key, F.col(url).alias("page_url"), F.explode(H.media_tags(html)).alias("m"))
    scored = rows.withColumn("score", H.media_score(F.col("m"), U.host("page_url")))
    return scored.select(key, "page_url", "m.*", "score", H.worth_processing(F.col("m"), F.col("score")).alias("process"))


def media_cost(media: DataFrame) -> DataFrame:
    """Items and estimated seconds by type of medium."""
    each = F.when(F.col("media_type") == "image", 2).when(F.col("media_type") == "video", 30).when(F.col("media_type") == "audio", 15).otherwise(10)
    return media.groupBy("media_type").agg(F.count("*").alias("items"), F.sum(each).cast("long").alias("seconds"))


def processing_method(media: DataFrame, prefer_speed: bool = False, prefer_quality: bool = True) -> DataFrame:
    """The method for each medium and how sure that choice is.

    ``media`` has media_type and url, and where known is_handwritten,
    is_printed_text, has_clear_speech, has_audio, duration, width and height.
    """
    have = lambda c, kind: F.col(c).cast(kind) if c in media.columns else F.lit(None).cast(kind)
    u = F.lower(F.coalesce(F.col("url"), F.lit("")))
    pixels = have("width", "long") * have("height", "long")
    pick = lambda m, c: F.struct(F.lit(m).alias("method"), F.lit(c).alias("confidence"))
    image = (
        F.when(have("is_handwritten", "boolean"), pick("image2text", 0.9)).when(have("is_printed_text", "boolean"), pick("tesseract", 0.95)).when((pixels > 0) & (pixels < 200_000), pick("image2text", 0.7))
        .when(u.rlike("screenshot|screen|capture"), pick("tesseract", 0.8)).when(u.rlike("diagram|chart|infographic|graph"), pick("image2text", 0.8)).otherwise(pick("tesseract" if prefer_speed else "image2text", 0.6))
    )
    seconds = have("duration", "double")
    video = (
        F.when(have("has_clear_speech", "boolean"), pick("speech", 0.9)).when(~have("has_audio", "boolean"), pick("video2text", 0.95)).when((seconds > 0) & (seconds < 120), pick("video2text", 0.7))
        .when(seconds > 600, pick("speech", 0.75)).otherwise(pick("speech" if prefer_speed or not prefer_quality else "video2text", 0.6))
    )
    t = F.col("media_type")
    chosen = F.when(t == "image", image).when(t == "video", video).when(t == "audio", pick("speech", 1.0)).when(t == "pdf", pick("pdf_extract", 1.0))
    return media.withColumn("_d", chosen).withColumn("method", F.col("_d.method")).withColumn("method_confidence", F.col("_d.confidence")).drop("_d")


def save_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct links with the ids of both pages where they are known, and the edge kind."""
    known = pages.select(F.col("url").alias("_u"), uuid5("url").alias("_id")).distinct()
    rows = links.withColumn("relation_type", F.lit("links_to")).dropDuplicates(["from_url", "to_url", "relation_type"])
    rows = rows.join(known.withColumnsRenamed({"_u": "from_url", "_id": "from_page_id"}), "from_url", "left").join(known.withColumnsRenamed({"_u": "to_url", "_id": "to_page_id"}), "to_url", "left")
    return rows.withColumn("is_edge", F.col("from_page_id").isNotNull() & F.col("to_page_id").isNotNull())


def frontier(rows: DataFrame, domain: str, cap: int, threshold: float, visited: DataFrame | None = None) -> DataFrame:
    """The next batch of a crawl: best first, at most ``cap`` per domain, unvisited, scored enough."""
    if visited is not None:
        rows = rows.join(visited.select("url"), "url", "left_anti")
    w = Window.partitionBy(domain).orderBy(F.desc("score"), "depth", "url")
    return rows.filter(F.col("score") >= threshold).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cap)


def refresh_scan(pages: DataFrame, key: str, limit: int) -> DataFrame:
    """Pages fetched longest ago first, never fetched ones before all."""
    return pages.orderBy(F.coalesce("last_fetch_at", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), key).limit(limit)


def valid_patterns(patterns: list[str]) -> list[str]:
    """Those that compile; the others are skipped."""
    good = []
    for p in patterns:
        try:
            re.compile(p)
            good.append(p)
        except re.error:
            continue
    return good


def matches_any(c: str, patterns: list[str]) -> Column:
    good = valid_patterns(patterns)
    return reduce(lambda a, b: a | b, [F.col(c).rlike(p) for p in good], F.lit(not good))


def seeds(sources: list[DataFrame], patterns: list[str], limit: int) -> DataFrame:
    """URLs of several ranked sources, each once at its first place."""
    rows = reduce(DataFrame.unionByName, sources).filter(matches_any("url", patterns))
    return rows.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos", "url").limit(limit)


def urls_in_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct URLs of a text in order, without a final full stop."""
    found = F.regexp_extract_all(F.col(text), F.lit("https?://[^\\s<>\"']*[^\\s<>\"'.]"), F.lit(0))
    return df.select(key, F.explode(F.array_distinct(found)).alias("url"), F.lit(0.5).alias("score"))


def listing(df: DataFrame, order: Column, offset: int, limit: int) -> DataFrame:
    """One page of a listing with the total: the count is an aggregate of its own, not a window over one task."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # the total is one row
