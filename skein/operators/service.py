"""What a running service is asked besides searches: its status, and edits of files' notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def readable(spark: SparkSession, path: str) -> bool:
    """Whether a table can be opened at ``path``."""
    try:
        spark.read.parquet(path)
    except AnalysisException:
        return False
    return True


def status(spark: SparkSession, store: str, vectors: str | None, embedder: object | None, settings: dict[str, str]) -> DataFrame:
    """One row: whether store and vectors can be read, whether an embedder is at hand, and the settings."""
    row = {"db_ok": readable(spark, store), "vectors_ok": vectors is not None and readable(spark, vectors), "embedding_loaded": embedder is not None}
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in (row | settings).items()))


def update_metadata(files: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """``files`` (key, title, metadata map) with edits (key, title, tags, notes): a null field leaves what is there; unknown files are ignored."""
    e = edits.select(key, F.col("title").alias("new_title"), F.map_filter(F.create_map(F.lit("tags"), F.col("tags"), F.lit("notes"), F.col("notes")), lambda k, v: v.isNotNull()).alias("new"))
    rows = files.join(e, key, "left")
    kept = F.map_filter("metadata", lambda k, v: ~F.array_contains(F.map_keys("new"), k))
    merged = F.when(F.col("new").isNotNull(), F.map_concat(kept, F.col("new"))).otherwise(F.col("metadata"))
    return rows.select(key, F.coalesce("new_title", "title").alias("title"), merged.alias("metadata"))


def add_relations(asked: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Edges from files to other things, made by hand: the file must be known, the target named and well formed; related_to if no type is given."""
    target = F.trim(F.coalesce("target_id", F.lit("")))
    kind = F.trim(F.coalesce("relation_type", F.lit("related_to")))
    rows = asked.filter((target != "") & target.rlike(r"^[A-Za-z0-9-]+$")).join(files.select(F.col(key).alias("source_id")), "source_id", "left_semi")
    return rows.select("source_id", target.alias("target_id"), kind.alias("relation_type"), F.coalesce("description", F.lit("")).alias("description"), F.lit("user_manual").alias("source"))
