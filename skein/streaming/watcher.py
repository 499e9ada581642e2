"""A watched directory: new files as a stream, changed and deleted ones by comparing snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of files as they appear."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).schema("path string, modificationTime timestamp, length long, content binary").load(path)


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """What a directory holds now, with digests."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length", F.sha2("content", 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """New, modified and deleted files between two snapshots."""
    from skein.operators.aggregates import snapshot_diff

    return snapshot_diff(before, after, "path", "digest").filter("change <> 'same'")


def ingest(stream: DataFrame, path: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame] | None = None):
    """Starts a query that appends handled files to a Parquet table, one row per path and digest."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("digest", F.sha2("content", 256)).dropDuplicates(["path", "digest"])
        (handle(rows) if handle else rows.drop("content")).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
