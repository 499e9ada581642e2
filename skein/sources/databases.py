"""Several databases: a registry over Spark's catalogue, switching, merging and searching them all."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.pages import upsert


def clean_name(name: str) -> str:
    """Letters, digits and single underscores in lower case; ``db`` where nothing is left."""
    return re.sub(r"_+", "_", re.sub(r"[^a-zA-Z0-9_]", "_", name)).strip("_").lower() or "db"


class Databases:
    """Creates, lists, switches and drops databases, and merges one into another."""

    def __init__(self, spark: SparkSession, prefix: str = "skein_"):
        self.spark, self.prefix = spark, prefix

    def create(self, name: str) -> str:
        full = self.prefix + clean_name(name)
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {full}")
        return full

    def list(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases() if d.name.startswith(self.prefix))

    def switch(self, name: str) -> None:
        self.spark.catalog.setCurrentDatabase(self.prefix + clean_name(name))

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.prefix}{clean_name(name)} CASCADE")

    def save(self, name: str, table: str, df: DataFrame) -> None:
        df.write.mode("overwrite").saveAsTable(f"{self.create(name)}.{table}")

    def table(self, name: str, table: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}{clean_name(name)}.{table}")

    def merge(self, source: str, target: str, tables: dict[str, str]) -> dict[str, int]:
        """Upserts each table (by its key) of ``source`` into ``target``; parents first, as they are given."""
        counts = {}
        for table, key in tables.items():
            merged = upsert(self.table(target, table), self.table(source, table), key)
            self.save(target, f"{table}_merged", merged)
            counts[table] = self.table(target, f"{table}_merged").count()
            full = self.prefix + clean_name(target)
            self.spark.sql(f"DROP TABLE {full}.{table}")
            self.spark.sql(f"ALTER TABLE {full}.{table}_merged RENAME TO {full}.{table}")
        return counts

    def search(self, word: str, fields: dict[str, str], limit: int) -> DataFrame:
        """Rows of all databases whose field contains ``word``, at most ``limit`` per database and table."""
        from skein.operators.aggregates import global_search

        parts = [self.spark.table(f"{db}.{t}").select(F.lit(db).alias("db"), F.lit(t).alias("type"), F.col("id").cast("string").alias("id"), F.col(f).alias("name")) for db in self.list() for t, f in fields.items() if self.spark.catalog.tableExists(f"{db}.{t}")]
        return global_search([reduce(DataFrame.unionByName, parts)], word, limit)
