"""Adapters: records of any shape made documents, and a data source that an adapter backs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

DOCUMENT = "id string, url string, title string, content string, confidence double"
TITLES = ("title", "name", "subject", "heading")


def normalise(rows: DataFrame, url: str, body: str) -> DataFrame:
    """JSON answers as documents: id from the URL, title from the first of four keys, else null."""
    fields = F.from_json(F.col(body), "map<string,string>")
    title = F.coalesce(*(F.nullif(F.trim(F.try_element_at(fields, F.lit(t))), F.lit("")) for t in TITLES))
    return rows.select(F.sha2(url, 256).alias("id"), F.col(url).alias("url"), title.alias("title"), F.col(body).alias("content"), F.lit(0.8).alias("confidence"))


def valid(docs: DataFrame, content: str = "content", confidence: str = "confidence") -> DataFrame:
    """Documents of ten characters or more and a confidence of .3 or more."""
    return docs.filter((F.length(content) >= 10) & (F.col(confidence) >= 0.3))


class AdapterSource(DataSource):
    """A registered fetch function as ``spark.read.format("adapter")``: one partition per URL."""

    fetch: Callable[[str], Iterable[dict]] = staticmethod(lambda url: ())

    @classmethod
    def name(cls) -> str:
        return "adapter"

    def schema(self) -> str:
        return DOCUMENT

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options.get("urls", "[]")), type(self).fetch)


class _Reader(DataSourceReader):
    def __init__(self, urls: list[str], fetch):
        self.urls, self.fetch = urls, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(u) for u in self.urls]

    def read(self, partition: InputPartition):
        import hashlib

        for record in self.fetch(partition.value):
            title = next((str(record[t]) for t in TITLES if record.get(t)), None)
            yield hashlib.sha256(partition.value.encode()).hexdigest(), partition.value, title, json.dumps(record, sort_keys=True), 0.8


def register(spark: SparkSession, fetch: Callable[[str], Iterable[dict]], name: str = "adapter") -> None:
    """Makes a fetch function a readable format under ``name``."""
    spark.dataSource.register(type("Source_" + name, (AdapterSource,), {"fetch": staticmethod(fetch), "name": classmethod(lambda cls: name)}))


def first_hits(hits: DataFrame, key: str, order: Column) -> DataFrame:
    """Search results once per link, at their first place."""
    return hits.groupBy(key).agg(F.min(order).alias("place")).orderBy("place", key)
