"""Queries over documents and vectors: keyword and hybrid search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.operators.search import keyword_search as search
from skein.plans.catalog import query
from skein.sources.tables import table


@query("""
SELECT doc_id, source, n_chars, substr(text, greatest(1, instr(lower(text), 'the') - 60), 200) AS snippet
FROM documents WHERE text ILIKE '%the%' ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 50
""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), "the", "text", ["doc_id", "source", "n_chars"], "n_chars", "doc_id", 50)
