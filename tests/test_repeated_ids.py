"""Snippets of rows that share a doc_id or have none, against SQL in another engine."""

import duckdb

from skein.plans import catalog

catalog.load()
LONG = " ".join(f"Sentence {i} says {i * i}." for i in range(20))
ROWS = [(1, LONG), (2, "Alone. " * 9), (1, LONG), (1, "Zero. One! Two? Three. Four."), (None, "B one. B two."), (3, None), (1, ""), (None, "A one. A two. A three. A four."), (3, "Last.")]


def test_snippet_expansion_same_rows_as_sql(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL["snippet_expansion"])
    columns = [d[0] for d in want.description]
    got = catalog.QUERIES["snippet_expansion"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
