"""Sentences beside odd white space, Unicode blanks and the mark that SQL parts texts at, against SQL in another engine."""

import duckdb
import pytest

from skein.plans import catalog

catalog.load()
ODD = ["One.\x0bTwo. \x0b", " One. Two. 　Three?  Four", "One.\x01 Two\x01three. \x01", "a.   .  b", "Tab.\tFeed.\fLine.\n \n", "12345678. ", "\x01", "　"]
TEXTS = {50 * i: (x + " Mark. ") * n for i, (x, n) in enumerate((x, n) for x in ODD for n in (1, 9))} | {1: "12345678. ", 2: "1234 \x0b", 3: "1234.\x01123456", 4: None}
NAMES = ["sentence_windows", "snippet_embedding_plan", "snippet_expansion", "snippet_neighbours"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, tmp_path, name):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, str(tmp_path)).select(*columns).collect()) == sorted(want.fetchall())
