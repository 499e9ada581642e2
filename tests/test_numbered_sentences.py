"""Sentences that begin or end with the digits of their own place, against SQL in another engine."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import text
from skein.plans import catalog

catalog.load()
LONG = "  " + " ".join(f"{i}.{i} mark {i}!" if i % 2 else f"{i} item of {i}." for i in range(30)) + " 30"
TEXTS = {0: LONG, 1: LONG, 2: LONG, 3: "One. Two. Three. 3abcdefgh3", 4: "", 50: LONG + "1.", 51: "0"}
NAMES = ["split_sentences", "content_processors", "sentence_windows", "snippet_embedding_plan", "snippet_expansion", "snippet_neighbours", "snippets_prev_next"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("numbered"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return at


def test_sentences_keep_their_digits(spark):
    got = spark.range(1).select(text.sentences(F.lit("  0 a. 1 b 1! 2.2? 3")).alias("s")).first()["s"]
    assert got == ["0 a.", "1 b 1!", "2.2?", "3"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in catalog.QUERIES[name](spark, folder).select(*columns).collect()) == sorted(want.fetchall())
