"""Vectors: cosine, top-k, near pairs, and a deterministic embedder for tests."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import is_uuid, uuid5
from pyspark.sql.functions import pandas_udf

from skein.functions.text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(F.transform(col(a), lambda x: x.cast("double")), F.transform(col(b), lambda x: x.cast("double")), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; 0 where either is empty or has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(col(a)) > 0) & (F.size(col(b)) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def top_k(points: DataFrame, query: list[float], vector: str, key: str, k: int, keep: Column | None = None, digits: int = 6) -> DataFrame:
    """The ``k`` points nearest to one query vector: a scan with a bounded heap per task."""
    rows = points if keep is None else points.filter(keep)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.withColumn("score", F.round(cosine(vector, q), digits)).orderBy(F.desc("score"), key).limit(k)


def top_k_each(points: DataFrame, queries: DataFrame, vector: str, key: str, k: int, digits: int = 6, batch: int = 256, chunk: int = 16_384) -> DataFrame:
    """The ``k`` nearest points of every query row, ties to the smaller key.

    Both sides are dealt by a hash, queries to blocks of about ``batch`` and points to
    chunks of about ``chunk``; each block meets each chunk in one matrix product, which
    leaves ``k`` rows a query. No side is ever held whole, by a task or the driver.
    """
    counts = points.agg(F.count("*")).first()[0], queries.agg(F.count("*")).first()[0]
    chunks, blocks = (max(1, -(-n // size)) for n, size in zip(counts, (chunk, batch)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    p = points.select(F.col(key).alias("id"), F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("c"), every(blocks).alias("b"))
    q = queries.select(F.col(key).alias("id"), F.col(vector).alias("v"), every(chunks).alias("c"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))

    def unit(column: pd.Series) -> np.ndarray:
        m = np.asarray(column.tolist(), dtype=np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values("id")
            ids = left["id"].to_numpy()
            scores = np.round(unit(right["v"]) @ unit(left["v"]).T, digits)
            for query, row in zip(right["id"], scores):
                best = np.argsort(-row, kind="stable")[:k]  # equal scores stay in the order of ids
                out.append(pd.DataFrame({"query_id": query, key: ids[best], "score": row[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], key: [], "score": []})

    found = p.groupBy("c", "b").cogroup(q.groupBy("c", "b")).applyInPandas(meet, f"query_id long, {key} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def similar_pairs(points: DataFrame, key: str, vector: str, block: Column, least: float, digits: int = 6, chunk: int = 2048) -> DataFrame:
    """Pairs of a block whose cosine is ``least`` or more.

    A block's rows are dealt to chunks, and each two chunks meet in one matrix product:
    a large block is many tasks of bounded memory, and only pairs alike leave them.
    """
    rows = points.select(F.col(key).alias("id"), F.col(vector).alias("v"), block.alias("g")).filter(norm(vector) > 0)
    sizes = rows.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("n"))
    dealt = rows.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    squares = dealt.select("id", "v", "g", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    kind = dict(rows.dtypes)["id"]

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        m = np.asarray(group["v"].tolist(), dtype=np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        ids, own = group["id"].to_numpy(), group["own"].to_numpy()
        first = np.flatnonzero(own == group["lo"].iloc[0])
        second = np.flatnonzero(own == group["hi"].iloc[0])
        scores = np.round(m[first] @ m[second].T, digits)
        i, j = np.nonzero(scores >= least)
        a, b = ids[first[i]], ids[second[j]]
        keep = a < b if group["lo"].iloc[0] == group["hi"].iloc[0] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": scores[i, j][keep]})

    return squares.groupBy("g", "lo", "hi").applyInPandas(meet, f"a {kind}, b {kind}, similarity double")


def upsert_points(stored: DataFrame, incoming: DataFrame, order: str) -> DataFrame:
    """Points (id, vector, payload) after an upsert: ids that are no UUID become one by name; of a batch's equal ids the last by ``order`` stays."""
    named = lambda rows: rows.withColumn("id", F.when(is_uuid("id"), F.lower("id")).otherwise(uuid5("id", "6ba7b8119dad11d180b400c04fd430c8")))
    both = named(stored).select("id", "vector", "payload", F.lit(0).alias("new"), F.lit(0).cast("long").alias("at")).unionByName(named(incoming).select("id", "vector", "payload", F.lit(1).alias("new"), F.col(order).cast("long").alias("at")))
    return both.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), F.struct("new", "at")).alias("p")).select("id", "p.*")


def hashing_embedder(dimensions: int = 64):
    """Deterministic stand-in for a sentence encoder: signed hashed words, length 1; short texts give []."""

    @pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        def one(text: str) -> list[float]:
            if text is None or len(text) < 10:
                return []
            v = np.zeros(dimensions)
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dimensions] += 1 if h >> 31 else -1
            size = np.linalg.norm(v)
            return (v / size if size else v).tolist()

        return s.map(one)

    return embed
