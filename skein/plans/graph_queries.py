"""Queries over edges made of foreign keys and line items, and over vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import edges as E
from skein.operators import graph as G
from skein.operators import search as S
from skein.operators import vectors as V
from skein.plans.catalog import query
from skein.sources.tables import table

FK_SQL = """(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'part_of' AS kind FROM nation
UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'based_in' FROM supplier
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in' FROM customer)"""


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), ka).alias("src"), F.concat(F.lit(b), kb).alias("dst"), F.lit(kind).alias("kind"))

    parts = [of("nation", "n", "n_nationkey", "r", "n_regionkey", "part_of"), of("supplier", "s", "s_suppkey", "n", "s_nationkey", "based_in"), of("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in")]
    return reduce(DataFrame.unionByName, parts)


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_discount", "l_shipdate")


_CONF = "SELECT l_suppkey, l_partkey, count(*) AS occurrence_count, round(least(1.0, 1 - 0.5 * power(0.9, count(*) - 1)), 6) AS confidence FROM lineitem GROUP BY ALL"


@query(_CONF.replace("AS confidence", "AS confidence, count(DISTINCT l_orderkey) AS n_sources"))
def edge_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confidence(supply(spark, sf_dir), ["l_suppkey", "l_partkey"], source="l_orderkey")


@query(f"SELECT * FROM ({_CONF}) WHERE confidence >= 0.55 AND occurrence_count >= 2 ORDER BY confidence DESC, l_suppkey, l_partkey LIMIT 100")
def high_confidence_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.high_confidence(E.confidence(supply(spark, sf_dir), ["l_suppkey", "l_partkey"]), 0.55, 2, ["l_suppkey", "l_partkey"], 100)


@query(f"SELECT count(*) AS total, count(*) FILTER (occurrence_count > 1) AS repeated, count(*) FILTER (confidence >= 0.9) AS very_high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS high, count(*) FILTER (confidence >= 0.5 AND confidence < 0.7) AS medium, count(*) FILTER (confidence < 0.5) AS low FROM ({_CONF})")
def confidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.confidence_buckets(E.confidence(supply(spark, sf_dir), ["l_suppkey", "l_partkey"]))


@query("SELECT l_suppkey, l_partkey, l_orderkey, confidence FROM (SELECT l_suppkey, l_partkey, l_orderkey, l_discount * 10 AS confidence, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_discount * 10 DESC, l_shipdate DESC, l_orderkey * 10 + l_linenumber) AS r FROM lineitem) WHERE r = 1")
def dedup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supply(spark, sf_dir).withColumn("confidence", F.col("l_discount") * 10).withColumn("id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return E.dedup(rows, ["l_suppkey", "l_partkey"], "l_shipdate", "id").select("l_suppkey", "l_partkey", "l_orderkey", "confidence")


@query("""
WITH e AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber = 7 THEN l_partkey ELSE l_suppkey END AS src, l_partkey AS dst, CASE WHEN l_linenumber = 6 THEN 'high' WHEN l_linenumber = 5 THEN '1.7' ELSE '0.5' END AS confidence FROM lineitem),
k AS (SELECT p_partkey AS n FROM part WHERE p_partkey % 11 <> 0)
SELECT issue, count(*) AS n, round(sum(fixed), 6) AS fixed_sum FROM (
  SELECT CASE WHEN src = dst THEN 'circular' WHEN src NOT IN (SELECT n FROM k) OR dst NOT IN (SELECT n FROM k) THEN 'orphan' WHEN try_cast(confidence AS DOUBLE) IS NULL OR try_cast(confidence AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'confidence' ELSE 'ok' END AS issue,
    coalesce(greatest(0.0, least(1.0, try_cast(confidence AS DOUBLE))), 0.5) AS fixed FROM (SELECT id, src, dst, confidence, try_cast(confidence AS DOUBLE) AS c FROM e)) GROUP BY issue
""".replace("coalesce(greatest(0.0, least(1.0, try_cast(confidence AS DOUBLE))), 0.5)", "CASE WHEN try_cast(confidence AS DOUBLE) IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, try_cast(confidence AS DOUBLE))) END"))
def validate_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    rows = supply(spark, sf_dir).select(F.when(n == 7, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst"), F.when(n == 6, "high").when(n == 5, "1.7").otherwise("0.5").alias("confidence"))
    nodes = table(spark, sf_dir, "part").filter("p_partkey % 11 <> 0")
    return E.validate(rows, nodes, "src", "dst", "p_partkey").groupBy("issue").agg(F.count("*").alias("n"), F.round(F.sum("fixed"), 6).alias("fixed_sum"))


@query(f"SELECT kind AS relation_type, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM {FK_SQL} GROUP BY 1")
def edges_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.by_type(fk_edges(spark, sf_dir).withColumnsRenamed({"src": "source_id", "dst": "target_id", "kind": "relation_type"}))


@query(f"SELECT src AS source_id, CASE WHEN kind = 'part_of' THEN 'nation' ELSE CASE substr(src, 1, 1) WHEN 's' THEN 'supplier' WHEN 'n' THEN 'nation' END END AS source_type, CASE substr(dst, 1, 1) WHEN 'n' THEN 'nation' END AS target_type, count(*) AS n FROM {FK_SQL} GROUP BY ALL")
def backfill_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("nation").alias("entry_type")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.lit("supplier").alias("entry_type")))
    rows = fk_edges(spark, sf_dir).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.when(F.col("kind") == "part_of", "nation").alias("source_type"), F.lit(None).cast("string").alias("target_type"))
    return E.backfill_types(rows, entries).groupBy("source_id", "source_type", "target_type").agg(F.count("*").alias("n"))


@query(f"SELECT node, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, sum(t)::BIGINT AS degree FROM (SELECT src AS node, 1 AS o, 0 AS i, 1 AS t FROM {FK_SQL} UNION ALL SELECT dst, 0, 1, (src <> dst)::INT FROM {FK_SQL}) GROUP BY node")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.degree(fk_edges(spark, sf_dir), "src", "dst")


@query("SELECT p_partkey, 0::BIGINT AS out_degree, count(l_suppkey) AS in_degree FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey ORDER BY p_partkey LIMIT 50")
def dead_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supply(spark, sf_dir).select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("p"))
    return E.dead_ends(table(spark, sf_dir, "part"), e, "p_partkey", "src", "p", 50)


def _bfs_sql(depth: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {FK_SQL} UNION SELECT dst, src FROM {FK_SQL}),
w(node, depth) AS (SELECT 'c1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < {depth})
SELECT node, min(depth) AS depth FROM w GROUP BY node"""


def _seed(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("c1").alias("node"))


@query(_bfs_sql(3))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs(fk_edges(spark, sf_dir), _seed(spark), "src", "dst", 3)


@query(f"""
WITH e AS (SELECT src AS a, dst AS b FROM {FK_SQL} UNION SELECT dst, src FROM {FK_SQL}),
d1 AS (SELECT b AS node, count(*) AS connections FROM e WHERE a = 'c1' GROUP BY b ORDER BY connections DESC, node LIMIT 3),
d2 AS (SELECT b AS node, count(*) AS connections FROM e JOIN d1 ON a = d1.node WHERE b <> 'c1' AND b NOT IN (SELECT node FROM d1) GROUP BY b ORDER BY connections DESC, node LIMIT 3)
SELECT 'c1' AS node, 0 AS depth, 0 AS connections UNION ALL SELECT node, 1, connections FROM d1 UNION ALL SELECT node, 2, connections FROM d2
""")
def bfs_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs_top(fk_edges(spark, sf_dir), _seed(spark), "src", "dst", 2, 3)


@query(f"""WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM {FK_SQL} UNION SELECT dst, src FROM {FK_SQL}),
w(node, depth) AS (SELECT 'c1', 0 UNION SELECT e.b, w.depth + 1 FROM w JOIN e ON e.a = w.node WHERE w.depth < 5)
SELECT min(depth) + 1 AS n_nodes, 'c1' AS first_node, 's3' AS last_node FROM w WHERE node = 's3'""")
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = G.shortest_path(fk_edges(spark, sf_dir), "c1", "s3", "src", "dst")
    return spark.createDataFrame([(len(path) or None, "c1", "s3")], "n_nodes int, first_node string, last_node string")


_PART_EDGES = "(SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supply(spark, sf_dir).select(F.concat(F.lit("o"), "l_orderkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT src AS a, dst AS b FROM {0} UNION SELECT DISTINCT dst, src FROM {0}),
w(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, w.label FROM w JOIN e ON e.a = w.node)
SELECT node, min(label) AS component FROM w GROUP BY node""".format("(SELECT 'a' || o_orderkey AS src, 'a' || (o_orderkey - o_orderkey % 27 + o_orderkey % 27 // 3) AS dst FROM orders)"))
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    up = F.expr("o_orderkey - o_orderkey % 27 + (o_orderkey % 27) div 3")  # trees of up to 27 orders
    return G.connected_components(table(spark, sf_dir, "orders").select(F.concat(F.lit("a"), "o_orderkey").alias("src"), F.concat(F.lit("a"), up).alias("dst")))


_SHARED = "SELECT x.src AS a, y.src AS b, count(*) AS shared FROM (SELECT DISTINCT src, dst FROM {0}) x JOIN (SELECT DISTINCT src, dst FROM {0}) y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL".format(_PART_EDGES)


@query(f"SELECT * FROM ({_SHARED}) WHERE shared >= 2")
def shared_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_neighbours(part_edges(spark, sf_dir), "src", "dst", 2)


@query(f"""WITH e AS (SELECT src AS a, dst AS b FROM {_PART_EDGES} UNION SELECT dst, src FROM {_PART_EDGES}),
p AS (SELECT x.a AS a, y.a AS b, count(*) AS shared FROM e x JOIN e y ON x.b = y.b AND x.a < y.a GROUP BY ALL)
SELECT a, b, shared, round(least(0.95, 0.3 + 0.15 * shared), 6) AS confidence FROM p WHERE (a, b) NOT IN (SELECT (a, b) FROM e) ORDER BY shared DESC, a, b LIMIT 50""")
def link_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.predict_links(part_edges(spark, sf_dir), "src", "dst", 50)


@query(f"""WITH b AS ({_bfs_sql(3)}), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {FK_SQL} UNION ALL SELECT dst FROM {FK_SQL}) GROUP BY node)
SELECT node, depth, degree, round(0.7::DOUBLE * depth / 3 + 0.3::DOUBLE * least(degree / 10, 1.0), 3) AS priority FROM b JOIN d USING (node) WHERE depth > 0 ORDER BY priority DESC, node LIMIT 30""")
def explore_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.explore(fk_edges(spark, sf_dir), _seed(spark), "src", "dst", 3, 30)


@query(f"WITH b AS ({_bfs_sql(2)}) SELECT src, dst, kind FROM {FK_SQL} WHERE src IN (SELECT node FROM b) AND dst IN (SELECT node FROM b)")
def ego_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ego(fk_edges(spark, sf_dir), _seed(spark), "src", "dst", 2)


@query("SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS weight FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) x JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL HAVING count(*) >= 2")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.cooccurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").filter("weight >= 2")


_FIELDS = "(SELECT 'n' || n_nationkey AS id, 'location' AS field, n_name AS value FROM nation UNION ALL SELECT 'c' || c_custkey, 'location', c_mktsegment FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 'r' || r_regionkey, 'country', r_name FROM region)"


@query(f"SELECT e.src AS source_id, r.field, min(f.value) AS value, min(e.dst) AS from_id FROM {FK_SQL} e JOIN (SELECT * FROM (VALUES ('lives_in', 'location'), ('based_in', 'location'), ('part_of', 'country')) v(kind, field)) r ON r.kind = e.kind JOIN {_FIELDS} f ON f.id = e.dst AND f.field = r.field WHERE NOT EXISTS (SELECT 1 FROM {_FIELDS} g WHERE g.id = e.src AND g.field = r.field) GROUP BY ALL")
def infer_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("location").alias("field"), F.col("n_name").alias("value"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 4 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("location").alias("field"), F.col("c_mktsegment").alias("value"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("country").alias("field"), F.col("r_name").alias("value"))
    e = fk_edges(spark, sf_dir).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.col("kind").alias("relation_type"), F.col("dst").alias("edge_id"))
    return E.propagate(n.unionByName(c).unionByName(r), e, [("lives_in", "location"), ("based_in", "location"), ("part_of", "country")])


# ---------------------------------------------------------------- vectors
def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return points(spark, sf_dir).filter("vec_id = 0").first()["embedding"]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(points(spark, sf_dir), _query_vector(spark, sf_dir), "embedding", "vec_id", 20).select("vec_id", "label", "score")


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(points(spark, sf_dir), _query_vector(spark, sf_dir), "embedding", "vec_id", 20, F.col("label").isin(1, 2, 3)).select("vec_id", "label", "score")


@query(f"SELECT query_id, vec_id, score, place FROM (SELECT q.vec_id AS query_id, e.vec_id, round({_COS}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 6) DESC, e.vec_id) AS place FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0) WHERE place <= 5")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return V.top_k_each(p, p.filter("vec_id % 50 = 0"), "embedding", "vec_id", 5).withColumn("place", F.col("place").cast("long"))


@query("SELECT e.vec_id AS a, q.vec_id AS b, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e JOIN embeddings q ON e.label = q.label AND e.vec_id < q.vec_id WHERE round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) >= 0.3")
def semantic_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.similar_pairs(points(spark, sf_dir), "vec_id", "embedding", F.col("label"), 0.3)


@query(f"WITH v AS (SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 30), k AS (SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE text ILIKE '%the%' ORDER BY n_chars DESC, doc_id LIMIT 200) SELECT id, round(sum(p), 6) AS score FROM (SELECT id, score * 1.2 AS p FROM v UNION ALL SELECT id, score * 0.5 FROM k) GROUP BY id")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = V.top_k(points(spark, sf_dir), _query_vector(spark, sf_dir), "embedding", "vec_id", 30).select(F.col("vec_id").alias("id"), "score")
    k = S.keyword_search(table(spark, sf_dir, "documents"), "the", "text", ["doc_id", "n_chars"], "n_chars", "doc_id", 200).select(F.col("doc_id").alias("id"), F.lit(1.0).alias("score"))
    return S.fuse(v, k, "id")


@query("SELECT source AS url, doc_id, n_chars AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def best_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), "doc_id", F.col("n_chars").alias("score"))
    return S.best_per_key(hits, "url", [F.desc("score"), F.asc("doc_id")])


@query(f"WITH s AS (SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10) SELECT count(*) AS hits, count(*) FILTER (score >= 0.7) AS good, CASE WHEN count(*) FILTER (score >= 0.7) >= 2 THEN 'answer' WHEN count(*) > 0 THEN 'paraphrase' ELSE 'crawl' END AS phase FROM s")
def phase_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.quality_decision(V.top_k(points(spark, sf_dir), _query_vector(spark, sf_dir), "embedding", "vec_id", 10))


@query(f"WITH x AS (SELECT c_custkey AS id, 1.0::DOUBLE AS score, 0 AS rank FROM customer WHERE contains(lower(c_name), '00001')), s AS (SELECT e.vec_id AS id, round({_COS}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 100) SELECT id, score FROM (SELECT * FROM x UNION ALL SELECT id, score, 1 FROM s WHERE score >= 0.2 AND id NOT IN (SELECT id FROM x)) ORDER BY rank, score DESC, id LIMIT 30")
def hybrid_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = V.top_k(points(spark, sf_dir), _query_vector(spark, sf_dir), "embedding", "vec_id", 100).select(F.col("vec_id").alias("id"), "score")
    return S.hybrid_entities(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "00001", near, "id", "c_name", 30, 0.2)


@query("WITH a AS (SELECT source AS url, doc_id AS id, n_chars / 1000.0 AS score, 'keyword' AS source, 0 AS p FROM documents), b AS (SELECT url, page_id AS id, length(html) / 2000.0 AS score, 'page' AS source, 1 AS p FROM pages) SELECT url, id, round(score, 6) AS score, source FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY score DESC, p, id) AS r FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) WHERE r = 1 ORDER BY score DESC, p, url LIMIT 40")
def rag_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select(F.col("source").alias("url"), F.col("doc_id").alias("id"), (F.col("n_chars") / 1000.0).alias("score"))
    b = table(spark, sf_dir, "pages").select("url", F.col("page_id").alias("id"), (F.length("html") / 2000.0).alias("score"))
    best = [x.groupBy("url").agg(F.max_by(F.struct("id", "score"), F.struct("score", -F.col("id"))).alias("x")).select("url", "x.*") for x in (a, b)]
    return S.gather([("keyword", best[0]), ("page", best[1])], 40).withColumn("score", F.round("score", 6))
