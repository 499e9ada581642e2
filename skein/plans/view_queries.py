"""Queries for views of the graph, page contents, listings, sinks' inputs and composed agent steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import content as CT
from skein.functions import selectors as SL
from skein.operators import assembly as AS
from skein.operators import edges as E
from skein.operators import gaps as GP
from skein.operators import graph as G
from skein.operators import inference as I
from skein.operators import intel as N
from skein.operators import learn as L
from skein.operators import planning as P
from skein.operators import resolve as R
from skein.plans.catalog import query
from skein.plans.graph_queries import FK_SQL, _bfs_sql, fk_edges
from skein.sources.tables import table


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fk_edges(spark, sf_dir).withColumnsRenamed({"src": "source_id", "dst": "target_id", "kind": "relation_type"})


_S = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"


@query(f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN n > 10 THEN array_to_string(s[n // 10 + 1:n - n // 10], ' ') ELSE text END WHEN 1 THEN CASE WHEN n > 20 THEN array_to_string(s[1:20], ' ') ELSE text END WHEN 2 THEN CASE WHEN n > 5 THEN array_to_string(s[1:5], ' ') ELSE text END ELSE text END AS main_content FROM (SELECT doc_id, text, s, len(s) AS n FROM (SELECT doc_id, text, {_S} AS s FROM documents))")
def content_processors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 4
    kind = F.when(k == 0, "article").when(k == 1, "listing").when(k == 2, "forum").otherwise("generic")
    return t(spark, sf_dir, "documents").select("doc_id", CT.main_content("text", kind).alias("main_content"))


@query("SELECT doc_id, i AS pos, substr(text, i * 3000 + 1, 4000) AS part FROM (SELECT doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 4000) / 3000)::BIGINT + 1))) AS i FROM documents WHERE length(text) > 0)")
def hierarchical_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(CT.hierarchical_windows("text")).alias("pos", "part"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query()
def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", F.explode(SL.fingerprints("html")).alias("f")).select("page_id", "f.*")


@query("SELECT c_custkey AS id, round(((c_mktsegment <> '')::INT + (c_custkey % 2 = 0)::INT) / 9, 6) AS completeness FROM customer")
def category_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.create_map(F.lit("industry"), F.col("c_mktsegment"), F.lit("Website"), F.when(F.col("c_custkey") % 2 == 0, "w").otherwise(""))
    return GP.category_completeness(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), data.alias("data")), "id", "data").select("id", "completeness")


_DEDUP = """WITH e AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' co.' WHEN 1 THEN ' company' ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'entity' ELSE 'product' END AS kind, p_size % 3 AS rich FROM part),
g AS (SELECT *, kind AS k, CASE WHEN p = '' THEN b ELSE b || ' company' END AS g FROM (SELECT *, CASE WHEN name LIKE '% co.' THEN left(name, length(name) - 4) WHEN name LIKE '% company' THEN left(name, length(name) - 8) ELSE name END AS b, CASE WHEN name LIKE '% co.' OR name LIKE '% company' THEN 'c' ELSE '' END AS p FROM e))"""


@query(_DEDUP + """, c AS (SELECT *, first_value(id) OVER (PARTITION BY g, k ORDER BY rich DESC, length(name) DESC, id) AS canonical_id FROM g)
SELECT canonical_id, id AS duplicate_id FROM c WHERE id <> canonical_id""".replace("name LIKE '% company' THEN left(name, length(name) - 8)", "name LIKE '% company' THEN left(name, length(name) - 8)"))
def dedup_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dedup_scan(_dedup_entities(spark, sf_dir), "id", "name", "kind", "at", F.col("rich")).select("canonical_id", "duplicate_id")


def _dedup_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    name = F.concat("p_name", F.when(k == 0, " co.").when(k == 1, " company").otherwise(""))
    kind = F.when(F.col("p_partkey") % 5 == 0, "entity").otherwise("product")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), kind.alias("kind"), F.col("p_partkey").alias("at"), (F.col("p_size") % 3).alias("rich"))


@query("WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' set' END AS q FROM part) SELECT q, p_partkey, CASE WHEN p_name = q THEN 1.0 ELSE 0.85 END::DOUBLE AS similarity FROM q JOIN part ON contains(q, p_name) OR contains(p_name, q)")
def containing_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    asked = p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" set"))).alias("q")).distinct()
    return R.containing_names(asked, p, "q", "p_partkey", "p_name").select("q", "p_partkey", "similarity")


@query("WITH s AS (SELECT user_id, avg((event_type <> 'error')::INT) AS reliability FROM events GROUP BY 1), p AS (SELECT event_type, user_id % 20 AS b, avg((value > 30)::INT) * least(1.0, count(*) / 10) AS c FROM events GROUP BY ALL) SELECT (SELECT count(*) FROM s) AS domains, (SELECT count(*) FROM s WHERE reliability > 0.7) AS reliable, (SELECT count(*) FROM p) AS patterns, (SELECT count(*) FROM p WHERE round(c, 6) > 0.7) AS trusted")
def learning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    stats = e.groupBy("user_id").agg(F.avg((F.col("event_type") != "error").cast("double")).alias("reliability"))
    return L.summary(stats, L.pattern_confidence(e.withColumn("b", F.col("user_id") % 20), ["event_type", "b"], F.col("value") > 30))


@query("SELECT least(l_suppkey, l_partkey) AS a, greatest(l_suppkey, l_partkey) AS b, count(*) AS weight, arg_max(l_returnflag, l_orderkey * 10 + l_linenumber) AS kind FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def undirected_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem").withColumn("kind", F.col("l_returnflag")).withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return E.undirected(rows, "l_suppkey", "l_partkey", F.lit(1)).filter("weight > 1").withColumn("weight", F.col("weight").cast("long"))


@query(f"SELECT src AS source_id, dst AS target_id, kind AS relation_type FROM {FK_SQL} WHERE kind <> 'lives_in' AND src NOT LIKE '%3'")
def relationship_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir).withColumn("confidence", F.when(F.col("relation_type") == "lives_in", 0.2))
    ids = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct()
    keep = ids.filter("id NOT LIKE '%3' OR id LIKE 'n%' OR id LIKE 'r%'")
    return AS.export(keep, e, 0.5).filter("source_id NOT LIKE '%3'").select("source_id", "target_id", "relation_type")


@query(f"WITH b AS ({_bfs_sql(3)}) SELECT depth, count(*) AS nodes FROM b GROUP BY depth")
def depth_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.depth_counts(G.bfs(fk_edges(spark, sf_dir), spark.range(1).select(F.lit("c1").alias("node")), "src", "dst", 3))


@query(f"WITH b AS ({_bfs_sql(2)}), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM {FK_SQL} UNION ALL SELECT dst FROM {FK_SQL}) GROUP BY node) SELECT id, depth, degree, findings FROM (SELECT b.node AS id, depth, degree, CASE WHEN b.node LIKE 'n%' THEN 2 ELSE 0 END AS findings FROM b JOIN d USING (node))")
def entity_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir)
    ids = e.select(F.col("source_id").alias("id")).unionByName(e.select(F.col("target_id").alias("id"))).distinct()
    n = ids.filter("id LIKE 'n%'").select(F.col("id").alias("entity_id"))
    return AS.entity_view(ids, e, n.unionByName(n), "c1").select("id", "depth", "degree", "findings")


@query("SELECT 'customer' AS entry_type, 7::BIGINT AS id UNION ALL SELECT 'part', 7 UNION ALL SELECT 'supplier', 7")
def node_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "part": t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), "supplier": t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))}
    return AS.lookup(tables, 7).select("entry_type", "id")


@query("SELECT c_custkey AS id FROM customer WHERE contains(lower(c_name), '0001') OR contains(lower(c_custkey::VARCHAR), '0001')")
def graph_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("label"))
    return AS.seeds_for(nodes, "0001").select(F.col("id").cast("long").alias("id"))


@query("SELECT c_custkey AS id, 'organization' AS field, n_name AS value, 0.8::DOUBLE AS confidence FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 2 = 0")
def missing_field_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("x"), F.lit("y"))).otherwise(F.create_map(F.lit("organization"), F.lit("o"))).alias("data"))
    n = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.create_map(F.lit("x"), F.lit("y")).alias("data"))
    e = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.lit("works_at").alias("relation_type"))
    return I.missing_fields(c.unionByName(n), e).select(F.substring("id", 2, 20).cast("long").alias("id"), "field", "value", "confidence")


@query("SELECT c_custkey, 'name: \"' || c_name || '\" | segment: \"' || c_mktsegment || '\"' AS finding FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'name: \"' || c_name || '\"' FROM customer WHERE c_custkey % 2 = 1")
def format_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = F.concat_ws(" | ", F.concat(F.lit("name: "), quoted(F.col("c_name"))), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("segment: "), quoted(F.col("c_mktsegment")))))
    return t(spark, sf_dir, "customer").select("c_custkey", parts.alias("finding"))


@query("SELECT user_id, list_sort(list_distinct(list(event_type))) AS kinds FROM events GROUP BY user_id")
def merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    halves = [e.filter(f"event_id % 2 = {i}").groupBy("user_id").agg(F.collect_set("event_type").alias(f"l{i}")) for i in (0, 1)]
    return halves[0].join(halves[1], "user_id", "full").select("user_id", F.sort_array(N.merge_lists("l0", "l1")).alias("kinds"))


@query("SELECT c_custkey AS id, c_custkey % 3 < 2 AS year_ok, true AS name_ok FROM customer")
def consistency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("id"), F.lit("1990").alias("founded"), F.col("c_name").alias("name"))
    b = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 < 2, "in 1991").otherwise("2001").alias("founded"), F.concat("c_name", F.lit(" Inc.")).alias("name"))
    return N.consistent(a, b, "id")


@query("SELECT n AS before, n - d AS after, d AS merged FROM (SELECT count(*) AS n, count(*) - count(DISTINCT p_name) AS d FROM part)")
def reflect_and_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").withColumn("rank", F.lit(1))
    e = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("supplies").alias("relation_type"))
    return P.reflect(p, e, "p_partkey", F.col("p_name"), F.col("rank"), F.col("p_size"))[2].select("before", "after", "merged")


@query("SELECT c_name, min(o) AS from_list FROM (SELECT c_name, 0 AS o FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_name, 1 FROM customer WHERE c_custkey % 9 = 0) GROUP BY c_name")
def autonomous_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    dead = c.join(t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return P.discover(dead, c.filter("c_custkey % 9 = 0"), "c_name")


@query("SELECT c_custkey AS id, round((c_custkey % 50) / 2.0, 2) AS gain, CASE WHEN c_custkey % 2 = 0 THEN ['x'] ELSE [] END AS filled FROM customer")
def completeness_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    before = c.select(F.col("c_custkey").alias("id"), F.lit(10.0).alias("completeness"), F.array(F.lit("x"), F.lit("y")).alias("gaps"))
    after = c.select(F.col("c_custkey").alias("id"), (10.0 + (F.col("c_custkey") % 50) / 2.0).alias("completeness"), F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("y"))).otherwise(F.array(F.lit("x"), F.lit("y"))).alias("gaps"))
    return P.completeness_delta(before, after, "id")


@query("SELECT event_type AS kind, CASE event_type WHEN 'person' THEN 'person' ELSE 'company' END AS strategy, count(*) AS n FROM events GROUP BY ALL")
def extraction_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return g.select("kind", P.extraction_strategy(F.col("kind")).alias("strategy"), "n")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT text FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE conv_id % 3 = 0))")
def uncached_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    cache = c.filter("conv_id % 3 = 0").select(F.sha2("text", 256).alias("prompt_hash"), F.lit("2024-05-30 00:00:00").cast("timestamp").alias("created_at"))
    return P.uncached(c, cache, "text", now).agg(F.count("*").alias("n"))


@query("SELECT event_id, try_cast(trim(v) AS DOUBLE) AS as_float, CASE WHEN event_id % 3 = 1 THEN trunc(try_cast(trim(v) AS DOUBLE))::BIGINT WHEN event_id % 3 = 0 THEN event_id END AS as_int FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || event_id || ' ' WHEN 1 THEN event_id || '.75' ELSE event_type END AS v FROM events)")
def safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.functions.text import safe_float, safe_int

    k = F.col("event_id") % 3
    v = F.when(k == 0, F.concat(F.lit(" "), "event_id", F.lit(" "))).when(k == 1, F.concat("event_id", F.lit(".75"))).otherwise(F.col("event_type"))
    return t(spark, sf_dir, "events").select("event_id", safe_float(v).alias("as_float"), safe_int(v).alias("as_int"))


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'auto') OR contains(lower(c_name), 'auto')")
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.functions.text import any_key_contains

    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name"))
    return t(spark, sf_dir, "customer").filter(any_key_contains(m, "AUTO")).select("c_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence FROM orders")
def set_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = t(spark, sf_dir, "orders").select("o_orderkey", F.lit(0.5).alias("confidence"))
    wanted = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, 0.9).otherwise(1.5).alias("confidence")).filter("o_orderkey % 3 < 2")
    return E.set_confidence(o, wanted, "o_orderkey")


@query(f"SELECT src AS source_id, dst AS target_id FROM {FK_SQL} WHERE src = 'n3' OR dst = 'n3'")
def edges_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = links(spark, sf_dir).withColumn("id", F.concat_ws("|", "source_id", "target_id"))
    return E.edges_of(e, "n3", "source_id", "target_id", "id").select("source_id", "target_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE 'old' END AS a, 'kept' AS b FROM customer")
def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("kept"))
    new = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return t(spark, sf_dir, "customer").select("c_custkey", E.merge_metadata(old, new).alias("m")).select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT 'nodes' AS part, count(*) AS n FROM customer WHERE c_custkey % 10 > 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey % 10 > 0")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    out = E.delete_nodes(c, c.filter("c_custkey % 10 = 0"), "c_custkey", {"orders": (t(spark, sf_dir, "orders"), ["o_custkey"])})
    return out["nodes"].agg(F.lit("nodes").alias("part"), F.count("*").alias("n")).unionByName(out["orders"].agg(F.lit("orders").alias("part"), F.count("*").alias("n")))


@query("SELECT media_id, media_type, state, total FROM (SELECT event_id AS media_id, event_type AS media_type, CASE WHEN value > 90 THEN 'error' WHEN value > 40 THEN 'processed' ELSE 'pending' END AS state, count(*) OVER () AS total, ts FROM events WHERE event_type = 'view' AND value > 40 AND value <= 90) ORDER BY ts DESC, media_id LIMIT 25 OFFSET 5")
def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").filter("event_type = 'view'")
    state = F.when(F.col("value") > 90, "error").when(F.col("value") > 40, "processed").otherwise("pending")
    rows = e.select(F.col("event_id").alias("media_id"), F.col("event_type").alias("media_type"), state.alias("state"), "ts").filter("state = 'processed'")
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("ts"), "media_id").offset(5).limit(25).crossJoin(F.broadcast(total)).select("media_id", "media_type", "state", "total")  # the total is one row


@query("SELECT conv_id AS plan_id, role AS key, text AS value FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r = 1")
def planner_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "conversations")
    return c.groupBy(F.col("conv_id").alias("plan_id"), F.col("role").alias("key")).agg(F.max_by("text", "turn").alias("value"))


@query("SELECT raw, hint, CASE raw WHEN '' THEN 'entity' WHEN 'hq' THEN 'headquarters' ELSE raw END AS kind, CASE raw WHEN '' THEN NULL WHEN 'hq' THEN 'location' WHEN 'ceo' THEN 'person' WHEN 'city hall' THEN coalesce(hint, 'location') WHEN 'saas tool' THEN coalesce(hint, 'product') END AS parent, count(*) AS n FROM (SELECT CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'hq' WHEN 2 THEN 'ceo' WHEN 3 THEN 'city hall' ELSE 'saas tool' END AS raw, CASE WHEN c_custkey % 2 = 0 THEN 'thing' END AS hint FROM customer) GROUP BY ALL")
def resolved_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.functions.kinds import resolved_kind

    k = F.col("c_custkey") % 5
    raw = F.when(k == 0, "").when(k == 1, "hq").when(k == 2, "ceo").when(k == 3, "city hall").otherwise("saas tool")
    g = t(spark, sf_dir, "customer").groupBy(raw.alias("raw"), F.when(F.col("c_custkey") % 2 == 0, "thing").alias("hint")).agg(F.count("*").alias("n"))
    kind, parent = resolved_kind(F.col("raw"), F.col("hint"))
    return g.select("raw", "hint", kind.alias("kind"), parent.alias("parent"), "n")


@query("SELECT a, b, CASE WHEN a = 'company' AND b = 'person' THEN 'has-person' WHEN a = 'company' AND b = 'product' THEN 'has-product' WHEN a = 'person' AND b = 'company' THEN 'works-at' WHEN a = 'product' AND b = 'company' THEN 'produced-by' WHEN a = 'product' AND b = 'person' THEN 'associated-with-person' ELSE 'related-entity' END AS relation, count(*) AS n FROM (SELECT CASE p_size % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'product' END AS a, CASE p_partkey % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'person' ELSE 'product' END AS b FROM part) GROUP BY ALL")
def page_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda c: F.when(c % 3 == 0, "company").when(c % 3 == 1, "person").otherwise("product")
    g = t(spark, sf_dir, "part").groupBy(kind(F.col("p_size")).alias("a"), kind(F.col("p_partkey")).alias("b")).agg(F.count("*").alias("n"))
    return g.select("a", "b", E.page_relation(F.col("a"), F.col("b")).alias("relation"), "n")


@query("WITH v AS (SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, 'semantic' AS kind FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, e.vec_id LIMIT 15), s AS (SELECT event_id AS id, 0.0::DOUBLE AS score, 'sql' AS kind FROM events WHERE props ILIKE '%77%' ORDER BY event_id LIMIT 15) SELECT * FROM v UNION ALL SELECT * FROM s")
def semantic_and_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.vectors import top_k

    p = t(spark, sf_dir, "embeddings")
    near = top_k(p, p.filter("vec_id = 0").first()["embedding"], "embedding", "vec_id", 15).select(F.col("vec_id").alias("id"), "score", F.lit("semantic").alias("kind"))
    rows = t(spark, sf_dir, "events").filter(F.col("props").ilike("%77%")).orderBy("event_id").limit(15)
    return near.unionByName(rows.select(F.col("event_id").alias("id"), F.lit(0.0).alias("score"), F.lit("sql").alias("kind")))


@query("SELECT event_type AS field_name, count(*) AS discovery_count, round(avg((value > 20)::INT), 6) AS success_rate FROM events GROUP BY event_type HAVING count(*) >= 10 ORDER BY discovery_count DESC, field_name LIMIT 10")
def field_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("ok", F.col("value") > 20).withColumnRenamed("event_type", "field_name")
    rows = L.success_rate(e, ["field_name"], "ok").withColumnRenamed("n", "discovery_count")
    return rows.filter("discovery_count >= 10").orderBy(F.desc("discovery_count"), "field_name").limit(10)
