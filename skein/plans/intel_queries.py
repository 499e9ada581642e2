"""Queries for findings, inference, mentions, graph assembly, planning and media choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.operators import assembly as AS
from skein.operators import chunks as C
from skein.operators import edges as E
from skein.operators import inference as I
from skein.operators import intel as N
from skein.operators import learn as L
from skein.operators import mentions as M
from skein.operators import pages as PG
from skein.operators import planning as P
from skein.operators import resolve as R
from skein.plans.catalog import query
from skein.plans.graph_queries import FK_SQL, fk_edges
from skein.sources.tables import table


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(spark, sf_dir, name)


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%a%' AND p_size = 10 ORDER BY p_partkey LIMIT 30")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "part").filter(F.col("p_name").ilike("%a%") & (F.col("p_size") == 10)).select("p_partkey", "p_name", "p_type").orderBy("p_partkey").limit(30)


@query("SELECT event_id, user_id, value FROM events WHERE value >= 70 AND event_type ILIKE '%ur%' ORDER BY ts DESC, event_id DESC LIMIT 50")
def intelligence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").filter((F.col("value") >= 70) & F.col("event_type").ilike("%ur%"))
    return e.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


@query("SELECT event_id FROM events WHERE props ILIKE '%7%'")
def json_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").filter(F.to_json(F.parse_json("props")).ilike("%7%")).select("event_id")


_KIND = "CASE p_size % 6 WHEN 0 THEN 'organization' WHEN 1 THEN 'company' WHEN 2 THEN 'ceo' WHEN 3 THEN 'subsidiary' WHEN 4 THEN 'unknown' ELSE 'product' END"


def _kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 6
    kind = F.when(k == 0, "organization").when(k == 1, "company").when(k == 2, "ceo").when(k == 3, "subsidiary").when(k == 4, "unknown").otherwise("product")
    return t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), kind.alias("kind"))


@query(f"SELECT p_partkey AS id FROM part WHERE {_KIND} IN ('organization', 'company', 'subsidiary', 'unknown')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.kind_filter(_kinds(spark, sf_dir), "kind", "company").select("id")


@query(f"SELECT kind, CASE kind WHEN 'organization' THEN 'org' ELSE kind END AS normal_kind, CASE kind WHEN 'organization' THEN 50 WHEN 'company' THEN 55 WHEN 'ceo' THEN 70 WHEN 'subsidiary' THEN 60 WHEN 'unknown' THEN 5 ELSE 50 END AS priority, CASE kind WHEN 'company' THEN true WHEN 'subsidiary' THEN true ELSE false END AS upgrades_org, count(*) AS n FROM (SELECT {_KIND} AS kind FROM part) GROUP BY ALL")
def kind_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _kinds(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))
    k = K.normalized_kind(F.col("kind"))
    return g.select("kind", k.alias("normal_kind"), K.priority(k).alias("priority"), K.more_specific(k, F.lit("org")).alias("upgrades_org"), "n")


@query(f"SELECT a, b, CASE WHEN a IN ('organization', 'company') AND b = 'person' THEN 'has_person' WHEN a IN ('organization', 'company') AND b = 'product' THEN 'produces' WHEN b = 'event' THEN 'associated_with_event' ELSE 'related_to' END AS relation, CASE WHEN b = 'person' AND a = 'ceo' THEN 'ceo_of' WHEN b = 'product' THEN 'product_of' WHEN b = 'event' THEN 'event_of' END AS suggested, count(*) AS n FROM (SELECT {_KIND} AS a, CASE p_size % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'product' WHEN 2 THEN 'event' ELSE 'company' END AS b FROM part) GROUP BY ALL")
def relation_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    b = F.when(k == 0, "person").when(k == 1, "product").when(k == 2, "event").otherwise("company")
    rows = _kinds(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), b.alias("b")), "id").groupBy(F.col("kind").alias("a"), "b").agg(F.count("*").alias("n"))
    section = F.concat(F.col("b"), F.lit("s"))
    return rows.select("a", "b", E.relation_for_kinds(F.col("a"), F.col("b")).alias("relation"), E.suggested_relation(F.col("a"), section).alias("suggested"), "n")


_TITLE = "CASE c_custkey % 6 WHEN 0 THEN 'Chief Executive Officer' WHEN 1 THEN 'Co-Founder' WHEN 2 THEN 'Vice President' WHEN 3 THEN 'Chairman' WHEN 4 THEN 'Head office' ELSE 'Clerk' END"


@query(f"SELECT c_custkey, CASE title WHEN 'Chief Executive Officer' THEN 'ceo' WHEN 'Co-Founder' THEN 'founder' WHEN 'Vice President' THEN 'executive' WHEN 'Chairman' THEN 'board_member' ELSE 'person' END AS person_kind, CASE title WHEN 'Head office' THEN 'headquarters' WHEN 'Chief Executive Officer' THEN 'office' ELSE 'location' END AS place_kind, CASE title WHEN 'Co-Founder' THEN 'founder' WHEN 'Vice President' THEN 'executive' WHEN 'Chairman' THEN 'board_member' WHEN 'Chief Executive Officer' THEN 'ceo' END AS special FROM (SELECT c_custkey, {_TITLE} AS title FROM customer)")
def special_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 6
    title = F.when(k == 0, "Chief Executive Officer").when(k == 1, "Co-Founder").when(k == 2, "Vice President").when(k == 3, "Chairman").when(k == 4, "Head office").otherwise("Clerk")
    rows = t(spark, sf_dir, "customer").select("c_custkey", title.alias("title"))
    return rows.select("c_custkey", K.person_kind(F.col("title")).alias("person_kind"), K.location_kind(F.col("title")).alias("place_kind"), K.special_kind("person", F.col("title")).alias("special"))


@query("SELECT c_custkey AS entity_id, 'probable_location' AS field, n_name AS value, 0.75::DOUBLE AS confidence, 'workplace_location' AS rule FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 > 0")
def rule_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.lit("person").alias("kind"), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("location"), F.lit("known"))).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("data"))
    n = t(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("org").alias("kind"), F.create_map(F.lit("location"), F.col("n_name")).alias("data"))
    e = t(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), F.lit("works_at").alias("relation_type"))
    facts = I.infer(c.unionByName(n), e, least=0.5)
    return facts.select(F.substring("entity_id", 2, 20).cast("long").alias("entity_id"), "field", "value", "confidence", "rule")


_ORGS = "(SELECT p_partkey AS id, 'Acme ' || CASE p_size % 5 WHEN 0 THEN 'acquired' WHEN 1 THEN 'is a rival of' WHEN 2 THEN 'and' WHEN 3 THEN 'has a stake in' ELSE repeat('far away ', 30) END || ' Globex' AS x FROM part)"


@query(f"SELECT id, CASE WHEN contains(x, 'far away') THEN NULL WHEN contains(x, 'acquired') THEN 'acquired' WHEN contains(x, 'rival') THEN 'competes_with' WHEN contains(x, 'stake') THEN 'invested_in' ELSE 'related_to' END AS relation FROM {_ORGS}")
def heuristic_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 5
    middle = F.when(k == 0, "acquired").when(k == 1, "is a rival of").when(k == 2, "and").when(k == 3, "has a stake in").otherwise("far away " * 30)
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("Acme "), middle, F.lit(" Globex")).alias("x"))
    return rows.select("id", I.relation_near(F.col("x"), F.lit("Acme"), F.lit("Globex")).alias("relation"))


_NAMES = "(SELECT DISTINCT item_id AS eid, regexp_extract(text, '^(\\S+ \\S+)', 1) AS name FROM benchmark)"


_BARE = "' ' || trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


@query(f"SELECT doc_id, eid, (length(x) - length(replace(x, n, ''))) // length(n) AS n FROM (SELECT doc_id, {_BARE.format('text')} AS x FROM documents), (SELECT eid, {_BARE.format('name')} AS n FROM {_NAMES} WHERE name <> '') WHERE trim(n) <> '' AND contains(x, n)")
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eid"), F.regexp_extract("text", r"^(\S+ \S+)", 1).alias("name")).filter("name <> ''")
    return M.mentions(t(spark, sf_dir, "documents"), names, "doc_id", "text", "eid", "name")


_FIRST_WORDS = "(SELECT DISTINCT item_id AS eid, regexp_extract(text, '^(\\S+)', 1) AS name FROM benchmark)"


@query(f"WITH m AS (SELECT doc_id, eid, instr(' ' || regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g') || ' ', n) AS pos FROM (SELECT doc_id, text, {_BARE.format('text')} AS x FROM documents), (SELECT eid, name, {_BARE.format('name')} AS n FROM {_FIRST_WORDS} WHERE name <> '') WHERE trim(n) <> '' AND contains(x, n)) SELECT a.doc_id, a.eid AS a, b.eid AS b, abs(a.pos - b.pos) AS distance FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.eid < b.eid WHERE a.pos > 0 AND b.pos > 0 AND abs(a.pos - b.pos) <= 200")
def mention_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("eid"), F.regexp_extract("text", r"^(\S+)", 1).alias("name")).filter("name <> ''")
    d = t(spark, sf_dir, "documents")
    return M.near_pairs(M.mentions(d, names, "doc_id", "text", "eid", "name"), d, names, "doc_id", "text", "eid", "name")


@query("""
WITH r AS (SELECT trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS canonical, p_name AS label, p_retailprice AS score FROM part)
SELECT label, 'product' AS kind, count(*) AS count, max(score) AS score FROM r GROUP BY label, canonical
""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "part").withColumn("kind", F.lit("product"))
    return AS.entity_nodes(rows, "p_name", "kind", "p_retailprice").select("label", "kind", "count", "score")


@query(f"""WITH n AS (SELECT node AS id, count(*) AS count FROM (SELECT src AS node FROM {FK_SQL} UNION ALL SELECT dst FROM {FK_SQL}) GROUP BY node),
k AS (SELECT id FROM n ORDER BY id LIKE 'r%' DESC, count DESC, id LIMIT 40)
SELECT least(src, dst) AS source, greatest(src, dst) AS target, count(*) AS weight FROM {FK_SQL} WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY ALL""")
def graph_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = fk_edges(spark, sf_dir)
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).groupBy("id").agg(F.count("*").alias("count"))
    nodes = ends.select("id", F.col("id").alias("label"), F.lit("entity").alias("kind"), "count", F.lit(1.0).alias("score"))
    seeds = nodes.filter("id LIKE 'r%'").select("id")
    _, kept = AS.assemble([nodes], [e.select(F.col("src").alias("source"), F.col("dst").alias("target"), F.lit(1).alias("weight"), "kind")], 40, seeds)
    return kept.select("source", "target", F.col("weight").cast("long").alias("weight"))


@query(f"SELECT least(src, dst) AS a, greatest(src, dst) AS b, kind AS relation_type FROM {FK_SQL} GROUP BY ALL")
def distinct_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return AS.distinct_edges(fk_edges(spark, sf_dir).withColumnsRenamed({"src": "source_id", "dst": "target_id", "kind": "relation_type"}))


@query("SELECT doc_id, chunk_index, 'snippet' AS kind FROM (SELECT doc_id, unnest(range(0, ceil(len(s) / 3)::BIGINT)) AS chunk_index, s FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)) WHERE length(array_to_string(s[chunk_index * 3 + 1:chunk_index * 3 + 3], ' ')) >= 10")
def snippet_embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.snippet_views(C.snippets(t(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id").select("doc_id", "chunk_index", F.lit("snippet").alias("kind"))


@query()
def page_embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_views(t(spark, sf_dir, "documents").withColumn("title", F.substring("text", 1, 60)), "doc_id", "title", "text")


@query("SELECT c_custkey, 'name' AS view, c_name AS text FROM customer UNION ALL SELECT c_custkey, 'segment', c_name || ': ' || c_mktsegment FROM customer WHERE length(c_mktsegment) >= 10")
def entity_embedding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("data"))
    return P.entity_views(rows, "c_custkey", "c_name", "data")


_SNIPPETS = "SELECT doc_id, (i - 1) // 3 AS chunk_index, string_agg(s[i], ' ' ORDER BY i) AS snippet FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)) GROUP BY ALL"
_AROUND = ", ".join(f"string_agg(snippet, ' ') OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN {2 * r} PRECEDING AND {2 * r} FOLLOWING) AS w{r}" for r in range(5))


@query(f"SELECT doc_id, chunk_index, CASE {' '.join(f'WHEN length(w{r}) >= 200 THEN w{r}' for r in range(4))} ELSE w4 END AS expanded FROM (SELECT doc_id, chunk_index, {_AROUND} FROM ({_SNIPPETS}))")
def snippet_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "documents").withColumn("at", F.struct("_metadata.file_path", "_metadata.row_index"))  # rows of one doc_id in the order of the table
    return C.expand_snippets(C.snippets_of_keys(rows, "doc_id", "text", "at"), "doc_id", "chunk_index", "snippet").select("doc_id", "chunk_index", "expanded")


@query("WITH w AS (SELECT c_custkey, 0 AS word FROM (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '00012') ORDER BY 1 LIMIT 5) UNION ALL SELECT c_custkey, 1 FROM (SELECT c_custkey FROM customer WHERE contains(lower(c_name), '0007') ORDER BY 1 LIMIT 5)) SELECT c_custkey FROM (SELECT c_custkey, min(word) AS word FROM w GROUP BY 1) ORDER BY word, c_custkey LIMIT 3")
def graph_search_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.word_starts(t(spark, sf_dir, "customer"), "00012 of 0007", "c_custkey", "c_name")


@query("SELECT event_type || user_id AS query, min(event_id) AS pos FROM events GROUP BY 1 HAVING max(value) / 100 >= 0.5 ORDER BY pos LIMIT 4")
def seed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").select(F.concat("event_type", "user_id").alias("query"), F.col("event_id").alias("pos"), (F.col("value") / 100).alias("score"))
    return P.seed_queries(e)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY CASE WHEN user_id % 3 = 0 THEN event_type || '|' || user_id ELSE user_id::VARCHAR END ORDER BY event_id) AS r FROM events) WHERE r = 1")
def hit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("point", F.when(F.col("user_id") % 3 != 0, F.col("user_id").cast("string"))).withColumn("u", F.col("user_id").cast("string"))
    return P.dedup_hits(e, "point", "event_type", "u", "event_id").select("event_id")


@query("SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) JOIN customer ON c_custkey = o_custkey")
def hydration(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = t(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return P.hydrate(ids, t(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("o_custkey"))


@query("SELECT 'gap' AS task, p_partkey::VARCHAR AS subject, p_type AS what, p_size::DOUBLE AS score FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') ORDER BY score DESC, task, subject, what LIMIT 20")
def investigation_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("priority"), F.col("p_type").alias("field"), F.col("p_size").cast("double").alias("score"))
    none = spark.createDataFrame([], "a string, b string, confidence double")
    return P.investigation_tasks(gaps, none, ["Brand#11", "Brand#12"], 20)


@query("SELECT user_id, round(greatest(0.0, 50 + sum(value - 60)), 4) AS reward FROM events GROUP BY user_id")
def step_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    p = e.select("user_id").distinct().withColumn("reward", F.lit(50.0))
    return L.step_reward(p, e.select("user_id", (F.col("value") - 60).alias("delta")), "user_id").withColumn("reward", F.round("reward", 4))


@query("WITH p AS (SELECT event_type, user_id % 20 AS b, count(*) AS n, round(avg((value > 30)::INT) * least(1.0, count(*) / 10), 6) AS confidence FROM events GROUP BY ALL) SELECT event_type, b, confidence FROM p WHERE confidence > 0.5 ORDER BY confidence DESC, event_type, b LIMIT 10")
def successful_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events").withColumn("b", F.col("user_id") % 20)
    p = L.pattern_confidence(e, ["event_type", "b"], F.col("value") > 30)
    return L.successful_patterns(p, 0.5, [F.desc("confidence"), F.asc("event_type"), F.asc("b")], 10).select("event_type", "b", "confidence")


@query("SELECT event_id, round(CASE WHEN value / 100 > 0.6 THEN CASE WHEN event_type <> 'error' THEN 20.0 ELSE -15.0 END + value / 100 * 25 ELSE 0.0 END, 4) AS adjustment FROM events")
def frontier_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value") / 100
    return t(spark, sf_dir, "events").select("event_id", F.round(L.frontier_adjustment(F.col("event_type") != "error", v, v), 4).alias("adjustment"))


@query("WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) END AS q FROM part) SELECT q, min(p_partkey) AS p_partkey, 1.0::DOUBLE AS similarity FROM q JOIN part ON p_name = q OR p_name = split_part(q, ' ', 2) || ' ' || split_part(q, ' ', 1) GROUP BY q")
def find_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part")
    turned = F.concat(F.element_at(F.split("p_name", " "), 2), F.lit(" "), F.element_at(F.split("p_name", " "), 1))  # not a known name: found by its words
    return R.find_existing(p.select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(turned).alias("q")).distinct(), p, "q", "p_partkey", "p_name")


@query("SELECT c_custkey, (c_custkey + 1) % 50 AS entity_id FROM customer")
def resolve_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "customer").select("c_custkey", F.array(F.lit("nobody"), F.concat(F.lit("E"), (F.col("c_custkey") + 1) % 50), F.lit("E3")).alias("aliases"))
    known = spark.range(50).select("id", F.concat(F.lit("e"), "id").alias("name"))
    return R.resolve_aliases(rows, known, "c_custkey", "aliases", "id", "name")


@query("WITH m AS (SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_name) AS new_id FROM part) SELECT count(*) AS entities, count(*) FILTER (id = new_id) AS after FROM m")
def merge_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name")
    e = t(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("edge_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("supplies").alias("relation_type"))
    ids = R.id_map(p, F.col("p_name"), "id")
    soft, _ = R.merge(p, e, ids, "id", "soft")
    hard, _ = R.merge(p, e, ids, "id", "hard")
    return soft.agg(F.count("*").alias("entities")).crossJoin(F.broadcast(hard.agg(F.count("*").alias("after"))))  # one row each


@query("SELECT event_id, CASE WHEN lower(trim(v)) IN ('', 'n/a', 'unknown', '--') OR v IS NULL THEN NULL ELSE v END AS kept FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ' N/A' WHEN 1 THEN 'Unknown' WHEN 2 THEN '--' WHEN 3 THEN NULL ELSE event_type END AS v FROM events)")
def filler_sanitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 5
    v = F.when(k == 0, " N/A").when(k == 1, "Unknown").when(k == 2, "--").when(k == 3, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    return t(spark, sf_dir, "events").select("event_id", F.when(~N.is_filler(v), v).alias("kept"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (event_id % 90 + 1.5)::DOUBLE END AS revenue_billions, CASE WHEN event_id % 2 = 0 THEN event_id + 10000 END AS employees FROM events")
def rule_based_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    text = F.concat(F.lit("It had "), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Revenue US$ "), (F.col("event_id") % 90 + 1.5).cast("string"), F.lit(" billion and "))).otherwise(""), F.when(F.col("event_id") % 2 == 0, F.concat(F.format_number(F.col("event_id") + 10000, 0), F.lit(" employees"))).otherwise("staff"))
    return e.select("event_id", N.rule_based(text).alias("r")).select("event_id", "r.*")


@query("SELECT c_custkey, 'persons' AS section, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'ceo' ELSE 'person' END AS kind FROM customer UNION ALL SELECT c_custkey, 'products', 'P' || c_custkey, 'product' FROM customer WHERE c_custkey % 3 = 0")
def finding_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer")
    person = F.struct(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "CEO").otherwise("n/a").alias("title"))
    product = F.struct(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("P"), "c_custkey")).otherwise("unknown").alias("name"))
    text = F.to_json(F.struct(F.array(person).alias("persons"), F.array(product).alias("products")))
    rows = N.section_rows(c.select("c_custkey", N.parse(text).alias("finding")), "c_custkey", "finding")
    return N.entities_of(rows, "c_custkey").select("c_custkey", "section", "name", "kind")


@query("SELECT event_id, '$.k' AS path, json_extract_string(props, '$.k') AS value FROM events UNION ALL SELECT event_id, '$.who', event_type FROM events")
def json_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = t(spark, sf_dir, "events")
    text = F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.struct(F.col("event_type").alias("name"), F.lit("event").alias("kind")).alias("who")))
    return e.select("event_id", F.explode(N.harvest_entities(text)).alias("x")).select("event_id", "x.path", "x.value")


@query("SELECT c_custkey, 'x' AS field_name, CASE WHEN c_custkey % 2 = 0 THEN c_custkey + 1 ELSE 1 END AS discovery_count, CASE WHEN c_custkey % 3 = 0 THEN 'critical' ELSE 'important' END AS importance FROM customer")
def field_definition_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t(spark, sf_dir, "customer").withColumn("field_name", F.lit("x"))
    known = c.filter("c_custkey % 2 = 0").select("c_custkey", "field_name", F.col("c_custkey").alias("discovery_count"), F.lit("important").alias("importance"))
    found = c.select("c_custkey", "field_name", F.when(F.col("c_custkey") % 3 == 0, "critical").otherwise("important").alias("importance"))
    return P.field_upsert(known, found, ["c_custkey", "field_name"])


@query("""
SELECT media_id, CASE media_type WHEN 'image' THEN CASE WHEN pixels < 200000 THEN 'image2text' WHEN contains(url, 'screen') THEN 'tesseract' ELSE 'image2text' END
  WHEN 'video' THEN CASE WHEN NOT has_audio THEN 'video2text' WHEN duration < 120 THEN 'video2text' WHEN duration > 600 THEN 'speech' ELSE 'video2text' END
  WHEN 'audio' THEN 'speech' ELSE 'pdf_extract' END AS method,
  CASE media_type WHEN 'image' THEN CASE WHEN pixels < 200000 THEN 0.7 WHEN contains(url, 'screen') THEN 0.8 WHEN contains(url, 'chart') THEN 0.8 ELSE 0.6 END
  WHEN 'video' THEN CASE WHEN NOT has_audio THEN 0.95 WHEN duration < 120 THEN 0.7 WHEN duration > 600 THEN 0.75 ELSE 0.6 END ELSE 1.0 END::DOUBLE AS confidence
FROM (SELECT event_id AS media_id, CASE event_id % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'pdf' END AS media_type, (user_id * 10) * 400 AS pixels, value * 10 AS duration, user_id % 5 > 0 AS has_audio,
  CASE event_id % 3 WHEN 0 THEN 'my_screen.png' WHEN 1 THEN 'chart.png' ELSE 'x.png' END AS url FROM events WHERE user_id > 0 AND value > 0)
""")
def media_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, j = F.col("event_id") % 4, F.col("event_id") % 3
    kind = F.when(k == 0, "image").when(k == 1, "video").when(k == 2, "audio").otherwise("pdf")
    url = F.when(j == 0, "my_screen.png").when(j == 1, "chart.png").otherwise("x.png")
    e = t(spark, sf_dir, "events").filter("user_id > 0 and value > 0")
    rows = e.select(F.col("event_id").alias("media_id"), kind.alias("media_type"), url.alias("url"), (F.col("user_id") * 10).alias("width"), F.lit(400).alias("height"), (F.col("value") * 10).alias("duration"), (F.col("user_id") % 5 > 0).alias("has_audio"))
    return PG.processing_method(rows).select("media_id", "method", F.col("method_confidence").alias("confidence"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN length(text) > 0 ELSE true END AS ok FROM conversations")
def planner_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations")
    tool = F.when(F.col("turn") % 3 == 0, "search").otherwise("other")
    return rows.select("conv_id", "turn", P.step_ok(tool, F.length("text"), F.col("text")).alias("ok"))


@query("SELECT url, min(depth) AS depth FROM (SELECT 'u0' AS url, 0 AS depth UNION ALL SELECT 'u' || i, 1 FROM range(1, 4) x(i) UNION ALL SELECT 'u' || i, 2 FROM range(4, 13) x(i)) GROUP BY url")
def crawl_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.crawl import crawl

    links = spark.range(1, 40).select(F.concat(F.lit("u"), F.floor((F.col("id") - 1) / 3)).alias("from_url"), F.concat(F.lit("u"), "id").alias("to_url"))
    seeds = spark.range(1).select(F.lit("u0").alias("url"))
    return crawl(seeds, links, lambda df: df.withColumn("score", F.lit(50)), 2, 100, 25)


@query()
def post_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.plans.pipelines import post_crawl as job

    p = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("product").alias("kind"), F.create_map(F.lit("type"), F.col("p_type")).alias("data"))
    e = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.lit("supplies").alias("relation_type"))
    i = t(spark, sf_dir, "events").select(F.col("user_id").alias("entity_id"), F.col("value").alias("confidence"), F.col("ts").cast("timestamp").alias("created"), F.create_map(F.lit("k"), F.col("event_type")).alias("data"))
    out = job(p, e, i)
    return out["entities"].select("id", "name", F.to_json("data").alias("data"))
