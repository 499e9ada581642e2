"""Queries over media and their entities, files' notes, points, names alike, joins of pages, and the service's status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import html as H
from skein.functions import text as T
from skein.operators import inference as I
from skein.operators import joins as J
from skein.operators import mentions as M
from skein.operators import resolve as R
from skein.operators import service as S
from skein.operators import vectors as V
from skein.plans.catalog import query
from skein.sources.tables import table

_MEDIA = "(SELECT doc_id AS media_id, text AS extracted_text, lang AS media_type, (doc_id % 10) / 10.0 AS confidence FROM documents)"


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"), F.col("text").alias("extracted_text"), F.col("lang").alias("media_type"), (F.col("doc_id") % 10 / 10.0).alias("confidence"))


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from media to the entities (sources here) that they mention."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("target_id"), F.when(F.col("doc_id") % 3 == 0, "related_to").otherwise("mentions").alias("relation_type"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("entity_id")).filter("source is not null").distinct().withColumn("name", F.upper("entity_id"))


@query(f"SELECT media_id, media_type, length(extracted_text) AS n_chars FROM {_MEDIA} WHERE confidence >= 0.5 AND extracted_text ILIKE '%license%'")
def media_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.search_media(media(spark, sf_dir), "license").select("media_id", "media_type", F.length("extracted_text").cast("long").alias("n_chars"))


@query("SELECT source AS entity_id, doc_id AS media_id, lang AS media_type, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS extracted_text FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL AND lang = 'en'")
def media_of_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.media_of_entity(media(spark, sf_dir), said(spark, sf_dir), sources(spark, sf_dir), "en")


@query("SELECT doc_id AS media_id, source AS entity_id, upper(source) AS name FROM documents WHERE doc_id % 3 <> 0 AND source IS NOT NULL")
def entities_in_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.entities_in_media(media(spark, sf_dir), said(spark, sf_dir), sources(spark, sf_dir)).select("media_id", "entity_id", "name")


@query(f"SELECT c_custkey, eid, (length(x) - length(replace(x, n, ''))) // length(n) AS n FROM (SELECT c_custkey, lower(c_mktsegment || ' ' || c_name) AS x FROM customer), (SELECT p_partkey AS eid, CASE WHEN p_partkey % 2 = 0 THEN 'omer#' || p_partkey ELSE split_part(p_name, ' ', 1) END AS n FROM part WHERE p_size < 9) WHERE contains(x, n)")
def substring_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", "c_mktsegment", "c_name").alias("x"))
    names = table(spark, sf_dir, "part").filter("p_size < 9").select(F.col("p_partkey").alias("eid"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("omer#"), "p_partkey")).otherwise(F.element_at(F.split("p_name", " "), 1)).alias("name"))
    return M.substring_mentions(texts, names, "c_custkey", "x", "eid", "name")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' new' ELSE p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'mine' ELSE 'old' END AS tags, CASE WHEN p_partkey % 4 = 0 THEN p_type END AS notes FROM part")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    files = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.create_map(F.lit("tags"), F.lit("old")).alias("metadata"))
    edits = p.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" new")).alias("title"), F.lit("mine").alias("tags"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_type")).alias("notes"))
    return S.update_metadata(files, edits, "id").select("id", "title", F.try_element_at("metadata", F.lit("tags")).alias("tags"), F.try_element_at("metadata", F.lit("notes")).alias("notes"))


@query("SELECT o_orderkey AS source_id, 'c-' || o_custkey AS target_id, CASE WHEN o_orderkey % 3 = 0 THEN 'related_to' ELSE 'derived_from' END AS relation_type, '' AS description, 'user_manual' AS source FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0")
def file_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    asked = o.select(k.alias("source_id"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit(" c-"), "o_custkey")).alias("target_id"), F.when(k % 3 != 0, " derived_from ").alias("relation_type"), F.lit(None).cast("string").alias("description"))
    return S.add_relations(asked, o.filter("o_orderkey % 5 <> 0"), "o_orderkey")


@query("SELECT true AS db_ok, true AS vectors_ok, false AS embedding_loaded, 'points' AS collection, 'none' AS model")
def service_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.status(spark, f"{sf_dir}/pages.parquet", f"{sf_dir}/embeddings.parquet", None, {"collection": "points", "model": "none"})


@query("SELECT label AS name, count(*) AS n, max(vec_id) AS last FROM (SELECT vec_id // 2 AS g, max_by(vec_id, vec_id) AS vec_id, max_by(label, vec_id) AS label FROM embeddings GROUP BY 1) GROUP BY 1")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points named by half their number: even ones are stored, odd ones come in over them."""
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.floor(F.col("vec_id") / 2)).alias("id"), F.col("embedding").alias("vector"), F.struct("vec_id", "label").alias("payload"), "vec_id")
    after = V.upsert_points(e.filter("vec_id % 2 = 0").drop("vec_id"), e.filter("vec_id % 2 = 1"), "vec_id")
    return after.groupBy(F.col("payload.label").alias("name")).agg(F.count("*").alias("n"), F.max("payload.vec_id").alias("last"))


_ALIKE = "(SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' co.' WHEN 1 THEN ' company' ELSE '' END AS name, CASE WHEN p_partkey % 5 = 0 THEN 'entity' ELSE 'product' END AS kind FROM part)"


@query(f"""WITH e AS (SELECT *, regexp_replace(name, ' co\\.$', ' company') AS form FROM {_ALIKE}), q AS (SELECT DISTINCT name AS q, form AS qf FROM e),
r AS (SELECT q, 'product' AS kind, id, CASE WHEN name = q THEN 'exact' ELSE 'semantic' END AS match_type, 1.0::DOUBLE AS similarity, row_number() OVER (PARTITION BY q ORDER BY id) AS r FROM q JOIN e ON form = qf)
SELECT q, kind, id, similarity, match_type FROM r WHERE r <= 10""")
def semantic_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    e = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.when(k == 0, " co.").when(k == 1, " company").otherwise("")).alias("name"), F.when(F.col("p_partkey") % 5 == 0, "entity").otherwise("product").alias("kind"))
    asked = e.select(F.col("name").alias("q"), F.lit("product").alias("kind")).distinct()
    return R.semantic_duplicates(asked, e, "q", "kind", "id", "name", "kind").select("q", "kind", "id", "similarity", "match_type")


@query("SELECT o_orderkey, CASE WHEN o_custkey % 4 = 3 THEN 'b' ELSE 'a' END AS source_id, CASE WHEN o_custkey % 4 = 3 THEN 'a' ELSE 'b' END AS target_id, CASE o_custkey % 4 WHEN 0 THEN 'leads_as_ceo' WHEN 1 THEN 'produces' WHEN 2 THEN 'headquartered_at' ELSE 'associated_with' END AS relation_type FROM orders")
def implied_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order says two entities near each other; their kinds go by the customer."""
    k = F.col("o_custkey") % 4
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("a"), k).alias("a"), F.concat(F.lit("b"), k).alias("b"))
    rows = [("a0", "Ann", "ceo", {}), ("b0", "Acme", "company", {}), ("a1", "Acme Corp", "company", {}), ("b1", "Bolt", "product", {"manufacturer": "acme"}), ("a2", "Acme", "org", {}), ("b2", "Tower", "headquarters", {}), ("a3", "Acme", "organization", {}), ("b3", "Bob", "person", {})]
    entities = spark.createDataFrame(rows, "id string, name string, kind string, data map<string,string>")
    out = I.implied_relations(o, entities, "o_orderkey")
    return out.select("o_orderkey", F.substring("source_id", 1, 1).alias("source_id"), F.substring("target_id", 1, 1).alias("target_id"), "relation_type")


# ---------------------------------------------------------------- joins of pages, entities and findings
@query("SELECT p.page_id, length(c.text) AS n_chars FROM pages p JOIN documents c ON c.doc_id = p.page_id WHERE c.text ILIKE '%the%'")
def page_content_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "documents").filter(F.col("text").ilike("%the%")).select(F.col("doc_id").alias("page_id"), F.length("text").cast("long").alias("n_chars"))
    return table(spark, sf_dir, "pages").select("page_id").join(content, "page_id")


@query("SELECT p.page_id, p.url, coalesce(length(c.text), 0) AS n_chars FROM pages p LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) c ON c.doc_id = p.page_id")
def page_list_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("page_id"), F.length("text").cast("long").alias("n"))
    return table(spark, sf_dir, "pages").join(content, "page_id", "left").select("page_id", "url", F.coalesce("n", F.lit(0).cast("long")).alias("n_chars"))


@query("SELECT c_custkey, p_partkey FROM customer JOIN part ON trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower('Hot ' || CASE c_custkey % 3 WHEN 0 THEN 'Gear!' WHEN 1 THEN 'BOLT' ELSE 'thing' END), '[^a-z0-9]+', ' ', 'g'))")
def seed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey") % 3
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Hot "), F.when(k == 0, "Gear!").when(k == 1, "BOLT").otherwise("thing")).alias("q"))
    known = table(spark, sf_dir, "part").select("p_partkey", T.canonical_name("p_name").alias("c"))
    return J.all_pairs(asked.select("c_custkey", T.canonical_name("q").alias("c")), known, "c").select("c_custkey", "p_partkey")


@query("SELECT user_id, event_id, value FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def intelligence_of_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return table(spark, sf_dir, "events").join(wanted, "user_id", "left_semi").select("user_id", "event_id", "value")


@query("SELECT doc_id, EXISTS (SELECT 1 FROM pages WHERE page_id = doc_id) AS visited FROM documents")
def has_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("seen")).distinct()
    return table(spark, sf_dir, "documents").select("doc_id").join(seen, "doc_id", "left").select("doc_id", F.coalesce("seen", F.lit(False)).alias("visited"))


@query("SELECT p_partkey FROM part WHERE lower(p_name) = 'hot gear'")
def exact_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").filter(F.lower("p_name") == F.lower(F.trim(F.lit(" Hot Gear ")))).select("p_partkey")


# ---------------------------------------------------------------- facts, clean text
@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'own' WHEN c_custkey % 2 = 0 THEN 'strong' ELSE 'weak' END AS location FROM customer")
def applied_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    entities = c.withColumn("data", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("location"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>")))
    fact = lambda value, sure: F.struct(F.lit(value).alias("value"), F.lit(sure).alias("confidence"))
    facts = c.withColumn("f", F.explode(F.when(F.col("id") % 2 == 0, F.array(fact("weak", 0.5), fact("strong", 0.9))).otherwise(F.array(fact("weak", 0.5)))))
    facts = facts.select(F.col("id").alias("entity_id"), F.lit("location").alias("field"), "f.value", "f.confidence", F.lit("r").alias("rule"), F.lit(0).alias("via"))
    return I.apply_facts(entities, facts).select("id", F.try_element_at("data", F.lit("location")).alias("location"))


@query("""SELECT conv_id, turn, 'First part\n\nsecond one' || CASE WHEN turn % 2 = 0 THEN '' ELSE '\nlast ' || conv_id END AS cleaned FROM conversations""".replace("\n", "' || chr(10) || '"))
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with blanks, prompt lines and, on every odd turn, tags around the last line."""
    tail = F.when(F.col("turn") % 2 == 0, "").otherwise(F.concat(F.lit("\n<script>x</script><b>last "), "conv_id", F.lit("</b>")))
    raw = F.concat(F.lit("First \t part \nscore 12 prompt\n\n\n\n  second one  "), tail)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace(H.clean_text(raw), r"\n\s*\nlast", "\nlast").alias("cleaned"))


@query("SELECT conv_id, turn, 'Head body ' || conv_id AS page_text FROM conversations")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("<html><nav>menu</nav><h1>Head</h1>\n<aside>ad</aside><p>body "), "conv_id", F.lit("</p><iframe>x</iframe><!-- no --></html>"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", H.html_to_text(raw).alias("page_text"))
