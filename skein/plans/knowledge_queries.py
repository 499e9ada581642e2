"""Queries for learning, gaps, quality, resolution, catalogues and streams' batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.functions import text as T
from skein.operators import aggregates as A
from skein.operators import gaps as GP
from skein.operators import learn as L
from skein.operators import resolve as R
from skein.plans.catalog import query
from skein.sources.tables import table




def _ok():
    return F.col("event_type") != "error"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS successes, round(avg((event_type <> 'error')::INT), 6) AS success_rate, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.domain_stats(events(spark, sf_dir), "user_id", _ok(), "ts", "event_type")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.kind_histogram(events(spark, sf_dir), "user_id", "event_type")


_EMA = "SELECT user_id, round(sum(0.1::DOUBLE * power(0.9::DOUBLE, r - 1) * (event_type <> 'error')::INT), 6) AS quality FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) GROUP BY user_id"


@query(_EMA)
def ema_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.ema(events(spark, sf_dir), "user_id", _ok().cast("double"), [F.desc("ts"), F.desc("event_id")])


@query(f"WITH q AS ({_EMA}), s AS (SELECT user_id, avg((event_type <> 'error')::INT) AS success, date_diff('day', max(ts)::DATE, (SELECT max(ts)::DATE + 10 FROM events)) AS age FROM events GROUP BY user_id) SELECT user_id, round((0.4::DOUBLE * success + 0.4::DOUBLE * quality) * (0.8::DOUBLE + 0.2::DOUBLE * greatest(0.0, 1 - age / 30)), 6) AS reliability FROM q JOIN s USING (user_id)")
def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    as_of = e.agg(F.date_add(F.max("ts").cast("date"), 10)).first()[0]
    s = e.groupBy("user_id").agg(F.avg(_ok().cast("double")).alias("success"), F.max("ts").cast("date").alias("last"))
    q = L.ema(e, "user_id", _ok().cast("double"), [F.desc("ts"), F.desc("event_id")])
    return s.join(q, "user_id").select("user_id", L.reliability(F.col("success"), F.col("quality"), F.datediff(F.lit(as_of), "last")).alias("reliability"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS bucket, count(*) AS n, round(avg((value > 50)::INT) * least(1.0, count(*) / 10), 6) AS confidence FROM events GROUP BY ALL")
def pattern_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("bucket", F.try_variant_get(F.parse_json("props"), "$.k", "int") % 10)
    return L.pattern_confidence(e, ["event_type", "bucket"], F.col("value") > 50)


_BOOST = "SELECT user_id, count(*) AS n, avg((event_type <> 'error')::INT) AS s, avg(value) / 100 AS q FROM events GROUP BY user_id"


@query(f"SELECT user_id, round(CASE WHEN n < 3 THEN 0.0 WHEN s >= 0.7 THEN q * 30 WHEN s >= 0.5 THEN q * 15 WHEN s < 0.3 THEN -20.0 ELSE 0.0 END, 2) AS domain_boost, CASE WHEN n < 5 THEN 0.0 WHEN s >= 0.8 THEN 10.0 WHEN s >= 0.6 THEN 5.0 WHEN s < 0.3 THEN -10.0 ELSE 0.0 END::DOUBLE AS pattern_boost, CASE WHEN s > 0.8 THEN 90 WHEN s < 0.3 THEN 150 ELSE 120 END AS timeout, round(CASE WHEN n >= 5 THEN q ELSE 0.25 END, 4) AS expected FROM ({_BOOST})")
def learned_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg(_ok().cast("double")).alias("s"), (F.avg("value") / 100).alias("q"))
    timeout, expected = L.strategy(F.col("s"), F.lit(0.25), F.col("n"), F.col("q"))
    return g.select("user_id", F.round(L.domain_boost(F.col("n"), F.col("q"), F.col("s")), 2).alias("domain_boost"), L.pattern_boost(F.col("n"), F.col("s")).alias("pattern_boost"), timeout.alias("timeout"), F.round(expected, 4).alias("expected"))


@query("SELECT event_type, count(*) AS n, round(coalesce(avg((value > 20)::INT), 0.0), 6) AS success_rate FROM events GROUP BY event_type")
def field_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.success_rate(events(spark, sf_dir).withColumn("ok", F.col("value") > 20), ["event_type"], "ok")


# ---------------------------------------------------------------- gaps
_EXPECTED = "(VALUES " + ", ".join(f"('{t}', '{p}', '{f}')" for t, by in K.EXPECTED.items() for p, fs in by.items() for f in fs) + ") x(entity_type, priority, field)"
_ENTITY = "(SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'Company' WHEN 1 THEN 'person' ELSE 'widget' END AS kind FROM customer)"
_PRESENT = """(SELECT c_custkey AS id, unnest(['officialname', 'industry', CASE WHEN c_acctbal > 5000 THEN 'revenue' END, CASE WHEN c_custkey % 2 = 0 THEN 'fullname' END, CASE WHEN c_custkey % 5 = 0 THEN 'website' END]) AS bare FROM customer)"""
_TYPE = "CASE kind WHEN 'Company' THEN 'company' WHEN 'person' THEN 'person' ELSE 'entity' END"


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 3
    value = lambda hit: F.when(hit, "x").otherwise("")
    data = F.create_map(F.lit("Official_Name"), F.col("c_name"), F.lit("industry"), F.col("c_mktsegment"), F.lit("REVENUE"), value(F.col("c_acctbal") > 5000), F.lit("full name"), value(F.col("c_custkey") % 2 == 0), F.lit("website"), value(F.col("c_custkey") % 5 == 0))
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(k == 0, "Company").when(k == 1, "person").otherwise("widget").alias("kind"), data.alias("data"))


def _case(column: str, groups, default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({column}), '{p}')" for p in parts) + f" THEN {value}" for value, parts in groups) + f" ELSE {default} END"


_CATEGORY = _case("field", ((f"'{k}'", v) for k, v in K.CATEGORIES.items()), "'other'")
_FINDABLE = _case("field", ((f"{v}::DOUBLE", p) for v, p in K.FINDABLE), "0.5::DOUBLE")
_GAPS = f"SELECT e.id, x.entity_type, priority, field, {_CATEGORY} AS category, {_FINDABLE} AS findability, round(CASE priority WHEN 'critical' THEN 10 WHEN 'important' THEN 5 ELSE 1 END * {_FINDABLE}, 6) AS score FROM {_ENTITY} e JOIN {_EXPECTED} ON x.entity_type = {_TYPE} WHERE NOT EXISTS (SELECT 1 FROM {_PRESENT} p WHERE p.id = e.id AND p.bare = replace(field, '_', ''))"


@query(_GAPS)
def gap_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GP.gaps(entities(spark, sf_dir), "id", "kind", "data")


@query(f"SELECT id, round(coalesce(100.0 * sum(CASE WHEN there THEN w ELSE 0 END) / nullif(sum(CASE WHEN field IS NOT NULL THEN w ELSE 0 END), 0), 0.0), 2) AS completeness FROM (SELECT e.id, field, CASE priority WHEN 'critical' THEN 3 WHEN 'important' THEN 2 ELSE 1 END AS w, EXISTS (SELECT 1 FROM {_PRESENT} p WHERE p.id = e.id AND p.bare = replace(field, '_', '')) AS there FROM {_ENTITY} e LEFT JOIN {_EXPECTED} ON x.entity_type = {_TYPE}) GROUP BY id")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GP.completeness(entities(spark, sf_dir), "id", "kind", "data")


_TEMPLATES = "(VALUES " + ", ".join(f"('{b}', '{v}', '{t}')" for b, v, t in GP.GAP_QUERIES) + ") t(by_what, value, template)"


@query(f"WITH g AS ({_GAPS}) SELECT DISTINCT g.id, replace(template, '%s', c_name) AS query FROM g JOIN {_TEMPLATES} ON (by_what = 'category' AND value = category) OR (by_what = 'type' AND value = entity_type) JOIN customer ON c_custkey = g.id")
def gap_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    return GP.gap_queries(GP.gaps(e, "id", "kind", "data"), e, "id", "name")


@query("WITH q AS (SELECT c_custkey AS id, c_name, unnest(['\"%s\"', '\"%s\" official', '\"%s\" information'] || CASE WHEN c_custkey % 3 = 1 THEN ['\"%s\" biography', '\"%s\" profile', '\"%s\" linkedin', '\"%s\" about'] ELSE [] END) AS t FROM customer) SELECT id, replace(t, '%s', c_name) AS query FROM q")
def discovery_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GP.discovery_queries(entities(spark, sf_dir), "id", "name", F.col("kind")).select("id", "query")


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'inc|corp|ltd|llc|gmbh|ag|sa|plc') THEN 'company' WHEN len(string_split_regex(trim(p_name), '\\s+')) >= 2 AND regexp_matches(p_name, '^(\\p{Lu}\\S*\\s*)+$') THEN 'person' ELSE 'entity' END AS name_type FROM part")
def name_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts(spark, sf_dir).select("p_partkey", K.type_of_name(F.col("p_name")).alias("name_type"))


@query("SELECT o_orderpriority AS kind, CASE WHEN contains(lower(o_orderpriority), 'org') THEN 'organization' ELSE 'entity' END AS entity_type, count(*) AS n FROM orders GROUP BY ALL")
def entity_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("n")).withColumn("entity_type", K.entity_type(F.col("kind")))


@query("SELECT c_custkey AS id, issue FROM (SELECT c_custkey, unnest([CASE WHEN c_custkey % 7 = 0 THEN 'missing_name' END, CASE WHEN c_custkey % 11 = 0 THEN 'missing_kind' END, CASE WHEN c_custkey NOT IN (SELECT o_custkey FROM orders) THEN 'orphan' END]) AS issue FROM customer) WHERE issue IS NOT NULL")
def entity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 11 != 0, "company").otherwise(" ").alias("kind"))
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (-F.col("o_orderkey") - 1).alias("b"))
    return GP.entity_issues(c, e, "id", "name", "kind", "a", "b")


@query("SELECT c_custkey, (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT + (n IS NULL)::INT AS gaps FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE (c_custkey % 3 = 0)::INT + (c_custkey % 4 = 0)::INT + (n IS NULL)::INT > 0 ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 60")
def knowledge_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("kind", F.when(F.col("c_custkey") % 3 != 0, "k")).withColumn("website", F.when(F.col("c_custkey") % 4 != 0, "w"))
    intel = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return GP.knowledge_gaps(c, intel, "c_custkey", ["kind", "website"], "c_acctbal", 60).select("c_custkey", "gaps")


@query("WITH i AS (SELECT o_custkey AS id, count(*) AS n, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1) SELECT id, CASE WHEN n >= 20 OR p >= 5 THEN 'gap_filling' ELSE 'discovery' END AS mode, 2 + CASE WHEN n / 20 >= 0.7 THEN 1 WHEN n / 20 < 0.3 THEN -1 ELSE 0 END AS depth FROM i")
def crawl_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("p"))
    mode, depth = GP.crawl_plan(F.col("n"), F.col("p"), F.col("n") / 20)
    return i.select("id", mode.alias("mode"), depth.alias("depth"))


@query("""
WITH d AS (SELECT user_id AS id, list(event_type ORDER BY event_id) AS names, count(DISTINCT event_type) AS filled, min(event_id) AS first FROM events GROUP BY user_id),
s AS (SELECT id, first, least(1.0, ((first % 5 > 0)::INT + (filled > 1)::INT + (filled > 3)::INT) / 3)::DOUBLE AS c, 1.0::DOUBLE - CASE WHEN len(list_distinct(names)) < len(names) THEN 0.1 ELSE 0.0 END AS k, 1.0::DOUBLE - CASE WHEN first % 4 = 0 THEN 0.2 ELSE 0.0 END AS p, first % 5 > 0 AS basic FROM d)
SELECT id, round(c, 6) AS completeness, round(k, 6) AS consistency, round(p, 6) AS plausibility, round(c * 0.4 + k * 0.3 + p * 0.3, 6) AS overall, round(c * 0.4 + k * 0.3 + p * 0.3, 6) >= 0.6 AND basic AS passed FROM s
""")
def quality_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = events(spark, sf_dir).groupBy(F.col("user_id").alias("id")).agg(F.collect_list("event_type").alias("names"), F.count_distinct("event_type").alias("filled"), F.min("event_id").alias("first"))
    none = F.array().cast("array<string>")
    founded = F.when(F.col("first") % 4 == 0, "2090").otherwise("1990")
    q = GP.quality({"basic_info": F.col("first") % 5 > 0, "persons": F.col("filled") > 1, "events": F.col("filled") > 3}, F.col("names"), none, none, founded, 2026)
    return d.select("id", *(c.alias(n) for n, c in q.items()))


@query("SELECT p_name AS name, 'brand' AS field, count(DISTINCT lower(trim(p_brand))) AS n_values, min(lower(trim(p_brand))) AS first_value, max(lower(trim(p_brand))) AS last_value FROM part GROUP BY p_name HAVING count(DISTINCT lower(trim(p_brand))) > 1")
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GP.contradictions(parts(spark, sf_dir).select(F.col("p_name").alias("name"), F.lit("brand").alias("field"), F.col("p_brand").alias("value")), "name", "field", "value")


# ---------------------------------------------------------------- resolution
@query("SELECT lower(p_name) AS norm, count(*) AS members, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.duplicate_groups(parts(spark, sf_dir), "p_partkey", F.lower("p_name"))


@query("SELECT grp, members, p_partkey AS canonical_id, p_name AS canonical_name FROM (SELECT lower(p_name) AS grp, p_partkey, p_name, count(*) OVER (PARTITION BY lower(p_name)) AS members, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_size DESC, p_retailprice DESC, length(p_name) DESC, p_partkey) AS r FROM part) WHERE r = 1")
def canonical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.canonical_choice(parts(spark, sf_dir), F.lower("p_name"), "p_partkey", F.col("p_size"), F.col("p_retailprice"), "p_name")


@query("WITH m AS (SELECT p_partkey AS old_id, min(p_partkey) OVER (PARTITION BY p_name) AS new_id FROM part) SELECT l_suppkey AS src, new_id AS dst, l_returnflag AS kind, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem JOIN m ON old_id = l_partkey WHERE l_suppkey <> new_id GROUP BY ALL")
def merge_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = R.id_map(parts(spark, sf_dir), F.col("p_name"), "p_partkey").withColumnRenamed("old_id", "dst").withColumnRenamed("new_id", "_new")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    moved = rows.join(ids, "dst", "left").withColumn("dst", F.coalesce("_new", "dst")).filter("src <> dst")
    return moved.groupBy("src", "dst", "kind").agg(F.min("id").alias("id"))


@query("""
WITH e AS (SELECT p_partkey AS id, lower(trim(p_brand)) AS norm, CASE p_size % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'org' WHEN 2 THEN 'company' ELSE 'person' END AS k, CASE p_size % 4 WHEN 0 THEN 10 WHEN 1 THEN 50 WHEN 2 THEN 55 ELSE 50 END AS p FROM part),
b AS (SELECT norm, id AS new_id, k AS bk FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY p DESC, id) AS r, count(*) OVER (PARTITION BY norm) AS n FROM e) WHERE r = 1 AND n > 1)
SELECT e.norm, e.id AS old_id, new_id, bk AS kind FROM e JOIN b ON e.norm = b.norm WHERE e.id <> new_id AND (e.k = 'entity' OR bk = 'entity' OR e.k = bk OR (bk = 'company' AND e.k = 'org'))
""")
def cross_kind_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_size") % 4
    rows = parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), F.when(k == 0, "entity").when(k == 1, "organization").when(k == 2, "company").otherwise("person").alias("kind"))
    return R.cross_kind(rows, "id", "name", "kind")


@query("WITH r AS (SELECT lower(trim(p_name)) AS norm, p_name, p_partkey, p_brand, CASE WHEN p_size > 25 THEN p_type END AS t FROM part) SELECT norm, count(*) AS seen, max(p_partkey) AS last_seen, arg_min(p_brand, p_partkey) AS brand, arg_min(t, p_partkey) FILTER (t IS NOT NULL) AS type FROM r GROUP BY norm")
def save_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(""))
    rows = parts(spark, sf_dir).select(F.col("p_name").alias("name"), F.lit("product").alias("kind"), data.alias("data"), F.col("p_partkey").alias("pos"))
    return R.save_entities(rows, "pos").select("norm", "seen", "last_seen", F.col("data")["brand"].alias("brand"), F.try_element_at("data", F.lit("type")).alias("type"))


@query("SELECT id, field, value FROM (SELECT user_id AS id, 'k' AS field, json_extract_string(props, '$.k') AS value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE json_extract_string(props, '$.k') NOT IN ('0', '')) WHERE r = 1")
def intel_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("user_id").alias("id"), "event_id", "value", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("data"))
    return R.merge_first(rows, "id", "data", [-F.col("value"), F.col("event_id")])


@query("SELECT section, item, count(*) AS mentions, min(event_id) AS first_id, count(DISTINCT user_id) AS sources FROM (SELECT event_type AS section, CAST(json_extract(props, '$.k') AS INT) AS item, event_id, user_id FROM events) GROUP BY ALL")
def intel_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("event_type").alias("section"), F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("item"), "event_id", "user_id")
    return A.first_wins(rows, ["section", "item"], "event_id", "user_id")


@query("SELECT user_id, event_type, event_id, ts, ts = max(ts) OVER (PARTITION BY user_id, event_type) AS is_current FROM events")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.field_values(events(spark, sf_dir).select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], "ts")


# ---------------------------------------------------------------- aggregates and catalogues
@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'events', count(*) FROM events")
def db_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table_counts({n: table(spark, sf_dir, n) for n in ("customer", "supplier", "part", "events")})


@query("SELECT user_id, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'missing') AS missing FROM events GROUP BY user_id")
def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.status_counts(events(spark, sf_dir), "user_id", "event_type", ["signup", "error", "missing"])


@query("SELECT l_partkey, l_shipmode AS label FROM (SELECT l_partkey, l_returnflag AS l_shipmode, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, min(l_orderkey), l_returnflag) AS r FROM lineitem GROUP BY l_partkey, l_returnflag) WHERE r = 1")
def best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.best_label(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag", "l_orderkey").withColumnRenamed("l_returnflag", "label")


@query("SELECT user_id, list(event_type ORDER BY first_id) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_id) AS r FROM (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL)) WHERE r <= 3 GROUP BY user_id")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.first_values(events(spark, sf_dir), "user_id", "event_type", "event_id", 3).withColumnRenamed("values", "kinds")


@query("SELECT count(*) AS total, count(*) FILTER (event_type = 'view') AS hits, round(count(*) FILTER (event_type = 'view') / count(*), 6) AS hit_rate, count(*) FILTER (ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events)) AS valid FROM events")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return A.cache_stats(e, F.col("event_type") == "view", "ts", e.agg(F.max("ts")).first()[0], 7)


@query("SELECT db, type, id, name FROM (SELECT *, row_number() OVER (PARTITION BY db, type ORDER BY name, id) AS r FROM (SELECT 'a' AS db, 'customer' AS type, c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%1%' UNION ALL SELECT 'b', 'supplier', s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%1%')) WHERE r <= 10")
def global_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.lit("a").alias("db"), F.lit("customer").alias("type"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.lit("b").alias("db"), F.lit("supplier").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return A.global_search([a, b], "1", 10)


@query("SELECT coalesce(s.id, t.id) AS id, coalesce(s.name, t.name) AS name FROM (SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0) t FULL JOIN (SELECT c_custkey AS id, c_name || '*' AS name FROM customer WHERE c_custkey % 3 = 0) s ON s.id = t.id")
def merge_databases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.pages import upsert

    c = table(spark, sf_dir, "customer")
    target = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    source = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat("c_name", F.lit("*")).alias("name"))
    return upsert(target, source, "id")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'new' WHEN b.id IS NULL THEN 'deleted' WHEN a.h <> b.h THEN 'modified' ELSE 'same' END AS change FROM (SELECT p_partkey AS id, p_brand AS h FROM part WHERE p_partkey % 5 > 0) a FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE p_brand END AS h FROM part WHERE p_partkey % 7 > 0) b ON a.id = b.id")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = parts(spark, sf_dir)
    before = p.filter("p_partkey % 5 > 0").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("h"))
    after = p.filter("p_partkey % 7 > 0").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(F.col("p_brand")).alias("h"))
    return A.snapshot_diff(before, after, "id", "h")


@query("SELECT s.source, s.n_docs, s.chars, round(s.chars / s.n_docs, 4) AS mean_chars FROM (SELECT source, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source) s")
def source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_chars").alias("chars"))
    return g.withColumn("mean_chars", F.round(F.col("chars") / F.col("n_docs"), 4))


@query("SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(c_name || '#x', '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')) AS safe FROM customer")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", T.safe_name(F.concat("c_name", F.lit("#x"))).alias("safe"))


# ---------------------------------------------------------------- streams' batch twins
@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
w AS (SELECT user_id, event_id, r, ts AS accepted_ts, true AS accepted FROM e WHERE r = 1
  UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.ts - w.accepted_ts >= INTERVAL 12 HOUR THEN e.ts ELSE w.accepted_ts END, e.ts - w.accepted_ts >= INTERVAL 12 HOUR FROM w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
SELECT user_id, event_id FROM w WHERE accepted
""")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.throttle import throttle_batch

    return throttle_batch(events(spark, sf_dir), "user_id", "ts", "event_id", 12 * 3600).select("user_id", "event_id")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.windows import tumbling

    return tumbling(events(spark, sf_dir), "ts", "1 hour", ["event_type"], "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOUR AND ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.windows import sessions

    return sessions(events(spark, sf_dir), "ts", "6 hours", ["user_id"])


@query("SELECT user_id AS task_id, status, progress FROM (SELECT user_id, event_type AS status, least(1.0, greatest(0.0, value / 100)) AS progress, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def task_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.tasks import latest_state

    rows = events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 100)).alias("progress"), "ts", "event_id")
    return latest_state(rows, "task_id", ["ts", "event_id"]).select("task_id", "status", "progress")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view' ORDER BY ts DESC, event_id DESC LIMIT 1000")
def event_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).filter("event_type <> 'view'").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000)


@query("SELECT o_orderkey, place FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS place FROM orders) WHERE place <= 100")
def task_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.streaming.tasks import schedule

    return schedule(table(spark, sf_dir, "orders"), [F.asc("o_orderpriority"), F.asc("o_orderdate"), F.asc("o_orderkey")], 100).select("o_orderkey", "place")
