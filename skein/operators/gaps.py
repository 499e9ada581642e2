"""Data gaps, completeness, queries to fill them, and quality of entities and findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.functions.text import is_truthy, year

WEIGHTS = {"critical": 3, "important": 2, "supplementary": 1}
POINTS = {"critical": 10, "important": 5, "supplementary": 1}


def present_fields(entities: DataFrame, key: str, data: str) -> DataFrame:
    """(key, field) of meaningful values of a map column; spellings without marks and of any case count."""
    rows = entities.select(key, F.explode(data).alias("field", "value")).filter(is_truthy("value"))
    return rows.select(key, F.regexp_replace(F.lower("field"), "[_ ]", "").alias("bare")).distinct()


def gaps(entities: DataFrame, key: str, kind: str, data: str) -> DataFrame:
    """Expected fields that an entity lacks, with category, findability and score."""
    spark = entities.sparkSession
    expected = F.broadcast(K.expected_fields(spark).withColumn("bare", F.regexp_replace(F.lower("field"), "[_ ]", "")))  # a fixed table
    wanted = entities.select(key, K.entity_type(F.col(kind)).alias("entity_type")).join(expected, "entity_type")
    missing = wanted.join(present_fields(entities, key, data), [key, "bare"], "left_anti")
    points = F.when(F.col("priority") == "critical", 10).when(F.col("priority") == "important", 5).otherwise(1)
    found = K.findability(F.col("field"))
    return missing.select(key, "entity_type", "priority", "field", K.field_category(F.col("field")).alias("category"), found.alias("findability"), F.round(points * found, 6).alias("score"))


def completeness(entities: DataFrame, key: str, kind: str, data: str) -> DataFrame:
    """Weighted share of expected fields that are there, in percent; 0 where none is expected."""
    spark = entities.sparkSession
    expected = F.broadcast(K.expected_fields(spark).withColumn("bare", F.regexp_replace(F.lower("field"), "[_ ]", "")))
    weight = F.when(F.col("priority") == "critical", 3).when(F.col("priority") == "important", 2).otherwise(1)
    there = present_fields(entities, key, data).withColumn("there", F.lit(1))
    wanted = entities.select(key, K.entity_type(F.col(kind)).alias("entity_type")).join(expected, "entity_type", "left").join(there, [key, "bare"], "left")
    share = F.try_divide(100 * F.sum(F.when(F.col("there") == 1, weight).otherwise(0)), F.sum(F.when(F.col("field").isNotNull(), weight).otherwise(0)))
    return wanted.groupBy(key).agg(F.round(F.coalesce(share, F.lit(0.0)), 2).alias("completeness"))


#: Search templates by category of gap and by entity type (fixed values).
GAP_QUERIES = (("category", "business", '"%s" revenue employees industry'), ("category", "business", '"%s" company information'), ("category", "location", '"%s" headquarters location address'), ("category", "temporal", '"%s" founded history'), ("category", "contact", '"%s" official website contact'), ("category", "descriptive", '"%s" about description overview'), ("category", "hierarchical", '"%s" leadership team management'), ("type", "company", '"%s" investor relations'), ("type", "company", '"%s" annual report'), ("type", "person", '"%s" biography'), ("type", "person", '"%s" linkedin profile'))
DISCOVERY_QUERIES = {"": ('"%s"', '"%s" official', '"%s" information'), "company": ('"%s" company', '"%s" investor relations', '"%s" about us', '"%s" corporate information'), "person": ('"%s" biography', '"%s" profile', '"%s" linkedin', '"%s" about'), "product": ('"%s" product', '"%s" specifications', '"%s" details')}


def gap_queries(gaps: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct searches that may fill an entity's gaps."""
    spark = gaps.sparkSession
    table = F.broadcast(spark.createDataFrame(GAP_QUERIES, "by string, value string, template string"))  # a fixed table
    what = gaps.select(key, F.lit("category").alias("by"), F.col("category").alias("value")).unionByName(gaps.select(key, F.lit("type").alias("by"), F.col("entity_type").alias("value"))).distinct()
    return what.join(table, ["by", "value"]).join(names.select(key, name), key).select(key, F.replace("template", F.lit("%s"), F.col(name)).alias("query")).distinct()


def discovery_queries(entities: DataFrame, key: str, name: str, kind: Column) -> DataFrame:
    parts = [F.array(*map(F.lit, DISCOVERY_QUERIES[""]))]
    extra = F.lit(None).cast("array<string>")
    for t, q in DISCOVERY_QUERIES.items():
        if t:
            extra = F.when(kind == t, F.array(*map(F.lit, q))).otherwise(extra)
    templates = F.concat(parts[0], F.coalesce(extra, F.array().cast("array<string>")))
    return entities.select(key, name, F.posexplode(templates).alias("pos", "t")).select(key, "pos", F.replace("t", F.lit("%s"), F.col(name)).alias("query"))


def knowledge_gaps(entities: DataFrame, intel: DataFrame, key: str, fields: list[str], updated: str, limit: int) -> DataFrame:
    """Entities updated longest ago with the number of missing basics, one more without any finding."""
    n = intel.groupBy(key).agg(F.count("*").alias("_n"))
    missing = sum((F.col(f).isNull().cast("int") for f in fields), F.lit(0)) + F.col("_n").isNull().cast("int")
    return entities.join(n, key, "left").withColumn("gaps", missing).filter("gaps > 0").orderBy(F.asc_nulls_first(updated), key).limit(limit)


def entity_issues(entities: DataFrame, edges: DataFrame, key: str, name: str, kind: str, src: str, dst: str) -> DataFrame:
    """Missing names, missing kinds and entities without any edge."""
    ends = edges.select(F.col(src).alias(key)).unionByName(edges.select(F.col(dst).alias(key))).distinct().withColumn("_e", F.lit(True))
    rows = entities.join(ends, key, "left")
    issues = F.array_compact(F.array(F.when(F.coalesce(F.trim(F.col(name)), F.lit("")) == "", "missing_name"), F.when(F.coalesce(F.trim(F.col(kind)), F.lit("")) == "", "missing_kind"), F.when(F.col("_e").isNull(), "orphan")))
    return rows.select(key, F.explode(issues).alias("issue"))


def crawl_plan(pages: Column, intel: Column, reliability: Column) -> tuple[Column, Column]:
    """Gap filling or discovery, and how deep to go."""
    mode = F.when((pages >= 20) | (intel >= 5), "gap_filling").otherwise("discovery")
    return mode, F.lit(2) + F.when(reliability >= 0.7, 1).when(reliability < 0.3, -1).otherwise(0)


# ---------------------------------------------------------------- findings
def quality(sections: dict[str, Column], names: Column, events: Column, places: Column, founded: Column, this_year: int) -> dict[str, Column]:
    """Completeness, consistency, plausibility and their mean of one finding, and whether it passes."""
    filled = sum((F.coalesce(c, F.lit(False)).cast("int") for c in sections.values()), F.lit(0))
    complete = F.least(F.lit(1.0), filled / 3)
    twice = lambda a: F.coalesce(F.size(F.array_distinct(a)) < F.size(a), F.lit(False))
    consistent = F.greatest(F.lit(0.0), 1.0 - F.when(twice(names), 0.1).otherwise(0.0) - F.when(twice(events), 0.05).otherwise(0.0) - F.when(twice(places), 0.05).otherwise(0.0))
    y = year(founded)
    plausible = F.lit(1.0) - F.when(y > this_year, 0.2).when(y < 1800, 0.1).otherwise(0.0)
    overall = F.round(complete * 0.4 + consistent * 0.3 + plausible * 0.3, 6)
    critical = ~F.coalesce(sections["basic_info"], F.lit(False))
    return {"completeness": F.round(complete, 6), "consistency": F.round(consistent, 6), "plausibility": F.round(plausible, 6), "overall": overall, "passed": (overall >= 0.6) & ~critical}


def contradictions(facts: DataFrame, key: str, field: str, value: str) -> DataFrame:
    """Fields for which one entity has several different values."""
    v = F.lower(F.trim(F.col(value)))
    return facts.groupBy(key, field).agg(F.count_distinct(v).alias("n_values"), F.min(v).alias("first_value"), F.max(v).alias("last_value")).filter("n_values > 1")


#: The categories of a crawl mode's completeness and the fields of each (fixed values of this library).
MODE_CATEGORIES = {"basic": ("official_name", "name", "description"), "persons": ("persons", "ceo", "leadership"), "locations": ("location", "headquarters", "address"), "financials": ("revenue", "financials"), "products": ("products",), "events": ("events",), "relationships": ("relationships",), "contact": ("website", "email", "phone"), "identity": ("ticker", "founded", "industry")}


def category_completeness(entities: DataFrame, key: str, data: str) -> DataFrame:
    """Share of the nine categories in which an entity has something, and those in which it has nothing."""
    have = F.map_keys(F.map_filter(data, lambda k, v: is_truthy(v)))
    filled = {c: F.arrays_overlap(F.transform(have, F.lower), F.array(*map(F.lit, f))) for c, f in MODE_CATEGORIES.items()}
    share = sum((F.coalesce(c, F.lit(False)).cast("int") for c in filled.values()), F.lit(0)) / len(filled)
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in filled.items())))
    return entities.select(key, F.round(share, 6).alias("completeness"), missing.alias("missing"))
