"""Inference: a registry of rules over entities and edges, heuristics over text, and applied facts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[DataFrame, DataFrame], DataFrame]
RULES: dict[str, Rule] = {}
FACT = ("entity_id", "field", "value", "confidence", "rule", "via")


def register_rule(name: str, rule: Rule) -> None:
    """Adds a rule: a function of (entities, edges) that gives facts (entity_id, field, value, confidence, via)."""
    RULES[name] = rule


def _through(relation: str, source_kind: str, field: str, inferred: str, confidence: float) -> Rule:
    def rule(entities: DataFrame, edges: DataFrame) -> DataFrame:
        e = edges.filter(F.col("relation_type") == relation)
        s = entities.filter(F.col("kind") == source_kind).select(F.col("id").alias("source_id"), F.col("data").alias("own"))
        t = entities.select(F.col("id").alias("target_id"), F.try_element_at("data", F.lit(field)).alias("value"))
        rows = e.join(s, "source_id").join(t, "target_id").filter(F.col("value").isNotNull() & ~F.coalesce(F.array_contains(F.map_keys("own"), field), F.lit(False)))
        return rows.groupBy(F.col("source_id").alias("entity_id")).agg(F.min_by("value", "target_id").alias("value"), F.min("target_id").alias("via")).select("entity_id", F.lit(inferred).alias("field"), "value", F.lit(confidence).alias("confidence"), "via")

    return rule


register_rule("workplace_location", _through("works_at", "person", "location", "probable_location", 0.75))
register_rule("workplace_industry", _through("works_at", "person", "industry", "industry", 0.85))


def infer(entities: DataFrame, edges: DataFrame, least: float = 0.0, fields: list[str] | None = None, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Facts of all rules with provenance, above a confidence, of the wanted fields."""
    parts = [rule(entities, edges).withColumn("rule", F.lit(name)).select(*FACT) for name, rule in (rules or RULES).items()]
    facts = reduce(DataFrame.unionByName, parts).filter(F.col("confidence") >= least)
    return facts.filter(F.col("field").isin(*fields)) if fields else facts


def apply_facts(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """Entities with the surest fact of each field put in where they have none."""
    best = facts.groupBy("entity_id", "field").agg(F.max_by("value", F.struct("confidence", "rule")).alias("value"))
    added = best.groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("_new"))  # one entry per field and rule set
    rows = entities.join(added.withColumnRenamed("entity_id", "id"), "id", "left")
    new = F.map_filter("_new", lambda k, v: ~F.array_contains(F.map_keys("data"), k))
    return rows.withColumn("data", F.when(F.col("_new").isNotNull(), F.map_concat("data", new)).otherwise(F.col("data"))).drop("_new")


#: Words that tell how two organisations near each other are related, in order of weight (fixed values).
NEAR_WORDS = (
    ("acquired", ("acquired", "buys", "bought", "acquisition", "takeover", "merged")),
    ("partners_with", ("partner", "partnership", "collaboration", "alliance", "joint")),
    ("competes_with", ("competes", "competitor", "rival", "competition", "versus")),
    ("subsidiary_of", ("subsidiary", "division", "unit", "owned by", "parent company")),
    ("invested_in", ("invested", "investment", "funding", "stake", "shareholder")),
)


def relation_near(text: Column, a: Column, b: Column, reach: int = 200, around: int = 100) -> Column:
    """The relation of two names first mentioned within ``reach`` characters: by words around them, else related_to when close; null beyond."""
    t = F.lower(text)
    i, j = F.instr(t, F.lower(a)), F.instr(t, F.lower(b))
    start = F.greatest(F.lit(1), F.least(i, j) - around)
    part = F.substring(t, start, F.abs(i - j) + 2 * around)
    out = F.when((i == 0) | (j == 0) | (F.abs(i - j) > reach), F.lit(None).cast("string"))
    for name, words in NEAR_WORDS:
        out = out.when(reduce(lambda x, y: x | y, [part.contains(w) for w in words]), name)
    return out.when(F.abs(i - j) <= around, "related_to")


#: Kinds that count as persons, organisations, places (fixed values).
PERSONS = ("person", "ceo", "founder", "executive", "board_member")
ORGANISATIONS = ("company", "organization", "org")
PLACES = ("location", "headquarters", "branch_office", "office")
#: What a person of a kind is to an organisation (fixed values); others are associated_with.
ROLES = (("ceo", "leads_as_ceo"), ("founder", "founded"), ("executive", "executive_at"), ("board_member", "board_member_of"))


def implied_relations(near: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Relations of entities that stand near each other in a text, by their kinds.

    ``near`` is (key, a, b), ``entities`` (id, name, kind, data). Person to organisation
    by the person's kind; organisation to product: produces if the product's data name
    it as its manufacturer, else associated_with_product; organisation to place:
    headquartered_at or located_at.
    """
    one = lambda p: entities.select(F.col("id").alias(p), F.col("name").alias(f"{p}_name"), F.lower("kind").alias(f"{p}_kind"), F.col("data").alias(f"{p}_data"))
    both = near.select(key, "a", "b").unionByName(near.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    rows = both.join(one("a"), "a").join(one("b"), "b")
    org = lambda p: F.col(f"{p}_kind").isin(*ORGANISATIONS)
    role = reduce(lambda x, r: x.when(F.col("a_kind") == r[0], r[1]), ROLES, F.when(F.lit(False), "")).otherwise("associated_with")
    maker = F.lower(F.try_element_at("b_data", F.lit("manufacturer")))
    made = F.when((maker != "") & F.contains(F.lower("a_name"), maker), "produces").otherwise("associated_with_product")
    place = F.when(F.col("b_kind") == "headquarters", "headquartered_at").otherwise("located_at")
    relation = F.when(F.col("a_kind").isin(*PERSONS) & org("b"), role).when(org("a") & (F.col("b_kind") == "product"), made).when(org("a") & F.col("b_kind").isin(*PLACES), place)
    return rows.select(key, F.col("a").alias("source_id"), F.col("b").alias("target_id"), relation.alias("relation_type")).filter("relation_type is not null").distinct()


def missing_fields(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Organisation, ceo and founder fields that edges imply and data lacks."""
    rules = (("works_at", "organization", 0.8, False), ("ceo_of", "ceo", 0.9, True), ("founded", "founder", 0.9, True))
    parts = []
    for relation, field, confidence, back in rules:
        own, other = ("target_id", "source_id") if back else ("source_id", "target_id")
        e = edges.filter(F.col("relation_type") == relation).select(F.col(own).alias("id"), F.col(other).alias("other"))
        rows = e.join(entities.select("id", "data"), "id").filter(~F.array_contains(F.map_keys("data"), field)).join(entities.select(F.col("id").alias("other"), F.col("name").alias("value")), "other")
        parts.append(rows.select("id", F.lit(field).alias("field"), "value", F.lit(confidence).alias("confidence")))
    return reduce(DataFrame.unionByName, parts)


def accepted_model_edges(edges: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Edges that a model proposes, kept where both ends exist and differ and the confidence suffices."""
    known = nodes.select("id")
    return edges.filter((F.col("source_id") != F.col("target_id")) & (F.col("confidence") >= least)).join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
