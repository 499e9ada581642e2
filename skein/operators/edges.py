"""The edge log: confidence, deduplication, validation, types and propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(edges: DataFrame, keys: list[str], boost: float = 0.1, source: str | None = None) -> DataFrame:
    """Confidence after n recordings of an edge: .5 at first, each repeat closes ``boost`` of what is missing."""
    c = F.least(F.lit(1.0), 1 - 0.5 * F.pow(F.lit(1 - boost), F.count("*") - 1))
    extra = [F.count_distinct(source).alias("n_sources")] if source else []
    return edges.groupBy(*keys).agg(F.count("*").alias("occurrence_count"), F.round(c, 6).alias("confidence"), *extra)


def high_confidence(edges: DataFrame, least: float, occurrences: int, order: list[str], limit: int) -> DataFrame:
    return edges.filter((F.coalesce("confidence", F.lit(0.5)) >= least) & (F.col("occurrence_count") >= occurrences)).orderBy(F.desc("confidence"), *order).limit(limit)


def confidence_buckets(edges: DataFrame) -> DataFrame:
    """Totals and buckets of confidence; a missing confidence counts as .5."""
    c = F.coalesce("confidence", F.lit(0.5))
    return edges.agg(F.count("*").alias("total"), F.count_if(F.col("occurrence_count") > 1).alias("repeated"), F.count_if(c >= 0.9).alias("very_high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("high"), F.count_if((c >= 0.5) & (c < 0.7)).alias("medium"), F.count_if(c < 0.5).alias("low"))


def dedup(edges: DataFrame, keys: list[str], newest: str, tie: str) -> DataFrame:
    """One edge per key: the highest confidence (missing as 0), then the newest. An aggregate, so hot keys combine before the shuffle."""
    rest = [c for c in edges.columns if c not in keys]
    order = F.struct(F.coalesce("confidence", F.lit(0.0)), F.col(newest), -F.col(tie))
    return edges.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def validate(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """``edges`` with the first failing check (circular, orphan, confidence) and the fixed confidence.

    ``confidence`` is text, as stored: what is no number becomes .5, the rest is clamped to [0, 1].
    """
    known = nodes.select(F.col(node).alias("_n")).distinct()
    rows = edges.join(known.select(F.col("_n").alias(src), F.lit(True).alias("_s")), src, "left").join(known.select(F.col("_n").alias(dst), F.lit(True).alias("_d")), dst, "left")
    c = F.col("confidence").try_cast("double")
    bad = c.isNull() | (c < 0) | (c > 1)
    issue = F.when(F.col(src) == F.col(dst), "circular").when(F.col("_s").isNull() | F.col("_d").isNull(), "orphan").when(bad, "confidence").otherwise("ok")
    return rows.withColumn("issue", issue).withColumn("fixed", F.when(c.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))).drop("_s", "_d")


def backfill_types(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing node types filled from ``entries`` (id, entry_type)."""
    e = entries.select("id", "entry_type")
    rows = edges.join(e.withColumnsRenamed({"id": "source_id", "entry_type": "_s"}), "source_id", "left").join(e.withColumnsRenamed({"id": "target_id", "entry_type": "_t"}), "target_id", "left")
    return rows.withColumn("source_type", F.coalesce("source_type", "_s")).withColumn("target_type", F.coalesce("target_type", "_t")).drop("_s", "_t")


def by_type(edges: DataFrame, kind: str = "relation_type") -> DataFrame:
    """How many edges and nodes each type has; the pairs themselves stay rows."""
    return edges.groupBy(kind).agg(F.count("*").alias("edges"), F.count_distinct("source_id").alias("sources"), F.count_distinct("target_id").alias("targets"))


def degree(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Out-, in- and total degree; a self-loop counts once in the total."""
    out = edges.select(F.col(src).alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i"), F.lit(1).alias("t"))
    into = edges.select(F.col(dst).alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"), (F.col(src) != F.col(dst)).cast("int").alias("t"))
    return out.unionByName(into).groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.sum("t").alias("degree"))


def dead_ends(nodes: DataFrame, edges: DataFrame, node: str, src: str, dst: str, limit: int) -> DataFrame:
    """Nodes with the fewest outgoing edges first."""
    d = degree(edges, src, dst).withColumnRenamed("node", node)
    rows = nodes.select(node).join(d, node, "left").na.fill(0, ["out_degree", "in_degree", "degree"])
    return rows.orderBy("out_degree", node).limit(limit).select(node, "out_degree", "in_degree")


def relation_for_kinds(source: Column, target: Column) -> Column:
    """Relation type of a pair of kinds; related_to where no rule fits."""
    org, of_org = source.isin("organization", "company"), target.isin("organization", "company")
    return (
        F.when(org & (target == "person"), "has_person").when(org & (target == "location"), "has_location").when(org & (target == "product"), "produces")
        .when((source == "person") & of_org, "works_at").when((source == "person") & (target == "event"), "participated_in")
        .when(target == "event", "associated_with_event").otherwise("related_to")
    )


def suggested_relation(kind: Column, section: Column) -> Column:
    """The relation of an entity found in a section to the main entity; people have one where they lead."""
    leader = F.when(kind.isin("ceo", "founder", "executive", "board_member"), F.concat(kind, F.lit("_of")))
    place = F.when(kind == "headquarters", "headquarters_of").when(kind == "branch_office", "branch_of").otherwise("location_of")
    return F.when(section == "persons", leader).when(section == "products", "product_of").when(section == "locations", place).when(section == "events", "event_of").when(section == "organizations", "related_organization")


def propagate(entities: DataFrame, edges: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Fields that a source lacks and the target of a ruled edge has: (entity, field, value), first edge wins.

    ``entities`` is (id, field, value) in long form, ``rules`` (relation type, field).
    """
    spark = entities.sparkSession
    rule = F.broadcast(spark.createDataFrame(rules, "relation_type string, field string"))  # a fixed table of rules
    offered = edges.join(rule, "relation_type").join(entities.withColumnsRenamed({"id": "target_id"}), ["target_id", "field"])
    missing = offered.join(entities.select(F.col("id").alias("source_id"), "field"), ["source_id", "field"], "left_anti")
    return missing.groupBy("source_id", "field").agg(F.min_by("value", "edge_id").alias("value"), F.min_by("target_id", "edge_id").alias("from_id"))


def cooccurrence(rows: DataFrame, group: str, node: str) -> DataFrame:
    """Unordered pairs of nodes that share a group, with how many groups they share."""
    pair = rows.select(group, node).distinct()
    a = pair.withColumnRenamed(node, "a")
    return a.join(pair.withColumnRenamed(node, "b"), group).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def undirected(edges: DataFrame, src: str, dst: str, weight: Column) -> DataFrame:
    """Edges as unordered pairs with summed weight and the kind of the last one."""
    return edges.groupBy(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).agg(F.sum(weight).alias("weight"), F.max_by("kind", "pos").alias("kind"))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def set_confidence(edges: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """New confidences by edge id; those outside [0, 1] are refused and the old ones stay."""
    new = wanted.filter((F.col("confidence") >= 0) & (F.col("confidence") <= 1)).select(key, F.col("confidence").alias("_c"))
    return edges.join(new, key, "left").withColumn("confidence", F.coalesce("_c", "confidence")).drop("_c")


def edges_of(edges: DataFrame, node, src: str, dst: str, key: str) -> DataFrame:
    """All edges at a node, each once."""
    return edges.filter((F.col(src) == F.lit(node)) | (F.col(dst) == F.lit(node))).dropDuplicates([key])


def merge_metadata(old: Column, new: Column) -> Column:
    """Two maps as one, new values over old ones."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)


def delete_nodes(nodes: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, DataFrame]:
    """Tables after a deletion and its cascades: child rows that refer to a deleted node by any column go."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    out = {"nodes": nodes.join(ids, F.col(key) == F.col("_gone"), "left_anti")}
    for name, (rows, columns) in children.items():
        for c in columns:
            rows = rows.join(ids, F.col(c) == F.col("_gone"), "left_anti")
        out[name] = rows
    return out


def page_relation(primary: Column, found: Column) -> Column:
    """Relation of a page's main entity to another on it, in the hyphenated words of pages."""
    org, other = primary.isin("company", "organization"), found.isin("company", "organization")
    out = F.when(org & (found == "person"), "has-person").when(org & (found == "product"), "has-product").when(org & (found == "location"), "has-location").when(org & (found == "event"), "participated-in-event")
    out = out.when((primary == "person") & other, "works-at").when((primary == "person") & (found == "location"), "located-at").when((primary == "person") & (found == "event"), "participated-in-event")
    return out.when((primary == "product") & other, "produced-by").when((primary == "product") & (found == "person"), "associated-with-person").otherwise("related-entity")
