"""The knowledge graph as nodes and edges from all tables, its seeds, views and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.functions.text import canonical_name, is_uuid, uuid5


def entity_nodes(rows: DataFrame, name: str, kind: str, score: str) -> DataFrame:
    """One node per canonical name: most frequent label, kind of highest priority, summed count, best score."""
    r = rows.select(canonical_name(name).alias("canonical"), F.col(name).alias("label"), K.normalized_kind(F.col(kind)).alias("kind"), F.col(score).alias("score")).filter("canonical <> ''")
    labels = r.groupBy("canonical", "label").agg(F.count("*").alias("n")).groupBy("canonical").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
    main = r.groupBy("canonical").agg(F.max_by("kind", F.struct(K.priority(F.col("kind")), F.col("kind"))).alias("kind"), F.count("*").alias("count"), F.max("score").alias("score"))
    return main.join(labels, "canonical").select(uuid5(F.concat(F.lit("entity:"), "canonical")).alias("id"), "label", "kind", "count", "score")


def assemble(parts: list[DataFrame], edges: list[DataFrame], limit: int, seeds: DataFrame | None = None, least_edge: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes of several tables, seeds first, best first, and the edges between those kept."""
    nodes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).groupBy("id").agg(F.max_by("label", F.struct("score", "label")).alias("label"), F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.sum("count").alias("count"), F.max("score").alias("score"))
    if seeds is not None:
        nodes = nodes.join(seeds.select("id", F.lit(True).alias("seed")).distinct(), "id", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    else:
        nodes = nodes.withColumn("seed", F.lit(False))
    kept = nodes.orderBy(F.desc("seed"), F.desc("score"), F.desc("count"), "id").limit(limit)
    e = reduce(DataFrame.unionByName, edges).groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.sum("weight").alias("weight"), F.max("kind").alias("kind"))
    ids = kept.select("id")
    e = e.filter(F.col("weight") >= least_edge).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept, e


def seeds_for(nodes: DataFrame, query: str | None, semantic: DataFrame | None = None) -> DataFrame:
    """No query: all nodes; a UUID: that node; else nodes whose label or id contains it, and semantic hits."""
    if not query:
        return nodes.select("id")
    q = query.lower()
    exact = nodes.filter(F.lower("id") == q).select("id")
    part = nodes.filter(F.lower("label").contains(q) | F.lower("id").contains(q)).select("id")
    found = exact if nodes.sparkSession.range(1).select(is_uuid(F.lit(query))).first()[0] else part
    return found.unionByName(semantic.select("id")).distinct() if semantic is not None else found


def export(entities: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Edges of enough confidence (missing counts as 1) with both ends among the entities."""
    ids = entities.select("id")
    return edges.filter(F.coalesce("confidence", F.lit(1.0)) >= least).join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")


def depth_counts(reached: DataFrame) -> DataFrame:
    """How many nodes each depth has."""
    return reached.groupBy("depth").agg(F.count("*").alias("nodes"))


def entity_view(entities: DataFrame, edges: DataFrame, intel: DataFrame, root, depth: int = 2) -> DataFrame:
    """One row per entity within ``depth`` of the root: its data, degree and number of findings."""
    from skein.operators.edges import degree
    from skein.operators.graph import bfs

    seed = entities.filter(F.col("id") == F.lit(root)).select("id")
    near = bfs(edges, seed, "source_id", "target_id", depth).withColumnRenamed("node", "id")
    d = degree(edges, "source_id", "target_id").withColumnRenamed("node", "id")
    n = intel.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("findings"))
    return near.join(entities, "id").join(d, "id", "left").join(n, "id", "left").na.fill(0, ["degree", "findings"])


def lookup(tables: dict[str, DataFrame], node) -> DataFrame:
    """A node wherever it is kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.filter(F.col("id") == F.lit(node)).withColumn("entry_type", F.lit(n)) for n, t in tables.items()])


def entries(tables: dict[str, DataFrame]) -> DataFrame:
    """The view over all subtype tables that orphan checks and type backfill need."""
    return reduce(DataFrame.unionByName, [t.select("id", F.lit(n).alias("entry_type")) for n, t in tables.items()])


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair and type."""
    return edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "relation_type").distinct()


def kind_filter(entities: DataFrame, kind: str, wanted: str) -> DataFrame:
    """Entities of a kind, its descendants, its ancestors, or of no particular kind."""
    spark = entities.sparkSession
    closure = K.closure_table(spark)
    down = closure.filter(F.col("ancestor") == wanted).select("kind")
    up = closure.filter(F.col("kind") == wanted).select(F.col("ancestor").alias("kind"))
    generic = spark.createDataFrame([(g,) for g in K.GENERIC if g], "kind string")
    allowed = F.broadcast(down.unionByName(up).unionByName(generic).distinct())  # at most the table of kinds
    return entities.withColumn("_k", K.normalized_kind(F.col(kind))).join(allowed.withColumnRenamed("kind", "_k"), "_k", "left_semi").drop("_k")
