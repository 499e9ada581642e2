"""Graph operators over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.sources.storage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 50) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable), edges taken both ways.

    Each round takes the smallest label among the neighbours and then follows
    labels to their own label, so that long paths shrink by halves. The minimum is
    aggregated before the shuffle, so a node with very many edges costs one row a
    task; a round's result is written to the shared folder.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "cc-labels")
    for _ in range(rounds):
        offered = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("offer"))
        nearer = labels.join(offered, "node").select("node", "component", F.least("component", "offer").alias("near"))
        after = labels.select(F.col("node").alias("at"), F.col("component").alias("next"))
        moved = cut(nearer.join(after, F.col("near") == F.col("at"), "left").select("node", F.least("near", F.coalesce("next", "near")).alias("component"), (F.least("near", F.coalesce("next", "near")) != F.col("component")).alias("moved")), "cc-labels")
        labels = moved.select("node", "component")
        if not moved.filter("moved").limit(1).count():
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")


def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def bfs(edges: DataFrame, seeds: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """``node`` and its distance from the nearest seed, up to ``depth``, edges taken both ways."""
    both = _both_ways(edges, src, dst)
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1)
        reached = both.join(front, F.col("a") == F.col("node")).select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        if not (step := cut(reached.withColumn("depth", F.lit(d)), "bfs")).limit(1).count():
            break
        seen = cut(seen.unionByName(step), "bfs")
    return seen


def bfs_top(edges: DataFrame, seeds: DataFrame, src: str, dst: str, depth: int, top: int) -> DataFrame:
    """Traversal that keeps at each depth the ``top`` nodes with most connections to the frontier."""
    both = _both_ways(edges, src, dst)
    seen = cut(seeds.select(F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("connections")).distinct(), "bfs-top")
    for d in range(1, depth + 1):
        front = seen.filter(F.col("depth") == d - 1)
        ranked = both.join(front.select("node"), F.col("a") == F.col("node")).select(F.col("b").alias("node")).join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.count("*").alias("connections"))
        step = cut(ranked.orderBy(F.desc("connections"), "node").limit(top).select("node", F.lit(d).alias("depth"), "connections"), "bfs-top")
        if not step.limit(1).count():
            break
        seen = cut(seen.unionByName(step), "bfs-top")
    return seen


def shortest_path(edges: DataFrame, start, goal, src: str, dst: str, most: int = 5) -> list:
    """Nodes of one shortest undirected path, or []; one node where start and goal are the same."""
    if start == goal:
        return [start]
    both = _both_ways(edges, src, dst)
    spark = edges.sparkSession
    kind = both.schema["a"].dataType.simpleString()
    seen = cut(spark.createDataFrame([(start, None, 0)], f"node {kind}, parent {kind}, depth int"), "path")
    for d in range(1, most + 1):
        front = seen.filter(F.col("depth") == d - 1).select("node")
        step = both.join(front, F.col("a") == F.col("node")).groupBy(F.col("b").alias("found")).agg(F.min("a").alias("parent"))
        step = cut(step.join(seen.select(F.col("node").alias("found")), "found", "left_anti").select(F.col("found").alias("node"), "parent", F.lit(d).alias("depth")), "path")
        seen = cut(seen.unionByName(step), "path")
        if step.filter(F.col("node") == F.lit(goal)).limit(1).count():
            path, at = [goal], goal
            while at != start:  # at most ``most`` lookups
                at = seen.filter(F.col("node") == F.lit(at)).first()["parent"]
                path.append(at)
            return path[::-1]
        if not step.limit(1).count():
            break
    return []


def clusters(edges: DataFrame, src: str, dst: str, least: int = 2) -> DataFrame:
    """Components with at least ``least`` nodes and their sizes."""
    labels = connected_components(edges, src, dst)
    return labels.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)


def shared_neighbours(edges: DataFrame, src: str, dst: str, least: int = 2) -> DataFrame:
    """Pairs of sources with ``least`` common targets or more."""
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("nbr")).distinct()
    return e.join(e.withColumnRenamed("a", "b"), "nbr").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)


def predict_links(edges: DataFrame, src: str, dst: str, top: int) -> DataFrame:
    """Unconnected pairs by their number of common neighbours."""
    both = cut(_both_ways(edges, src, dst), "predict")
    pairs = shared_neighbours(both, "a", "b", 1)
    direct = both.select("a", "b")
    confidence = F.round(F.least(F.lit(0.95), 0.3 + 0.15 * F.col("shared")), 6)
    return pairs.join(direct, ["a", "b"], "left_anti").withColumn("confidence", confidence).orderBy(F.desc("shared"), "a", "b").limit(top)


def explore(edges: DataFrame, seeds: DataFrame, src: str, dst: str, depth: int, top: int) -> DataFrame:
    """Nodes within reach by priority: .7 for distance, .3 for degree (10 counts in full)."""
    from skein.operators.edges import degree

    found = bfs(edges, seeds, src, dst, depth).filter("depth > 0")
    score = F.round(0.7 * F.col("depth") / depth + 0.3 * F.least(F.col("degree") / 10, F.lit(1.0)), 3)
    return found.join(degree(edges, src, dst), "node").select("node", "depth", "degree", score.alias("priority")).orderBy(F.desc("priority"), "node").limit(top)


def ego(edges: DataFrame, seeds: DataFrame, src: str, dst: str, depth: int) -> DataFrame:
    """Edges between nodes within ``depth`` of the seeds; a depth below 0 or from 99 on keeps all."""
    if depth < 0 or depth >= 99:
        return edges
    near = bfs(edges, seeds, src, dst, depth).select("node")
    return edges.join(near.withColumnRenamed("node", src), src, "left_semi").join(near.withColumnRenamed("node", dst), dst, "left_semi")
