"""Joins whose keys many rows share: results against plain code, and how much work they make."""

from pyspark.sql import functions as F

from skein.operators import joins, mentions
from skein.plans import service_queries


def most_rows(df):
    """The most rows that any node of the executed plan put out, and the rows."""
    from pyspark.sql.classic.dataframe import DataFrame

    jdf = df._jdf
    rows = DataFrame(jdf, df.sparkSession).collect()
    todo, most = [jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        metric = node.metrics().get("numOutputRows")
        most = max(most, metric.get().value() if metric.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most, rows


def test_substring_mentions_look_for_a_name_once(spark):
    texts = [(i, "ohnrc") for i in range(300)] + [(300, "OLD, older, household"), (301, None), (302, "")]
    entities = [(i, "old") for i in range(300)] + [(300, "house"), (301, ""), (302, None), (303, "hold"), (304, "holds")]
    got = mentions.substring_mentions(spark.createDataFrame(texts, "k long, x string"), spark.createDataFrame(entities, "e long, name string"), "k", "x", "e", "name")
    most, rows = most_rows(got)
    assert sorted(map(tuple, rows)) == [(300, i, 3 if i < 300 else 1) for i in (*range(301), 303)]
    assert most < 20_000  # 300 texts by 300 entities of one name were 90,000 candidates


def test_all_pairs_are_an_inner_join(spark):
    left = [(i % 3 if i < 40 else None if i < 45 else i, i, None if i % 7 else f"l{i}") for i in range(60)]
    right = [(1 if i < 30 else 0 if i < 35 else None if i < 40 else i, i) for i in range(60)]
    a, b = spark.createDataFrame(left, "k long, x long, y string"), spark.createDataFrame(right, "k long, z long")
    want = sorted(((x, y or "", z) for k, x, y in left for j, z in right if k is not None and k == j))
    for size in (1, 4, 1000):
        assert sorted((r.x, r.y or "", r.z) for r in joins.all_pairs(a, b, "k", size).collect()) == want
    assert joins.all_pairs(a.limit(0), b, "k").count() == 0


def test_seed_entities_spread_one_name_over_tasks(spark, tmp_path):
    spark.range(30_000).select((F.col("id") * 3).alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(5).select(F.col("id").alias("p_partkey"), F.lit("Hot gear").alias("p_name")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    rows = service_queries.seed_entities(spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in rows) == 150_000
    assert len(rows) > 2  # of four; all rows of the name were in one
