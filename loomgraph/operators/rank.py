"""PageRank by a fixed number of steps, scaled to the largest score.

Edges are dealt by source once and kept; a step joins scores to them where they lie, sums
contributions within tasks, and moves one row per target and task. Scores come out dealt by node,
which is how the next step needs them; every fifth step they are written, so plans stay short and
a lost executor repeats little. Mass of nodes without outgoing edges is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.sources.shared import spill


def pagerank(nodes: DataFrame, edges: DataFrame, steps: int = 20, damping: float = 0.85, parts: int | None = None, digits: int = 4) -> DataFrame:
    """(id, rank): rank is the score over the largest score, rounded. nodes: id; edges: source, target, weight (null: 1)."""
    spark = nodes.sparkSession
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n == 0:
        return ids.select("id", F.lit(None).cast("double").alias("rank"))
    parts = parts or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, n // 10_000))
    weight = F.coalesce(F.nullif("weight", F.lit(0)), F.lit(1)).cast("double")
    links = edges.select("source", "target", weight.alias("weight"))
    links = links.join(ids, links["target"] == ids["id"], "left_semi")
    out = links.groupBy("source").agg(F.sum("weight").alias("total"))
    # Parallel edges of one pair act as one with their shares added up.
    links = links.join(out, "source").groupBy("source", "target").agg(F.sum(F.col("weight") / F.col("total") * damping).alias("share"))
    links = links.repartition(parts, "source").sortWithinPartitions("source").persist()
    base = (1 - damping) / n
    start = ids.repartition(parts, "id").persist()
    scores = start.select("id", F.lit(1 / n).alias("score"))
    for i in range(steps):
        if i and i % 5 == 0:
            scores = spill(scores, "scores").repartition(parts, "id")
        sent = links.join(scores.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), (F.col("share") * F.col("score")).alias("score"))
        own = start.select("id", F.lit(base).alias("score"))
        scores = sent.unionByName(own).groupBy("id").agg(F.sum("score").alias("score"))
    scores = spill(scores, "scores")
    links.unpersist()
    start.unpersist()
    top = scores.agg(F.max("score")).scalar()
    return scores.select("id", F.when(top > 0, F.round(F.col("score") / top, digits)).otherwise(0.0).alias("rank"))


def with_rank(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    columns = nodes.columns
    return nodes.drop("rank").join(pagerank(nodes, edges), "id", "left").select(columns)
