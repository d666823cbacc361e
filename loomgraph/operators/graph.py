"""Views of a graph: neighbours, hops, degrees, statistics, details, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import build
from loomgraph.operators.search import label
from loomgraph.sources.shared import spill


def has_node(nodes: DataFrame, id_: str) -> bool:
    return not nodes.filter(F.col("id") == id_).isEmpty()


def node(nodes: DataFrame, id_: str) -> DataFrame:
    return nodes.filter(F.col("id") == id_)


def neighbors(edges: DataFrame, id_: str) -> DataFrame:
    out = edges.filter(F.col("source") == id_).select(F.col("target").alias("id"))
    return out.unionByName(edges.filter(F.col("target") == id_).select(F.col("source").alias("id"))).distinct()


def incident_edges(edges: DataFrame, id_: str) -> DataFrame:
    """direction, source, target, type; a loop is both outgoing and incoming."""
    side = lambda c, name: edges.filter(F.col(c) == id_).select(F.lit(name).alias("direction"), "source", "target", "type")
    return side("source", "out").unionByName(side("target", "in"))


def both_ways(edges: DataFrame) -> DataFrame:
    pairs = edges.select("source", "target").distinct()
    return pairs.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(pairs.select(F.col("target").alias("a"), F.col("source").alias("b")))


def traverse(nodes: DataFrame, edges: DataFrame, id_: str, hops: int = 1) -> DataFrame:
    """(id, depth) of nodes within so many hops, whichever way edges point. Every hop moves each node it finds once.

    Links and hops are written, so the plan of a hop holds no earlier one; an empty hop ends the walk.
    """
    spark = nodes.sparkSession
    seen = spark.createDataFrame([(id_, 0)], "id string, depth int")
    ways = spill(both_ways(edges), "ways") if hops > 1 else both_ways(edges)
    frontier = seen
    for depth in range(1, hops + 1):
        reached = ways.join(frontier.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:
            frontier = spill(frontier, "hop")
            if frontier.isEmpty():
                break
        seen = seen.unionByName(frontier)
    return seen.join(nodes.select("id").distinct(), "id", "left_semi")


def degrees(edges: DataFrame, base: float = 3.0) -> DataFrame:
    """(id, degree, radius): ends of edges, and the size at which a viewer draws the node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return ends.withColumn("radius", base + F.least(F.lit(6.0), F.sqrt("degree") * 1.5))


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges."""
    return nodes.agg(F.count("*").alias("nodes")).withColumn("edges", edges.agg(F.count("*")).scalar())


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, type, count) of nodes and edges; a missing type is `unknown`."""
    of = lambda rows, name: rows.groupBy(F.coalesce(F.nullif("type", F.lit("")), F.lit("unknown")).alias("type")).count().select(F.lit(name).alias("what"), "type", "count")
    return of(nodes, "node").unionByName(of(edges, "edge"))


def of_types(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the types, and edges with both ends visible."""
    shown = nodes.filter(F.col("type").isin(*types))
    return shown, build.existing(edges, shown)


def detail(nodes: DataFrame, edges: DataFrame, id_: str) -> DataFrame:
    """(direction, edge_type, other, other_type, label) of a node's edges."""
    rows = incident_edges(edges, id_).withColumn("other", F.when(F.col("direction") == "out", F.col("target")).otherwise(F.col("source")))
    named = nodes.select(F.col("id").alias("other"), F.col("type").alias("other_type"), label(nodes).alias("label"))
    return rows.join(named, "other", "left").select("direction", F.col("type").alias("edge_type"), "other", "other_type", "label")


def merge(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Attributes of b win over those of a, edges of a over those of b. Nothing is filtered or ranked again."""
    late = lambda rows, c: rows.withColumn(c, F.col(c).withField("run", F.col(c)["run"] + 1_000_000))
    edges = build.unique_edges(a[1].unionByName(late(b[1], "ord")))
    nodes = build.overlay(a[0], late(b[0], "node_ord"))
    return build.with_endpoints(nodes, edges), edges
