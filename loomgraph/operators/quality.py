"""Quality filter: which nodes of a graph are worth keeping, and the subgraph they induce.

Degrees are those of the unfiltered graph, so nothing is iterated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

TEXT_TYPES = ("fact", "decision", "preference", "frustration")
#: Edges that tell where a node comes from, not what it means.
PLAIN_EDGES = ("ABOUT", "FROM_SOURCE")


def meaningful_degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges other than PLAIN_EDGES at either end; a loop counts twice."""
    kept = edges.filter(~F.coalesce("type", F.lit("")).isin(*PLAIN_EDGES))
    return kept.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def core_survivors(nodes: DataFrame, edges: DataFrame, least_mentions: int = 2, least_relations: int = 3, least_person: int = 2) -> DataFrame:
    """Ids of documents, of entities that matter and of people with relations."""
    rows = nodes.filter(F.col("type").isin("document", "entity", "person")).join(meaningful_degree(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    mentions = F.coalesce(F.nullif("mentions", F.lit(0)), F.lit(1))
    entity = (F.col("type") == "entity") & ~T.is_noise_entity(F.col("name")) & ((mentions >= least_mentions) | (F.col("degree") >= least_relations))
    return rows.filter((F.col("type") == "document") | entity | ((F.col("type") == "person") & (F.col("degree") >= least_person))).select("id")


def near_duplicate_key(text) -> F.Column:
    return T.utf16_left(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), 50)


def first_of_near_duplicates(texts: DataFrame) -> DataFrame:
    """Ids of texts (id, text, node_ord) that are first, in node order, of those with an equal key."""
    return texts.groupBy(near_duplicate_key(F.coalesce("text", F.lit(""))).alias("key")).agg(F.min_by("id", "node_ord").alias("id")).select("id")


def surviving_texts(nodes: DataFrame, edges: DataFrame, core: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """Ids of texts that are no noise, are about a survivor, and are first of their near duplicates."""
    texts = nodes.filter(F.col("type").isin(*TEXT_TYPES) & ~T.is_noise_text(F.col("text"), names)).select("id", "text", "node_ord")
    about = edges.filter("type = 'ABOUT'")
    ends = about.select(F.col("source").alias("id"), F.col("target").alias("other")).unionByName(about.select(F.col("target").alias("id"), F.col("source").alias("other")))
    touching = ends.join(core.select(F.col("id").alias("other")), "other", "left_semi").select("id")
    return first_of_near_duplicates(texts.join(touching, "id", "left_semi"))


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes among the ids, and edges with both ends among them."""
    edges = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    return nodes.join(ids, "id", "left_semi"), edges.join(ids, edges["target"] == ids["id"], "left_semi")


def filter_graph(nodes: DataFrame, edges: DataFrame, names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The graph without noise. Nodes of unknown type go. names: see is_noise_text."""
    core = core_survivors(nodes, edges)
    return induced(nodes, edges, core.unionByName(surviving_texts(nodes, edges, core, names)))
