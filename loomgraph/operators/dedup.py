"""Merging of extractions across chunks: aliases, entities, people, texts, relationships.

First and last are meant in the order of the extractions, never of rows; every first/last is an
aggregate over an explicit order, so partial results form within tasks and no name or entity,
however frequent, is gathered in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: How many items of each list of an extraction count.
CAPS = {"entities": 8, "people": 8, "facts": 5, "decisions": 3, "preferences": 2, "frustrations": 2, "relationships": 10}
#: Node type of each list of texts, in node order.
TEXT_KINDS = {"facts": "fact", "decisions": "decision", "preferences": "preference", "frustrations": "frustration"}


def _items(ext: DataFrame, field: str, rank: int, capped: bool = True) -> DataFrame:
    """ord (extraction, list, place), item."""
    array = F.slice(field, 1, CAPS[field]) if capped else F.col(field)
    return ext.select("ext_ord", F.posexplode(array).alias("pos", "item")).select("ext_ord", F.struct("ext_ord", F.lit(rank).alias("rank"), "pos").alias("ord"), "item")


def _named(ext: DataFrame, field: str, rank: int, capped: bool = True) -> DataFrame:
    return _items(ext, field, rank, capped).filter(F.coalesce(F.col("item.name"), F.lit("")) != "")


def alias_index(ext: DataFrame) -> DataFrame:
    """(alias, canonical, node_type): the last direct use of a name, else the first use as an alias. All items count."""
    entities, people = _named(ext, "entities", 0, False), _named(ext, "people", 1, False)
    direct = lambda rows, kind: rows.select(F.lower("item.name").alias("alias"), F.lit(True).alias("direct"), F.lower("item.name").alias("canonical"), F.lit(kind).alias("node_type"), "ord", F.lit(0).alias("at"))
    also = entities.select("item", "ord", F.posexplode(F.coalesce("item.aliases", F.array())).alias("at", "alias")).filter("alias <> ''")
    also = also.select(F.lower("alias").alias("alias"), F.lit(False).alias("direct"), F.lower("item.name").alias("canonical"), F.lit("entity").alias("node_type"), "ord", "at")
    rows = direct(entities, "entity").unionByName(direct(people, "person")).unionByName(also)
    what, order = F.struct("canonical", "node_type"), F.struct("ord", "at")
    best = F.coalesce(F.max_by(F.when(F.col("direct"), what), F.when(F.col("direct"), order)), F.min_by(F.when(~F.col("direct"), what), F.when(~F.col("direct"), order)))
    return rows.groupBy("alias").agg(best.alias("b")).select("alias", "b.canonical", "b.node_type")


def merge_entities(ext: DataFrame) -> DataFrame:
    """id, name, type, aliases, mentions, ord. A single occurrence keeps its aliases as they are; else they unite in order of sight."""
    rows = _named(ext, "entities", 0).select(T.canonical_id("entity", F.lower("item.name")).alias("id"), "item", "ord")
    first = F.min_by("item", "ord")
    merged = rows.groupBy("id").agg(F.count("*").alias("mentions"), first.alias("first"), F.min("ord").alias("ord"))
    seen = rows.select("id", "ord", F.posexplode(F.coalesce("item.aliases", F.array())).alias("at", "alias")).groupBy("id", "alias").agg(F.min(F.struct("ord", "at")).alias("o"))
    union = seen.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]).alias("all"))  # distinct aliases of one entity
    none = F.array().cast("array<string>")
    aliases = F.when(F.col("mentions") == 1, F.coalesce("first.aliases", none)).otherwise(F.coalesce("all", none))
    kind = F.coalesce(F.nullif(F.col("first.type"), F.lit("")), F.lit("concept"))
    return merged.join(union, "id", "left").select("id", F.col("first.name").alias("name"), kind.alias("type"), aliases.alias("aliases"), "mentions", "ord")


def merge_people(ext: DataFrame) -> DataFrame:
    """id, name, role (the first that is not empty), mentions, ord."""
    rows = _named(ext, "people", 1).select(T.canonical_id("person", F.col("item.name")).alias("id"), "item", "ord")
    told = F.when(F.coalesce("item.role", F.lit("")) != "", F.col("ord"))
    return rows.groupBy("id").agg(F.min_by("item.name", "ord").alias("name"), F.coalesce(F.min_by("item.role", told), F.lit("")).alias("role"), F.count("*").alias("mentions"), F.min("ord").alias("ord"))


def _texts(ext: DataFrame) -> DataFrame:
    out = None
    for rank, (field, kind) in enumerate(TEXT_KINDS.items(), 2):
        rows = _items(ext, field, rank).filter(F.coalesce("item", F.lit("")) != "")
        rows = rows.select("ext_ord", F.lit(kind).alias("kind"), T.text_id(kind, F.col("item")).alias("id"), F.col("item").alias("text"), "ord")
        out = rows if out is None else out.unionByName(rows)
    return out


def merge_texts(ext: DataFrame) -> DataFrame:
    """id, kind, text (the last), ord (of the first) of facts, decisions, preferences and frustrations."""
    return _texts(ext).groupBy("id", "kind").agg(F.max_by("text", "ord").alias("text"), F.min("ord").alias("ord"))


def _endpoint(names: DataFrame, column: str, index: DataFrame) -> DataFrame:
    """Resolves a column of names to node ids by the alias index, else as entities."""
    found = index.select(F.col("alias").alias("_alias"), T.canonical_id(F.col("node_type"), F.col("canonical")).alias("_id"))
    lower = F.lower(column)
    out = names.join(found, lower == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_id", T.canonical_id("entity", lower))).drop("_alias", "_id")


def relationships(ext: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """source, target, type, ord; repeats stay."""
    index = alias_index(ext) if index is None else index
    rows = _items(ext, "relationships", 6).select(F.col("item.from").alias("source"), F.col("item.to").alias("target"), F.coalesce(F.nullif(F.col("item.type"), F.lit("")), F.lit("RELATED_TO")).alias("type"), "ord")
    rows = rows.filter("source <> '' and target <> ''")
    return _endpoint(_endpoint(rows, "source", index), "target", index)


def chunk_nodes(ext: DataFrame) -> DataFrame:
    """ext_ord, source, id: the distinct nodes of each extraction."""

    def ids(field: str, id_: Column, name: str) -> DataFrame:
        return _items(ext, field, 0).filter(F.coalesce(name, F.lit("")) != "").select("ext_ord", id_.alias("id"))

    entities = ids("entities", T.canonical_id("entity", F.lower("item.name")), "item.name")
    people = ids("people", T.canonical_id("person", F.col("item.name")), "item.name")
    nodes = entities.unionByName(people).unionByName(_texts(ext).select("ext_ord", "id")).distinct()
    return nodes.join(ext.select("ext_ord", "source"), "ext_ord").select("ext_ord", "source", "id")
