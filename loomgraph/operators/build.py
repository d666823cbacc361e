"""The property graph: consolidation, nodes, relationship and co-occurrence edges.

Nodes are wide rows (NODE), edges are (source, target, type, weight, ord). An edge is unique by
source, target and type; the first keeps its weight. Names of new columns never reach users'
own: every step selects what it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import dedup

#: Node columns after id, with their types. `extra`: JSON of attributes that have no column, and "null" for columns given as null outright.
NODE = {
    "type": "string", "name": "string", "entityType": "string", "role": "string", "aliases": "array<string>", "mentions": "bigint", "text": "string",
    "path": "string", "filename": "string", "size": "bigint", "timestamp": "string", "ingestedAt": "string", "summary": "string", "rank": "double",
    "extra": "map<string,string>",
}
#: Node order: run, kind, and the place of the first sight.
ORD = "struct<run:int,kind:int,file_ord:bigint,chunk_index:int,rank:int,pos:int>"
EDGE_ORD = "struct<run:int,step:int,key:string,file_ord:bigint,chunk_index:int,pos:int>"
KINDS = {"document": 0, "entity": 1, "person": 2, "fact": 3, "decision": 4, "preference": 5, "frustration": 6}


def null_node(**known: Column) -> list[Column]:
    return [known.get(c, F.lit(None)).cast(t).alias(c) for c, t in NODE.items()]


def node_ord(kind: Column | int, ord_: Column | None = None, file_ord: Column | None = None, run: int = 0) -> Column:
    at = (lambda c: ord_[c]) if ord_ is not None else lambda c: F.lit(None)
    where = ord_["ext_ord"]["file_ord"] if ord_ is not None else file_ord if file_ord is not None else F.lit(None)
    index = ord_["ext_ord"]["chunk_index"] if ord_ is not None else F.lit(None)
    parts = F.struct(F.lit(run).alias("run"), (F.lit(kind) if isinstance(kind, int) else kind).alias("kind"), where.alias("file_ord"), index.alias("chunk_index"), at("rank").alias("rank"), at("pos").alias("pos"))
    return parts.cast(ORD).alias("node_ord")


def overlay(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of both; of a shared id, attributes of `new` that are there win, nulls given outright among them, and the place is the old one's."""
    a, b = old.alias("a"), new.alias("b")
    both = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    none = F.create_map().cast("map<string,string>")
    before, after = F.coalesce("a.extra", none), F.coalesce("b.extra", none)
    given = {c: F.when(~F.map_contains_key(after, c), F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}"))) for c in NODE if c != "extra"}
    filled = F.array(*[F.when(F.col(f"b.{c}").isNotNull(), F.lit(c)) for c in given])
    extra = F.map_filter(F.map_zip_with(before, after, lambda _, x, y: F.coalesce(y, x)), lambda k, _: F.map_contains_key(after, k) | ~F.coalesce(F.array_contains(filled, k), F.lit(False)))
    return both.select(F.coalesce("a.id", "b.id").alias("id"), *[v.alias(c) for c, v in given.items()], F.when(F.size(extra) > 0, extra).alias("extra"), F.coalesce("a.node_ord", "b.node_ord").alias("node_ord"))


def replace(nodes: DataFrame) -> DataFrame:
    """One row per id: the last one in node order, whole."""
    return nodes.groupBy("id").agg(F.max_by(F.struct(*NODE, "node_ord"), F.col("node_ord")).alias("n")).select("id", "n.*")


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first of each (source, target, type); types may be null. Formed in tasks first, so hubs are no burden."""
    return edges.groupBy("source", "target", "type").agg(F.min_by("weight", "ord").alias("weight"), F.min("ord").alias("ord"))


def with_endpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, and empty nodes for endpoints of edges that are none."""
    ends = edges.select(F.col("source").alias("id")).unionByName(edges.select(F.col("target").alias("id"))).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    return nodes.unionByName(missing.select("id", *null_node(), node_ord(99)))


def remap(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, to) from merges (ord, canonical, alias): the last wins; none for entities with two mentions or more."""
    pairs = merges.select("ord", T.canonical_id("entity", F.col("alias")).alias("id"), T.canonical_id("entity", F.col("canonical")).alias("to")).filter("id <> to")
    pairs = pairs.join(entities.select("id", "mentions"), "id", "left").filter("coalesce(mentions, 0) < 2")
    return pairs.groupBy("id").agg(F.max_by("to", "ord").alias("to"), F.min("ord").alias("first"))


def apply_remap(entities: DataFrame, moves: DataFrame) -> DataFrame:
    """Entities after the moves, taken in order: mentions add up, aliases and the old name unite, the old one goes.

    The moves are one consolidation answer, a few dozen at most; they and the entities they name
    are folded on the driver, since chains depend on their order. All other entities are not
    touched. In a cycle the later move is ignored.
    """
    steps = moves.orderBy("first").collect()
    if not steps:
        return entities
    named = sorted({x for s in steps for x in (s["id"], s["to"])})
    touched = F.col("id").isin(named)
    rows = {r["id"]: r.asDict() for r in entities.filter(touched).collect()}
    gone: dict[str, str] = {}
    for s in steps:
        target = s["to"]
        while target in gone and target != s["id"]:
            target = gone[target]
        if target == s["id"]:
            continue
        gone[s["id"]] = s["to"]
        old, new = rows.pop(s["id"], None), rows.get(s["to"])
        if old and new:
            new["mentions"] += old["mentions"]
            new["aliases"] = list(dict.fromkeys([*new["aliases"], *old["aliases"], old["name"]]))
    left = entities.sparkSession.createDataFrame([tuple(r[c] for c in entities.columns) for r in rows.values()], entities.schema)
    return entities.filter(~touched).unionByName(left)


def resolved(rows: DataFrame, column: str, moves: DataFrame) -> DataFrame:
    """One hop of the moves."""
    hop = moves.select(F.col("id").alias("_from"), F.col("to").alias("_to"))
    return rows.join(hop, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def document_nodes(files: DataFrame, now: str) -> DataFrame:
    known = {"type": F.lit("document"), "path": F.col("path"), "filename": F.col("filename"), "size": F.col("size"), "ingestedAt": F.lit(now)}
    return files.select(T.document_id(F.col("path")).alias("id"), *null_node(**known), node_ord(0, file_ord=F.col("file_ord")))


def extracted_nodes(entities: DataFrame, people: DataFrame, texts: DataFrame, now: str) -> DataFrame:
    c = F.col
    e = entities.select("id", *null_node(type=F.lit("entity"), entityType=c("type"), name=c("name"), aliases=c("aliases"), mentions=c("mentions")), node_ord(1, c("ord")))
    p = people.select("id", *null_node(type=F.lit("person"), name=c("name"), role=c("role"), mentions=c("mentions")), node_ord(2, c("ord")))
    place = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[c("kind")]
    t = texts.select("id", *null_node(type=c("kind"), text=c("text"), timestamp=F.lit(now)), node_ord(place, c("ord")))
    return e.unionByName(p).unionByName(t)


def edge_ord(step: int, ord_: Column | None = None, key: Column | None = None) -> Column:
    at = (lambda f: f(ord_)) if ord_ is not None else lambda f: F.lit(None)
    return F.struct(
        F.lit(0).alias("run"), F.lit(step).alias("step"), (key if key is not None else F.lit(None)).cast("string").alias("key"),
        at(lambda o: o["ext_ord"]["file_ord"]).alias("file_ord"), at(lambda o: o["ext_ord"]["chunk_index"]).alias("chunk_index"), at(lambda o: o["pos"]).alias("pos"),
    ).cast(EDGE_ORD).alias("ord")


def existing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id")
    edges = edges.join(ids, edges["source"] == ids["id"], "left_semi")
    return edges.join(ids, edges["target"] == ids["id"], "left_semi")


def relationship_edges(relations: DataFrame, moves: DataFrame, nodes: DataFrame) -> DataFrame:
    rows = resolved(resolved(relations, "source", moves), "target", moves)
    return existing(rows.select("source", "target", "type", F.lit(None).cast("bigint").alias("weight"), edge_ord(1, F.col("ord"))), nodes)


def part_of_edges(part_of: DataFrame, entities: DataFrame, moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """PART_OF edges from (ord, child, parent), ends found by name or alias (the last wins), else by id."""
    names = entities.select("id", "ord", F.posexplode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("at", "name"))
    lookup = resolved(names, "id", moves).groupBy(F.lower("name").alias("_name")).agg(F.max_by("id", F.struct("ord", "at")).alias("_found"))
    rows = part_of
    for column in ("child", "parent"):
        rows = rows.withColumn("_id", T.canonical_id("entity", F.col(column)))
        rows = resolved(rows, "_id", moves).join(lookup, F.lower(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_found", "_id")).drop("_id", "_name", "_found")
    out = rows.select(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("PART_OF").alias("type"), F.lit(None).cast("bigint").alias("weight"), edge_ord(2, key=F.lpad(F.col("ord").cast("string"), 12, "0")))
    return existing(out, nodes)


def match_names(entities: DataFrame, people: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, names): what a text may call an entity or person, lower-cased. Empty aliases are left out."""
    e = entities.select("id", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array()))).alias("name"))
    first = F.split(F.col("name"), T.SPACE)[0]
    p = people.select("id", F.explode(F.when(T.utf16_length(first) >= 3, F.array("name", first)).otherwise(F.array("name"))).alias("name"))
    rows = resolved(e.unionByName(p), "id", moves).select("id", F.lower("name").alias("name")).filter("name <> ''").distinct()
    return rows.groupBy("id").agg(F.collect_list("name").alias("names"))  # distinct names of one node


def about_pairs(nodes_of_chunks: DataFrame, texts: DataFrame, names: DataFrame) -> DataFrame:
    """(source, target) for each chunk's texts and the entities and people of that chunk they name."""
    who = nodes_of_chunks.filter(F.col("id").startswith("entity:") | F.col("id").startswith("person:")).join(names, "id").select("ext_ord", F.col("id").alias("target"), "names")
    what = nodes_of_chunks.join(texts.select("id", F.lower("text").alias("said")), "id").select("ext_ord", F.col("id").alias("source"), "said")
    pairs = what.join(who, "ext_ord")  # at most 12 texts and 16 names a chunk
    return pairs.filter(F.exists("names", lambda n: F.contains(F.col("said"), n))).select("source", "target")


def co_occurrence_edges(nodes_of_chunks: DataFrame, texts: DataFrame, entities: DataFrame, people: DataFrame, moves: DataFrame, nodes: DataFrame) -> DataFrame:
    """ABOUT and FROM_SOURCE edges with their counts over chunks as weight, if above one.

    Ids take one hop when they are listed and another when they are counted.
    """
    listed = resolved(nodes_of_chunks, "id", moves)
    about = about_pairs(listed, texts, match_names(entities, people, moves)).withColumn("type", F.lit("ABOUT"))
    from_source = listed.filter(F.col("id").startswith("entity:") | F.col("id").startswith("person:")).select(F.col("id").alias("source"), T.document_id(F.col("source")).alias("target"), F.lit("FROM_SOURCE").alias("type"))
    rows = resolved(resolved(about.unionByName(from_source), "source", moves), "target", moves)
    counted = weighted(rows).withColumn("ord", edge_ord(3, key=F.concat_ws("|", "source", "target", "type")))
    return existing(counted, nodes)


def weighted(rows: DataFrame) -> DataFrame:
    """(source, target, type, weight): how often each occurs, null for once."""
    return rows.groupBy("source", "target", "type").agg(F.count("*").alias("n")).select("source", "target", "type", F.when(F.col("n") > 1, F.col("n")).alias("weight"))


def no_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "id string, to string, first long")


def earlier(rows: DataFrame, column: str) -> DataFrame:
    """Rows of an older graph, placed before those of this run; older runs keep their order."""
    return rows.withColumn(column, F.col(column).withField("run", F.col(column)["run"] - 1))


def build(files: DataFrame, ext: DataFrame, now: str, merges: DataFrame | None = None, part_of: DataFrame | None = None, old: tuple[DataFrame, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from files and extractions, over an older graph if there is one. now: a timestamp for the whole run."""
    entities, people, texts = dedup.merge_entities(ext), dedup.merge_people(ext), dedup.merge_texts(ext)
    moves = remap(merges, entities) if merges is not None else no_moves(ext.sparkSession)
    if merges is not None:
        entities = apply_remap(entities, moves)
    new = document_nodes(files, now).unionByName(extracted_nodes(entities, people, texts, now))
    nodes = overlay(earlier(old[0], "node_ord"), new) if old else new
    edges = relationship_edges(dedup.relationships(ext), moves, nodes)
    if part_of is not None:
        edges = edges.unionByName(part_of_edges(part_of, entities, moves, nodes))
    edges = edges.unionByName(co_occurrence_edges(dedup.chunk_nodes(ext), nodes.filter("text is not null"), entities, people, moves, nodes))
    if old:
        edges = earlier(old[1], "ord").unionByName(edges)
    return nodes, unique_edges(edges)
