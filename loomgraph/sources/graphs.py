"""Graphs in and out: Parquet tables, one JSON document for interchange, DOT."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import build
from loomgraph.operators.search import label

_NODE = "id string, " + ", ".join(f"{c} {t}" for c, t in build.NODE.items() if c != "extra")
_JSON = "nodes array<string>, edges array<struct<source:string,target:string,type:string,weight:bigint>>"
_COMPLETE = "_COMPLETE"


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (the last of an id, whole) and edges (the first of a key) of a graph document; missing ends become empty nodes.

    Attributes of nodes that have no column, and nulls given outright, go to `extra`.
    """
    raw = spark.read.schema(_JSON).option("multiLine", True).json(path)
    nodes = raw.select(F.posexplode("nodes").alias("pos", "j"))
    all_ = F.transform_values(F.from_json("j", "map<string,variant>"), lambda _, v: F.coalesce(F.to_json(v), F.lit("null")))
    extra = F.map_filter(all_, lambda k, v: (k != "id") & (~k.isin(*build.NODE) | (v == "null")))
    nodes = nodes.select(F.from_json("j", _NODE).alias("n"), F.when(F.size(extra) > 0, extra).alias("extra"), "pos").select("n.*", "extra", "pos")
    place = F.struct(F.lit(0).alias("run"), F.lit(0).alias("kind"), F.lit(0).alias("file_ord"), F.lit(0).alias("chunk_index"), F.lit(0).alias("rank"), "pos").cast(build.ORD)
    edges = raw.select(F.posexplode("edges").alias("pos", "e")).select("e.*", "pos")
    edge_place = F.struct(F.lit(0).alias("run"), F.lit(0).alias("step"), F.lit("").alias("key"), F.lit(0).alias("file_ord"), F.lit(0).alias("chunk_index"), "pos").cast(build.EDGE_ORD)
    edges = build.unique_edges(edges.filter("source is not null and target is not null").select("source", "target", "type", "weight", edge_place.alias("ord")))
    nodes = build.replace(nodes.filter("id is not null").select("id", *build.NODE, place.alias("node_ord")))
    return build.with_endpoints(nodes, edges), edges


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """One indented JSON document, for interchange; it passes through the driver row by row."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    counts = [0, 0]
    with open(f"{path}.new", "w", encoding="utf-8") as out:
        out.write("{")
        for i, (name, rows) in enumerate((("nodes", nodes.orderBy("node_ord", "id").select("id", *build.NODE)), ("edges", edges.orderBy("ord").select("source", "target", "type", "weight")))):
            out.write(("," if i else "") + f'\n  "{name}": [')
            for row in rows.toLocalIterator():
                kept = {k: v for k, v in row.asDict(recursive=True).items() if v is not None}
                kept |= {k: json.loads(v) for k, v in kept.pop("extra", {}).items()}
                out.write(("," if counts[i] else "") + "\n    " + json.dumps(kept, ensure_ascii=False))
                counts[i] += 1
            out.write("\n  ]" if counts[i] else "]")
        out.write("\n}\n")
    os.replace(f"{path}.new", path)  # whole or not at all
    return counts[0], counts[1]


def _folder(spark: SparkSession, path: str):
    """A file system and a path on it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a stored graph, rising."""
    fs, target = _folder(spark, path)
    if not fs.exists(target):
        return []
    names = [entry.getPath().getName() for entry in fs.listStatus(target)]
    numbers = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(v for v in numbers if fs.exists(_folder(spark, f"{path}/v{v}/{_COMPLETE}")[1]))


def write_tables(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes/ and edges/ as Parquet in a new version folder v<n>/ of `path`: the form for graphs of any size.

    A version counts once its marker is there, so a failed write leaves the graph as it was. The version
    before stays for those who read it; older ones go. One writer at a time.
    """
    spark = nodes.sparkSession
    before = _versions(spark, path)
    new = f"{path}/v{before[-1] + 1 if before else 1}"
    nodes.write.mode("overwrite").parquet(f"{new}/nodes")
    edges.write.mode("overwrite").parquet(f"{new}/edges")
    fs, marker = _folder(spark, f"{new}/{_COMPLETE}")
    fs.create(marker, True).close()
    for version in before[:-1]:
        fs.delete(_folder(spark, f"{path}/v{version}")[1], True)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether a graph has been written there."""
    return bool(_versions(spark, path))


def read_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The last complete version."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no graph in {path}")
    return tuple(spark.read.parquet(f"{path}/v{versions[-1]}/{name}") for name in ("nodes", "edges"))


#: Fill colour of each node type; others are white.
COLOURS = {"entity": "lightblue", "person": "lightyellow", "fact": "lightgreen", "decision": "lightsalmon", "document": "lightgray", "preference": "lavender", "frustration": "mistyrose"}


def _colour(kind: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])[kind], F.lit("white"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a DOT graph; parts 0 head, 1 nodes, 2 edges, 3 end."""
    spark = nodes.sparkSession
    shown = F.left(F.regexp_replace(label(nodes), '"', '\\\\\\\\"'), F.lit(50))
    node = F.format_string('  "%s" [label="%s", style=filled, fillcolor="%s"];', "id", shown, _colour(F.coalesce("type", F.lit(""))))
    edge = F.format_string('  "%s" -> "%s" [label="%s", fontsize=8];', "source", "target", F.coalesce("type", F.lit("")))
    head = spark.createDataFrame([(0, "digraph G {"), (0, "  rankdir=LR;"), (0, "  node [shape=box, fontsize=10];"), (3, "}")], "part int, line string")
    return head.unionByName(nodes.select(F.lit(1).alias("part"), node.alias("line"))).unionByName(edges.select(F.lit(2).alias("part"), edge.alias("line")))


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as out:
        for part in range(4):
            for row in dot_lines(nodes, edges).filter(F.col("part") == part).toLocalIterator():
                out.write(row["line"] + "\n")
