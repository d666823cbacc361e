"""Keyword search over nodes: stems, inverse document frequency, share of the query matched.

Terms are literals. One pass over the nodes marks which terms each holds and is written; document
frequencies, one aggregate row, and scores read the marks.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.sources.shared import spill


def query_terms(query: str) -> tuple[list[str], int]:
    """Distinct terms and their stems in order, and the number of distinct stems of the terms."""
    raw = [t for t in re.split(r"\s+", query.lower()) if len(t) > 2 and t not in T.STOP_WORDS]
    terms = list(dict.fromkeys(x for t in raw for x in (t, T.stem_word(t))))
    return terms, len({T.stem_word(t) for t in raw})


def node_text(nodes: DataFrame) -> Column:
    """What is searched: id, summary, text, name and aliases, lower-cased, followed by the stems of all words."""
    has = lambda c: F.nullif(F.col(c), F.lit("")) if c in nodes.columns else F.lit(None).cast("string")
    aliases = F.filter("aliases", lambda a: a != "") if "aliases" in nodes.columns else F.lit(None).cast("array<string>")
    raw = F.lower(F.concat_ws(" ", "id", has("summary"), has("text"), has("name"), aliases))
    stems = F.array_join(F.transform(F.split(raw, rf"{T.SPACE}+", -1), T.stem), " ")
    return F.concat(raw, F.lit(" "), stems)


def search(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes that match, with `score`. Each stem counts once, with the frequency of its first term that matches."""
    terms, stems = query_terms(query)
    if not terms:
        return nodes.limit(0).withColumn("score", F.lit(0.0))
    # The text is an element of an array, so that its long expression stands in the plan once.
    marks = F.transform(F.array(node_text(nodes)), lambda x: F.array(*[F.contains(x, F.lit(t)) for t in terms]))[0]
    texts = spill(nodes.withColumn("_found", marks), "marked")
    found = [F.col("_found")[i] for i in range(len(terms))]
    counts = texts.agg(F.struct(F.count("*").alias("n"), F.array(*[F.count(F.when(f, 1)) for f in found]).alias("df")).alias("c")).scalar()
    texts = texts.withColumn("_c", counts)
    roots: dict[str, list[int]] = {}
    for i, t in enumerate(terms):
        roots.setdefault(T.stem_word(t), []).append(i)
    score, matched = F.lit(0.0), F.lit(0)
    for places in roots.values():
        gain = F.lit(None).cast("double")
        for i in reversed(places):
            df = F.greatest(F.col("_c.df")[i], F.lit(1))
            gain = F.when(found[i], F.log(F.col("_c.n") / df) + 1).otherwise(gain)
        score, matched = score + F.coalesce(gain, F.lit(0.0)), matched + F.when(gain.isNotNull(), 1).otherwise(0)
    scored = texts.withColumns({"score": score * (matched / F.lit(stems)), "_matched": matched})
    return scored.filter("_matched > 0").drop("_found", "_c", "_matched")


def label(nodes: DataFrame) -> Column:
    """name, else text, summary, path, id."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("name", "text", "summary", "path") if c in nodes.columns], F.col("id"))


def top(nodes: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The k best: id, score (2 digits), type, label, aka. Of equal scores the first in node order comes first."""
    found = search(nodes, query)
    order = ["node_ord"] if "node_ord" in nodes.columns else ["id"]
    best = found.orderBy(F.desc("score"), *order).limit(k)
    aka = F.array_join("aliases", ", ") if "aliases" in nodes.columns else F.lit(None).cast("string")
    return best.select("id", F.round("score", 2).alias("score"), F.coalesce("type", F.lit("unknown")).alias("type"), label(nodes).alias("label"), aka.alias("aka"))
