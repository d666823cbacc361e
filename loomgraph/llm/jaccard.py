"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct shingles of `n` words, A-Z lower-cased. Two sets of a and b
shingles with Jaccard similarity of at least t/100 differ in at most (a + b)(100 - t)/(100 + t)
shingles. A shingle is hashed to one of P parts of a very wide bit sketch and flips one bit there,
so the sketches of two sets differ in no more bits than the sets in shingles. A part is kept as
the XOR of a random word for each bit that is set; as in the sketch, what is flipped twice is
gone. Within a band of sizes P exceeds the most shingles by which similar sets can differ, so
similar sets have a part in common (pigeonhole). Parts are the keys; sets that share one are
compared exactly.

Parts without any shingle are alike in all documents. P is larger by 2 * spare, so the `spare`
emptiest parts of each document need no key: of the 1 + 2 * spare parts that similar sets have in
common, 2 * spare at most are left out on either side. `spare` covers the parts expected to be
empty in the smallest sets of a band, and from a similarity of 0.9 on those with one shingle.

A set belongs to the band of its size, and to each band above whose sets can be similar to it.
Bands are `ratio` wide.

Documents without words have an empty set and are linked with nothing; so are null texts. With
fewer words than n the whole sequence is one shingle. Documents of equal sets and at least one
word are linked. A null id is no smallest one: a row without id has the smallest id that it
reaches, null only if it reaches none. Repeated rows each get a row.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, similar
from loomgraph.llm.decontaminate import Hashes, grams, hashed

_KNOWN = Hashes()
_FIRST = np.uint64(0x9E3779B97F4A7C15)
RATIO = 1.25


def shingles(text: str | bytes | None, n: int = 3) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    found = (text if isinstance(text, bytes) else text.encode()).lower().split() if text else []
    h = hashed(found, _KNOWN)
    if not len(h):
        return h
    if len(h) < n:
        return grams(h, len(h)) ^ np.uint64(len(h))
    return np.unique(grams(h, n))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@functools.cache
def band(number: int, percent: int, ratio: float = RATIO) -> tuple[int, int, int, int]:
    """The least and the largest size in a band, its parts P, and how many of a set's parts need no key."""
    low = 1 if number == 0 else band(number - 1, percent, ratio)[1] + 1
    high = max(low, int(low * ratio))
    differ = 2 * high * (100 - percent) // (100 + percent)
    spare = 0
    while differ >= 4 and spare < differ:
        parts = differ + 1 + 2 * spare
        mean = low / parts
        light = math.exp(-mean) * (1 + mean * (percent >= 90))
        if spare >= parts * light + 2 * math.sqrt(parts * light):
            break
        spare += 1
    return low, high, differ + 1 + 2 * spare, spare


def bands(size: int, percent: int, ratio: float = RATIO) -> list[int]:
    """The band of a size, and those above that hold sets similar to sets of that size."""
    number = 0
    while band(number, percent, ratio)[1] < size:
        number += 1
    out = [number]
    while band(number + 1, percent, ratio)[0] * percent <= size * 100:
        out.append(number := number + 1)
    return out


def sketch_keys(tokens: np.ndarray, percent: int = 90, ratio: float = RATIO) -> np.ndarray:
    """The keys of a set: a 64-bit hash of band, part and the part's sketch, for each of its bands and parts."""
    keys = []
    flip = _mix(tokens * np.uint64(0xC2B2AE3D27D4EB4F))
    for number in bands(len(tokens), percent, ratio):
        _, _, parts, spare = band(number, percent, ratio)
        part = ((flip >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        sketch = np.zeros(parts, dtype=np.uint64)
        np.bitwise_xor.at(sketch, part, tokens)
        filled = np.bincount(part, minlength=parts)
        full = np.sort(np.lexsort((np.arange(parts), filled))[spare:])
        keys.append(_mix((sketch[full] + full.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(number + 1)) * _FIRST))
    return np.unique(np.concatenate(keys))


def is_linked(percent: int):
    return lambda both, a, b: 100 * both >= percent * (a + b - both)


def _rooted(docs: DataFrame, n: int, percent: int, part_chars: int) -> DataFrame:
    """(doc_id, n_shingles, mark, root) of every row of docs (doc_id, text, mark); the root is null where the set is empty."""
    dealt, size = common.deal(docs, part_chars)

    def pack(table: pa.Table) -> similar.Packed:
        out, number = similar.Packed(keys=[]), {}
        for doc_id, text, mark in zip(*(table.column(c).to_pylist() for c in ("doc_id", "text", "mark")), strict=True):
            tokens = shingles(text, n)
            node = xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None
            out.members.append((doc_id, len(tokens), None if node is None else number.setdefault(node, len(number)), mark))
            if node and len(number) > len(out.nodes):
                out.nodes.append(node)
                out.texts.append(text.encode())
                out.keys.append(sketch_keys(tokens, percent))
        return out

    def sketch(texts: list[bytes]) -> list[tuple[int, bytes]]:
        return [(len(x), similar.parity(_mix(x * _FIRST))) for x in (shingles(t, n) for t in texts)]

    keyed, found = similar.shared_keys(dealt, pack, None, sketch, size // 20, every=True)
    roots = similar.link(keyed, found, lambda texts: [shingles(t, n) for t in texts], is_linked(percent))
    members = found.filter(F.col("kind") == similar.MEMBER).select("doc_id", F.col("place").cast("long").alias("n_shingles"), "node", "mark")
    return members.join(roots, "node", "left").select("doc_id", "n_shingles", "mark", F.coalesce("root", "node").alias("root"))


def join(docs: DataFrame, n: int = 3, percent: int = 90, part_chars: int = 4_000_000) -> DataFrame:
    """Per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    rooted = _rooted(common.pick(docs, doc_id="long", text="string").withColumn("mark", F.lit(None).cast("long")), n, percent, part_chars)
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rooted.join(least, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, n: int = 5, percent: int = 80, part_chars: int = 4_000_000) -> DataFrame:
    """The documents, all columns, but for those linked with another of their component that comes first.

    Each row is judged by itself: rows of a component come in the order of their ids, nulls last,
    then of a digest of their texts; of rows alike in both, one stays. Rows without words all stay.
    """
    at, text_at, names = common.position(docs, "doc_id"), common.position(docs, "text"), docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    flat = flat.withColumns({"doc_id": F.col(f"_{at}").cast("long"), "mark": F.xxhash64(F.col(f"_{text_at}").cast("string"))})
    rows = _rooted(flat.select("doc_id", F.col(f"_{text_at}").cast("string").alias("text"), "mark"), n, percent, part_chars).filter("root is not null")
    marked = rows.select("root", F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "mark").alias("row"))
    firsts = marked.groupBy("root").agg(F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1")
    judged = marked.groupBy("root", "row").agg(F.count("*").alias("alike")).join(firsts, "root")
    goes = ~F.col("row").eqNullSafe(F.col("first"))
    judged = common.spill(judged.filter(goes | (F.col("alike") > 1)).select(F.col("row.doc_id").alias("id"), F.col("row.mark").alias("of"), goes.alias("goes")), "judged")
    same = flat["doc_id"].eqNullSafe(judged["id"]) & (flat["mark"] == judged["of"])
    columns = [f"_{i}" for i in range(len(names))]
    out = flat.join(judged, same, "left_anti").select(columns)
    if judged.filter("not goes").isEmpty():
        return out.toDF(*names)
    once = flat.join(judged.filter("not goes"), same, "left_semi").groupBy("doc_id", "mark")
    once = once.agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("row")).select("row.*")
    return out.unionByName(once).toDF(*names)
