"""Benchmark decontamination by winnowing.

Documents and benchmark items are hashed word by word; of every `w` consecutive k-gram hashes
the least is kept, with k + w - 1 = the window length, so any shared span of that many words
shares a kept hash. Kept hashes of the documents meet those of the benchmark, and each hit is
extended over the windows around it, which are compared whole. Items shorter than a window are
one window of their own length, met by every gram of that length (w = 1).

The benchmark is read in blocks of at most `block_bytes` of text; a block's index is broadcast,
so its size is bounded whatever the benchmark's, and documents are never shuffled. With several
blocks, the hits of each are merged per document afterwards, and the result is the same.

Null texts have no words. Items without words are never found. An item with a null id marks
words but is not counted. Repeated documents each get a row; repeated items count once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Bytes that words consist of, lower-cased; all others part words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
SCHEMA = "doc_id long, digest string, n_words long, n_hit long, spans binary, items array<string>"
TYPES = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.binary()), ("items", pa.list_(pa.string()))])


class Hashes(dict):
    """Word to 64-bit hash, kept for words met again; forgets all beyond a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, 7)
        return value


def split(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


def hashed(found: list[bytes], known: Hashes) -> np.ndarray:
    return np.fromiter((known[w] for w in found), dtype=np.uint64, count=len(found))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = (out + h[j : j + n]) * _MULTIPLY
        out ^= out >> np.uint64(29)
    return out * _MIX


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Places of k-grams that are least in some window of w; equals are all kept."""
    n = len(g) - w + 1
    if n <= 0:
        return np.arange(0)
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : j + n], out=least)
    highest = np.zeros(len(g), dtype=np.uint64)
    for j in range(w):
        np.maximum(highest[j : j + n], least, out=highest[j : j + n])
    return np.flatnonzero(highest == g)


class Index:
    """Windows of a block of benchmark items: kept k-grams, whole windows by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = 10, k: int = 5):
        known, self.window, self.k = Hashes(), window, k
        kept, self.names = [], [x[0] for x in items]
        pairs: dict[int, list] = {}
        for i, (_, text) in enumerate(items):
            h = hashed(split(text), known)
            if len(h) >= window:
                g = grams(h, k)
                kept.append(g[winnow(g, window - k + 1)])
            if len(h):
                whole = grams(h, n := min(len(h), window))
                pairs.setdefault(n, []).append((whole, np.full(len(whole), i)))
        self.kept = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.uint64)
        self.whole = {}
        for n, found in pairs.items():
            g, owner = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((owner, g))
            values, first = np.unique(g[order], return_index=True)
            self.whole[n] = (values, np.append(first, len(g)), owner[order])

    def find(self, h: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Which words are hit, and which items occur."""
        hit, items = np.zeros(len(h) + 1, dtype=np.int64), set()
        for n, (values, first, owner) in self.whole.items():
            if len(h) < n:
                continue
            if n == self.window:
                g, w = grams(h, self.k), n - self.k + 1
                at = winnow(g, w)
                at = at[member(g[at], self.kept)]
                if not len(at):
                    continue
                starts = np.unique((at[:, None] - np.arange(w)).ravel())  # extend: windows that hold the k-gram
                starts = starts[(starts >= 0) & (starts <= len(h) - n)]
                whole = grams(h, n)[starts]
            else:
                starts, whole = np.arange(len(h) - n + 1), grams(h, n)
            same = member(whole, values)
            starts, whole = starts[same], whole[same]
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + n, -1)
            for v in np.searchsorted(values, np.unique(whole)):
                items.update(owner[first[v] : first[v + 1]].tolist())
        return np.cumsum(hit[:-1]) > 0, items


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), dtype=bool)
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def spans_of(mask: np.ndarray) -> bytes:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges.astype("<u4").tobytes()


def mask_of(spans: list[bytes], n: int) -> np.ndarray:
    mask = np.zeros(n, dtype=bool)
    for x in spans:
        for a, b in np.frombuffer(x, "<u4").reshape(-1, 2):
            mask[a:b] = True
    return mask


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    items = common.pick(benchmark, item_id="string", text="string").filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-int(total) // block_bytes) or 1
    for b in range(n):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 32_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, spans (pairs of word places, 32-bit, end exclusive) and items found, sorted."""
    docs, spark = common.pick(docs, doc_id="long", text="string"), docs.sparkSession
    blocks = [spark.sparkContext.broadcast(Index(b, window, k)) for b in _blocks(benchmark, block_bytes)]
    single = len(blocks) == 1

    def scan(index):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, found = Hashes(), index.value
            for batch in common.chunks(batches, 1):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    h = hashed(split(text), known)
                    mask, items = found.find(h)
                    if single or items:
                        names = sorted({found.names[i] for i in items if found.names[i] is not None})
                        digest = None if single else hashlib.sha256((text or "").encode()).hexdigest()
                        rows.append((doc_id, digest, len(h), int(mask.sum()), spans_of(mask), names))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES.types, strict=True)], schema=TYPES)

        return docs.mapInArrow(task, SCHEMA)

    if single:
        return scan(blocks[0]).drop("digest")
    found = functools.reduce(DataFrame.unionByName, map(scan, blocks))
    # A document has at most one distinct (spans, items) for each block, so these sets are small.
    found = found.groupBy("doc_id", "digest").agg(F.collect_set("spans").alias("all_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    every = docs.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)).mapInArrow(_count, "doc_id long, digest string, n_words long")
    a, b = every.alias("a"), found.alias("b")
    joined = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.digest") == F.col("b.digest")), "left")
    return joined.select("a.doc_id", "n_words", "all_spans", "items").mapInArrow(_merge, "doc_id long, n_words long, n_hit long, spans binary, items array<string>")


def _count(batches):
    for batch in batches:
        n = [len(split(x)) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=["doc_id", "digest", "n_words"])


def _merge(batches):
    for batch in batches:
        masks = [mask_of(x or [], n) for n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        items = [x or [] for x in batch.column(3).to_pylist()]
        columns = [batch.column(0), batch.column(1), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(map(spans_of, masks), pa.binary()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "spans", "items"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 32_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs, benchmark, window, k, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, k: int = 5, block_bytes: int = 32_000_000) -> DataFrame:
    """The documents, all columns, in which no window of any item occurs."""
    at, schema, spark = common.position(docs, "text"), docs.schema, docs.sparkSession
    out = docs
    for block in _blocks(benchmark, block_bytes):
        index = spark.sparkContext.broadcast(Index(block, window, k))

        def task(batches, index=index):
            known = Hashes()
            for batch in common.chunks(batches, at):
                clean = [not index.value.find(hashed(split(text), known))[0].any() for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(task, schema)
    return out
