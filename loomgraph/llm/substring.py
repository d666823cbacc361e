"""Substring deduplication: words within long repeats go, but for the repeat's first document.

A word is removed if a window of `length` words covers it whose word sequence also starts in a
document with a smaller id. Every repeat of `length` words holds a whole reference block of
length // 2 words, so the search has four steps over documents dealt by ranges of their ids:

1. anchors: the non-overlapping blocks of every document are the index, and every rolling window
   of block length probes it. A range of documents sends each distinct window hash once, with two
   bits (is a block here; occurs in several documents here), packed by hash bucket.
2. a bucket answers with one bit for each hash: it is a block somewhere and occurs twice.
3. extension: around each hit all windows of `length` words are compared whole, again by
   distinct hash for each range; a bucket answers which occur in an earlier range. Runs of such
   windows are the maximal repeats.
4. the ranges mark and remove the words.

A passage shared by any number of documents is one entry of each range, so no task sees a group
of its occurrences, and nothing is paired with anything. Traffic follows the number of words.
Anchor hashes are cut to 32 bits within their bucket and only select; windows are compared by
64 bits, on top of the anchor's.

Null texts have no words; the empty result has the digest of the empty text. A null id is neither
smaller nor greater than any: its row loses nothing and takes nothing from others. Repeated rows of
one id are no repeats of each other; each gets a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common
from loomgraph.llm.decontaminate import Hashes, hashed

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_KNOWN = Hashes()
PACKED = "part int, bucket int, hashes binary, flags binary"
PACKED_TYPES = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("flags", pa.binary())])
ANSWER = "part int, bucket int, step int, bits binary"
ANSWER_TYPES = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("step", pa.int32()), ("bits", pa.binary())])


def rolling(h: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every k consecutive items, from sums of powers of an odd base mod 2^64."""
    n = len(h)
    if n < k:
        return h[:0]
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = int(_BASES[which])
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(max(n, 1 << 16), np.uint64(b))
            x[0] = 1
            pair.append(np.multiply.accumulate(x))
        _POWERS[which] = tuple(pair)
    up, down = _POWERS[which]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    out = (total[k:] - total[:-k]) * down[: n - k + 1]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


class Range:
    """The documents of one id range, smallest id first, with all their words hashed in one array."""

    def __init__(self, docs: pa.Table, length: int, buckets: int):
        self.length, self.block, self.bits = length, length // 2, buckets.bit_length() - 1
        ids = docs.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        texts = docs.column("text").to_pylist()
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        hashes = [hashed(common.words(text), _KNOWN) for text in self.texts]
        sizes = np.array([len(h) for h in hashes], dtype=np.int64)
        self.ends = np.cumsum(sizes)
        new = [True] + [a != b for a, b in zip(self.ids, self.ids[1:], strict=False)]
        self.rank = np.repeat(np.cumsum(new)[: len(sizes)], sizes).astype(np.int32)  # equal ids have one rank
        self.left = (np.repeat(self.ends, sizes) - np.arange(sizes.sum())).astype(np.int32)  # words from here to the document's end
        self.place = np.repeat(sizes, sizes).astype(np.int32) - self.left
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of block-long windows, sorted; where each window starts and which hash it has; flags of each hash."""
        at = np.flatnonzero(self.left >= self.block)
        g = rolling(self.h, self.block)[at]
        distinct, inverse = np.unique(g, return_inverse=True)
        flags = np.zeros(len(distinct), dtype=np.uint8)
        flags[inverse[self.place[at] % self.block == 0]] |= 1
        first = np.full(len(distinct), np.iinfo(np.int32).max, np.int32)
        last = np.zeros(len(distinct), np.int32)
        np.minimum.at(first, inverse, self.rank[at])
        np.maximum.at(last, inverse, self.rank[at])
        flags[first < last] |= 2
        return distinct, at, inverse, flags

    def candidates(self, hit: np.ndarray) -> np.ndarray:
        """Starts of windows of the full length that hold a hit anchor (starts of anchors)."""
        edge = np.zeros(len(self.h) + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(hit - (self.length - self.block), hit - self.place[hit]), 1)
        np.add.at(edge, hit + 1, -1)
        return np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (self.left >= self.length))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of full windows, sorted; the hash of each start; whether a smaller id of this range has it."""
        g = rolling(self.h, self.length, 1)[starts] if len(starts) else np.zeros(0, np.uint64)
        distinct, inverse = np.unique(g, return_inverse=True)
        first = np.full(len(distinct), np.iinfo(np.int32).max, np.int32)
        np.minimum.at(first, inverse, self.rank[starts])
        return distinct, inverse, self.rank[starts] > first[inverse]

    def slices(self, distinct: np.ndarray) -> Iterator[tuple[int, slice]]:
        """The buckets, those with a hash, of sorted hashes."""
        if not len(distinct):
            return
        bucket = distinct >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(distinct), np.uint64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        for b, i, j in zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            yield b, slice(i, j)

    def answered(self, distinct: np.ndarray, answers: pa.Table, step: int) -> np.ndarray:
        """The bits that buckets gave for the distinct hashes of a step."""
        out = np.zeros(len(distinct), dtype=bool)
        given = {b: x for b, s, x in zip(*(answers.column(c).to_pylist() for c in ("bucket", "step", "bits")), strict=True) if s == step}
        for b, where in self.slices(distinct):
            if b in given:
                n = where.stop - where.start
                out[where] = np.unpackbits(np.frombuffer(given[b], np.uint8), count=n)
        return out


def _packed(part: int, found: Range, distinct: np.ndarray, payload: np.ndarray, flags: np.ndarray | None) -> pa.Table:
    rows = [(part, b, payload[s].tobytes(), b"" if flags is None else flags[s].tobytes()) for b, s in found.slices(distinct)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, PACKED_TYPES.types, strict=True)], schema=PACKED_TYPES)


def _answers(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, ANSWER_TYPES.types, strict=True)], schema=ANSWER_TYPES)


def _gathered(table: pa.Table, dtype: str) -> tuple[list[int], int | None, np.ndarray, np.ndarray]:
    """The parts of a bucket's rows, the bucket, all hashes, and the row of each."""
    parts = table.column("part").to_pylist()
    arrays = [np.frombuffer(x, dtype) for x in table.column("hashes").to_pylist()]
    return parts, table.column("bucket")[0].as_py(), np.concatenate(arrays), np.repeat(np.arange(len(arrays)), [len(a) for a in arrays])


def _bit_rows(parts: list[int], bucket: int, step: int, yes: np.ndarray, row: np.ndarray) -> list[tuple]:
    cut = np.searchsorted(row, np.arange(len(parts) + 1))
    return [(p, bucket, step, np.packbits(yes[cut[i] : cut[i + 1]]).tobytes()) for i, p in enumerate(parts) if yes[cut[i] : cut[i + 1]].any()]


def _match_anchors(table: pa.Table) -> pa.Table:
    parts, bucket, v, row = _gathered(table, "<u4")
    flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist()])
    order = np.argsort(v, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
    size = np.diff(np.append(starts, len(v)))
    any_ = np.bitwise_or.reduceat(flags[order], starts)
    good = (any_ & 1 > 0) & ((size > 1) | (any_ & 2 > 0))
    yes = np.zeros(len(v), dtype=bool)
    yes[order] = np.repeat(good, size)
    return _answers(_bit_rows(parts, bucket, 1, yes, row))


def _match_windows(table: pa.Table) -> pa.Table:
    """A window occurs in an earlier range if its least range is below one's own."""
    parts, bucket, v, row = _gathered(table, "<u8")
    own = np.array(parts)[row]
    order = np.argsort(v, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], v[order][1:] != v[order][:-1]]))
    least = np.minimum.reduceat(own[order], starts)
    yes = np.zeros(len(v), dtype=bool)
    yes[order] = own[order] > np.repeat(least, np.diff(np.append(starts, len(v))))
    return _answers(_bit_rows(parts, bucket, 2, yes, row))


def dedupe(docs: DataFrame, length: int = 50, part_chars: int = 4_000_000, bucket_words: int = 2_000_000) -> DataFrame:
    """Per document row: doc_id, n_words, n_removed, kept (text: kept words joined by spaces), kept_sha256.

    part_chars bounds the text of an id range, bucket_words the hashes of a bucket, on average;
    both numbers of tasks are derived from the size of the input.
    """
    every, spark = common.pick(docs, doc_id="long", text="string"), docs.sparkSession
    docs = every.filter("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = common.parts_for(spark, -(-size // part_chars))
    buckets = 1 << max(0, (max(8, size // 6 // bucket_words) - 1).bit_length())
    bounds = sorted({int(x) for x in docs.approxQuantile("doc_id", [i / n_parts for i in range(1, n_parts)], 0.1 / n_parts)}) if n_parts > 1 else []
    cut = np.array(bounds, dtype=np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cut, ids.astype("int64"), "right").astype("int32"))

    dealt = docs.withColumn("part", part_of("doc_id")).repartition(n_parts, "part")
    part_at = lambda t: t.column("part")[0].as_py()

    def probe(table: pa.Table) -> pa.Table:
        found = Range(table, length, buckets)
        distinct, _, _, flags = found.anchors()
        cut_down = ((distinct << np.uint64(found.bits)) >> np.uint64(32)).astype("<u4")
        return _packed(part_at(table), found, distinct, cut_down, flags)

    def extended(table: pa.Table, answers: pa.Table):
        found = Range(table, length, buckets)
        distinct, at, inverse, _ = found.anchors()
        starts = found.candidates(at[found.answered(distinct, answers, 1)[inverse]])
        return found, starts, *found.windows(starts)

    def extend(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table) or not len(answers):
            return PACKED_TYPES.empty_table()
        found, _, distinct, _, _ = extended(table, answers)
        return _packed(part_at(table), found, distinct, distinct.astype("<u8"), None)

    out_types = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return out_types.empty_table()
        found, starts, distinct, inverse, here = extended(table, answers)
        starts = starts[here | found.answered(distinct, answers, 2)[inverse]]
        edge = np.zeros(len(found.h) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows, begin = [], 0
        for doc_id, text, end in zip(found.ids, found.texts, found.ends.tolist(), strict=True):
            mask, words = gone[begin:end], common.words(text)
            kept = b" ".join([w for w, x in zip(words, mask.tolist(), strict=True) if not x] if mask.any() else words)
            rows.append((doc_id, len(words), int(mask.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            begin = end
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types.types, strict=True)], schema=out_types)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(None, len(w), 0, (kept := b" ".join(w)).decode(), hashlib.sha256(kept).hexdigest()) for w in map(common.words, batch.column(1).to_pylist())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out_types.types, strict=True)], schema=out_types)

    anchors = dealt.groupBy("part").applyInArrow(probe, PACKED)
    hits = anchors.groupBy("bucket").applyInArrow(_match_anchors, ANSWER)
    windows = dealt.groupBy("part").cogroup(hits.groupBy("part")).applyInArrow(extend, PACKED)
    earlier = windows.groupBy("bucket").applyInArrow(_match_windows, ANSWER)
    answers = hits.unionByName(earlier)
    result = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    done = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(remove, result)
    return done.unionByName(every.filter("doc_id is null").mapInArrow(whole, result))
