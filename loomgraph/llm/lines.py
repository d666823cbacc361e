"""Fuzzy line deduplication: MinHash signatures of character shingles, banding, exact Jaccard, union-find.

A line (text between \\n) is compared after A-Z are lower-cased and runs of white space become one
space. Its set holds the distinct shingles of `width` characters, or the whole line if it has
fewer. Two lines are linked from a Jaccard similarity of percent/100 on. Candidates share a band of
their signatures: with 16 bands of 4 rows a pair at 0.8 is missed once in 4,700 times. They are
then compared exactly, and of each component of lines the first stays: of the smallest doc_id,
then the smallest line number. All others go.

Signatures split the range of one hash into as many bins as rows (one-permutation hashing); empty
bins take the next full bin's value. Lines of fewer shingles than bins are hashed ROUNDS times, each
time into a share of the bins; lines near that size have both kinds of keys, so that similar lines
always share one.

Shingles have nine characters: of five, unrelated lines of a language share so many that candidates
grow with the square of the corpus (README has figures).

Lines without a word are blank; they are never removed. Null texts stay null and have no lines.
A null doc_id counts as smaller than every id. Rows of one doc_id are one document: where they
hold the same line at the same place, each keeps it.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, similar
from loomgraph.llm.jaccard import is_linked

BANDS, ROWS = 16, 4
BINS = BANDS * ROWS
#: Lines of few shingles are hashed so many times over, each time into BINS // ROUNDS bins.
ROUNDS = 4
_SEEDS = np.random.default_rng(20_240_502).integers(1, 1 << 63, (2, 64), dtype=np.uint64) | np.uint64(1)
_EMPTY = np.uint32(0xFFFFFFFF)
_ODD = np.uint64(0xFF51AFD7ED558CCD)
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t\r\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz    ")


def normalised(text: str | bytes | None) -> list[bytes]:
    """The lines of a text as UTF-8: A-Z lower-cased, runs of U+0020 and U+0009 to U+000D one space, none at the ends."""
    if not text:
        return []
    raw = (text if isinstance(text, bytes) else text.encode()).translate(_PLAIN).strip(b" ")
    low = np.frombuffer(raw, np.uint8) <= 32  # a space beside white space makes two such bytes in a row
    if (low[1:] & low[:-1]).any():
        while b"  " in raw:
            raw = raw.replace(b"  ", b" ")
        raw = raw.replace(b" \n", b"\n").replace(b"\n ", b"\n")
    return raw.split(b"\n")


def normal(line: str) -> str:
    """One line, as of normalised()."""
    return b" ".join(line.encode().lower().split()).decode()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x *= _ODD
    x ^= x >> np.uint64(33)
    return x


def _sums(codes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` codes the sum of code j times the power j + 1 of an odd number; sums of half the width make those of the whole."""
    base, one = int(_SEEDS[0, 0]), codes * _SEEDS[0, 0]
    out, size = one, 1
    for bit in bin(width)[3:]:
        longer = out[size:] * np.uint64(pow(base, size, 1 << 64))
        longer += out[: len(longer)]
        out, size = longer, 2 * size
        if bit == "1":
            longer = out[1:] * _SEEDS[0, 0]
            longer += one[: len(longer)]
            out, size = longer, size + 1
    return out


def hashes(lines: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all lines, repeats included, and how many each line has.

    A shingle's hash is a sum of its code points times powers of an odd number, mixed.
    """
    joined = b"".join(lines)
    codes = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array(list(map(len, lines)), dtype=np.int64)
    if len(codes) < len(joined):  # less the bytes that begin no code point
        within = np.flatnonzero((np.frombuffer(joined, np.uint8) & np.uint8(0xC0)) == np.uint8(0x80))
        size -= np.diff(np.searchsorted(within, np.cumsum(size)), prepend=0)
    n, ends, count = max(len(codes) - width + 1, 0), np.cumsum(size), np.maximum(size - width + 1, 1)
    x = _sums(codes, width)
    inside = np.ones(len(codes), dtype=bool)  # where a whole shingle starts
    inside[(ends[:, None] - np.minimum(np.arange(1, width), np.maximum(size, 1)[:, None])).ravel()] = False
    short = np.flatnonzero(size < width)
    if not len(short):
        return _mix(x[inside[:n]]), count
    inside[(ends - size)[short]] = False
    out, place = np.empty(count.sum(), dtype=np.uint64), np.cumsum(count) - count
    long_ = np.ones(len(out), dtype=bool)
    long_[place[short]] = False
    out[long_] = _mix(x[inside[:n]])
    out[place[short]] = [xxhash.xxh64_intdigest(lines[i]) for i in short]
    return out, count


def tokens_of(lines: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, sorted."""
    return [x for h, ends in _distinct(lines, width) for x in np.split(h, ends[:-1])]


def _distinct(lines: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For lines of about a batch each: the distinct shingle hashes of all, sorted within each line, and where each line's end."""
    for some in _batches(lines):
        h, count = hashes(some, width)
        ends = np.cumsum(count)
        for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False):
            h[a:b].sort()
        fresh = np.concatenate([[True], h[1:] != h[:-1]])
        fresh[ends[:-1]] = True
        yield h[fresh], np.cumsum(fresh)[ends - 1]


def tokens(line: str, width: int) -> np.ndarray:
    return tokens_of([line.encode()], width)[0]


def _batches(lines: list[bytes], limit: int = common.CHUNK_CHARS // 8) -> Iterator[list[bytes]]:
    start = total = 0
    for i, line in enumerate(lines):
        if total and total + len(line) > limit:
            yield lines[start:i]
            start, total = i, 0
        total += len(line)
    if start < len(lines):
        yield lines[start:]


def _least(x: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """Signatures [rows, bins]: the least hash of each row in each bin of the range of hashes, a power of two of bins. row: the row of each hash times bins."""
    out = np.full(rows * bins, _EMPTY, dtype=np.uint32)
    at = x >> np.uint64(65 - bins.bit_length())
    at += row
    np.minimum.at(out, at.view(np.int64), x.astype(np.uint32))
    return out.reshape(rows, bins)


def _filled(signature: np.ndarray) -> np.ndarray:
    """Empty bins take the next full bin's value, around the end, and how far it is."""
    rows, bins = signature.shape
    out = signature.astype(np.uint64)
    at = np.flatnonzero((signature == _EMPTY).any(1))
    if len(at):
        some = signature[at]
        place = np.where(some != _EMPTY, np.arange(bins, dtype=np.int32), np.int32(2 * bins))
        least = place.min(1, keepdims=True) + np.int32(bins)  # the first full bin, met again after the end
        nxt = np.minimum(np.minimum.accumulate(place[:, ::-1], 1)[:, ::-1], least)
        far = nxt - np.arange(bins, dtype=np.int32)
        nxt %= bins
        out[at] = some.ravel()[nxt + (np.arange(len(at), dtype=np.int32) * bins)[:, None]] + (far.astype(np.uint64) << np.uint64(32))
    return out


def _banded(signature: np.ndarray, kind: int) -> np.ndarray:
    """Keys [lines, BANDS] of signatures [lines, BINS]."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.full(rows.shape[:2], np.uint64(kind), dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + rows[:, :, j])
    return out


def line_keys(lines: list[str] | list[bytes], width: int, percent: int) -> list[np.ndarray]:
    """The band keys of each line."""
    lines = [x.encode() if isinstance(x, str) else x for x in lines]
    h, count = hashes(lines, width)
    edge = BINS * 100 // percent
    few, many = count <= edge, count > BINS
    at = np.flatnonzero(many)
    signature = _least(h, np.repeat(np.arange(len(lines), dtype=np.uint64) * np.uint64(BINS), count), len(lines), BINS)[at]
    # Which kinds of keys a line must have depends on its distinct shingles, of which lines with many empty bins may have few.
    some = np.zeros(len(lines), dtype=bool)
    some[at[((signature != _EMPTY).sum(1) <= BINS * 7 // 8) & (count[at] > edge)]] = True
    if some.any():
        n, rows = count[some], np.flatnonzero(some)
        # Sorted by line, then by the upper bits of the hash; equal upper bits of unequal hashes only make keys of both kinds.
        x = np.sort((np.repeat(np.arange(len(rows), dtype=np.uint64), n) << np.uint64(40)) | (h[np.repeat(some, count)] >> np.uint64(24)))
        repeats = np.concatenate([[False], x[1:] == x[:-1]])
        few[rows] = n - np.bincount((x[repeats] >> np.uint64(40)).astype(np.int64), minlength=len(rows)) <= edge
    keys: list[np.ndarray | None] = [None] * len(lines)
    for i, x in zip(at.tolist(), _banded(_filled(signature), 2 << 32), strict=True):
        keys[i] = x
    at = np.flatnonzero(few)
    if len(at):
        bins = BINS // ROUNDS
        x, row = h[np.repeat(few, count)], np.repeat(np.arange(len(at), dtype=np.uint64) * np.uint64(bins), count[at])
        rounds = [_filled(_least(_mix(x * _SEEDS[0, j] + _SEEDS[1, j]), row, len(at), bins)) for j in range(ROUNDS)]
        for i, x in zip(at.tolist(), _banded(np.concatenate(rounds, 1), 1 << 32), strict=True):
            keys[i] = x if keys[i] is None else np.concatenate([keys[i], x])
    return keys


def node_of(line: bytes) -> bytes:
    return xxhash.xxh3_128_digest(line)


def _packed(table: pa.Table) -> similar.Packed:
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").cast(pa.binary()).to_pylist()
    number: dict[bytes, int] = {}
    members: list[tuple] = []
    for doc_id, text in sorted(zip(ids, texts, strict=True), key=lambda x: (x[0] is not None, x[0] or 0)):
        for place, line in enumerate(normalised(text)):
            if line:
                i = number.setdefault(line, len(members))
                if i == len(members):
                    members.append((doc_id, place, i, None))
                elif place < members[i][1] and members[i][0] == doc_id:  # another row of this id
                    members[i] = doc_id, place, i, None
    return similar.Packed(list(map(node_of, number)), list(number), members)


def _keys(width: int, percent: int) -> similar.Keys:
    return lambda texts: [k for some in _batches(texts) for k in line_keys(some, width, percent)]


def _sketch(width: int) -> similar.Sketcher:
    return lambda texts: [x for h, ends in _distinct(texts, width) for x in zip(np.diff(ends, prepend=0).tolist(), similar.parities(h, ends), strict=True)]


def winners(dealt: DataFrame, size: int, width: int = 9, percent: int = 80) -> DataFrame:
    """(part, node, doc_id, place): for nodes that occur in several parts or are linked, as met in each part, the line that stays.

    dealt: doc_id, text and part, `size` bytes of text in all.
    """
    keyed, found = similar.shared_keys(dealt, _packed, _keys(width, percent), _sketch(width), size // 12, every=False)
    roots = similar.link(keyed, found, lambda texts: tokens_of(texts, width), is_linked(percent))
    members = found.filter(F.col("kind") == similar.MEMBER).select("part", "node", "digest", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "place").alias("at"))
    by_node = members.groupBy("node").agg(F.min("at").alias("at"), F.count("*").alias("parts"))
    rooted = by_node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rooted.groupBy("root").agg(F.min("at").alias("at"), F.count("*").alias("nodes"), F.max("parts").alias("most")).filter("nodes > 1 or most > 1")
    stays = rooted.select("node", "root").join(by_root.select("root", "at"), "root").select("node", "at")
    out = common.spill(members.select("part", "node", "digest").join(stays, "node").select("part", F.col("digest").alias("node"), "at.doc_id", "at.place"), "winners")
    common.forget(found, roots)
    return out


def dedupe(docs: DataFrame, width: int = 9, percent: int = 80, drop_empty: bool = False, part_chars: int = 4_000_000) -> DataFrame:
    """The documents, all columns, without the lines that go; with drop_empty, documents that lose all their lines with a word go too.

    Columns n_lines and n_removed (of the document's lines) follow unless drop_empty is set, named
    so unless the documents have columns of that name, which stay.
    """
    schema, names = docs.schema, docs.columns
    id_at, text_at = common.position(docs, "doc_id"), common.position(docs, "text")
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    plain = flat.withColumns({"doc_id": F.col(f"_{id_at}").cast("long"), "text": F.col(f"_{text_at}").cast("string")})
    dealt, size = common.deal(plain, part_chars)
    kept_lines = winners(dealt.select("doc_id", "text", "part"), size, width, percent)
    # Ids and texts that need no cast travel once.
    id_name, text_name = ("doc_id" if schema[id_at].dataType.simpleString() != "bigint" else f"_{id_at}"), ("text" if schema[text_at].dataType.simpleString() != "string" else f"_{text_at}")
    sent = dealt.select("part", *dict.fromkeys([*flat.columns, id_name, text_name]))
    extra = [] if drop_empty else [c for c in ("n_lines", "n_removed") if c not in [n.lower() for n in names]]

    def clean(table: pa.Table, winning: pa.Table) -> pa.Table:
        stays = dict(zip(winning.column("node").to_pylist(), zip(winning.column("doc_id").to_pylist(), winning.column("place").to_pylist(), strict=True), strict=True))
        ids, texts = table.column(id_name).to_pylist(), table.column(text_name).cast(pa.binary()).to_pylist()
        firsts = stays  # and the first places of the lines that no other part has
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))

        def named(i: int) -> list[bytes | None]:
            return [node_of(x) if x else None for x in normalised(texts[i])] or [None] * (texts[i] is not None)

        if len(set(ids)) < len(ids):  # of the rows of an id, the least place counts
            here: dict[bytes, tuple] = {}
            for i in order:
                for place, node in enumerate(named(i)):
                    if node is not None and node not in stays:
                        first = here.setdefault(node, (ids[i], place))
                        if place < first[1] and first[0] == ids[i]:
                            here[node] = ids[i], place
            firsts |= here
        out, total, removed, keep = list(texts), [0] * len(ids), [0] * len(ids), [True] * len(ids)
        for i in order:
            nodes = named(i)
            places = [(ids[i], place) for place in range(len(nodes))]
            good = [n is None or first == at for n, first, at in zip(nodes, map(firsts.setdefault, nodes, places), places, strict=True)]
            total[i], removed[i] = len(good), good.count(False)
            if removed[i]:
                out[i] = b"\n".join(itertools.compress(texts[i].split(b"\n"), good))
                keep[i] = removed[i] < len(nodes) - nodes.count(None)
        columns = table.select([f"_{i}" for i in range(len(names))])
        columns = columns.set_column(text_at, f"_{text_at}", pa.array(out, pa.binary()).cast(columns.schema.field(text_at).type))
        for name, values in (("n_lines", total), ("n_removed", removed)):
            if name in extra:
                columns = columns.append_column(name, pa.array(values, pa.int64()))
        return columns.filter(pa.array(keep, pa.bool_())) if drop_empty else columns

    result = sent.groupBy("part").cogroup(kept_lines.groupBy("part"))
    fields = ", ".join([f"_{i} {f.dataType.simpleString()}" for i, f in enumerate(schema)] + [f"{c} long" for c in extra])

    def task(table: pa.Table, winning: pa.Table) -> pa.Table:
        if not len(table):
            kept = [table.schema.field(f"_{i}") for i in range(len(names))] if len(table.schema) else []
            return pa.schema(kept + [pa.field(c, pa.int64()) for c in extra]).empty_table()
        return clean(table, winning)

    return result.applyInArrow(task, fields).toDF(*names, *extra)


def digest(docs: DataFrame, width: int = 9, percent: int = 80) -> DataFrame:
    """Per document row: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left; a null text as the empty one)."""
    done = dedupe(common.pick(docs, doc_id="long", text="string"), width, percent)
    return done.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
