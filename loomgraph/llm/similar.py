"""Linking similar sets among nodes (documents or lines) by shared keys, exactly and without pairing groups.

A node is a set of 64-bit tokens, known by a 128-bit digest of its text; equal texts are one node.
Each node has keys; two nodes whose sets are similar share a key (surely or almost surely, as the
operator's keys promise). The search never forms the pairs of a group:

1. Rows are dealt to parts. Each part is packed into one row of distinct nodes and their members, and
   sends the digest of each node to a hash bucket, which names its first place: part and number
   there. That is the node's id from then on; only the first place takes part in what follows.
2. Each part signs its nodes once and sends every distinct key once, cut to 32 bits, with its least
   node, to a hash bucket; further nodes of the key in that part are told of this least one. A
   bucket tells the nodes of keys that come from several parts of the least of them. So a key of
   any share of all nodes is one entry of each part. What a node is told of is its head.
3. Each node is compared with the least of its heads, if their parity sketches allow a link: both
   texts are read again and their sets compared exactly. What is linked so far forms components.
4. Keys whose nodes are in one component are done. Of the others, nodes whose parity sketch differs
   from that of every node of the key in more bits than linked sets differ in tokens are done too
   (nodes of keys with more than `most` are tested block by block). Every node left is compared with
   the key's least node in the same way, and the difference of the two sets is kept.
5. Where such a head still has nodes that are not in one component with it, two of its nodes x and y
   may be similar all the same. The symmetric difference of x and y is that of their differences
   from the head, so they are compared exactly without their texts: first with the least such node
   as a new head while more than `block` nodes are left, then all that still are in different
   components, in blocks of bounded size. A block emits a spanning forest of its links.

So no link is lost between nodes that share a key. A head may have any share of all nodes: it is
met by blocks of them, each of which reads the head's text once. Work beyond linear is spent on
nodes of one head that are similar to it yet not linked, growing with the square of their number
over `block`, and on the sketches of nodes of one key in several components: all pairs are tested.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import components
from loomgraph.llm.common import forget, spill


@dataclass
class Packed:
    """What an operator reads off the rows of a part: distinct nodes with their texts, and rows for members."""

    nodes: list[bytes] = field(default_factory=list)  # digests of 16 bytes
    texts: list[bytes] = field(default_factory=list)  # UTF-8
    members: list[tuple[int | None, int, int | None, int | None]] = field(default_factory=list)  # doc_id, place, number of the node, any mark
    keys: list[np.ndarray] | None = None  # of each node, if it takes its tokens to know the node; else they are made later


_PACKED = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("numbers", pa.binary()), ("nodes", pa.binary()), ("members", pa.binary()), ("keys", pa.binary())])
_SAME = pa.schema([("part", pa.int32()), ("numbers", pa.binary()), ("first", pa.binary())])
_SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("hashes", pa.binary()), ("numbers", pa.binary()), ("heads", pa.binary())])
_KEYED = pa.schema([("key", pa.int64()), ("head", pa.int64()), ("node", pa.int64())])
_FOUND = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int32()), ("node", pa.int64()), ("digest", pa.binary()), ("mark", pa.int64()), ("text", pa.binary()), ("sketch", pa.binary())])
FOUND = "kind int, part int, doc_id long, place int, node long, digest binary, mark long, text binary, sketch binary"
MEMBER, TEXT = 0, 1
#: Entries of a bucket, on average: bounds the memory of the task that answers for it.
BUCKET_KEYS = 1_000_000
Sketcher = Callable[[list[bytes]], list[tuple[int, bytes]]]  # size and parity sketch of the set of each text
Keys = Callable[[list[bytes]], list[np.ndarray]]  # distinct keys of the set of each text


def buckets_for(keys: int, least: int = 8) -> int:
    """A power of two of hash buckets for about so many keys."""
    return 1 << (max(least, -(-keys // BUCKET_KEYS)) - 1).bit_length()


def _ipc(columns: dict[str, pa.Array]) -> bytes:
    sink, table = pa.BufferOutputStream(), pa.table(columns)
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> dict[str, pa.Array]:
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    return {n: c.chunk(0) if c.num_chunks else pa.array([], c.type) for n, c in zip(table.column_names, table.columns, strict=True)}


def _slices(ordered: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The buckets, those with a hash, of sorted hashes."""
    if not len(ordered):
        return
    bucket = ordered >> np.uint64(64 - bits) if bits else np.zeros(len(ordered), np.uint64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    for b, i, j in zip(bucket[cut[:-1]].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        yield b, slice(i, j)


def _table(rows: list[tuple], types: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.types, strict=True)], schema=types)


def _shortened(keys: np.ndarray, bits: int) -> bytes:
    """Keys without the low bytes that no bucket sees."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, : min(8, (bits + 39) // 8)].tobytes()


def _lengthened(data: bytes, bits: int) -> np.ndarray:
    width = min(8, (bits + 39) // 8)
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view(">u8").ravel().astype(np.uint64)


def _narrow(numbers: np.ndarray, n: int) -> bytes:
    """Numbers below n; _wide() reads them."""
    return numbers.astype("<u2" if n <= 1 << 16 else "<u4").tobytes()


def _wide(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if len(data) == 2 * count else "<u4").astype(np.int64)


def _starts(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)


def _by_key(keys: np.ndarray, numbers: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of `bits` bits, sorted, with their numbers below n, ascending for each key; sorted as single words if both fit in one."""
    low = max(n - 1, 1).bit_length()
    if bits + low > 64:
        order = np.lexsort((numbers, keys))
        return keys[order], numbers[order].astype("<u4")
    both = keys << np.uint64(low)
    both |= numbers.astype(np.uint64)
    both.sort()
    return both >> np.uint64(low), (both & np.uint64((1 << low) - 1)).astype("<u4")


def _pack(part: int, packed: Packed, bits: int) -> pa.Table:
    """The row of a part, and its digests by bucket."""
    joined = b"".join(packed.nodes)
    digests = np.frombuffer(joined, "<u8").reshape(-1, 2)
    order = np.argsort(digests[:, 0], kind="stable")
    by_hash = digests[order]
    rows = [(part, b, by_hash[s].tobytes(), _narrow(order[s], len(order)), None, None, None) for b, s in _slices(by_hash[:, 0], bits)]
    nodes = {"digest": pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(packed.nodes), [None, pa.py_buffer(joined)]), "text": pa.array(packed.texts, pa.binary())}
    keys = None if packed.keys is None else _ipc({"keys": pa.array([_shortened(k, bits) for k in packed.keys], pa.binary())})
    ids, places, at, marks = zip(*packed.members, strict=True) if packed.members else ([], [], [], [])
    members = {"doc_id": pa.array(ids, pa.int64()), "place": pa.array(places, pa.int32()), "at": pa.array(at, pa.int32()), "mark": pa.array(marks, pa.int64())}
    return _table([*rows, (part, -1, None, None, _ipc(nodes), _ipc(members), keys)], _PACKED)


def _gathered(table: pa.Table, dtype: str, width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, parts and numbers of all entries of a bucket, and the id of each."""
    arrays = [np.frombuffer(x, dtype).reshape(-1, width) for x in table.column("hashes").to_pylist()]
    part = np.repeat(table.column("part").to_numpy().astype(np.int64), [len(a) for a in arrays])
    number = np.concatenate([_wide(x, len(a)) for x, a in zip(table.column("numbers").to_pylist(), arrays, strict=True)])
    return np.concatenate(arrays), part, number


def _match_nodes(table: pa.Table) -> pa.Table:
    """For parts that share nodes with others: numbers of such nodes and the id of their first place."""
    digests, part, number = _gathered(table, "<u8", 2)
    id_ = part << 32 | number
    order = np.lexsort((id_, digests[:, 1], digests[:, 0]))
    a, b = digests[order, 0], digests[order, 1]
    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    count = np.diff(np.append(starts, len(order)))
    shared = np.repeat(count > 1, count)
    at, first = order[shared], np.repeat(id_[order[starts]], count)[shared]
    by_part = np.argsort(part[at], kind="stable")
    at, first = at[by_part], first[by_part]
    cut = np.append(_starts(part[at]), len(at)).tolist()
    return _table([(int(part[at[i]]), number[at[i:j]].astype("<u4").tobytes(), first[i:j].astype("<i8").tobytes()) for i, j in zip(cut, cut[1:], strict=False)], _SAME)


def _ids(part: int, n: int, same: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a part's nodes, and which of them other parts have too."""
    ids, shared = part << 32 | np.arange(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for numbers, first in zip(same.column("numbers").to_pylist(), same.column("first").to_pylist(), strict=True):
        at = np.frombuffer(numbers, "<u4")
        ids[at], shared[at] = np.frombuffer(first, "<i8"), True
    return ids, shared


def _send(row: dict, same: pa.Table, keys_of: Keys, bits: int) -> pa.Table:
    """The keys of a part by bucket, and those of several of its nodes. row: part, and `keys` or else `nodes`."""
    nodes, part = _unpacked(row["keys"] if "keys" in row else row["nodes"]), row["part"]
    n = len(nodes["keys"] if "keys" in nodes else nodes["text"])
    own = np.flatnonzero(_ids(part, n, same)[0] >> 32 == part)
    some = pa.array(own)
    keys = [_lengthened(x, bits) for x in nodes["keys"].take(some).to_pylist()] if "keys" in nodes else keys_of(nodes["text"].take(some).to_pylist())
    number = np.repeat(own, [len(k) for k in keys])
    short, number = _by_key(np.concatenate(keys) >> np.uint64(32 - bits) if keys else np.zeros(0, np.uint64), number, 32 + bits, n)
    cut = short.astype("<u4")
    starts = _starts(short)
    rows = [(part, b, cut[starts][s].tobytes(), _narrow(number[starts][s], n), None) for b, s in _slices(short[starts] << np.uint64(32 - bits), bits)]
    count = np.diff(np.append(starts, len(short)))
    several = np.repeat(count > 1, count)
    if several.any():
        rows.append((part, -1 - part, short[several].astype("<i8").tobytes(), number[several].tobytes(), np.repeat(number[starts], count)[several].tobytes()))
    return _table(rows, _SENT)


def _match_keys(table: pa.Table) -> pa.Table:
    """(key, head, node) of keys that come from several parts; of keys of one part as that part says."""
    bucket = table.column("bucket")[0].as_py()
    if bucket < 0:
        row = table.to_pylist()[0]
        base = row["part"] << 32
        columns = np.frombuffer(row["hashes"], "<i8"), *(base | np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("heads", "numbers"))
        return pa.table([pa.array(c) for c in columns], schema=_KEYED)
    hashes, part, number = _gathered(table.sort_by("part"), "<u4")
    v, order = _by_key(hashes[:, 0].astype(np.uint64), np.arange(len(hashes)), 32, len(hashes))  # a part has a key once, so ids ascend
    id_ = (part << 32 | number)[order]
    starts = _starts(v)
    count = np.diff(np.append(starts, len(v)))
    shared = np.repeat(count > 1, count)
    columns = bucket << 32 | v[shared].astype(np.int64), np.repeat(id_[starts], count)[shared], id_[shared]
    return pa.table([pa.array(c) for c in columns], schema=_KEYED)


def _collect(row: dict, same: pa.Table, asked: pa.Table, sketch: Sketcher, every: bool) -> Iterator[pa.Table]:
    """FOUND rows of a part: members of nodes that are asked for or that other parts have too, or all; texts of those asked for."""
    nodes, members, part = _unpacked(row["nodes"]), _unpacked(row["members"]), row["part"]
    ids, shared = _ids(part, len(nodes["text"]), same)
    digest = nodes["digest"].cast(pa.binary())
    sent = np.sort(asked.column("node").to_numpy() & 0xFFFFFFFF).astype(np.int64)
    shared[sent] = True
    number = members["at"].fill_null(-1).to_numpy(zero_copy_only=False)
    shown = np.arange(len(number)) if every else np.flatnonzero((number >= 0) & shared[number]) if len(shared) else np.zeros(0, np.int64)
    n, take = len(shown), pa.array(shown)
    at = members["at"].take(take)
    fixed = lambda n, kind: (pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int32)))
    yield pa.table([*fixed(n, MEMBER), members["doc_id"].take(take), members["place"].take(take), pa.array(ids).take(at), digest.take(at), members["mark"].take(take), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], schema=_FOUND)
    text = nodes["text"].take(pa.array(sent))
    n, made = len(sent), sketch(text.to_pylist())
    yield pa.table([*fixed(n, TEXT), pa.nulls(n, pa.int64()), pa.array([x for x, _ in made], pa.int32()), pa.array(ids[sent]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), text, pa.array([x for _, x in made], pa.binary())], schema=_FOUND)


def shared_keys(dealt: DataFrame, pack: Callable[[pa.Table], Packed], keys_of: Keys | None, sketch: Sketcher, keys: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """Two written tables, of rows of `dealt` (a frame with `part`) with about so many keys in all. keys_of: None if pack() gives keys.

    (key, head, node): nodes of keys that several nodes have, each with a head, at times twice.
    FOUND rows: texts, sizes and parity sketches of these nodes; members of these and of nodes that
    several parts have or, with `every`, of all rows.
    """
    buckets = buckets_for(keys)
    bits = buckets.bit_length() - 1

    def first(table: pa.Table) -> pa.Table:
        return _pack(table.column("part")[0].as_py(), pack(table), bits)

    def send(packed: pa.Table, same: pa.Table) -> pa.Table:
        return pa.concat_tables([_SENT.empty_table(), *(_send(row, same, keys_of, bits) for row in packed.to_pylist())])

    def collect(packed: pa.Table, told: pa.Table) -> pa.Table:
        same, asked = told.filter(pa.compute.is_null(told.column("node"))), told.filter(pa.compute.is_valid(told.column("node")))
        return pa.concat_tables([_FOUND.empty_table(), *(t for row in packed.to_pylist() for t in _collect(row, same, asked, sketch, every))])

    packed = spill(dealt.groupBy("part").applyInArrow(first, "part int, bucket int, hashes binary, numbers binary, nodes binary, members binary, keys binary"), "packed")
    digests = packed.filter("bucket >= 0").select("part", "bucket", "hashes", "numbers")
    same = spill(digests.groupBy("bucket").applyInArrow(_match_nodes, "part int, numbers binary, first binary"), "same")
    parts = packed.filter("bucket < 0").select("part", "nodes", "members")
    signed = packed.filter("bucket < 0").select("part", "nodes" if keys_of else "keys")
    sent = signed.groupBy("part").cogroup(same.groupBy("part")).applyInArrow(send, "part int, bucket int, hashes binary, numbers binary, heads binary")
    keyed = spill(sent.groupBy("bucket").applyInArrow(_match_keys, "key long, head long, node long"), "keyed")
    asked = keyed.select("node").distinct().select(F.shiftright("node", 32).cast("int").alias("part"), F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("first"), "node")
    told = asked.unionByName(same.withColumn("node", F.lit(None).cast("long")))
    found = spill(parts.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(collect, FOUND), "found")
    forget(packed, same)
    return keyed, found


DIFFERENCE = "head long, node long, n_head int, n_node int, delta binary, linked boolean"
_DIFFERENCE = pa.schema([("head", pa.int64()), ("node", pa.int64()), ("n_head", pa.int32()), ("n_node", pa.int32()), ("delta", pa.binary()), ("linked", pa.bool_())])
Linked = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]  # sizes of intersection and of both sets
Tokens = Callable[[list[bytes]], list[np.ndarray]]  # of each text its tokens, sorted and distinct


def _linked_delta(linked: Linked, n_a, n_b, size):
    """Are sets of n_a and n_b tokens, `size` of them in one only, linked?"""
    return linked((n_a + n_b - size) // 2, n_a, n_b)


def link(keyed: DataFrame, found: DataFrame, tokens: Tokens, linked: Linked, block: int = 1500, rounds: int = 4) -> DataFrame:
    """(node, root) of nodes that are linked, from shared_keys()."""
    texts = found.filter(F.col("kind") == TEXT).select("node", "text")
    sketches = found.filter(F.col("kind") == TEXT).select("node", F.col("place").alias("size"), "sketch")
    first = spill(_near(keyed.groupBy("node").agg(F.min("head").alias("head")).filter("node <> head"), sketches, linked), "first")
    links = spill(_direct(_compared(first, texts, tokens, linked)), "links")
    forget(first)
    roots = components.components(links)

    rooted = keyed.select("key", "node").join(roots.withColumnRenamed("root", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    open_keys = rooted.groupBy("key").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.count("*").alias("n"), F.min("node").alias("head")).filter("a < b").select("key", "n", "head")
    open_rows = spill(rooted.join(open_keys, "key"), "open-rows")
    forget(keyed)
    pairs = spill(_possible(open_rows, sketches, linked).filter("node <> head").select("head", "node").distinct(), "pairs")
    forget(pairs if (none := pairs.isEmpty()) else None, open_rows)
    if none:
        return roots
    apart = spill(_compared(pairs, texts, tokens, linked), "apart")
    links = spill(links.unionByName(_direct(apart)), "direct")
    forget(pairs)
    state = None
    for i in range(rounds + 1):
        forget(roots, state)
        roots = components.components(links)
        state = spill(_with_roots(apart, roots), "state")
        away = F.col("own") != F.col("of_head")
        open_ = state.groupBy("head").agg(F.count("*").alias("n"), F.sum(F.length("delta")).alias("bytes"), F.count(F.when(away, 1)).alias("left"), F.min(F.when(away, F.col("node"))).alias("next")).filter("left > 0 and n > 1")
        open_ = spill(open_, "open")
        large = open_.filter(F.col("left") > block)
        if i == rounds or large.isEmpty():
            break
        links = spill(links.unionByName(_next_heads(state, large, linked)), "more")
    if open_.isEmpty():
        return roots
    links = spill(links.unionByName(_exhaust(state, open_, linked, block)), "rest")
    forget(apart, state, open_, roots)
    return components.components(links)


def parity(hashes: np.ndarray, most: int = 8192) -> bytes:
    """A bit sketch: each hash flips a bit. About two bits a hash, up to `most`."""
    bits = min(most, 1 << max(6, (2 * len(hashes) - 1).bit_length()))
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool)).tobytes()


def parities(hashes: np.ndarray, ends: np.ndarray, most: int = 8192) -> list[bytes]:
    """parity() of several sets, of which all hashes are given, and where each set's end; none is empty."""
    count = np.diff(ends, prepend=0)
    bits = np.minimum(most, 1 << np.maximum(6, np.ceil(np.log2(2 * count)).astype(np.int64)))
    start = np.cumsum(bits) - bits
    at = (hashes & np.repeat((bits - 1).astype(np.uint64), count)).view(np.int64) + np.repeat(start, count)
    flat = np.packbits((np.bincount(at, minlength=int(bits.sum())) & 1).astype(bool)).tobytes()
    return [flat[i:j] for i, j in zip((start // 8).tolist(), ((start + bits) // 8).tolist(), strict=True)]


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    """Sketches of one length folded to `width` bytes; folding keeps the bound."""
    return np.bitwise_xor.reduce(np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1, width), axis=1)


def may_link(n_a: np.ndarray, a: list[bytes], n_b: np.ndarray, b: list[bytes], linked: Linked) -> np.ndarray:
    """For each pair: sketches differ in no more bits than linked sets in tokens."""
    lengths = np.fromiter(map(len, a), np.int64, len(a)) << 32 | np.fromiter(map(len, b), np.int64, len(a))
    out = np.zeros(len(lengths), dtype=bool)
    for both in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == both)
        width = min(both >> 32, both & 0xFFFFFFFF)
        bits = np.bitwise_count(_folded([a[i] for i in at], width) ^ _folded([b[i] for i in at], width)).sum(1, dtype=np.int64)
        out[at] = _linked_delta(linked, n_a[at], n_b[at], np.maximum(bits, np.abs(n_a[at] - n_b[at])))
    return out


def _near(pairs: DataFrame, sketches: DataFrame, linked: Linked) -> DataFrame:
    """Those (head, node) whose sketches allow a link."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, marks = ([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 4)], [batch.column(i).to_pylist() for i in (3, 5)])
            yield batch.select(["head", "node"]).filter(pa.array(may_link(sizes[0], marks[0], sizes[1], marks[1], linked), pa.bool_()))

    # Joined by one name on either side, so the sketches are shuffled once.
    both = pairs.join(sketches, "node").alias("x").join(sketches.alias("y"), F.col("x.head") == F.col("y.node"))
    both = both.select("head", "x.node", "x.size", "x.sketch", F.col("y.size").alias("n_head"), F.col("y.sketch").alias("of_head"))
    return both.mapInArrow(task, "head long, node long")


def partners(sizes: np.ndarray, sketches: list[bytes], own: list, linked: Linked, second: np.ndarray | None = None) -> np.ndarray:
    """Which nodes may be linked with one of another component: sketches differ in no more bits than sets in tokens.

    second: nodes of a second block; then only pairs of a node of it and one of the others count.
    """
    width = min(map(len, sketches))
    x = np.concatenate([_folded([s], width) for s in sketches]).view(np.uint64)
    short = x if width <= 64 else np.bitwise_xor.reduce(x.reshape(len(x), -1, max(64, width // 4) // 8), axis=1)
    comp = np.unique(own, return_inverse=True)[1]
    out = np.zeros(len(sketches), dtype=bool)
    order = np.arange(len(x)) if second is None else np.argsort(second, kind="stable")
    x, short, comp, sizes, found = x[order], short[order], comp[order], sizes[order], out[order]
    begin = len(x) if second is None else int(len(x) - np.count_nonzero(second))

    def good(i: int, at: np.ndarray | slice, of: np.ndarray) -> np.ndarray:
        bits = np.maximum(np.bitwise_count(of[at] ^ of[i]).sum(1, dtype=np.int64), np.abs(sizes[at] - sizes[i]))
        return _linked_delta(linked, sizes[at], sizes[i], bits) & (comp[at] != comp[i])

    for i in range(begin):
        start = i + 1 if second is None else begin
        at = start + np.flatnonzero(good(i, slice(start, None), short))
        if len(at) and short is not x:  # a folded sketch tells less
            at = at[good(i, at, x)]
        if len(at):
            found[i] = found[at] = True
    out[order] = found
    return out


def _tested(key: np.ndarray, own: list, sizes: np.ndarray, sketches: list[bytes], linked: Linked, small: int = 24) -> np.ndarray:
    """Which of rows sorted by key may be linked with one of another component of the same key."""
    out = np.zeros(len(key), dtype=bool)
    starts = _starts(key)
    count = np.diff(np.append(starts, len(key)))
    for i, n in zip(starts[count > small].tolist(), count[count > small].tolist(), strict=True):
        out[i : i + n] = partners(sizes[i : i + n], sketches[i : i + n], own[i : i + n], linked)
    comp = np.unique(own, return_inverse=True)[1]
    end = np.repeat(starts + count, count)
    few = np.repeat(count <= small, count)
    for d in range(1, min(small, int(count.max(initial=0)))):
        i = np.flatnonzero(few[:-d] & (np.arange(len(key) - d) + d < end[:-d]) & (comp[:-d] != comp[d:]))
        good = i[may_link(sizes[i], [sketches[k] for k in i], sizes[i + d], [sketches[k + d] for k in i], linked)] if len(i) else i
        out[good] = out[good + d] = True
    return out


def _possible(rows: DataFrame, sketches: DataFrame, linked: Linked, most: int = 2000) -> DataFrame:
    """(head, node) of rows (key, head, node, own, n nodes of the key), without nodes that no sketch of another component's node of the key allows to be linked.

    The nodes of a key with over `most` are dealt to blocks; each pair of blocks, and each block with itself, is a group.
    """
    columns = ["key", "head", "node", "own", "size", "sketch"]
    small = rows.filter(F.col("n") <= most).join(sketches, "node").select(columns)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of one key, `most` at most

        def kept(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(c).to_pylist() for c in ("own", "sketch")]
            yes = _tested(table.column("key").to_numpy(), columns[0], table.column("size").to_numpy().astype(np.int64), columns[1], linked)
            yield from table.select(["head", "node"]).filter(pa.array(yes, pa.bool_())).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield from kept(held.slice(0, last))
                held = held.slice(last).combine_chunks()
        if held is not None and len(held):
            yield from kept(held)

    def of_blocks(table: pa.Table) -> pa.Table:
        own, sketch = (table.column(c).to_pylist() for c in ("own", "sketch"))
        second = table.column("block").to_numpy() != table.column("x").to_numpy() if table.column("x")[0] != table.column("y")[0] else None
        return table.select(["head", "node"]).filter(pa.array(partners(table.column("size").to_numpy().astype(np.int64), sketch, own, linked, second), pa.bool_()))

    tested = small.repartition("key").sortWithinPartitions("key").mapInArrow(task, "head long, node long")
    if rows.filter(F.col("n") > most).isEmpty():
        return tested
    # Blocks of `most` nodes: a row is sent once to each block of its key.
    blocks = F.ceil(F.col("n") / most).cast("int")
    dealt = rows.filter(F.col("n") > most).withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.join(sketches, "node").select(*columns, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    return tested.unionByName(dealt.groupBy("key", "x", "y").applyInArrow(of_blocks, "head long, node long"))


def _compared(pairs: DataFrame, texts: DataFrame, tokens: Tokens, linked: Linked, block: int = 500) -> DataFrame:
    """DIFFERENCE rows of pairs (head, node), a written table. The nodes of a head are dealt to blocks; each meets the head's text once."""

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: np.ndarray | None = None
        for batch in batches:
            rows, size = [], 0
            heads, nodes, given = (batch.column(i).to_pylist() for i in range(3))
            for head, node, y in zip(heads, nodes, tokens(given), strict=True):
                if node is None:
                    last = y
                    continue
                delta = np.setxor1d(last, y, assume_unique=True)
                rows.append((head, node, len(last), len(y), delta.tobytes(), bool(_linked_delta(linked, len(last), len(y), len(delta)))))
                size += 8 * len(delta)
                if size > 2_000_000:
                    yield from _table(rows, _DIFFERENCE).to_batches()
                    rows, size = [], 0
            if rows:
                yield from _table(rows, _DIFFERENCE).to_batches()
            pa.default_memory_pool().release_unused()

    blocks = pairs.groupBy("head").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    asked = pairs.join(blocks, "head").join(texts, "node").select("head", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), "node", "text")
    met = blocks.join(texts, F.col("head") == F.col("node")).select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("node"), "text")
    both = asked.unionByName(met).repartition("head", "block").sortWithinPartitions("head", "block", F.col("node").asc_nulls_first())
    return both.select("head", "node", "text").mapInArrow(difference, DIFFERENCE)


def _direct(compared: DataFrame) -> DataFrame:
    """Links (a, b) of nodes to their heads. One Python stage at a time: the comparison tells, a filter takes."""
    return compared.filter("linked").select(F.col("head").alias("a"), F.col("node").alias("b"))


def _with_roots(apart: DataFrame, roots: DataFrame) -> DataFrame:
    out = apart.join(roots.withColumnRenamed("root", "own"), "node", "left").withColumn("own", F.coalesce("own", "node"))
    heads = roots.select(F.col("node").alias("head"), F.col("root").alias("of_head"))
    return out.join(heads, "head", "left").withColumn("of_head", F.coalesce("of_head", "head"))


def _next_heads(state: DataFrame, large: DataFrame, linked: Linked) -> DataFrame:
    """Links of the nodes of large heads to the least node that is not linked with its head."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, n, delta, other, m, theirs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                size = len(np.setxor1d(np.frombuffer(delta, "<u8"), np.frombuffer(theirs, "<u8"), assume_unique=True))
                if _linked_delta(linked, np.int64(n), np.int64(m), np.int64(size)):
                    a.append(other)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    nexts = large.select("head", F.col("next").alias("node")).join(state.select("head", "node", "n_node", "delta"), ["head", "node"])
    nexts = nexts.select("head", F.col("node").alias("other"), F.col("n_node").alias("m"), F.col("delta").alias("theirs"))
    return state.join(nexts, "head").filter("node <> other").select("node", "n_node", "delta", "other", "m", "theirs").mapInArrow(task, "a long, b long")


def _exhaust(state: DataFrame, open_: DataFrame, linked: Linked, block: int, block_bytes: int = 6_000_000) -> DataFrame:
    """Links of the nodes that are not in their head's component to any of the head's nodes.

    The former are dealt to blocks, and so are all of them; each pair of blocks is a group.
    """
    # A block is bounded in nodes and, on average, in bytes of differences.
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
    asking = F.least(blocks, F.greatest(F.ceil(F.col("left") / block), F.ceil(F.col("bytes") / F.col("n") * F.col("left") / block_bytes)).cast("int"))
    rows = state.join(open_.select("head", blocks.alias("blocks"), asking.alias("asking")), "head")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["head", "x", "y", "node", "own", "n_node", "delta", "asks"]
    asking = rows.filter(F.col("own") != F.col("of_head")).withColumn("x", place("asking")).withColumn("y", every("blocks")).withColumn("asks", F.lit(True))
    asked = rows.withColumn("y", place("blocks")).withColumn("x", every("asking")).withColumn("asks", F.lit(False))
    names = columns[3:]

    def compare(table: pa.Table) -> pa.Table:
        found = forest(*(table.column(c).to_pylist() for c in names), linked)
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip("ab", found, strict=True)})

    return asking.select(columns).unionByName(asked.select(columns)).groupBy("head", "x", "y").applyInArrow(compare, "a long, b long")


def forest(nodes: list, own: list, sizes: list[int], deltas: list[bytes], asks: list[bool], linked: Linked) -> tuple[list, list]:
    """Links between nodes that ask and nodes that do not, as few as join the components `own`."""
    names = {c: i for i, c in enumerate(dict.fromkeys(own))}
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    comp, asking = np.array([names[c] for c in own]), np.array(asks)
    n = np.array(sizes, dtype=np.int64)
    arrays = [np.frombuffer(d, "<u8") for d in deltas]
    length = np.array([len(a) for a in arrays], dtype=np.int64)
    _, token = np.unique(np.concatenate(arrays), return_inverse=True)
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(nodes)), length)[order]
    first = np.searchsorted(token[order], np.arange(token.max(initial=-1) + 2))
    begin = np.concatenate([[0], np.cumsum(length)])
    a, b = [], []
    for i in np.flatnonzero(asking):
        mine = token[begin[i] : begin[i + 1]]
        both = np.bincount(np.concatenate([holder[first[t] : first[t + 1]] for t in mine]), minlength=len(nodes)) if len(mine) else 0
        good = _linked_delta(linked, n[i], n, length[i] + length - 2 * both) & (comp != comp[i]) & ~asking
        for j in np.flatnonzero(good):
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                parent[x] = y
                a.append(nodes[i])
                b.append(nodes[j])
    return a, b
