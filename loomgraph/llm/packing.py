"""Packing: sum-of-squares online packing of tokenised documents into fixed windows.

Every document is cut into whole windows and one remainder. A remainder of size s goes to the
fill level h (0: a new window) for which the sum over levels of N(level)^2 grows least, N being
the counts of partly filled windows kept in a level array. Each task packs the rows of its own
input split, so no row moves and a lost task repeats alone. What is still partly filled at the
end of a task, or once `max_open` windows are open, is poured together with cuts, the last
tokens into windows whose lengths are powers of two; these need no padding.

Null and empty texts hold the end id alone. Repeated rows and null ids are packed like any row.
An empty table gives no pieces.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomgraph.llm import common

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
TYPES = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def encoder(path: str, added: bool = False) -> Callable[[str], np.ndarray]:
    """Text to ids for a byte-level BPE tokenizer file of the `tokenizers` library.

    The merges of such a file are ordered as its ids are, so its vocabulary serves as ranks for
    tiktoken, which yields equal ids in a third of the time (a test compares both). With `added`,
    strings of the file's added tokens within a text get their own ids, as `tokenizers` gives them
    by default: it encodes the texts that hold one. Otherwise they are ordinary text.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    contents = {x["content"] for x in model["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in contents}
    own = tiktoken.Encoding("loomgraph", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = cache(lambda: Tokenizer.from_file(path))

    def encode(text: str) -> np.ndarray:
        if added and any(x in text for x in contents):
            return np.array(whole().encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(own.encode_ordinary(text), dtype="<u4")

    return encode


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Packer:
    """One task's level array. Finished windows are handed out as lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, size: int = 1024, max_open: int = 8192):
        self.size, self.max_open = size, max_open
        self.counts = np.zeros(size + 1, dtype=np.int64)
        self.levels: list[deque] = [deque() for _ in range(size)]

    def add(self, doc_id, ids: np.ndarray) -> Iterator[list]:
        n, size = len(ids), self.size
        whole = n - n % size
        for start in range(0, whole, size):
            yield [(doc_id, start, ids[start : start + size], n)]
        if whole < n:
            full = self.place((doc_id, whole, ids[whole:], n))
            if full:
                yield full
            if self.counts.sum() >= self.max_open:
                yield from self.flush()

    def place(self, piece) -> list | None:
        s, size, n = len(piece[2]), self.size, self.counts
        after = n[s : size + 1].copy()  # after[h] = N(h + s); a full window counts nothing
        after[size - s] = 0
        grows = 2 * (after - n[: size - s + 1]) + 2
        grows[size - s] -= 1
        grows[n[: size - s + 1] == 0] = np.iinfo(np.int64).max
        grows[0] = 2 * n[s] + 1
        h = size - s - int(np.argmin(grows[::-1]))  # of equals the fullest
        window = self.levels[h].popleft() if h else []
        n[h] -= bool(h)
        window.append(piece)
        if h + s == size:
            return window
        self.levels[h + s].append(window)
        n[h + s] += 1
        return None

    def flush(self) -> Iterator[list]:
        """Pour all partly filled windows together; only here is a remainder cut."""
        pieces = [p for level in reversed(self.levels) for window in level for p in window]
        for level in self.levels:
            level.clear()
        self.counts[:] = 0
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc_id, start, ids, n = pieces.pop()
                window.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], n))
                room -= min(room, len(ids))
            yield window


def pack(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, end_id: int = 0, max_open: int = 8192, added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. added: as in encoder()."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer or default_tokenizer(), added), Packer(size, max_open)
        sequence = TaskContext.get().partitionId() << 40
        end = np.array([end_id], dtype="<u4")
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(TYPES)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=TYPES)

        def windows() -> Iterator[list]:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield from packer.add(doc_id, np.concatenate([encode(text), end]) if text else end)
            yield from packer.flush()

        for window in windows():
            offset = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), n, sequence, offset))
                offset += len(ids)
            sequence += 1
            if len(rows) >= 20_000:
                yield out()
        if rows:
            yield out()

    return common.pick(docs, doc_id="long", text="string").mapInArrow(task, SCHEMA)
