"""A linear-chain conditional random field over the lines of documents, two labels (1: good, 0: bad).

score(y | lines) = sum of w . x_t for lines with y_t = 1, plus a transition score for each pair of
neighbouring lines. x_t holds the line's own features and those of the lines before and after.
All passes run over many documents at once, one numpy step for each line number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: Phrases of licence and navigation lines.
STOCK = re.compile(r"(?i)licen[sc]e|all rights reserved|copyright|terms of (?:use|service)|privacy policy|cookies|click here|subscribe|sign up|log ?in|read more|share (?:this|on)")
NAMES = ("words", "word_length", "upper", "symbols", "digits", "stops", "shouts", "bars", "distinct", "seen", "ended", "capital", "stutter", "stock", "blank", "short")
N = len(NAMES)
_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _SHOUT, _BAR, _WHITE = (1 << i for i in range(8))


def _classes() -> np.ndarray:
    table = np.zeros(1 << 16, dtype=np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        table[i] = _UPPER * c.isupper() | _LOWER * (c.isalpha() and not c.isupper()) | _DIGIT * c.isdigit()
    for chars, bit in (("#*$%&|<>", _SYMBOL), (".,;:?!", _STOP), ("!", _SHOUT), ("|", _BAR), (" \t\n\r\x0b\x0c", _WHITE)):
        for c in chars:
            table[ord(c)] |= bit
    table[0xD800:0xE000] = _LOWER  # also stands for all beyond U+FFFF
    return table


_TABLE: list[np.ndarray] = []


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Features of every line of the texts, lines per text, characters per line, and counts per text.

    Counts: n_words, word_chars, n_symbols (characters of `#*$%&|<>`), n_dup_lines (lines with a
    word that equal an earlier one).
    """
    if not _TABLE:
        _TABLE.append(_classes())
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), dtype=np.uint32)
    kind = _TABLE[0][np.where(raw > 0xFFFF, 0xD800, raw)]
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    per_text = np.array([t.count("\n") + 1 for t in texts])
    total = lambda bits: np.add.reduceat((kind & bits > 0).astype(np.int32), starts).astype(np.float64)
    white = kind & _WHITE > 0
    begins = ~white & np.concatenate([[True], white[:-1]])
    n_words = np.add.reduceat(begins.astype(np.int32), starts).astype(np.float64)
    length = (ends - starts).astype(np.float64)
    chars = np.add.reduceat((~white).astype(np.int32), starts).astype(np.float64)
    symbols, upper, lower = total(_SYMBOL), total(_UPPER), total(_LOWER)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)

    x = np.zeros((len(ends), N))
    x[:, 0] = np.log1p(n_words) / 5
    x[:, 1] = np.minimum(chars / w / 10, 2)
    x[:, 2] = upper / np.maximum(upper + lower, 1)
    x[:, 3] = np.minimum(symbols / w, 1.5)
    x[:, 4] = total(_DIGIT) / c
    x[:, 5] = np.minimum(total(_STOP) / w, 1.5)
    x[:, 6] = np.minimum(total(_SHOUT) / w, 1.5)
    x[:, 7] = np.minimum(total(_BAR) / w, 1.5)
    x[:, 14] = n_words == 0
    x[:, 15] = n_words < 5
    dup, i = np.zeros(len(ends)), 0
    for text in texts:
        seen: set[str] = set()
        for line in text.split("\n"):
            if found := line.encode().split():  # words end at U+0020 and U+0009 to U+000D alone
                x[i, 8] = len(set(found)) / len(found)
                x[i, 12] = sum(map(bytes.__eq__, found, found[1:])) / len(found)
                x[i, 10] = found[-1][-1] in b".!?:;\"'"
                x[i, 11] = found[0].decode()[0].isupper()
                x[i, 13] = STOCK.search(line) is not None
                dup[i] = line in seen
                seen.add(line)
            i += 1
    x[:, 9] = dup * (n_words > 0)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    by_text = lambda v: np.add.reduceat(v, first).astype(np.int64)
    counts = {"n_words": by_text(n_words), "word_chars": by_text(chars), "n_symbols": by_text(symbols), "n_dup_lines": by_text(x[:, 9])}
    return x, per_text, length, counts


def neighbours(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """[own, previous, next, first line, last line, 1] for every line."""
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    last = first + per_text - 1
    before, after = np.roll(x, 1, 0), np.roll(x, -1, 0)
    edge = np.zeros((len(x), 3))
    edge[first, 0] = edge[last, 1] = edge[:, 2] = 1
    before[first] = 0
    after[last] = 0
    return np.hstack([x, before, after, edge])


WIDTH = 3 * N + 3


class Chain:
    """Weights w [WIDTH] and transitions t [2, 2]."""

    def __init__(self, w: np.ndarray | None = None, t: np.ndarray | None = None):
        self.w = np.zeros(WIDTH) if w is None else w
        self.t = np.zeros((2, 2)) if t is None else t

    @staticmethod
    def _steps(per_text: np.ndarray):
        """Texts from long to short, where each begins, and how many have a t-th line."""
        order = np.argsort(-per_text, kind="stable")
        first = (np.concatenate([[0], np.cumsum(per_text)[:-1]]))[order]
        alive = len(order) - np.searchsorted(per_text[order][::-1], np.arange(1, per_text.max(initial=0) + 1))
        return first, alive

    def marginals(self, s: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """P(good) of each line by forward-backward, expected transition counts, and the sum of log partition functions."""
        first, alive = self._steps(per_text)
        node = np.stack([np.zeros_like(s), s], 1)
        fwd, bwd = np.zeros_like(node), np.zeros_like(node)
        for t, n in enumerate(alive):
            at = first[:n] + t
            fwd[at] = node[at] + (np.logaddexp(fwd[at - 1, :1] + self.t[0], fwd[at - 1, 1:] + self.t[1]) if t else 0)
        pairs = np.zeros((2, 2))
        z = np.zeros(len(s))
        for t in range(len(alive) - 1, -1, -1):
            n, more = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
            at = first[:more] + t
            if more:
                ahead = node[at + 1] + bwd[at + 1]
                bwd[at] = np.logaddexp(ahead[:, :1] + self.t[:, 0], ahead[:, 1:] + self.t[:, 1])
                z[at] = z[at + 1]
            over = first[more:n] + t
            z[over] = np.logaddexp(fwd[over, 0], fwd[over, 1])
            if more:
                p = np.exp(fwd[at][:, :, None] + self.t[None] + ahead[:, None, :] - z[at][:, None, None])
                pairs += p.sum(0)
        good = np.exp(np.minimum(fwd[:, 1] + bwd[:, 1] - z, 0))
        return good, pairs, float(z[first].sum()) if len(first) else 0.0

    def decode(self, s: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The likeliest labels by Viterbi; equal scores keep the label good."""
        first, alive = self._steps(per_text)
        node = np.stack([np.zeros_like(s), s], 1)
        best, back = np.zeros_like(node), np.zeros(node.shape, dtype=np.int8)
        for t, n in enumerate(alive):
            at = first[:n] + t
            best[at] = node[at]
            if t:
                via = best[at - 1][:, :, None] + self.t[None]
                back[at] = via[:, 1] >= via[:, 0]
                best[at] += via.max(1)
        label = np.zeros(len(s), dtype=np.int8)
        for t in range(len(alive) - 1, -1, -1):
            more = alive[t + 1] if t + 1 < len(alive) else 0
            at, over = first[:more] + t, first[more : alive[t]] + t
            label[over] = best[over, 1] >= best[over, 0]
            label[at] = back[at + 1, label[at + 1]]
        return label

    def fit(self, x: np.ndarray, per_text: np.ndarray, y: np.ndarray, rounds: int = 250, decay: float = 1e-4) -> Chain:
        """Conditional likelihood by Adam. y: a label for each line."""
        if not len(y):
            return self
        ends = np.cumsum(per_text) - 1
        inside = np.ones(len(y), dtype=bool)
        inside[ends] = False
        at = np.flatnonzero(inside)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[at], y[at + 1]), 1)
        theta, m, v = np.concatenate([self.w, self.t.ravel()]), 0.0, 0.0
        for i in range(1, rounds + 1):
            self.w, self.t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
            good, pairs, _ = self.marginals(x @ self.w, per_text)
            g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(y) - decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + 0.1 * (1 - i / (rounds + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        self.w, self.t = theta[:WIDTH], theta[WIDTH:].reshape(2, 2)
        return self


def line_labels(x: np.ndarray, per_text: np.ndarray, y: np.ndarray, rounds: int = 30, decay: float = 1.0) -> np.ndarray:
    """Weak labels of lines from labels of their documents (y, for each line), 1: content, 0: boilerplate.

    A line model, logistic in the line's own features alone, learns from the documents' labels, both
    weighing the same; documents are mixed, so it meets the same kinds of lines under both labels. A
    line of a bad document that the model takes for one of a good document is content. Lines with
    stock phrases, and lines that repeat an earlier one of their document, are boilerplate anywhere.
    """
    own = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1)) * len(y)
    w = np.zeros(own.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
        step = np.linalg.solve((own * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ own + decay * np.eye(len(w)), own.T @ (weight * (y - p)) - decay * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    content = (y == 1) | (own @ w > 0)
    return (content & (x[:, NAMES.index("stock")] == 0) & (x[:, NAMES.index("seen")] == 0)).astype(y.dtype)


def _sample_features(most_lines: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 0):
            texts, y = [t or "" for t in batch.column(0).to_pylist()], batch.column(1).to_pylist()
            some = [(t, k) for t, k in zip(texts, y, strict=True) if t.count("\n") < most_lines]
            if some:
                x, per_text, _, _ = line_features([t for t, _ in some])
                cut = np.cumsum(per_text)[:-1]
                yield pa.RecordBatch.from_arrays([pa.array([p.astype("<f4").tobytes() for p in np.split(x, cut)], pa.binary()), pa.array([k for _, k in some], pa.int32())], names=["x", "y"])

    return task


def train(docs: DataFrame, labels: DataFrame, limit: int = 3000, most_lines: int = 500, weak: bool = False) -> Chain:
    """A chain trained on at most `limit` labelled documents of each label, those with the least hash of their id.

    docs: doc_id, text. labels: doc_id, y (0 or 1); of several labels of a document the least
    counts. Every line takes its document's label or, with `weak`, one of line_labels(). Only ids
    are compared to choose the sample, 2 * limit ids at most are broadcast, and only features of
    lines reach the driver, of documents of up to `most_lines` lines. Without rows of both labels
    the chain stays at zero, where everything scores 0.5.
    """
    labels = labels.filter("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    chosen = None
    for y in (0, 1):
        rows = labels.filter(F.col("y") == y).select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = rows if chosen is None else chosen.unionByName(rows)
    sample = docs.join(F.broadcast(chosen), "doc_id").select("text", F.col("y").cast("int").alias("y"))
    rows = sample.mapInArrow(_sample_features(most_lines), "x binary, y int").collect()
    if len({r["y"] for r in rows}) < 2:
        return Chain()
    rows.sort(key=lambda r: (r["y"], bytes(r["x"])))  # the order in which tasks end must not matter
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, N).astype(float) for r in rows]
    per_text = np.array([len(p) for p in parts])
    x, y = np.vstack(parts), np.repeat([r["y"] for r in rows], per_text)
    return Chain().fit(neighbours(x, per_text), per_text, line_labels(x, per_text, y) if weak else y)
