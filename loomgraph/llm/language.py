"""Language identification: script ranges, per-word scores, and Viterbi over words.

A language model is character trigrams of lower-cased words with word edges. Ranges of code
points give each word a script; only languages that are written in that script, as learned, can
label it. Viterbi over the words of a text, with a penalty for every change of language, labels
spans of mixed-language text. The language with most letters is the document's, its share of the
letters the score. Ties go to the language that sorts first.

Null texts and texts without letters are `und` with score 0. If nothing was learned, all are.
A word whose script no language uses can take any label. Repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common

#: First code points of script ranges, and the script from there on.
RANGES = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2C60, "Latin"), (0x3040, "Kana"), (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Bopomofo"), (0x31F0, "Kana"), (0x3400, "Han"), (0xA000, "Yi"), (0xA720, "Latin"), (0xAC00, "Hangul"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0x20000, "Han"),
)
_FIRST = np.array([a for a, _ in RANGES])
SCRIPTS = sorted({s for _, s in RANGES})
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_TABLES: dict[str, np.ndarray] = {}
#: No code point from here on is a letter, nor is this one.
LAST = 0x3FFFF


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For code points up to LAST: is it a letter, and its lower case (one code point, else itself)."""
    if not _TABLES:
        letter, lower = np.zeros(LAST + 1, dtype=bool), np.arange(LAST + 1, dtype=np.uint32)
        for i in range(LAST + 1):
            c = chr(i)
            letter[i] = c.isalpha()
            if len(c.lower()) == 1:
                lower[i] = ord(c.lower())
        _TABLES.update(letter=letter, lower=lower)
    return _TABLES["letter"], _TABLES["lower"]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words in the texts: a code for each letter with its neighbours, where words start among these,
    the script of each word, and the words of each text."""
    letter, lower = _tables()
    joined = "\n".join(texts) + "\n"
    raw = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    inside = letter[np.minimum(raw, LAST)]
    edge = np.concatenate([[0], np.where(inside, lower[np.minimum(raw, LAST)], 0), [0]]).astype(np.int64)
    at = np.flatnonzero(inside)
    codes = (edge[at] << 42) | (edge[at + 1] << 21) | edge[at + 2]
    begins = np.flatnonzero(edge[at] == 0)
    scripts = _SCRIPT[np.searchsorted(_FIRST, raw[at[begins]], "right") - 1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(at[begins], ends), prepend=0)
    return codes, begins, scripts, per_text


class Model:
    """Per-trigram log likelihoods by language, and which scripts each language uses."""

    def __init__(self, counts: dict[str, dict[int, int]], scripts: dict[str, dict[int, int]], penalty: float = 8.0, rare: float = 0.01):
        self.languages, self.penalty = sorted(counts), penalty
        self.codes = np.array(sorted({c for x in counts.values() for c in x}), dtype=np.int64)
        self.log = np.zeros((len(self.codes) + 1, len(self.languages)), dtype=np.float32)
        self.allowed = np.zeros((len(SCRIPTS), len(self.languages)), dtype=bool)
        for j, name in enumerate(self.languages):
            n = np.array([counts[name].get(int(c), 0) for c in self.codes] + [0]) + 0.1
            self.log[:, j] = np.log(n / n.sum())
            total = sum(scripts.get(name, {}).values()) or 1
            for s, k in scripts.get(name, {}).items():
                self.allowed[s, j] = k >= rare * total
        self.allowed[~self.allowed.any(1)] = True

    def word_scores(self, codes: np.ndarray, begins: np.ndarray, scripts: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.codes, codes)
        place[(place == len(self.codes)) | (self.codes[np.minimum(place, len(self.codes) - 1)] != codes)] = len(self.codes)
        scores = np.add.reduceat(self.log[place], begins, axis=0) if len(begins) else np.zeros((0, len(self.languages)), np.float32)
        scores -= scores.max(1, keepdims=True, initial=-np.inf) if len(begins) else 0
        return np.where(self.allowed[scripts], scores, np.float32(-1e4))

    def viterbi(self, scores: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """The label of each word; all texts advance together, one word at each step."""
        order = np.argsort(-per_text, kind="stable")
        first = np.concatenate([[0], np.cumsum(per_text)[:-1]])[order]
        alive = len(order) - np.searchsorted(per_text[order][::-1], np.arange(1, per_text.max(initial=0) + 1))
        stay = np.zeros(scores.shape, dtype=bool)
        came = np.zeros(len(scores), dtype=np.int16)
        label = np.zeros(len(scores), dtype=np.int16)
        best = np.zeros((len(order), scores.shape[1]))
        for t, n in enumerate(alive):
            at = first[:n] + t
            if t:
                from_ = best[:n].argmax(1)
                switch = best[np.arange(n), from_] - self.penalty
                stay[at] = best[:n] >= switch[:, None]
                came[at] = from_
                best[:n] = np.maximum(best[:n], switch[:, None])
            best[:n] += scores[at]
        for t in range(len(alive) - 1, -1, -1):
            n, more = alive[t], alive[t + 1] if t + 1 < len(alive) else 0
            at, over = first[:more] + t, first[more:n] + t
            label[over] = best[more:n].argmax(1)
            nxt = label[at + 1]
            label[at] = np.where(stay[at + 1, nxt], nxt, came[at + 1])
        return label

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        labels, letters, per_text = self.label(texts)
        out, i = [], 0
        for n in per_text:
            share = np.bincount(labels[i : i + n], letters[i : i + n], len(self.languages)) if n else np.zeros(0)
            i += n
            out.append((self.languages[int(share.argmax())], float(share.max() / share.sum())) if n and len(share) else ("und", 0.0))
        return out

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label and letters of each word, words of each text."""
        codes, begins, scripts, per_text = trigrams(texts)
        letters = np.diff(np.append(begins, len(codes)))
        if not self.languages:
            return np.zeros(0, np.int16), letters[:0], np.zeros_like(per_text)
        return self.viterbi(self.word_scores(codes, begins, scripts), per_text), letters, per_text


def spans(model: Model, text: str) -> list[tuple[int, int, str]]:
    """Mixed-language spans of one text: start, end (of words, in code points), language."""
    letter, _ = _tables()
    labels, _, _ = model.label([text])
    out: list[tuple[int, int, str]] = []
    inside = letter[np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), LAST)]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))).reshape(-1, 2)
    for (a, b), k in zip(edges.tolist(), labels, strict=False):
        name = model.languages[k]
        out = [*out[:-1], (out[-1][0], b, name)] if out and out[-1][2] == name else [*out, (a, b, name)]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.chunks(batches, 1):
        names = batch.column(0).to_pylist()
        for name in sorted(set(names)):
            codes, _, scripts, _ = trigrams([t for n, t in zip(names, batch.column(1).to_pylist(), strict=True) if n == name])
            for what, (values, n) in (("t", np.unique(codes, return_counts=True)), ("s", np.unique(scripts, return_counts=True))):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array([what] * len(n)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "what", "code", "n"])


def train(docs: DataFrame, per_language: int = 1500, penalty: float = 8.0) -> Model:
    """A model from about `per_language` documents of each language that are not held out, chosen by hash of the id.

    docs: doc_id, text, lang. The bound is met on average: the share that the language's count
    calls for is taken of the range of the hash. Only trigram counts reach the driver.
    """
    docs = common.pick(docs, doc_id="long", text="string", lang="string")
    docs = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~common.held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not sizes:
        return Model({}, {}, penalty)
    share = F.lit(0.0)
    for name, n in sorted(sizes.items()):
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= share * 1_000_003).select("lang", "text")
    rows = chosen.mapInArrow(_count, "lang string, what string, code long, n long").groupBy("lang", "what", "code").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, dict[str, dict[int, int]]] = {"t": {}, "s": {}}
    for r in rows:
        counts[r["what"]].setdefault(r["lang"], {})[r["code"]] = r["n"]
    return Model(counts["t"], counts["s"], penalty)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score. Reads doc_id and text alone."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 1):
            found = model.predict([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = common.pick(docs, doc_id="long", text="string").mapInArrow(task, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
