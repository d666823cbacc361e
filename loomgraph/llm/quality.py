"""Document quality by a linear-chain conditional random field over lines, used in two ways.

* classify: forward-backward marginals of every line, weighted with its length, make a score.
* rules: Viterbi decoding marks lines as content or boilerplate; a document stays if it passes
  two base rules and at least `least_content` of its words stand in content lines.

A null text is the empty text: one line without words. Its score is what the chain gives such a
line; rules reject it, as it has fewer words than the base rules ask for. Repeated rows and null
ids are judged like any row. Whole texts are read, in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import common, crf


def _by_text(values: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, np.concatenate([[0], np.cumsum(per_text)[:-1]]))


def scores(chain: crf.Chain, texts: list[str]) -> np.ndarray:
    x, per_text, length, _ = crf.line_features(texts)
    good, _, _ = chain.marginals(crf.neighbours(x, per_text) @ chain.w, per_text)
    weight = length + 1e-6  # a text of empty lines has the plain mean
    return np.clip(_by_text(good * weight, per_text) / _by_text(weight, per_text), 0, 1)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = 3000) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted. labels: doc_id, quality.

    Labels are learned only from rows that are not held out (crc32 of the id as text, mod 5, is 0).
    """
    docs = common.pick(docs, doc_id="long", text="string")
    known = common.pick(labels, doc_id="long", quality="int").withColumnRenamed("quality", "y").filter(F.col("doc_id").isNotNull() & ~common.held_out(F.col("doc_id")))
    chain = crf.train(docs, known, sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 1):
            s = scores(chain, [t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def repeated_words(text: str) -> int:
    """Words covered by 3-word windows that the text holds twice or more."""
    found = common.words(text)
    if len(found) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in found), dtype=np.int64, count=len(found))
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, inverse, count = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    hit = np.zeros(len(found), dtype=bool)
    for j in range(3):
        hit[twice + j] = True
    return int(hit.sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(chain: crf.Chain, texts: list[str], least_words: int = 50, most_repeated: int = 50, least_content: float = 0.5) -> dict[str, np.ndarray]:
    """COUNTS, base_failed, content (share of words in content lines) and kept, for each text."""
    x, per_text, _, out = crf.line_features(texts)
    label = chain.decode(crf.neighbours(x, per_text) @ chain.w, per_text)
    words = np.rint(np.expm1(x[:, 0] * 5))
    out["n_repeat_words"] = np.array([repeated_words(t) for t in texts], dtype=np.int64)
    out["base_failed"] = (out["n_words"] < least_words) | (100 * out["n_repeat_words"] > most_repeated * out["n_words"])
    out["content"] = _by_text(words * label, per_text) / np.maximum(_by_text(words, per_text), 1)
    out["kept"] = ~out["base_failed"] & (out["content"] >= least_content)
    return out


def train_rules(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> crf.Chain:
    """A chain over weak labels of lines, so that labels change within documents."""
    known = common.pick(labels, doc_id="long", quality="int").withColumnRenamed("quality", "y").filter(F.col("doc_id").isNotNull())
    return crf.train(common.pick(docs, doc_id="long", text="string"), known, sample, weak=True)


def rules(docs: DataFrame, chain: crf.Chain, **limits) -> DataFrame:
    """Per document row: doc_id, COUNTS, base_failed, content, kept. limits: see judge."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, 1):
            found = judge(chain, [t or "" for t in batch.column(1).to_pylist()], **limits)
            names = [*COUNTS, "base_failed", "content", "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n]) for n in names)], names=["doc_id", *names])

    schema = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, content double, kept boolean"
    return common.pick(docs, doc_id="long", text="string").mapInArrow(task, schema)


def keep_good(docs: DataFrame, chain: crf.Chain, **limits) -> DataFrame:
    """The documents, all columns, that rules() keeps."""
    at = common.position(docs, "text")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.chunks(batches, at):
            yield batch.filter(pa.array(judge(chain, [t or "" for t in batch.column(at).to_pylist()], **limits)["kept"]))

    return docs.mapInArrow(task, docs.schema)
