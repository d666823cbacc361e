"""Chunkers against hand-made cases and a plain fold."""

import math
import random
import re

from loomgraph.operators import chunking


def chunks(spark, content, ext=".txt", limit=6000):
    df = spark.createDataFrame([("f", content, ext, 0)], "path string, content string, ext string, file_ord long")
    return [(r["heading"], r["text"]) for r in chunking.chunk(df, limit).orderBy("chunk_index").collect()]


def packed(content, limit):
    size = lambda s: math.ceil(len(s) / 4)
    out, current, tokens = [], [], 0
    for p in (x.strip() for x in re.split(r"\n\s*\n", content) if x.strip()):
        if tokens + size(p) > limit and current:
            out.append("\n\n".join(current))
            current = current[-2:]
            tokens = size("\n\n".join(current))
        current.append(p)
        tokens += size(p)
    if current and (not out or out[-1] != "\n\n".join(current)):
        out.append("\n\n".join(current))
    return out


def test_paragraphs(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(0, 15))) for _ in range(30)] + ["a\n\na\n\na\n\na", "  \n\n \t\n", "x" * 100]
    df = spark.createDataFrame([(str(i), t, "", i) for i, t in enumerate(texts)], "path string, content string, ext string, file_ord long")
    got = {}
    for r in chunking.chunk(df, 20).orderBy("file_ord", "chunk_index").collect():
        got.setdefault(r["file_ord"], []).append(r["text"])
    assert got == {i: packed(t, 20) for i, t in enumerate(texts) if packed(t, 20)}


def test_markdown(spark):
    text = "intro\n# One\nbody\n#### deep\n```\n# fenced\n```\n## Two\n### Three\nend\n# Blank\n \n"
    assert chunks(spark, text, ".md") == [("", "intro"), ("One", "body\n#### deep\n```"), ("fenced", "```"), ("Two", "### Three\nend")]
    assert chunks(spark, "# A\n# B\nx", ".md") == [("A", "# A"), ("B", "x")]
    assert [h for h, _ in chunks(spark, "# A\n\n" + "p" * 40 + "\n\n" + "q" * 40, ".md", 12)] == ["A"] * 2


def test_json(spark):
    assert chunks(spark, '[{"a": "é"}, 2]', ".json") == [("items 0-1", '[\n  {\n    "a": "é"\n  },\n  2\n]')]
    assert chunks(spark, "[]", ".json") == []
    assert chunks(spark, '{"a": 1}', ".json") == [("", '{"a": 1}')]
    assert chunks(spark, "[1, oops", ".json") == [("", "[1, oops")]


def test_csv(spark):
    assert chunks(spark, "h\n1\n\n2\n3", ".csv", 3) == [("rows 1-2", "h\n1\n2"), ("rows 3-3", "h\n3")]
    assert chunks(spark, "only", ".tsv") == [("", "only")]


def chat(minutes, sender="A"):
    return [f"1/2/24, {10 + m // 60}:{m % 60:02} - {s}: m{i}" for i, (m, s) in enumerate(zip(minutes, sender * len(minutes), strict=False))]


def test_chat_gaps(spark):
    assert len(chunks(spark, "\n".join(chat([0, 1, 2, 3, 14])))) == 2
    assert len(chunks(spark, "\n".join(chat([0, 1, 2, 3, 13])))) == 1
    assert len(chunks(spark, "\n".join(chat([0, 1, 2, 14, 15])))) == 1  # three messages are too few
    got = chunks(spark, "lost\n" + "\n".join(chat([0, 1, 2, 3], "AB")) + "\nmore", ".md")
    assert got[0][0] == "Conversation: A, B" and got[0][1].endswith("m3\nmore") and "lost" not in got[0][1]


def test_chat_oversize(spark):
    lines = chat([0, 1, 2, 3, 4, 5])
    assert [t.count("\n") for _, t in chunks(spark, "\n".join(lines), limit=13)] == [1, 0, 1, 0]  # three messages are above the limit, so two and one
    assert len(chunks(spark, "\n".join(lines), limit=1)) == 6
