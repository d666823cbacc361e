"""Format-aware chunking: files to chunks, as one projection over the scan.

Every chunker is an expression that yields an array of (text, heading, participants, is_chat).
Stateful packing folds over sizes and positions only; texts are cut from the file once per chunk.
Only the pretty-printing of JSON needs Python, and sees nothing but JSON files.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

PIECES = "array<struct<text:string,heading:string,participants:array<string>,is_chat:boolean>>"
_SPANS = "array<struct<a:int,b:int>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value computed once, also where `then` uses it inside a fold."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _piece(text: Column, heading: Column | str = "", participants: Column | None = None) -> Column:
    return F.struct(
        text.alias("text"),
        (F.lit(heading) if isinstance(heading, str) else heading).alias("heading"),
        (participants if participants is not None else F.lit(None).cast("array<string>")).alias("participants"),
        F.lit(participants is not None).alias("is_chat"),
    )


def _joined(parts: Column, span: Column, by: str) -> Column:
    return F.array_join(F.slice(parts, span["a"] + 1, span["b"] - span["a"]), by)


def _indices(array: Column) -> Column:
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.array().cast("array<int>"))


def paragraphs(content: Column, limit: int, heading: Column | str = "") -> Column:
    """Greedy packing of blank-line separated paragraphs; a full chunk hands its last two on; a final repeat is dropped."""
    found = F.transform(F.filter(F.split(content, rf"\n{T.SPACE}*\n", -1), lambda p: ~T.is_blank(p)), T.trim)
    return _let(found, lambda parts: _let(F.transform(parts, T.utf16_length), lambda sizes: _packed_paragraphs(parts, sizes, limit, heading)))


def _packed_paragraphs(parts: Column, sizes: Column, limit: int, heading: Column | str) -> Column:
    size = lambda i: F.element_at(sizes, (i + 1).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.lit(0).cast("long").alias("tokens"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, i: Column) -> Column:
        tokens = T.tokens_of_length(size(i))
        full = (s["tokens"] + tokens > limit) & (i > s["a"])
        two = i - s["a"] >= 2
        carried = T.tokens_of_length(size(i - 1) + F.when(two, size(F.greatest(i - 2, F.lit(0))) + 2).otherwise(0))
        return F.struct(
            F.when(full, F.greatest(i - 2, s["a"])).otherwise(s["a"]).alias("a"),
            (F.when(full, carried).otherwise(s["tokens"]) + tokens).alias("tokens"),
            F.when(full, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), i.alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    spans = F.aggregate(_indices(parts), start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), F.size(parts).alias("b")))))

    def pieces(texts: Column) -> Column:
        n = F.size(texts)
        repeated = (n > 1) & (F.element_at(texts, -1) == F.element_at(texts, F.greatest(n - 1, F.lit(1))))
        kept = F.when(repeated, F.slice(texts, 1, F.greatest(n - 1, F.lit(0)))).otherwise(texts)
        return F.transform(kept, lambda t: _piece(t, heading))

    texts = F.transform(spans, lambda s: _joined(parts, s, "\n\n"))
    return F.when(F.size(parts) == 0, F.array().cast(PIECES)).otherwise(_let(texts, pieces))


def sections(content: Column) -> Column:
    """Markdown sections (heading, text): a heading of level 1 to 3 opens one if the current one has lines."""
    return _let(F.split(content, "\n", -1), _sections)


def _sections(lines: Column) -> Column:
    line = lambda i: F.element_at(lines, (i + 1).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.lit("").alias("heading"), F.array().cast("array<struct<heading:string,a:int,b:int>>").alias("out"))

    def step(s: Column, i: Column) -> Column:
        is_heading = line(i).rlike(rf"^#{{1,3}}{T.SPACE}")
        title = F.regexp_replace(line(i), rf"^#+{T.SPACE}*", "")
        opens = is_heading & (i > s["a"])
        return F.struct(
            F.when(opens, i + 1).otherwise(s["a"]).alias("a"),
            F.when(opens | (is_heading & (s["heading"] == "")), title).otherwise(s["heading"]).alias("heading"),
            F.when(opens, F.concat(s["out"], F.array(F.struct(s["heading"].alias("heading"), s["a"].alias("a"), i.alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    def finish(s: Column) -> Column:
        last = F.array(F.struct(s["heading"].alias("heading"), s["a"].alias("a"), F.size(lines).alias("b")))
        return F.when(F.size(lines) > s["a"], F.concat(s["out"], last)).otherwise(s["out"])

    spans = F.aggregate(_indices(lines), start, step, finish)
    return F.filter(F.transform(spans, lambda s: F.struct(s["heading"].alias("heading"), T.trim(_joined(lines, s, "\n")).alias("text"))), lambda x: x["text"] != "")


def markdown(content: Column, limit: int) -> Column:
    """Sections; one above the limit is packed as paragraphs under its heading."""
    small = lambda s: F.array(_piece(s["text"], s["heading"]))
    return F.flatten(F.transform(sections(content), lambda s: F.when(T.estimate_tokens(s["text"]) <= limit, small(s)).otherwise(paragraphs(s["text"], limit, s["heading"]))))


def messages(content: Column) -> Column:
    """Chat messages (sender, text, ts): a line with date, time and sender opens one, others continue it."""
    heads = lambda lines: F.filter(_indices(lines), lambda i: F.element_at(lines, (i + 1).cast("int")).rlike(T.CHAT_SENDER))
    return _let(F.split(content, "\n", -1), lambda lines: _let(heads(lines), lambda starts: _messages(lines, starts)))


def _messages(lines: Column, starts: Column) -> Column:
    line = lambda i: F.element_at(lines, (i + 1).cast("int"))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(lines)))
    spans = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    message = lambda s: F.struct(
        T.trim(F.regexp_extract(line(s["a"]), T.CHAT_SENDER, 1)).alias("sender"), _joined(lines, s, "\n").alias("text"), T.chat_millis(line(s["a"])).alias("ts")
    )
    return F.when(F.size(starts) > 0, F.transform(spans, message)).otherwise(F.array().cast("array<struct<sender:string,text:string,ts:bigint>>"))


def gap_spans(times: Column, sizes: Column, limit: int, gap_ms: int = 600_000, least: int = 3) -> Column:
    """Segments [a, b): a new one begins after a gap once `least` messages are exceeded, or once the current text is above the limit."""
    at = lambda x, i: F.element_at(x, (i + 1).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.lit(-1).cast("long").alias("size"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, i: Column) -> Column:
        before, now = at(times, F.greatest(i - 1, F.lit(0))), at(times, i)
        gap = F.when((now != 0) & (before != 0), now - before).otherwise(0)  # null times see no gap
        cut = (i > s["a"]) & (((gap > gap_ms) & (i - s["a"] > least)) | (T.tokens_of_length(s["size"]) > limit))
        return F.struct(
            F.when(cut, i).otherwise(s["a"]).alias("a"),
            (F.when(cut, F.lit(-1)).otherwise(s["size"]) + 1 + at(sizes, i)).alias("size"),
            F.when(cut, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), i.alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    last = lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), F.size(times).alias("b"))))
    return F.when(F.size(times) > 0, F.aggregate(_indices(times), start, step, last)).otherwise(F.array().cast(_SPANS))


def pack_spans(sizes: Column, span: Column, limit: int) -> Column:
    """Greedy packing of the messages of a segment by their own token counts."""
    start = F.struct(span["a"].alias("a"), F.lit(0).cast("long").alias("tokens"), F.array().cast(_SPANS).alias("out"))

    def step(s: Column, i: Column) -> Column:
        tokens = T.tokens_of_length(F.element_at(sizes, (i + 1).cast("int")))
        cut = (s["tokens"] + tokens > limit) & (i > s["a"])
        return F.struct(
            F.when(cut, i).otherwise(s["a"]).alias("a"),
            (F.when(cut, F.lit(0)).otherwise(s["tokens"]) + tokens).alias("tokens"),
            F.when(cut, F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), i.alias("b"))))).otherwise(s["out"]).alias("out"),
        )

    return F.aggregate(F.sequence(span["a"], span["b"] - 1), start, step, lambda s: F.concat(s["out"], F.array(F.struct(s["a"].alias("a"), span["b"].alias("b")))))


def chat(content: Column, limit: int) -> Column:
    """Conversation segments with their participants in order of appearance; without a message, paragraphs."""
    return _let(messages(content), lambda found: F.when(F.size(found) == 0, paragraphs(content, limit)).otherwise(_conversations(found, limit)))


def _conversations(found: Column, limit: int) -> Column:
    field = lambda name: F.transform(found, lambda m: m[name])
    sized = lambda texts, then: _let(F.transform(texts, T.utf16_length), then)
    return _let(field("text"), lambda texts: sized(texts, lambda sizes: _let(field("ts"), lambda times: _let(field("sender"), lambda senders: _segments(texts, sizes, times, senders, limit)))))


def _segments(texts: Column, sizes: Column, times: Column, senders: Column, limit: int) -> Column:
    segments = F.filter(gap_spans(times, sizes, limit), lambda s: ~T.is_blank(_joined(texts, s, "\n")))
    split = F.flatten(F.transform(segments, lambda s: F.when(T.estimate_tokens(_joined(texts, s, "\n")) > limit, pack_spans(sizes, s, limit)).otherwise(F.array(s))))

    def piece(s: Column) -> Column:
        people = F.array_distinct(F.slice(senders, s["a"] + 1, s["b"] - s["a"]))
        return _piece(_joined(texts, s, "\n"), F.concat(F.lit("Conversation: "), F.array_join(people, ", ")), people)

    return F.transform(split, piece)


def csv(content: Column, limit: int) -> Column:
    """Batches of rows under the repeated header; not aware of quotes. Below two lines, paragraphs."""
    found = F.filter(F.split(content, "\n", -1), lambda x: ~T.is_blank(x))
    return _let(found, lambda lines: F.when(F.size(lines) < 2, paragraphs(content, limit)).otherwise(_rows(lines, limit)))


def _rows(lines: Column, limit: int) -> Column:
    header = F.element_at(lines, 1)
    per = F.greatest(F.lit(1), F.floor((limit - T.estimate_tokens(header)) / F.greatest(F.lit(1), T.estimate_tokens(F.element_at(lines, 2))))).cast("int")

    def piece(i: Column) -> Column:
        rows = F.slice(lines, i + 1, per)
        return _piece(F.array_join(F.concat(F.array(header), rows), "\n"), F.concat(F.lit("rows "), i, F.lit("-"), i + F.size(rows) - 1))

    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines) - 1, F.lit(1)), per), piece)


def _json_batches(content: str | None, limit: int) -> list[dict] | None:
    try:
        items = json.loads(content, parse_constant=_no_constant)
    except (ValueError, TypeError, RecursionError):
        return None
    if not isinstance(items, list):
        return None
    pretty = lambda x: json.dumps(x, indent=2, ensure_ascii=False)
    if not items:
        return []
    per = max(1, limit // max(1, math.ceil(len(pretty(items[0]).encode("utf-16-le", "surrogatepass")) / 2 / 4)))
    cut = [items[i : i + per] for i in range(0, len(items), per)]
    return [{"text": pretty(x), "heading": f"items {i * per}-{i * per + len(x) - 1}"} for i, x in enumerate(cut)]


def _no_constant(name: str):
    raise ValueError(name)


def json_batches(content: Column, limit: int) -> Column:
    """Batches of an array's items, pretty-printed; null for what is no array."""

    @F.pandas_udf("array<struct<text:string,heading:string>>")
    def batches(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else _json_batches(x, limit))

    return F.transform(batches(content), lambda x: _piece(x["text"], x["heading"]))


def chunk(files: DataFrame, limit: int = 6000) -> DataFrame:
    """Chunks of files (path, content, ext, file_ord): text, source, heading, content_hash, participants, is_chat,
    chunk_index, total_chunks, file_ord. Chat is recognised first, then the extension decides.
    """
    content = F.coalesce(F.col("content"), F.lit(""))
    ext = F.coalesce(F.col("ext"), F.lit(""))
    chatty = T.is_chat(content)
    files = files.withColumn("_format", F.when(chatty, "chat").when(ext.isin(".md", ".markdown"), "markdown").when(ext == ".json", "json").when(ext.isin(".csv", ".tsv"), "csv").otherwise("paragraphs"))
    form = F.col("_format")
    files = files.withColumn("_json", json_batches(F.when(form == "json", F.col("content")), limit))
    plain = paragraphs(content, limit)
    pieces = F.when(form == "chat", chat(content, limit)).when(form == "markdown", markdown(content, limit)).when(form == "json", F.coalesce("_json", plain)).when(form == "csv", csv(content, limit)).otherwise(plain)
    files = files.select("path", "file_ord", pieces.cast(PIECES).alias("pieces"))
    rows = files.select("path", "file_ord", F.size("pieces").alias("total_chunks"), F.posexplode("pieces").alias("chunk_index", "p"))
    return rows.select(
        F.col("p.text").alias("text"), F.col("path").alias("source"), F.col("p.heading").alias("heading"), T.content_hash(F.col("p.text")).alias("content_hash"),
        F.col("p.participants").alias("participants"), F.col("p.is_chat").alias("is_chat"), "chunk_index", "total_chunks", "file_ord",
    )
