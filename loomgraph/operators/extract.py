"""Extraction of knowledge from chunks: deterministic rules, replay of stored answers, or a language model.

All yield the same columns (EXTRACTION). Order is (file_ord, chunk_index), whatever order chunks
were worked on, so everything downstream is deterministic.
"""

from __future__ import annotations

import copy
import json
import logging
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import combinations
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T

log = logging.getLogger("loomgraph")

ANSWER = (
    "struct<entities:array<struct<name:string,type:string,aliases:array<string>>>,people:array<struct<name:string,role:string>>,"
    "facts:array<string>,decisions:array<string>,preferences:array<string>,frustrations:array<string>,"
    "relationships:array<struct<`from`:string,`to`:string,type:string>>>"
)
FIELDS = ("entities", "people", "facts", "decisions", "preferences", "frustrations", "relationships")


class Extractor(Protocol):
    """Chunks in; per chunk file_ord, chunk_index, source, content_hash, answer (ANSWER), usage_tokens, error out."""

    def extract(self, chunks: DataFrame) -> DataFrame: ...


def lenient_json(raw: Column) -> Column:
    """The text between the first { and the last }, code fences off."""
    bare = F.regexp_replace(F.regexp_replace(T.trim(raw), r"^```(?:json)?\n?", ""), r"\n?```\z", "")
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(bare)


def parse_answer(raw: Column) -> Column:
    """A model's answer as ANSWER; null if it is no JSON, or names a key of one object twice. Texts that are no strings keep their JSON form."""
    bare = lenient_json(raw)
    return F.when(F.try_parse_json(bare).isNotNull(), F.from_json(bare, ANSWER, {"mode": "PERMISSIVE"}))


class RuleExtractor:
    """No model: capitalised words are entities, chat participants and named roles people, long sentences facts."""

    def __init__(self, least_letters: int = 4):
        self.least_letters = least_letters

    def extract(self, chunks: DataFrame) -> DataFrame:
        text = F.col("text")
        names = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b([A-Z][a-z]{{{self.least_letters - 1},}})\b"), F.lit(1)))
        people = F.coalesce(F.col("participants"), F.array().cast("array<string>"))
        names = F.slice(F.array_except(names, people), 1, 8)
        sentences = F.transform(F.split(F.regexp_replace(text, r"[.!?]\s+", "\u0001"), "[\u0001\n]", -1), T.trim)
        long_ = F.filter(sentences, lambda s: F.length(s).between(25, 200))
        wanted = lambda pattern: F.slice(F.filter(long_, lambda s: s.rlike(pattern)), 1, 3)
        entity = lambda n: F.struct(n.alias("name"), F.lit("concept").alias("type"), F.array().cast("array<string>").alias("aliases"))
        pairs = F.zip_with(F.slice(names, 1, F.greatest(F.size(names) - 1, F.lit(0))), F.slice(names, 2, 8), lambda a, b: F.struct(a.alias("from"), b.alias("to"), F.lit("RELATED_TO").alias("type")))
        answer = F.struct(
            F.transform(names, entity).alias("entities"),
            F.transform(people, lambda p: F.struct(p.alias("name"), F.lit("").alias("role"))).alias("people"),
            F.slice(long_, 1, 5).alias("facts"),
            wanted(r"(?i)\b(?:decided|agreed|will use)\b").alias("decisions"),
            wanted(r"(?i)\b(?:prefer|always|never)").alias("preferences"),
            wanted(r"(?i)\b(?:broken|blocked|annoying|fails)\b").alias("frustrations"),
            pairs.alias("relationships"),
        )
        return chunks.select("file_ord", "chunk_index", "source", "content_hash", answer.cast(ANSWER).alias("answer"), F.lit(0).cast("long").alias("usage_tokens"), F.lit(None).cast("string").alias("error"))


class ReplayExtractor:
    """Stored answers by content hash: content_hash, answer (JSON text), usage_tokens. Chunks without one fail."""

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def extract(self, chunks: DataFrame) -> DataFrame:
        stored = self.answers.groupBy("content_hash").agg(F.max_by(F.struct("answer", "usage_tokens"), F.col("answer")).alias("a"))
        rows = chunks.join(stored, "content_hash", "left")
        answer = parse_answer(F.col("a.answer"))
        return rows.select("file_ord", "chunk_index", "source", "content_hash", answer.alias("answer"), F.coalesce("a.usage_tokens", F.lit(0)).cast("long").alias("usage_tokens"), F.when(answer.isNull(), "no stored answer").alias("error"))


@dataclass
class Retry:
    """Attempts, and the wait in seconds before attempt i after a rate limit or another failure."""

    attempts: int = 3
    limited: float = 2.0
    failed: float = 1.0

    def run(self, call: Callable[[], dict], limited: Callable[[Exception], bool], sleep: Callable[[float], None] = time.sleep) -> dict:
        for i in range(self.attempts):
            try:
                return call()
            except Exception as error:  # noqa: BLE001
                if i + 1 == self.attempts:
                    raise
                sleep((self.limited if limited(error) else self.failed) * 2**i)
        raise AssertionError


class ModelExtractor:
    """Answers of a language model. call(system, user, max_tokens) -> {"content": text, "usage": tokens}.

    Each task keeps `concurrent` calls in flight; failures of a chunk go to its error column.
    """

    def __init__(self, call: Callable[[str, str, int], dict], guide: str | None = None, concurrent: int = 3, partitions: int | None = None, retry: Retry | None = None):
        self.call, self.guide, self.concurrent, self.partitions, self.retry = call, guide, concurrent, partitions, retry or Retry()

    def guided(self, guide: str | None) -> ModelExtractor:
        """The same extractor with a guide."""
        out = copy.copy(self)
        out.guide = guide
        return out

    def extract(self, chunks: DataFrame) -> DataFrame:
        asked = chunks.select("file_ord", "chunk_index", "source", "content_hash", system_prompt(F.coalesce("is_chat", F.lit(False)), self.guide).alias("system"), user_prompt().alias("user"))
        asked = asked.repartition(self.partitions) if self.partitions else asked
        call, retry, concurrent = self.call, self.retry, self.concurrent

        def one(system: str, user: str) -> tuple[str | None, int, str | None]:
            try:
                got = retry.run(lambda: call(system, user, 1500), lambda e: getattr(e, "code", None) == 429)
                return got["content"], int(got.get("usage") or 0), None
            except Exception as error:  # noqa: BLE001
                return None, 0, str(error) or type(error).__name__

        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(concurrent) as pool:
                for frame in frames:
                    got = list(pool.map(one, frame["system"], frame["user"]))
                    yield frame[["file_ord", "chunk_index", "source", "content_hash"]].assign(raw=[g[0] for g in got], usage_tokens=[g[1] for g in got], error=[g[2] for g in got])

        raw = asked.mapInPandas(task, "file_ord long, chunk_index int, source string, content_hash string, raw string, usage_tokens long, error string")
        answer = parse_answer(F.col("raw"))
        return raw.select("file_ord", "chunk_index", "source", "content_hash", answer.alias("answer"), "usage_tokens", F.coalesce("error", F.when(answer.isNull(), "no JSON in the answer")).alias("error"))


_SHAPE = (
    '{"entities": [{"name", "type", "aliases": []}], "people": [{"name", "role"}], "facts": [], "decisions": [], '
    '"preferences": [], "frustrations": [], "relationships": [{"from", "to", "type"}]}'
)
PROMPTS = {
    False: f"Read the passage and list only knowledge of lasting worth, as one JSON object shaped like {_SHAPE}. Entities are things with names of their own. Leave a list empty rather than fill it with the trivial.",
    True: f"Read the conversation and list who works on what, who relates to whom, and decisions and facts of lasting worth, as one JSON object shaped like {_SHAPE}. Leave out greetings, scheduling and passing states.",
}


def system_prompt(is_chat: Column, guide: str | None) -> Column:
    extra = f"\n\nWhat a first look at the whole found, as a help for names and types, not as a limit:\n{guide}" if guide else ""
    return F.when(is_chat, PROMPTS[True] + extra).otherwise(PROMPTS[False] + extra)


def user_prompt() -> Column:
    context = F.when(F.col("heading") != "", F.concat(F.lit("[Context: "), "heading", F.lit("]\n"))).otherwise("")
    return F.concat(context, F.lit("[Source: "), "source", F.lit("]\n\n"), "text")


def sample_positions(n: int, most: int = 8) -> list[int]:
    """Which of n chunks a first look reads: the first, the last and evenly spread ones; none below three."""
    if n < 3:
        return []
    inner = min(most, n) - 2
    step = n // (inner + 1)
    return sorted({0, n - 1} | {min(i * step, n - 1) for i in range(1, inner + 1)})


def prescan_sample(chunks: DataFrame, budget: int = 24_000, most_each: int = 3_000) -> DataFrame:
    """(position, text) of the sampled chunks, texts cut to their share of the budget.

    Positions in the order (file_ord, chunk_index) come from counts by file and places within a
    file, not from a sort of all chunks; indexes may have gaps.
    """
    sizes = chunks.groupBy("file_ord").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    positions = sample_positions(total)
    if not positions:
        return chunks.select(F.lit(0).cast("long").alias("position"), "text").limit(0)
    each = min(most_each, budget // len(positions))
    from loomgraph.functions.order import running_total

    first = running_total(sizes, "file_ord", "n", "before")
    places = chunks.select("file_ord", "chunk_index", (F.row_number().over(Window.partitionBy("file_ord").orderBy("chunk_index")) - 1).alias("place"))
    at = (F.col("before") + F.col("place")).cast("long").alias("position")
    wanted = places.join(first.select("file_ord", "before"), "file_ord").select("file_ord", "chunk_index", at).filter(F.col("position").isin(positions))
    return chunks.join(F.broadcast(wanted), ["file_ord", "chunk_index"]).select("position", T.utf16_left(F.col("text"), each).alias("text"))


PRESCAN = (
    "These are samples of a larger whole. List everyone named, the entities with names of their own (with other spellings and abbreviations as aliases), and which entities are parts of a larger one, "
    'as one JSON object shaped like {"people": [{"name", "role"}], "entities": [{"name", "type", "aliases": []}], "entity_groups": [{"parent", "children": []}], "context": "what the whole is about, in a sentence or two"}.'
)


def prescan(call: Callable[[str, str, int], dict], chunks: DataFrame) -> str | None:
    """The guide that a first look at sampled chunks gives. None below three chunks, and, with a warning, if the call or its answer fails."""
    samples = prescan_sample(chunks).orderBy("position").collect()  # eight at most
    if not samples:
        return None
    try:
        return guide_text(parse_lenient(call(PRESCAN, "\n\n".join(f"--- Sample {i} ---\n{r['text']}" for i, r in enumerate(samples, 1)), 1500)["content"]))
    except Exception as error:  # noqa: BLE001
        log.warning("no guide, the first look failed: %s", error)
        return None


def guide_text(found: dict) -> str | None:
    """What a first look found (context, people, entities, entity_groups) as lines for the prompt."""
    parts = []
    if found.get("context"):
        parts.append(f"CONTEXT: {found['context']}")
    if found.get("people"):
        parts.append("KNOWN PEOPLE: " + ", ".join(f"{p['name']} ({p['role']})" if p.get("role") else p["name"] for p in found["people"]))
    if found.get("entities"):
        also = lambda e: f" [also: {', '.join(e['aliases'])}]" if e.get("aliases") else ""
        parts.append("KNOWN ENTITIES: " + ", ".join(f"{e['name']} ({e['type']}){also(e)}" for e in found["entities"]))
    if found.get("entity_groups"):
        parts.append("ENTITY GROUPS: " + "; ".join(f"{g['parent']} includes: {', '.join(g['children'])}" for g in found["entity_groups"]))
    return "\n".join(parts) or None


def parse_lenient(raw: str) -> dict:
    """lenient_json() on the driver, for the single answers of prescan and consolidation."""
    bare = raw.strip()
    start, end = bare.find("{"), bare.rfind("}")
    return json.loads(bare[start : end + 1] if 0 <= start < end else bare)


def consolidation(call: Callable[[str, str, int], dict], names: list[str]) -> dict:
    """merges and part_of for entity names, in one call; nothing below three names or for an answer that is no JSON."""
    none: dict = {"merges": [], "part_of": []}
    if len(names) < 3:
        return none
    system = 'Some of these names may be spellings of one thing, or parts of another. Answer one JSON object {"merges": [{"canonical", "aliases": []}], "part_of": [{"child", "parent"}]}. If in doubt, leave a pair out.'
    try:
        found = parse_lenient(call(system, "\n".join(names), 1000)["content"])
    except ValueError:
        log.warning("consolidation of %d names: no JSON in the answer", len(names))
        return none
    return {k: found.get(k) or [] for k in none}


def consolidate_all(call: Callable[[str, str, int], dict], names: list[str], most: int = 2000, retry: Retry | None = None) -> dict:
    """consolidation() of any number of names, at most `most` in a call.

    Beyond that, any two halves of a block meet in one call, so that every pair of names is seen by
    one; the answers are united. The calls grow with the square of the names.
    """
    if len(names) <= most:
        return consolidation(call, names)
    half, retry = most // 2, retry or Retry()
    halves = [names[i : i + half] for i in range(0, len(names), half)]
    log.info("consolidation of %d names in %d calls", len(names), len(halves) * (len(halves) - 1) // 2)
    asked = lambda *a: retry.run(lambda: call(*a), lambda e: getattr(e, "code", None) == 429)
    return united([consolidation(asked, a + b) for a, b in combinations(halves, 2)])


def united(answers: list[dict]) -> dict:
    """Several answers as one: merges that share a name become one, under the canonical name named first; parts are listed once."""
    parent: dict[str, str] = {}
    order: dict[str, int] = {}

    def root(name: str) -> str:
        while parent.setdefault(name, name) != name:
            name = parent[name] = parent[parent[name]]
        return name

    for m in (m for answer in answers for m in answer["merges"]):
        order.setdefault(m["canonical"], len(order))
        for alias in m.get("aliases") or []:
            a, b = root(m["canonical"]), root(alias)
            if order.get(b, len(order)) < order.get(a, len(order)):
                a, b = b, a
            parent[b] = a
    groups: dict[str, list[str]] = {}
    for name in list(parent):
        if root(name) != name:
            groups.setdefault(root(name), []).append(name)
    parts = {(p["child"], p["parent"]): p for answer in answers for p in answer["part_of"]}
    return {"merges": [{"canonical": k, "aliases": v} for k, v in groups.items()], "part_of": list(parts.values())}


def extractions(extractor: Extractor, chunks: DataFrame) -> DataFrame:
    """Flat extractions: ext_ord (a struct of file_ord, chunk_index), source, content_hash, FIELDS, usage_tokens, error."""
    found = extractor.extract(chunks)
    fields = [F.coalesce(F.col(f"answer.{f}"), F.array()).alias(f) for f in FIELDS]
    return found.select(F.struct("file_ord", "chunk_index").alias("ext_ord"), "source", "content_hash", *fields, "usage_tokens", "error")
