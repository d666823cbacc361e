"""A registered query for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import build, chunking, dedup, extract, graph, incremental, quality, rank, search
from loomgraph.plans import fixtures as X
from loomgraph.sources import graphs
from loomgraph.sources.shared import spill

QUERIES = {}


def _weight():
    """As ranking reads it."""
    return F.coalesce("weight", F.lit(1)).alias("weight")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda t, c, kind: X.table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).alias("name"))
    rows = names("customer", "c_name", "person").unionByName(names("part", "p_name", "entity")).unionByName(names("nation", "n_name", "entity"))
    return rows.withColumn("id", T.canonical_id(F.col("kind"), F.col("name")))


@query
def token_estimate(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query
def cost_estimate(spark, sf_dir):
    cost = incremental.estimate(X.document_chunks(spark, sf_dir), "google/gemini-2.0-flash-lite-001")
    return cost.withColumn("estimated_cost", F.round("estimated_cost", 6))


@query
def content_hash_skip(spark, sf_dir):
    """Documents with a label count as processed."""
    chunks = X.document_chunks(spark, sf_dir)
    labels = X.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_ord"))
    return incremental.unprocessed(chunks, chunks.join(labels, "file_ord", "left_semi")).select(F.col("file_ord").alias("doc_id"), "content_hash")


@query
def chat_detect(spark, sf_dir):
    return X.chat_files(spark, sf_dir).select("path", T.is_chat(F.col("content")).alias("is_chat"))


@query
def chat_participants(spark, sf_dir):
    found = chunking.messages(F.col("content"))
    senders = F.array_join(F.array_distinct(F.transform(found, lambda m: m["sender"])), ", ")
    return X.chat_files(spark, sf_dir).select("path", F.size(found).cast("long").alias("messages"), senders.alias("participants"))


@query
def chat_chunks(spark, sf_dir):
    return chunking.chunk(X.chat_files(spark, sf_dir), 200).select("source", "chunk_index", "total_chunks", "heading", "content_hash", "is_chat")


@query
def gap_segments(spark, sf_dir):
    """Events of each user as messages, segmented at gaps of six hours once a segment has more than three."""
    events = X.table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")).alias("t"), "event_id"))).alias("e"))
    times = F.transform("e", lambda e: e["t"])
    spans = chunking.gap_spans(times, F.transform("e", lambda e: F.lit(0).cast("long")), 10**9, 6 * 3_600_000)
    rows = events.select("user_id", times.alias("times"), F.posexplode(spans).alias("segment", "s"))
    return rows.select("user_id", "segment", (F.col("s.b") - F.col("s.a")).cast("long").alias("messages"), F.col("times")[F.col("s.a")].alias("first_ms"))


@query
def csv_chunks(spark, sf_dir):
    return chunking.chunk(X.csv_files(spark, sf_dir), 200).select("source", "chunk_index", "total_chunks", "heading", "content_hash")


@query
def json_chunks(spark, sf_dir):
    return chunking.chunk(X.json_files(spark, sf_dir), 40).select("source", "chunk_index", "total_chunks", "heading", "text")


@query
def markdown_sections(spark, sf_dir):
    return chunking.chunk(X.markdown_files(spark, sf_dir)).select("source", "chunk_index", "total_chunks", "heading", "content_hash")


@query
def paragraph_chunks(spark, sf_dir):
    return chunking.chunk(X.text_files(spark, sf_dir), 200).select("source", "chunk_index", "total_chunks", "content_hash")


@query
def chunk_totals(spark, sf_dir):
    chunks = chunking.chunk(X.text_files(spark, sf_dir), 6000)
    return chunks.select(F.count("*").over(Window.partitionBy("source")).alias("n"), "source", T.estimate_tokens(F.col("text")).alias("tokens")).groupBy("source").agg(F.max("n").alias("chunks"), F.sum("tokens").alias("tokens"))


@query
def prescan_sample(spark, sf_dir):
    return extract.prescan_sample(X.document_chunks(spark, sf_dir))


@query
def alias_index(spark, sf_dir):
    return dedup.alias_index(X.order_extractions(spark, sf_dir))


@query
def entity_merge(spark, sf_dir):
    rows = dedup.merge_entities(X.order_extractions(spark, sf_dir))
    return rows.select("id", "name", "type", F.array_join("aliases", ",").alias("aliases"), "mentions", F.col("ord.ext_ord.file_ord").alias("first_order"))


@query
def person_merge(spark, sf_dir):
    return dedup.merge_people(X.order_extractions(spark, sf_dir)).select("id", "name", "role", "mentions")


@query
def text_merge(spark, sf_dir):
    return dedup.merge_texts(X.order_extractions(spark, sf_dir)).select("id", "kind", "text", F.col("ord.ext_ord.file_ord").alias("first_order"))


@query
def relationship_edges(spark, sf_dir):
    ext = X.order_extractions(spark, sf_dir)
    entities, people = dedup.merge_entities(ext), dedup.merge_people(ext)
    nodes = entities.select("id").unionByName(people.select("id"))
    return build.unique_edges(build.relationship_edges(dedup.relationships(ext), build.no_moves(spark), nodes)).select("source", "target", "type")


@query
def chunk_nodes(spark, sf_dir):
    return dedup.chunk_nodes(X.order_extractions(spark, sf_dir)).select("source", "id")


@query
def co_occurrence_edges(spark, sf_dir):
    ext = X.order_extractions(spark, sf_dir)
    entities, people, texts = dedup.merge_entities(ext), dedup.merge_people(ext), dedup.merge_texts(ext)
    files = X.table(spark, sf_dir, "orders").select(F.concat(F.lit("orders/"), "o_orderkey").alias("path"))
    nodes = entities.select("id").unionByName(people.select("id")).unionByName(texts.select("id")).unionByName(files.select(T.document_id(F.col("path")).alias("id")))
    return build.co_occurrence_edges(dedup.chunk_nodes(ext), texts, entities, people, build.no_moves(spark), nodes).select("source", "target", "type", _weight())


#: Merges and parts of the consolidation fixture: nations by name.
MERGES = [(0, "NATION_3", "NATION_5"), (1, "NATION_3", "Nation 7"), (2, "NATION_4", "NATION_7"), (3, "NATION_8", "No Such Nation"), (4, "No Such Canon", "NATION_9")]
PARTS = [(0, "nation_3", "NATION_4"), (1, "nation 12", "Nation_6"), (2, "nowhere", "NATION_1")]


def _nations(spark, sf_dir):
    place = F.struct(F.struct(F.col("n_nationkey").cast("long").alias("file_ord"), F.lit(0).alias("chunk_index")).alias("ext_ord"), F.lit(0).alias("rank"), F.lit(0).alias("pos"))
    return X.table(spark, sf_dir, "nation").select(T.canonical_id("entity", F.col("n_name")).alias("id"), F.col("n_name").alias("name"), F.lit("place").alias("type"), F.array(F.concat(F.lit("nation "), "n_nationkey")).alias("aliases"), F.lit(1).cast("long").alias("mentions"), place.alias("ord"))


@query
def remap_entities(spark, sf_dir):
    entities = _nations(spark, sf_dir)
    moves = build.remap(spark.createDataFrame(MERGES, "ord long, canonical string, alias string"), entities)
    return build.apply_remap(entities, moves).select("id", "name", "mentions", F.array_join("aliases", ",").alias("aliases"))


@query
def part_of_edges(spark, sf_dir):
    entities = _nations(spark, sf_dir)
    rows = spark.createDataFrame(PARTS, "ord long, child string, parent string")
    return build.part_of_edges(rows, entities, build.no_moves(spark), entities.select("id")).select("source", "target", "type")


@query
def noise_entities(spark, sf_dir):
    names = X.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).unionByName(X.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"))).unionByName(X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("name")))
    return names.distinct().select("name", T.is_noise_entity(F.col("name")).alias("noise"))


@query
def noise_text(spark, sf_dir):
    lines = X.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    return lines.select("doc_id", "line", T.is_noise_text(F.col("text")).alias("noise"))


@query
def near_duplicate_texts(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select(F.concat(F.lit("fact:"), "doc_id").alias("id"), "text", F.col("doc_id").alias("node_ord"))
    return quality.first_of_near_duplicates(docs)


@query
def core_survivors(spark, sf_dir):
    return quality.core_survivors(*X.graph(spark, sf_dir))


@query
def filtered_nodes(spark, sf_dir):
    return quality.filter_graph(*X.graph(spark, sf_dir))[0].select("id", "type")


@query
def filtered_edges(spark, sf_dir):
    return quality.filter_graph(*X.graph(spark, sf_dir))[1].select("source", "target", "type", _weight())


@query
def pagerank(spark, sf_dir):
    return rank.pagerank(*X.trading_graph(spark, sf_dir))


SEARCH = "which customers ordered urgent parts with priority high"


@query
def search_scores(spark, sf_dir):
    return search.search(X.graph(spark, sf_dir)[0], SEARCH).select("id", F.round("score", 6).alias("score"))


@query
def search_top(spark, sf_dir):
    return search.top(X.graph(spark, sf_dir)[0], SEARCH)


@query
def bfs_hops(spark, sf_dir):
    return graph.traverse(*X.trading_graph(spark, sf_dir), "region:1", 2)


@query
def neighbors(spark, sf_dir):
    return graph.neighbors(X.graph(spark, sf_dir)[1], "nation:7")


@query
def incident_edges(spark, sf_dir):
    return graph.incident_edges(X.graph(spark, sf_dir)[1], "supplier:3")


@query
def degrees(spark, sf_dir):
    return graph.degrees(X.graph(spark, sf_dir)[1]).withColumn("radius", F.round("radius", 6))


@query
def graph_counts(spark, sf_dir):
    return graph.counts(*X.graph(spark, sf_dir))


@query
def graph_stats(spark, sf_dir):
    return graph.stats(*X.graph(spark, sf_dir))


@query
def type_subgraph(spark, sf_dir):
    return graph.of_types(*X.graph(spark, sf_dir), ["entity"])[1].select("source", "target", "type", _weight())


@query
def node_detail(spark, sf_dir):
    return graph.detail(*X.graph(spark, sf_dir), "supplier:3")


def _halves(spark, sf_dir):
    """The graph twice over: once with people only, once without orders and with other roles."""
    nodes, edges = X.graph(spark, sf_dir)
    a = (nodes.filter("type = 'person'"), edges.filter("type = 'ABOUT'"))
    b = (nodes.filter("type <> 'fact'").withColumn("role", F.when(F.col("type") == "person", F.lower("role"))), edges.filter("type <> 'BOUGHT'").withColumn("weight", F.lit(7).cast("long")))
    return a, b


@query
def merged_nodes(spark, sf_dir):
    return graph.merge(*_halves(spark, sf_dir))[0].select("id", "type", "name", "role")


@query
def merged_edges(spark, sf_dir):
    return graph.merge(*_halves(spark, sf_dir))[1].select("source", "target", "type", _weight())


@query
def dot_export(spark, sf_dir):
    nodes, edges = X.trading_graph(spark, sf_dir)
    places = nodes.filter(F.col("entityType") == "place")
    return graphs.dot_lines(places, build.existing(edges, places))


@query
def chat_times(spark, sf_dir):
    """Times of events as chat lines: half days, seconds, and dates and hours that there are none of."""
    at = F.col("ts").cast("timestamp_ntz")
    form = F.col("event_id") % 4
    line = F.when(form == 0, F.date_format(at, "M/d/yyyy, h:mm:ss a")).when(form == 1, F.concat(F.lit("["), F.date_format(at, "M/d/yy, HH:mm:ss"), F.lit("]"))).when(form == 2, F.date_format(at, "'13/45/'yy, H:mm")).otherwise(F.date_format(at, "M/d/yy, '13':mm 'PM'"))
    return X.table(spark, sf_dir, "events").select("event_id", T.chat_millis(F.concat(line, F.lit(" - Ada: text"))).alias("millis"))


@query
def section_parts(spark, sf_dir):
    """Sections above the limit are packed as paragraphs under their heading."""
    return chunking.chunk(X.section_files(spark, sf_dir), 200).select("source", "chunk_index", "total_chunks", "heading", "content_hash")


@query
def json_fallback(spark, sf_dir):
    """Files that are JSON by name alone."""
    return chunking.chunk(X.text_files(spark, sf_dir).withColumn("ext", F.lit(".json")), 200).select("source", "chunk_index", "total_chunks", "content_hash")


@query
def chat_fallback(spark, sf_dir):
    """Files that look like chats, without a message."""
    return chunking.chunk(X.silent_chat_files(spark, sf_dir), 200).select("source", "chunk_index", "total_chunks", "content_hash")


@query
def chunk_prompts(spark, sf_dir):
    """What a model is asked about each document, its language as heading; none for a quarter of them."""
    heading = F.when(F.col("file_ord") % 4 > 0, F.concat(F.lit("part "), F.col("file_ord") % 4)).otherwise("")
    return X.document_chunks(spark, sf_dir).withColumn("heading", heading).select(F.col("file_ord").alias("doc_id"), F.sha2(extract.user_prompt(), 256).alias("prompt"))


@query
def replayed_answers(spark, sf_dir):
    """Stored answers read leniently; chunks without a usable one fail alone."""
    ext = extract.extractions(extract.ReplayExtractor(X.stored_answers(spark, sf_dir)), X.document_chunks(spark, sf_dir))
    return ext.select(F.col("ext_ord.file_ord").alias("doc_id"), F.get("entities", F.lit(0))["name"].alias("entity"), F.get("facts", F.lit(0)).alias("fact"), "usage_tokens", F.col("error").isNotNull().alias("failed"))


@query
def processed_rows(spark, sf_dir):
    """What the state of a run of replayed_answers() would hold."""
    ext = extract.extractions(extract.ReplayExtractor(X.stored_answers(spark, sf_dir)), X.document_chunks(spark, sf_dir))
    return incremental.processed_now(ext, "now").select("content_hash", "extracted_at", "tokens")


@query
def frustration_merge(spark, sf_dir):
    ext = X.order_extractions(spark, sf_dir)
    ext = ext.withColumn("frustrations", F.transform("preferences", lambda p: F.replace(p, F.lit(" prefers "), F.lit(" lacks "))))
    return dedup.merge_texts(ext).filter("kind = 'frustration'").select("id", "text", F.col("ord.ext_ord.file_ord").alias("first_order"))


@query
def document_nodes(spark, sf_dir):
    return build.document_nodes(X.text_files(spark, sf_dir), "now").select("id", "type", "path", "filename", "size", "ingestedAt")


@query
def upserted_nodes(spark, sf_dir):
    """Customers over customers: every second with another role, every third with a name given as null, some that are new."""
    people = X.graph(spark, sf_dir)[0].filter("type = 'person'")
    key = F.substring_index("id", ":", -1).cast("long")
    some = people.filter((key % 2 == 0) | (key % 3 == 0))
    new = some.withColumns({
        "id": F.when(key % 5 == 0, F.concat("id", F.lit("-new"))).otherwise(F.col("id")), "role": F.when(key % 2 == 0, F.lower("role")), "name": F.lit(None).cast("string"),
        "summary": F.lit("told again"), "extra": F.when(key % 3 == 0, F.create_map(F.lit("name"), F.lit("null"), F.lit("odd"), key.cast("string"))),
    })
    return build.overlay(people, new).select("id", "name", "role", "summary", F.col("extra")["odd"].alias("odd"))


@query
def node_lookup(spark, sf_dir):
    nodes = X.graph(spark, sf_dir)[0]
    return graph.node(nodes, "supplier:3").select("id", "type", "name")


@query
def filter_counts(spark, sf_dir):
    """How many nodes the filter keeps and cuts."""
    nodes, edges = X.graph(spark, sf_dir)
    kept = quality.filter_graph(nodes, edges)[0].agg(F.count("*").alias("kept"))
    return kept.withColumn("cut", nodes.agg(F.count("*")).scalar() - F.col("kept"))


@query
def rule_graph(spark, sf_dir):
    """Text files to a filtered, ranked graph by the rule extractor; per node type, how many are left."""
    from loomgraph.plans.ingest import graph_of

    files = X.text_files(spark, sf_dir)
    ext = spill(extract.extractions(extract.RuleExtractor(), spill(chunking.chunk(files, 1000), "chunks")), "extractions")
    nodes, *_ = graph_of(files, ext, "1970-01-01T00:00:00Z")
    return nodes.groupBy("type").agg(F.count("*").alias("nodes"), F.round(F.max("rank"), 4).alias("top"))
