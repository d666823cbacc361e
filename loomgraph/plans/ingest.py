"""The whole run: sources, chunks, extraction, graph, filter, ranks, output, state."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import build, chunking, extract, incremental, quality, rank
from loomgraph.sources import files as sources
from loomgraph.sources import graphs
from loomgraph.sources.shared import spill

log = logging.getLogger("loomgraph")


@dataclass
class Result:
    nodes: DataFrame
    edges: DataFrame
    estimate: dict
    failed_sources: list
    failed_chunks: int
    kept: int = 0
    cut: int = 0


def graph_of(files: DataFrame, ext: DataFrame, now: str, merges: DataFrame | None = None, part_of: DataFrame | None = None, old=None, names: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, int, int]:
    """Built, filtered and ranked, and how many nodes the filter kept and cut. The built graph is written once, since the filter reads it several times."""
    nodes, edges = (spill(t, name) for t, name in zip(build.build(files, ext, now, merges, part_of, old), ("nodes", "edges"), strict=True))
    before = nodes.count()
    nodes, edges = (spill(t, name) for t, name in zip(quality.filter_graph(nodes, edges, names), ("nodes", "edges"), strict=True))
    kept = nodes.count()
    return rank.with_rank(nodes, edges), edges, kept, before - kept


def ingest(
    spark: SparkSession, paths: list[str], extractor: extract.Extractor, output: str | None = None, chunk_size: int = 6000, model: str = "", dry_run: bool = False,
    call=None, text: str | None = None, now: str | None = None, names: tuple[str, ...] = (), proceed: Callable[[dict], bool] | None = None,
) -> Result:
    """Sources to a graph. output: a folder for the graph's tables and the state, or a local .json document with the state beside it; an older graph there is built upon.

    call: a language model for consolidation, if wanted. text: content given outright instead of paths.
    proceed: asked with the estimate before anything is extracted; if it says no, the result is empty.
    """
    now = now or datetime.now(UTC).isoformat()
    files, failed = (sources.from_text(spark, text).withColumn("error", F.lit(None).cast("string")), []) if text is not None else sources.read_sources(spark, paths)
    files = spill(files, "files")
    failed += [(r["path"], r["error"]) for r in files.filter("error is not null").select("path", "error").toLocalIterator()]
    for source, reason in failed:
        log.warning("skipped %s: %s", source, reason)
    files = files.filter("error is null").drop("error")
    chunks = spill(chunking.chunk(files, chunk_size), "chunks")
    state, old = None, None
    document = output is not None and output.endswith(".json")
    if output:
        state = incremental.State(f"{output}.processed" if document else f"{output}/processed")
        chunks = incremental.unprocessed(chunks, state.read(spark))
        if document:
            old = tuple(spill(t, "old") for t in graphs.read_json(spark, f"file://{os.path.abspath(output)}")) if os.path.exists(output) else None
        else:
            old = graphs.read_tables(spark, output) if graphs.stored(spark, output) else None
    cost = incremental.estimate(chunks, model).first().asDict()
    if dry_run or (proceed is not None and not proceed(cost)):
        return Result(spark.createDataFrame([], "id string"), spark.createDataFrame([], "source string"), cost, failed, 0)
    if isinstance(extractor, extract.ModelExtractor) and extractor.guide is None:
        extractor = extractor.guided(extract.prescan(extractor.call, chunks))
    ext = spill(extract.extractions(extractor, chunks), "extractions")
    merges = part_of = None
    if call is not None:
        from loomgraph.operators.dedup import merge_entities

        found = extract.consolidate_all(call, [r["name"] for r in merge_entities(ext).orderBy("ord").select("name").collect()])
        pairs = [(i, m["canonical"], a) for i, (m, a) in enumerate((m, a) for m in found["merges"] for a in m.get("aliases", []))]
        merges = spark.createDataFrame(pairs, "ord long, canonical string, alias string")
        part_of = spark.createDataFrame([(i, p["child"], p["parent"]) for i, p in enumerate(found["part_of"])], "ord long, child string, parent string")
    good = ext.filter("error is null")
    nodes, edges, kept, cut = graph_of(files, good, now, merges, part_of, old, names)
    log.info("filtered: kept %d, cut %d noise nodes", kept, cut)
    if output:
        nodes, edges = spill(nodes, "graph-nodes"), spill(edges, "graph-edges")
        (graphs.write_json if document else graphs.write_tables)(nodes, edges, output)
        state.append(incremental.processed_now(ext, now))  # after the graph, so a failed run is run again
    return Result(nodes, edges, cost, failed, ext.filter("error is not null").count(), kept, cut)
