"""Continuous ingestion: new files as they come, chunked, extracted and added to the graph batch by batch.

The state table skips chunks of earlier batches, and a batch that is run again after a failure
finds its own chunks done only if its graph was written, so every chunk takes effect once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.operators import chunking, extract, incremental
from loomgraph.plans.ingest import graph_of
from loomgraph.sources import graphs
from loomgraph.sources.files import TEXT_EXTENSIONS
from loomgraph.sources.shared import spill

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def read(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of text files below a path."""
    raw = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_batch).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    content = F.make_valid_utf8(F.col("content").cast("string"))
    rows = raw.select("path", name.alias("filename"), content.alias("content"), F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)\z", 1)).alias("ext"), "length", "modificationTime")
    rows = rows.filter(F.col("ext").isin(*sorted(TEXT_EXTENSIONS)) | (F.col("ext") == "")).filter(~F.col("filename").startswith(".") & ~F.col("path").contains("/node_modules/"))
    return rows.select("path", "filename", "content", "ext", F.col("length").alias("size"), F.xxhash64("path").alias("file_ord"), "modificationTime")


def start(stream: DataFrame, extractor: extract.Extractor, output: str, checkpoint: str, chunk_size: int = 6000, names: tuple[str, ...] = (), **trigger) -> StreamingQuery:
    """Run the stream into the graph at `output` (versions of nodes/ and edges/, processed/)."""

    def batch(files: DataFrame, number: int) -> None:
        spark = files.sparkSession
        files = spill(files.drop("modificationTime"), "stream-files")
        state = incremental.State(f"{output}/processed")
        chunks = incremental.unprocessed(chunking.chunk(files, chunk_size), state.read(spark))
        ext = spill(extract.extractions(extractor, chunks), "stream-extractions")
        if ext.isEmpty():
            return
        old = graphs.read_tables(spark, output) if graphs.stored(spark, output) else None
        now = str(number)
        nodes, edges, *_ = graph_of(files, ext.filter("error is null"), now, old=old, names=names)
        graphs.write_tables(spill(nodes, "stream-nodes"), spill(edges, "stream-edges"), output)
        state.append(incremental.processed_now(ext, now))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def conversation_windows(messages: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Messages (conversation, ts, text) per session: a stream's closest to segmenting by gaps, without its guard of three messages."""
    rows = messages.withWatermark("ts", late)
    return rows.groupBy("conversation", F.session_window("ts", gap)).agg(F.count("*").alias("messages"), F.min("ts").alias("first"), F.max("ts").alias("last"))
