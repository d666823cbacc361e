"""Re-runs and cost: which chunks are done, and what the rest would cost."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import text as T

#: US dollars for a million tokens in and out, by model; others cost OTHER_PRICE.
PRICES = {"google/gemini-2.0-flash-lite-001": (0.04, 0.15), "google/gemini-2.0-flash-001": (0.10, 0.40), "gpt-4o-mini": (0.15, 0.60), "llama-3.1-8b-instant": (0.05, 0.08)}
OTHER_PRICE = (0.10, 0.40)
TOKENS_OUT, TOKENS_SYSTEM = 500, 300


def unprocessed(chunks: DataFrame, processed: DataFrame) -> DataFrame:
    """Chunks whose hash is not processed; repeats within a run all stay."""
    return chunks.join(processed.select("content_hash"), "content_hash", "left_anti")


def processed_now(ext: DataFrame, now: str) -> DataFrame:
    """Rows for the state: content_hash, extracted_at, tokens, of extractions without an error."""
    return ext.filter("error is null").groupBy("content_hash").agg(F.lit(now).alias("extracted_at"), F.max("usage_tokens").alias("tokens"))


def estimate(chunks: DataFrame, model: str) -> DataFrame:
    """One row: chunks, input_tokens, output_tokens, estimated_cost, model."""
    price_in, price_out = PRICES.get(model, OTHER_PRICE)
    n, tokens = F.count("*"), F.coalesce(F.sum(T.estimate_tokens(F.col("text"))), F.lit(0))
    sums = chunks.agg(n.alias("chunks"), (tokens + n * TOKENS_SYSTEM).alias("input_tokens"), (n * TOKENS_OUT).alias("output_tokens"))
    cost = F.col("input_tokens") / 1e6 * price_in + F.col("output_tokens") / 1e6 * price_out
    return sums.withColumns({"estimated_cost": cost, "model": F.lit(model)})


@dataclass
class State:
    """The table of processed chunks of one output, appended to after the graph is written."""

    path: str

    def read(self, spark) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return spark.read.schema("content_hash string, extracted_at string, tokens bigint").parquet(self.path)
        except AnalysisException:
            return spark.createDataFrame([], "content_hash string, extracted_at string, tokens bigint")

    def append(self, rows: DataFrame) -> None:
        rows.select("content_hash", "extracted_at", F.col("tokens").cast("bigint").alias("tokens")).write.mode("append").parquet(self.path)
