"""Shared helpers of the text operators: column picking, word splitting, shared-folder tables.

Conventions kept by every operator of this subpackage:

* Only the columns an operator needs are picked, by exact name and position, so extra columns,
  and extra columns whose names differ by case alone, never clash with its own.
* A null text has no words, lines or letters. A null id stays null and orders below every id.
* Repeated rows are rows of their own; each gets its own result row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.sources.shared import forget, release, shared_dir, spill

__all__ = ["CHUNK_CHARS", "chunks", "deal", "forget", "held_out", "parts_for", "pick", "position", "release", "shared_dir", "spill", "table", "words"]

#: Text handled at once inside a Python worker, in characters; bounds numpy temporaries, not rows.
CHUNK_CHARS = 1_000_000


def bound_batches(spark: SparkSession, size: str = "3m") -> None:
    """Batches that go to Python are bounded in bytes, whatever the length of their texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def pick(df: DataFrame, **types: str) -> DataFrame:
    """The named columns, cast, of a frame that may hold clashing extra ones."""
    bound_batches(df.sparkSession)
    found = {}
    for name in types:
        exact = [i for i, c in enumerate(df.columns) if c == name]
        loose = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
        if not exact and not loose:
            raise ValueError(f"column {name} is missing; there are {df.columns}")
        found[name] = (exact or loose)[0]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{i}").cast(types[n]).alias(n) for n, i in found.items()])


def position(df: DataFrame, name: str) -> int:
    """The place of a column, an exact name before one that differs by case."""
    bound_batches(df.sparkSession)
    order = [i for i, c in enumerate(df.columns) if c == name] + [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not order:
        raise ValueError(f"column {name} is missing; there are {df.columns}")
    return order[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0; a null id counts as the empty text and is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than U+0020 and U+0009 to U+000D, as UTF-8."""
    return text.encode().split() if text else []


def chunks(batches: Iterable[pa.RecordBatch], text_at: int, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches holding about `limit` characters each, one row at least."""
    for batch in batches:
        sizes = [len(x) if x else 0 for x in batch.column(text_at).to_pylist()]
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def parts_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def deal(docs: DataFrame, part_chars: int) -> tuple[DataFrame, int]:
    """Documents dealt evenly to parts of about `part_chars` bytes of text, by a hash of id and text, in a column `part`;
    and the bytes of all texts.
    """
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    n = parts_for(docs.sparkSession, -(-size // part_chars))
    dealt = docs.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))
    return dealt.repartition(n, "part"), size
