"""Tables in the folder that driver and executors share, to end lineage between phases."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_kept: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a local one only where it is unset and the master is local (tests)."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        import tempfile

        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="loomgraph-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def spill(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and lost executors cost nothing that came before.

    With `keep`, the table outlives release(). Shuffle files of the job go when it ends.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/loomgraph-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    (_kept if keep else _written).append((spark, path))
    out = spark.read.schema(schema).parquet(path)
    out._spilled = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(*frames: DataFrame) -> None:
    """Delete tables of spill() that nothing will read any more; other frames are let be."""
    for path in (getattr(f, "_spilled", None) for f in frames):
        for entry in [e for e in _written if e[1] == path]:
            _written.remove(entry)
            _delete(*entry)


def release() -> None:
    """Delete the tables that spill() wrote and not kept. Call it once results that read them are written."""
    while _written:
        _delete(*_written.pop())


@atexit.register
def _at_end() -> None:
    try:
        _written.extend(_kept)
        release()
    except Exception:  # noqa: BLE001  the session has ended
        return
