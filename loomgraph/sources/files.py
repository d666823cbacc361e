"""Files as rows: path, filename, content, ext, size (UTF-8 bytes), file_ord.

Local paths are listed on the driver and read by tasks, so names that Spark's own file source
hides (a leading underscore) or would expand (glob characters) are read like any other. Paths
with a scheme go through Spark's binary reader. Zip archives are opened in tasks.
"""

from __future__ import annotations

import io
import os
import sys
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, filename string, content string, ext string, size long, file_ord long"

#: Extensions of text files.
TEXT_EXTENSIONS = frozenset(
    """
    .txt .md .markdown .json .csv .tsv .js .ts .jsx .tsx .py .rb .go .rs .java .c .h .cpp .hpp .cs .swift .kt
    .html .css .scss .less .xml .yaml .yml .toml .sh .bash .zsh .fish .bat .ps1 .sql .graphql .proto .env .ini .cfg .conf
    .log .rst .tex .org .adoc
    """.split()
)


def extension(name: str) -> str:
    """From the last dot on, lower-cased; none for names whose only dot leads."""
    stem, dot, last = name.rpartition(".")
    return f".{last}".lower() if dot and stem.strip(".") else ""


def is_text_file(name: str) -> bool:
    ext = extension(name)
    return ext in TEXT_EXTENSIONS or (not name.startswith(".") and ext == "")


def list_directory(top: str) -> list[str]:
    """Text files below a directory, without hidden names and node_modules, in name order."""
    out = []
    for entry in sorted(os.scandir(top), key=lambda e: e.name):
        if entry.name.startswith(".") or entry.name == "node_modules":
            continue
        if entry.is_dir():
            out += list_directory(entry.path)
        elif is_text_file(entry.name):
            out.append(entry.path)
    return out


def _zip_members(path: str) -> Iterator[tuple[str, str, bytes]]:
    with zipfile.ZipFile(path) as archive:
        for info in sorted(archive.infolist(), key=lambda i: i.filename):
            parts = info.filename.split("/")
            if info.is_dir() or any(p.startswith(".") or p == "__MACOSX" for p in parts) or not is_text_file(parts[-1]):
                continue
            yield f"{path}!/{info.filename}", parts[-1], archive.read(info)


def _rows(path: str, ord_: int) -> Iterator[tuple]:
    """A row for each file or member, and one with the reason where reading ends early. file_ord leaves room for members."""
    try:
        if path.endswith(".zip"):
            for i, (inner, name, raw) in enumerate(_zip_members(path)):
                yield _row(inner, name, raw, ord_ + i)
        else:
            with open(path, "rb") as file:
                raw = file.read()
            yield _row(path, os.path.basename(path), raw, ord_)
    except (OSError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as error:
        yield path, os.path.basename(path), None, "", 0, ord_, str(error) or type(error).__name__


def _row(path: str, name: str, raw: bytes, ord_: int) -> tuple:
    content = raw.decode("utf-8", "replace")
    return path, name, content, extension(name), len(content.encode()), ord_, None


def attempts(spark: SparkSession, paths: list[str], per_task: int = 200) -> DataFrame:
    """The listed files, read in tasks of some hundred, with `error`: null, or why a file could not be read (whole)."""
    listed = spark.createDataFrame([(p, i << 20) for i, p in enumerate(paths)], "path string, ord long")
    schema = f"{SCHEMA}, error string"

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in schema.split(", ")]
        for frame in frames:
            for path, ord_ in zip(frame["path"], frame["ord"], strict=True):
                yield pd.DataFrame(_rows(path, int(ord_)), columns=names)

    return listed.repartition(max(1, -(-len(paths) // per_task))).mapInPandas(task, schema)


def read_paths(spark: SparkSession, paths: list[str], per_task: int = 200) -> DataFrame:
    """attempts() that went well. Files that cannot be read are left out."""
    return attempts(spark, paths, per_task).filter("error is null").drop("error")


def read_remote(spark: SparkSession, path: str) -> DataFrame:
    """Text files below a path of any file system Spark reads; bytes that are no UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)\z", 1))
    content = F.make_valid_utf8(F.col("content").cast("string"))
    rows = raw.select("path", name.alias("filename"), content.alias("content"), ext.alias("ext"), F.octet_length(content).cast("long").alias("size"), F.xxhash64("path").alias("file_ord"))
    hidden = F.col("filename").startswith(".") | F.col("path").contains("/node_modules/")
    return rows.filter(~hidden & (F.col("ext").isin(*sorted(TEXT_EXTENSIONS)) | (F.col("ext") == "")))


def read_source(spark: SparkSession, source: str) -> DataFrame:
    """A directory, a .zip or one file; a file named outright is read whatever its extension."""
    if "://" in source:
        return read_remote(spark, source)
    return read_paths(spark, list_directory(source) if os.path.isdir(source) else [_there(source)])


def _there(path: str) -> str:
    os.stat(path)  # a source that is not there is the caller's error
    return path


def read_sources(spark: SparkSession, sources: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """All sources in order, with the `error` of files that could not be read, and (source, reason) of sources that are not there."""
    paths, failed, remote = [], [], []
    for source in sources:
        try:
            if "://" in source:
                remote.append(read_remote(spark, source))
            else:
                paths += list_directory(source) if os.path.isdir(source) else [_there(source)]
        except Exception as error:  # noqa: BLE001
            failed.append((source, str(error)))
    out = attempts(spark, paths)
    for rows in remote:
        out = out.unionByName(rows.withColumn("error", F.lit(None).cast("string")))
    return out, failed


def from_text(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    """One pseudo file, for standard input or pasted text."""
    return spark.createDataFrame([(path, path, text, ".txt", len(text.encode()), 0)], SCHEMA)


def from_stdin(spark: SparkSession, stream: io.BufferedIOBase | None = None) -> DataFrame:
    return from_text(spark, (stream or sys.stdin.buffer).read().decode("utf-8", "replace"))
