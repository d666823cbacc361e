"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, jaccard, language, lines, packing, pii, quality, substring, url_filter
from loomgraph.llm.common import pick, table

#: The rules of the url query: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedupe(table(spark, sf_dir, "documents")).drop("kept")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.rules(docs, quality.train_rules(docs, table(spark, sf_dir, "labels")))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def url_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, good: a page shows the document whose id ends its url's path; that document's quality label, the least of several, is its outcome.

    Only labelled pages are needed, so the labels are joined to pages and the rest left out.
    """
    pages = pick(pages, url="string").select(url_filter.host(F.col("url")).alias("host"), F.regexp_extract(url_filter.path(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("d"))
    shown = pages.filter("d <> ''").select("host", F.col("d").cast("long").alias("doc_id"))
    labels = pick(labels, doc_id="long", quality="int").filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return shown.join(labels, "doc_id").select("host", F.col("quality").alias("good"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES).drop("reputation")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lines, op3_language, op4_quality, op5_substring, op6_rules, op7_pii, op8_packing, op9_jaccard, op10_urls)}
