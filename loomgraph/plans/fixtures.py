"""Inputs of the registered queries, derived from the relational and text tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import build, extract

S, L = F.col, F.lit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _file(path, content, ext: str, ord_) -> list:
    return [path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("filename"), content.alias("content"), L(ext).alias("ext"), F.octet_length(content).cast("long").alias("size"), ord_.cast("long").alias("file_ord")]


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document, its lines as paragraphs."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(*_file(F.concat(L("docs/"), "doc_id", L(".txt")), F.replace("text", L("\n"), L("\n\n")), ".txt", S("doc_id")))


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: a preamble, a section, and a section that begins with a second heading."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(L("About "), "source", L("\n# Text of "), "doc_id", L("\n"), "text", L("\n## Language\n### Code\n"), "lang")
    return docs.select(*_file(F.concat(L("docs/"), "doc_id", L(".md")), content, ".md", S("doc_id")))


def section_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document: a preamble and one section, its lines as paragraphs. Number signs go, so that no line opens another."""
    docs = table(spark, sf_dir, "documents")
    content = F.concat(L("About "), "source", L("\n# Text of "), "doc_id", L("\n"), F.replace(F.replace("text", L("#"), L("")), L("\n"), L("\n\n")))
    return docs.select(*_file(F.concat(L("docs/"), "doc_id", L(".md")), content, ".md", S("doc_id")))


def silent_chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files after three dated lines that nobody sent."""
    return text_files(spark, sf_dir).withColumn("content", F.concat(L("1/2/24, 10:00\n\n" * 3), "content"))


def stored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's answer for most documents, by what their hash begins with: plain, fenced, with words around it, none, or no JSON."""
    key = F.sha2("text", 256)
    answer = F.concat(L('{"entities": [{"name": "E'), F.left(key, L(3)), L('", "type": "tool"}], "facts": ["About '), F.left(key, L(8)), L('"]}'))
    first = F.left(key, L(1))
    form = F.when(first < "4", answer).when(first < "8", F.concat(L("```json\n"), answer, L("\n```"))).when(first < "c", F.concat(L("Here it is: "), answer, L(" That is all."))).when(first < "e", L("I cannot"))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select(key.alias("content_hash"), form.alias("answer"), F.length("text").cast("long").alias("usage_tokens"))
    return rows.filter("answer is not null").distinct()


def csv_files(spark: SparkSession, sf_dir: str, rows: int = 500) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumn("f", F.floor(S("p_partkey") / rows))
    line = F.concat_ws(",", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    files = part.groupBy("f").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("x")))), lambda r: r["x"]).alias("lines"))
    content = F.concat(L("p_partkey,p_name,p_brand,p_type,p_size\n"), F.array_join("lines", "\n"))
    return files.select(*_file(F.concat(L("parts/"), "f", L(".csv")), content, ".csv", S("f")))


def json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, one file each, as an array of objects."""
    nation = table(spark, sf_dir, "nation")
    items = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.concat(L('{"n_nationkey": '), r["n_nationkey"], L(', "n_name": "'), r["n_name"], L('"}')))
    files = nation.groupBy("n_regionkey").agg(items.alias("items"))
    content = F.concat(L("["), F.array_join("items", ","), L("]"))
    return files.select(*_file(F.concat(L("nations/"), "n_regionkey", L(".json")), content, ".json", S("n_regionkey")))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per conversation: a message every two minutes, and half an hour more after every fourth."""
    rows = table(spark, sf_dir, "conversations")
    at = F.timestamp_seconds(L(1_704_067_200) + S("turn") * 120 + F.floor(S("turn") / 4) * 1800)
    line = F.concat(F.date_format(at, "M/d/yy, H:mm"), L(" - "), "role", L(": "), "text")
    files = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))), lambda r: r["x"]).alias("lines"))
    return files.select(*_file(F.concat(L("chats/"), "conv_id", L(".txt")), F.array_join("lines", "\n"), ".txt", S("conv_id")))


def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("text", F.concat(L("docs/"), "doc_id", L(".txt")).alias("source"), F.sha2("text", 256).alias("content_hash"), L(0).alias("chunk_index"), L(1).alias("total_chunks"), S("doc_id").alias("file_ord"))


def order_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extraction per order: its parts are entities (brand as alias), its customer a person."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    part = table(spark, sf_dir, "part").select(S("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type")
    items = lines.join(part, "l_partkey").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "p_brand", "p_type"))).alias("items"))  # at most seven lines an order
    orders = table(spark, sf_dir, "orders").join(items, S("o_orderkey") == S("l_orderkey"))
    orders = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), S("o_custkey") == S("c_custkey"))
    entity = lambda i: F.struct(i["p_name"].alias("name"), i["p_type"].alias("type"), F.array(i["p_brand"]).alias("aliases"))
    bought = lambda i: F.struct(S("c_name").alias("from"), i["p_name"].alias("to"), L("BOUGHT").alias("type"))
    first = S("items")[0]
    answer = F.struct(
        F.transform("items", entity).alias("entities"),
        F.array(F.struct(S("c_name").alias("name"), S("c_mktsegment").alias("role"))).alias("people"),
        F.array(F.concat("c_name", L(" ordered the part named "), first["p_name"], L(" of "), first["p_brand"])).alias("facts"),
        F.array(F.concat(L("Order "), "o_orderkey", L(" ships with priority "), "o_orderpriority")).alias("decisions"),
        F.array(F.concat("c_name", L(" prefers "), first["p_brand"])).alias("preferences"),
        F.array().cast("array<string>").alias("frustrations"),
        F.transform("items", bought).alias("relationships"),
    ).cast(extract.ANSWER)
    rows = orders.select(F.struct(S("o_orderkey").cast("long").alias("file_ord"), L(0).alias("chunk_index")).alias("ext_ord"), F.concat(L("orders/"), "o_orderkey").alias("source"), answer.alias("a"))
    return rows.select("ext_ord", "source", *[F.col(f"a.{f}").alias(f) for f in extract.FIELDS])


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and parts as entities, customers as people, orders as facts about them."""
    t = lambda name: table(spark, sf_dir, name)
    key = lambda kind, column: F.concat(L(f"{kind}:"), column)

    def nodes(source: str, id_, kind: str, order, **known) -> DataFrame:
        place = F.struct(L(0).alias("run"), L(order[0]).alias("kind"), S(order[1]).cast("long").alias("file_ord"), L(0).alias("chunk_index"), L(0).alias("rank"), L(0).alias("pos")).cast(build.ORD)
        return t(source).select(id_.alias("id"), *build.null_node(type=L(kind), **known), place.alias("node_ord"))

    orders = t("orders").join(t("customer").select("c_custkey", "c_name"), S("o_custkey") == S("c_custkey"))
    fact = F.concat(L("Order "), "o_orderkey", L(" of "), "c_name", L(" has priority "), "o_orderpriority")
    place = F.struct(L(0).alias("run"), L(5).alias("kind"), S("o_orderkey").cast("long").alias("file_ord"), L(0).alias("chunk_index"), L(0).alias("rank"), L(0).alias("pos")).cast(build.ORD)
    all_nodes = nodes("region", key("region", "r_regionkey"), "entity", (0, "r_regionkey"), name=S("r_name"), entityType=L("place"), mentions=L(1))
    for part in (
        nodes("nation", key("nation", "n_nationkey"), "entity", (1, "n_nationkey"), name=S("n_name"), entityType=L("place"), mentions=L(1)),
        nodes("supplier", key("supplier", "s_suppkey"), "entity", (2, "s_suppkey"), name=S("s_name"), entityType=L("organization"), mentions=L(1)),
        nodes("part", key("part", "p_partkey"), "entity", (3, "p_partkey"), name=S("p_name"), entityType=L("concept"), mentions=L(1), aliases=F.array("p_brand")),
        nodes("customer", key("customer", "c_custkey"), "person", (4, "c_custkey"), name=S("c_name"), role=S("c_mktsegment"), mentions=L(1)),
        orders.select(key("order", "o_orderkey").alias("id"), *build.null_node(type=L("fact"), text=fact), place.alias("node_ord")),
    ):
        all_nodes = all_nodes.unionByName(part)
    pair = lambda rows, a, b, kind: rows.select(a.alias("source"), b.alias("target"), L(kind).alias("type"))
    lines = t("lineitem")
    bought = lines.join(t("orders").select("o_orderkey", "o_custkey"), S("l_orderkey") == S("o_orderkey"))
    edges = pair(t("nation"), key("nation", "n_nationkey"), key("region", "n_regionkey"), "PART_OF")
    for rows in (
        pair(t("customer"), key("customer", "c_custkey"), key("nation", "c_nationkey"), "LOCATED_IN"),
        pair(t("supplier"), key("supplier", "s_suppkey"), key("nation", "s_nationkey"), "LOCATED_IN"),
        pair(lines, key("supplier", "l_suppkey"), key("part", "l_partkey"), "SUPPLIES"),
        pair(bought, key("customer", "o_custkey"), key("part", "l_partkey"), "BOUGHT"),
        pair(t("orders"), key("order", "o_orderkey"), key("customer", "o_custkey"), "ABOUT"),
    ):
        edges = edges.unionByName(rows)
    return all_nodes, build.weighted(edges).withColumn("ord", build.edge_ord(1, key=F.concat_ws("|", "source", "target", "type")))


def trading_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """graph() without orders."""
    nodes, edges = graph(spark, sf_dir)
    return nodes.filter("type <> 'fact'"), edges.filter("type <> 'ABOUT'")
