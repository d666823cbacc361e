"""Dedup, build, filter, rank, search, merge and files on hand-made cases."""

import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from loomgraph import cli
from loomgraph.operators import build, chunking, dedup, extract, graph, incremental, quality, rank, search
from loomgraph.plans import config, ingest
from loomgraph.sources import files, graphs


def extractions(spark, answers):
    rows = [(i, 0, f"s{i}", f"h{i}", json.dumps(a)) for i, a in enumerate(answers)]
    df = spark.createDataFrame(rows, "file_ord long, chunk_index int, source string, content_hash string, raw string")
    found = df.select("file_ord", "chunk_index", "source", "content_hash", extract.parse_answer(F.col("raw")).alias("answer"), F.lit(0).cast("long").alias("usage_tokens"), F.lit(None).cast("string").alias("error"))
    fields = [F.coalesce(F.col(f"answer.{f}"), F.array()).alias(f) for f in extract.FIELDS]
    return found.select(F.struct("file_ord", "chunk_index").alias("ext_ord"), "source", "content_hash", *fields, "usage_tokens", "error")


@pytest.fixture(scope="module")
def ext(spark):
    return extractions(spark, [
        {"entities": [{"name": "Acme", "type": "", "aliases": ["AC", "ac"]}, None, {"name": "Bolt", "aliases": ["acme"]}], "people": [{"name": "Bolt"}], "facts": ["Acme makes the best bolts in the land", {"k": 1}], "relationships": [{"from": "ac", "to": "Nobody"}, {"from": "x"}]},
        {"entities": [{"name": "ACME", "type": "tool", "aliases": ["Acme Co", "AC"]}, {"name": "Bolt"}], "people": [{"name": "Bolt", "role": "cto"}, {"name": ""}], "facts": ["Acme makes the best bolts in the land"], "relationships": [{"from": "bolt", "to": "ACME", "type": "USES"}]},
    ])


def test_alias_index(ext):
    rows = {r["alias"]: (r["canonical"], r["node_type"]) for r in dedup.alias_index(ext).collect()}
    assert rows == {"acme": ("acme", "entity"), "ac": ("acme", "entity"), "acme co": ("acme", "entity"), "bolt": ("bolt", "person")}


def test_merges(ext):
    rows = {r["id"]: r for r in dedup.merge_entities(ext).collect()}
    assert (rows["entity:acme"]["name"], rows["entity:acme"]["type"], rows["entity:acme"]["aliases"], rows["entity:acme"]["mentions"]) == ("Acme", "concept", ["AC", "ac", "Acme Co"], 2)
    people = dedup.merge_people(ext).collect()
    assert [(p["id"], p["role"], p["mentions"]) for p in people] == [("person:bolt", "cto", 2)]
    assert {r["text"] for r in dedup.merge_texts(ext).collect()} == {"Acme makes the best bolts in the land", '{"k":1}'}
    assert sorted((r["source"], r["target"], r["type"]) for r in dedup.relationships(ext).collect()) == [("entity:acme", "entity:nobody", "RELATED_TO"), ("person:bolt", "entity:acme", "USES")]


def test_texts_share_a_prefix(spark):
    a = "p" * 60
    rows = dedup.merge_texts(extractions(spark, [{"facts": [a + " first"]}, {"facts": [a + " last"]}])).collect()
    assert [(r["text"], r["ord"]["ext_ord"]["file_ord"]) for r in rows] == [(a + " last", 0)]


def test_remap_rules(spark):
    def entities(*names):
        rows = [(f"entity:{n}", n, "concept", [n + "!"], m, None) for n, m in names]
        return spark.createDataFrame(rows, "id string, name string, type string, aliases array<string>, mentions long, ord struct<a:int>")

    def moved(rows, merges):
        moves = build.remap(spark.createDataFrame(merges, "ord long, canonical string, alias string"), rows)
        return {r["id"]: (r["mentions"], r["aliases"]) for r in build.apply_remap(rows, moves).collect()}

    assert moved(entities(("a", 1), ("b", 1), ("c", 5)), [(0, "b", "a"), (1, "a", "c")]) == {"entity:b": (2, ["b!", "a!", "a"]), "entity:c": (5, ["c!"])}
    assert moved(entities(("a", 1)), [(0, "gone", "a")]) == {}
    assert moved(entities(("a", 1), ("b", 1)), [(0, "b", "a"), (1, "a", "b")]) == {"entity:b": (2, ["b!", "a!", "a"])}
    assert moved(entities(("a", 1), ("b", 1), ("c", 1)), [(0, "b", "a"), (1, "c", "b")]) == {"entity:c": (3, ["c!", "b!", "a!", "a", "b"])}


def test_build_and_filter(spark, ext):
    source = spark.createDataFrame([("s0", "s0", 1, 0), ("s1", "s1", 1, 1)], "path string, filename string, size long, file_ord long")
    nodes, edges = build.build(source, ext, "now")
    found = {(r["source"], r["target"], r["type"]): r["weight"] for r in edges.collect()}
    fact = "fact:acme_makes_the_best_bolts_in_the_land"
    assert found[fact, "entity:acme", "ABOUT"] == 2 and found["person:bolt", "entity:acme", "USES"] is None
    assert found[fact, "person:bolt", "ABOUT"] == 2  # the name occurs within "bolts"
    kept, left = quality.filter_graph(nodes, edges)
    ids = {r["id"] for r in kept.collect()}
    assert "entity:acme" in ids and fact in ids and "person:bolt" not in ids
    assert all(r["source"] in ids and r["target"] in ids for r in left.collect())


def plain_rank(nodes, edges, steps=20):
    n = len(nodes)
    out = {v: sum(w for s, _, w in edges if s == v) for v in nodes}
    score = dict.fromkeys(nodes, 1 / n)
    for _ in range(steps):
        after = dict.fromkeys(nodes, 0.15 / n)
        for s, t, w in edges:
            after[t] += 0.85 * score[s] * w / out[s]
        score = after
    return {v: round(s / max(score.values()), 4) for v, s in score.items()}


def test_pagerank(spark):
    edges = [("a", "b", 1), ("b", "c", 3), ("b", "a", 1), ("c", "a", 1), ("d", "d", 2), ("a", "c", 1)]
    nodes = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(v,) for v in nodes], "id string")
    rows = rank.pagerank(df, spark.createDataFrame(edges, "source string, target string, weight long")).collect()
    assert {r["id"]: r["rank"] for r in rows} == plain_rank(nodes, edges)
    assert rank.pagerank(df.limit(0), spark.createDataFrame([], "source string, target string, weight long")).count() == 0


def small(spark):
    nodes = spark.createDataFrame([("n1", "entity", "Solar panels", None, ["pv"]), ("n2", "fact", None, "The panel supplier ships on Mondays", None), ("n3", None, None, None, None)], "id string, type string, name string, text string, aliases array<string>")
    nodes = nodes.select("id", *build.null_node(type=F.col("type"), name=F.col("name"), text=F.col("text"), aliases=F.col("aliases")), build.node_ord(0, file_ord=F.xxhash64("id")))
    edges = spark.createDataFrame([("n1", "n2", "A", None), ("n2", "n2", None, 2)], "source string, target string, type string, weight long").withColumn("ord", build.edge_ord(1, key=F.col("source")))
    return nodes, edges


def test_search(spark):
    nodes, _ = small(spark)
    got = {r["id"]: r["score"] for r in search.search(nodes, "panels supplier").collect()}
    assert got["n1"] == pytest.approx((math.log(3 / 1) + 1) / 2)
    assert got["n2"] == pytest.approx(math.log(3 / 2) + 1 + math.log(3 / 1) + 1)
    assert search.search(nodes, "the of it").count() == 0
    assert [r["label"] for r in search.top(nodes, "solar").collect()] == ["Solar panels"]


def test_views(spark):
    nodes, edges = small(spark)
    assert {(r["id"], r["depth"]) for r in graph.traverse(nodes, edges, "n1", 2).collect()} == {("n1", 0), ("n2", 1)}
    assert graph.traverse(nodes, edges, "zzz", 3).count() == 0
    assert graph.incident_edges(edges, "n2").count() == 3
    assert {r["id"] for r in graph.neighbors(edges, "n2").collect()} == {"n1", "n2"}
    assert {(r["what"], r["type"], r["count"]) for r in graph.stats(nodes, edges).collect()} == {("node", "entity", 1), ("node", "fact", 1), ("node", "unknown", 1), ("edge", "A", 1), ("edge", "unknown", 1)}
    a, b = graph.merge((nodes, edges), (nodes, edges))
    assert a.count() == 3 and b.count() == 2


def test_graph_documents(spark, tmp_path):
    nodes, edges = small(spark)
    path = str(tmp_path / "x" / "g.json")
    assert graphs.write_json(nodes, edges, path) == (3, 2)
    document = json.loads(open(path).read())
    document["edges"].append({"source": "n1", "target": "new", "type": "B"})
    document["nodes"].append({"id": "n1", "type": "tool"})
    open(path, "w").write(json.dumps(document))
    again, more = graphs.read_json(spark, path)
    rows = {r["id"]: r for r in again.collect()}
    assert set(rows) == {"n1", "n2", "n3", "new"} and rows["n1"]["type"] == "tool" and rows["n1"]["name"] is None
    assert more.count() == 3
    graphs.write_dot(again, more, str(tmp_path / "g.dot"))
    assert open(tmp_path / "g.dot").read().startswith("digraph G {")


def test_files(spark, tmp_path):
    (tmp_path / "_x.txt").write_text("under")
    (tmp_path / "a[1].md").write_bytes(b"\xef\xbb\xbfbom\r\nx")
    (tmp_path / ".hidden").write_text("no")
    (tmp_path / "LICENSE").write_bytes(b"bad \xff byte")
    (tmp_path / "pic.png").write_bytes(b"no")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "m.js").write_text("no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        for name in ("in/a.txt", "__MACOSX/b.txt", "in/.c.txt", "node_modules/d.txt"):
            archive.writestr(name, name)
    (tmp_path / "broken.zip").write_text("not a zip")
    rows = {r["filename"]: r for r in files.read_source(spark, str(tmp_path)).collect()}
    assert set(rows) == {"_x.txt", "a[1].md", "LICENSE"}
    assert rows["a[1].md"]["content"] == "﻿bom\r\nx" and rows["LICENSE"]["content"] == "bad � byte"
    assert {r["path"].rsplit("!", 1)[1] for r in files.read_source(spark, str(tmp_path / "z.zip")).collect()} == {"/in/a.txt", "/node_modules/d.txt"}
    assert files.read_source(spark, str(tmp_path / "broken.zip")).count() == 0
    tried = files.attempts(spark, [str(tmp_path / "broken.zip"), str(tmp_path / "gone.txt"), str(tmp_path / "_x.txt")]).collect()
    assert {r["filename"]: r["error"] is None for r in tried} == {"broken.zip": False, "gone.txt": False, "_x.txt": True}
    assert files.read_source(spark, str(tmp_path / "pic.png")).count() == 1
    found, failed = files.read_sources(spark, [str(tmp_path / "_x.txt"), "/no/such/file"])
    assert found.count() == 1 and [s for s, _ in failed] == ["/no/such/file"]


def test_extractors(spark):
    chunks = chunking.chunk(spark.createDataFrame([("a.txt", "Zephyr works with Quartz.\n\nQuartz is here to stay for the long run.", ".txt", 0)], "path string, content string, ext string, file_ord long"))
    ruled = extract.extractions(extract.RuleExtractor(), chunks).first()
    assert {e["name"] for e in ruled["entities"]} == {"Zephyr", "Quartz"} and ruled["relationships"][0]["from"] == "Zephyr"
    answer = '```json\nSure: {"entities": [{"name": "Q"}], "facts": ["f", {"a": 1}]}\n```'
    stored = chunks.select("content_hash", F.lit(answer).alias("answer"), F.lit(7).alias("usage_tokens"))
    replayed = extract.extractions(extract.ReplayExtractor(stored), chunks).first()
    assert replayed["entities"][0]["name"] == "Q" and replayed["facts"] == ["f", '{"a":1}'] and replayed["usage_tokens"] == 7
    asked = extract.extractions(extract.ModelExtractor(lambda system, user, limit: {"content": answer if "Zephyr" in user else "", "usage": 3}), chunks).first()
    assert asked["entities"][0]["name"] == "Q" and asked["error"] is None

    def fails(system, user, limit):
        raise OSError("down")

    failed = extract.extractions(extract.ModelExtractor(fails, retry=extract.Retry(2, 0, 0)), chunks).first()
    assert failed["error"] == "down" and failed["entities"] == []


def test_prescan_and_guide():
    assert extract.sample_positions(2) == [] and extract.sample_positions(3) == [0, 1, 2] and extract.sample_positions(100) == [0, 14, 28, 42, 56, 70, 84, 99]
    guide = extract.guide_text({"context": "c", "people": [{"name": "A", "role": "r"}, {"name": "B"}], "entities": [{"name": "E", "type": "t", "aliases": ["x"]}], "entity_groups": [{"parent": "P", "children": ["c1", "c2"]}]})
    assert guide == "CONTEXT: c\nKNOWN PEOPLE: A (r), B\nKNOWN ENTITIES: E (t) [also: x]\nENTITY GROUPS: P includes: c1, c2"
    assert extract.guide_text({}) is None
    assert extract.consolidation(lambda *a: {"content": "no json"}, ["a", "b", "c"]) == {"merges": [], "part_of": []}


def test_consolidation_sees_every_pair(spark):
    names = [f"N{i:04}" for i in range(2600)]
    groups = [{"N0001", "N1500", "N2599"}, {"N0002", "N0003"}, {"N1100", "N1101"}]
    asked = []

    def call(system, user, limit):
        here = user.split("\n")
        asked.append(here)
        both = [sorted(g & set(here), reverse=True) for g in groups]
        return {"content": json.dumps({"merges": [{"canonical": g[0], "aliases": g[1:]} for g in both if len(g) > 1], "part_of": [{"child": "N0001", "parent": "N2598"}] if {"N0001", "N2598"} <= set(here) else []})}

    found = extract.consolidate_all(call, names)
    assert max(map(len, asked)) <= 2000 and len(asked) == 3
    assert [{m["canonical"], *m["aliases"]} for m in sorted(found["merges"], key=lambda m: min(m["aliases"]))] == groups
    assert found["part_of"] == [{"child": "N0001", "parent": "N2598"}]
    asked.clear()
    names = ["Q" + "".join(chr(97 + i // 26**j % 26) for j in range(5)) for i in range(2400)]
    text = "\n\n".join(" ".join(names[i : i + 8]) for i in range(0, len(names), 8))
    ingest.ingest(spark, [], extract.RuleExtractor(), chunk_size=20, call=call, text=text, now="t")
    assert {n for here in asked for n in here} >= set(names[:2300])  # short paragraphs at the end share a chunk, of which eight names count


def test_ingest_is_guided(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.txt").write_text(f"Passage {i} tells of the lighthouse and its keeper.")
    asked = []

    def ask(answer):
        def call(system, user, limit):
            asked.append((system, user))
            if system == extract.PRESCAN:
                return {"content": answer}
            name = "Guided" if "KNOWN PEOPLE: Ada" in system else "Unguided"
            return {"content": json.dumps({"entities": [{"name": name, "type": "tool"}, {"name": "Lighthouse", "type": "place"}], "relationships": [{"from": name, "to": "Lighthouse", "type": "USES"}]})}

        done = ingest.ingest(spark, [str(tmp_path)], extract.ModelExtractor(call), now="t")
        return {r["name"] for r in done.nodes.filter("type = 'entity'").collect()}

    assert ask('{"people": [{"name": "Ada"}]}') == {"Guided", "Lighthouse"}
    assert [s for s, _ in asked] == [extract.PRESCAN] and all(f"Passage {i} " in asked[0][1] for i in range(4))
    assert ask("no json") == {"Unguided", "Lighthouse"}
    gaps = spark.createDataFrame([(0, i, f"t{i}") for i in (1, 4, 6)] + [(2, 5, "u")], "file_ord long, chunk_index int, text string")
    assert [tuple(r) for r in extract.prescan_sample(gaps).orderBy("position").collect()] == [(0, "t1"), (1, "t4"), (2, "t6"), (3, "u")]


def test_config(tmp_path):
    stored = tmp_path / "c.json"
    stored.write_text('{"provider": "groq", "chunkSize": 77}')
    got = config.resolve({"model": "m", "max_concurrent": "9x"}, {"LOOMGRAPH_BASE_URL": "u"}, str(stored))
    assert (got.provider, got.model, got.base_url, got.max_concurrent, got.chunk_size) == ("groq", "m", "u", 9, 77)


def test_ingest_twice(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    (source / "a.txt").write_text("Zephyr meets Quartz and Marble at the harbour every morning.\n\nZephyr likes Quartz, and Quartz likes Marble very much.")
    (source / "b.txt").write_text("Quartz and Zephyr and Marble agreed to build a lighthouse together.")
    first = ingest.ingest(spark, [str(source)], extract.RuleExtractor(), out, now="t")
    ids = {r["id"] for r in first.nodes.collect()}
    assert {"entity:quartz", "entity:zephyr", "entity:marble"} <= ids and first.estimate["chunks"] == 2
    assert first.nodes.agg(F.max("rank")).first()[0] == 1.0
    second = ingest.ingest(spark, [str(source)], extract.RuleExtractor(), out, now="t")
    assert second.estimate["chunks"] == 0 and {r["id"] for r in second.nodes.collect()} == ids
    assert incremental.State(f"{out}/processed").read(spark).count() == 2
    assert cli.main(["stats", out], spark) == 0 and cli.main(["search", out, "quartz"], spark) == 0


def test_unknown_attributes_and_nulls(spark, tmp_path):
    """Attributes without a column survive import, overlay and export; a null given outright wins over a value."""
    a = [{"id": "x", "name": "X", "summary": "old", "score": 1.5, "tags": ["a", {"b": None}]}, {"id": "y", "name": "Y", "odd": "3"}, {"id": "u", "summary": None}]
    b = [{"id": "x", "summary": None, "score": 2, "more": True}, {"id": "y", "odd": 3}, {"id": "u", "summary": "told"}]
    for name, found in (("a", a), ("b", b)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"nodes": found, "edges": []}))
    read = lambda name: graphs.read_json(spark, str(tmp_path / f"{name}.json"))
    written = lambda g, name: (graphs.write_json(*g, str(tmp_path / name)), {n["id"]: n for n in json.loads((tmp_path / name).read_text())["nodes"]})[1]
    assert written(read("a"), "again.json") == {n["id"]: n for n in a}
    both = written(graph.merge(read("a"), read("b")), "both.json")
    assert both == {n["id"]: n | m for n, m in zip(a, b, strict=True)}


def test_stored_versions(spark, tmp_path):
    """A version without its marker does not count, and an error in reading is no first run."""
    nodes, edges = small(spark)
    out = str(tmp_path / "g")
    assert not graphs.stored(spark, out)
    with pytest.raises(FileNotFoundError):
        graphs.read_tables(spark, out)
    graphs.write_tables(nodes, edges, out)
    graphs.write_tables(nodes.filter("id = 'n1'"), edges, out)
    assert graphs.read_tables(spark, out)[0].count() == 1
    (tmp_path / "g" / "v2" / "_COMPLETE").unlink()
    assert graphs.read_tables(spark, out)[0].count() == 3
    for n in (1, 2, 3):
        graphs.write_tables(nodes.limit(n), edges, out)
        assert graphs.read_tables(spark, out)[0].count() == n
    assert len([p for p in (tmp_path / "g").iterdir() if p.name.startswith("v")]) == 2


def test_json_output_is_built_upon(spark, tmp_path, capsys, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out" / "g.json")
    source.mkdir()
    (source / "a.txt").write_text("Zephyr meets Quartz and Marble at the harbour every morning.\n\nZephyr likes Quartz, and Quartz likes Marble very much.")
    assert cli.main(["ingest", str(source), "--rules", "--no-such-flag", "-o", out], spark) == 0
    first = json.loads(open(out).read())
    first["nodes"][0]["odd"] = [1]
    open(out, "w").write(json.dumps(first))
    (source / "b.txt").write_text("Quartz and Zephyr and Marble agreed to build a lighthouse together.")
    (source / "c.zip").write_text("no zip")
    capsys.readouterr()
    assert cli.main(["ingest", str(source), str(source / "c.zip"), "--rules", "-y", "--output", out], spark) == 0
    told = capsys.readouterr()
    assert "chunks 1," in told.out and "kept" in told.out and "skipped" in told.err and "c.zip" in told.err
    second = {n["id"]: n for n in json.loads(open(out).read())["nodes"]}
    assert {n["id"] for n in first["nodes"]} < set(second) and second[first["nodes"][0]["id"]]["odd"] == [1]
    before = open(out).read()
    (source / "d.txt").write_text("Something else.")
    monkeypatch.setattr("builtins.input", lambda text: "no")
    assert cli.main(["ingest", str(source), "--output", out], spark) == 0 and open(out).read() == before


def test_stream(spark, tmp_path):
    from loomgraph.streaming import ingest as stream

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for number, text in enumerate(["Zephyr and Quartz and Marble", "Quartz, Zephyr and Marble again"]):
        (source / f"{number}.txt").write_text(text)
        query = stream.start(stream.read(spark, str(source)), extract.RuleExtractor(), out, str(tmp_path / "checkpoint"))
        query.awaitTermination(120)
        query.stop()
    nodes, _ = graphs.read_tables(spark, out)
    assert nodes.filter("type = 'document'").count() == 2
    assert incremental.State(f"{out}/processed").read(spark).count() == 2
