"""The five stages, each on all that the one before kept, against brute force."""

import corpus_pipeline
from loomgraph.llm import quality
from tests.llm import brute
from tests.llm.test_operators import corpus


def test_stages(spark, tmp_path):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus(21, 90)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(7, " ".join((rows[40][1] or "").split()[3:18])), (8, " ".join((rows[51][1] or "").split()[:12]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    have = [(i, t) for i, t, *_ in rows]
    for (name, stage), n in zip(corpus_pipeline.STAGES, range(5), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name == "quality rules":
            kept = quality.judge(quality.train_rules(source, labels), [t or "" for _, t in have])["kept"]
            have = [d for d, k in zip(have, kept, strict=True) if k]
        elif name == "line dedup":
            left = brute.line_dedupe(have)
            have = [(i, x) for (i, t), x in zip(have, left, strict=True) if brute.words(x) or not brute.words(t)]
        elif name == "n-gram Jaccard join":
            group = brute.jaccard(have, 5, 80)
            have = [(i, t) for i, t in have if group[i][1] == i]
        elif name == "benchmark decontamination":
            hit = brute.decontaminate(have, items)
            have = [(i, t) for i, t in have if not hit[i][1]]
        if n < 4:
            assert docs.columns == source.columns
            assert sorted((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()) == sorted((i, t, len(t)) for i, t in have), name
    assert have and {r["doc_id"] for r in docs.collect()} == {i for i, _ in have}
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(have)
