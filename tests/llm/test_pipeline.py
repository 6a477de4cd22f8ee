"""The pipeline's stages against brute force on the smallest table, and on edge rows."""

from collections import Counter

import corpus_pipeline as C
from flightperf.llm import decontam, quality
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_components

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup",
                                        "benchmark_decontamination", "sentencepiece"]
    from flightperf.llm.common import documents, written
    docs = documents(spark, SF)
    columns = docs.columns
    outs = []
    for _, stage in C.STAGES:
        docs = written(stage(spark, docs, SF), "t")
        outs.append(docs)
    assert all(o.columns == columns for o in outs[:-1])
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(documents(spark, SF), labels)
    keep = {r["doc_id"] for r in quality.scores(documents(spark, SF), model).where("keep = 1").collect()}
    rows = [[(r["doc_id"], r["text"], r["source"]) for r in o.collect()] for o in outs[:-1]]
    assert {r[0] for r in rows[0]} == keep
    assert Counter((d, t) for d, t, _ in rows[1]) == brute_lines(rows[0], 0.08, 5)
    assert {r[0] for r in rows[2]} == {c for _, _, c in brute_components([r[:2] for r in rows[1]])}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontam.leaks(outs[2], bench).collect()}
    assert {r[0] for r in rows[3]} == {r[0] for r in rows[2]} - leaked
    texts = {r[0]: r[1] for r in rows[3]}
    last = outs[4].collect()
    assert {r["doc_id"]: r["decoded"] for r in last} == texts
    ran = C.run(spark, SF).select("doc_id", "n_ids").collect()
    assert Counter((r["doc_id"], r["n_ids"]) for r in last) == Counter(map(tuple, ran))


def test_stages_on_edge_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
        assert C.tokenize(spark, docs, SF).count() == docs.count()
