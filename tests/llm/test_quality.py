import numpy as np
import pytest
from pyspark.sql import functions as F

from flightperf.llm import quality as Q
from flightperf.llm.linear import Logistic, sigmoid
from flightperf.llm.queries import op1_quality

SF = "/root/testdata/sf0.1"


def test_logistic_finds_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 9]
    y = (x[:, 0] + 0.2 * x[:, 1] > 0.6).astype(float)
    m = Logistic(1.0).fit(x, y)
    z = m._z(x)

    def loss(c):
        p = np.clip(sigmoid(z @ c), 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.5 * (c[1:] ** 2).sum()
    best = loss(m.coef)
    assert all(loss(m.coef + d) >= best for d in 0.01 * rng.normal(size=(50, 4)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    model = Q.train(docs, labels.where(~held))
    assert model.added and all(n > 0 for n in model.added[0][1:])     # the text view teaches the metadata view
    got = {r["doc_id"]: r for r in Q.scores(docs, model).join(labels.where(held).select("doc_id", "quality"), "doc_id").collect()}
    right = np.mean([r["keep"] == r["quality"] for r in got.values()])
    good = [r["keep"] for r in got.values() if r["quality"] == 1]
    bad = [r["keep"] for r in got.values() if r["quality"] == 0]
    assert right > 0.97 and np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_views_exchange_labels():
    """A view without labels of its own signal learns from the other through the pool."""
    rng = np.random.default_rng(1)
    n_meta = Q.LANG_BUCKETS + Q.SOURCE_BUCKETS + 5

    def rows(n, label):
        y = rng.integers(0, 2, n)
        text = np.column_stack([y * 4 - 2 + rng.normal(size=n), rng.normal(size=n)])
        meta = rng.normal(size=(n, n_meta))
        meta[:, 0] += 3 * y
        return np.column_stack([text, meta, y if label else np.full(n, -1)]), y
    few, _ = rows(60, True)
    pool, _ = rows(2000, False)
    test, y = rows(1000, True)
    text, meta = Q.CoTrained._split(test)
    alone = Q.CoTrained(few, pool[:0])
    both = Q.CoTrained(few, pool)
    assert sum(both.added[0]) > 200
    assert np.mean((both.score(text, meta)[2] > 0.5) == y) >= np.mean((alone.score(text, meta)[2] > 0.5) == y)


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 0, None), (7, 1, 0), (7, None, 0), (None, 0, 0), (99, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = Q.train(edge_docs, labels)
    rows = Q.scores(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    kept = Q.keep_good(edge_docs, model)
    assert kept.columns == edge_docs.columns and kept.count() == sum(r["keep"] for r in rows)
    assert Q.scores(no_docs, model).count() == 0 and Q.keep_good(no_docs, model).count() == 0


@pytest.mark.parametrize("only", ["false", "quality = 1"])
def test_without_both_classes_all_stay(spark, edge_docs, only):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").where(only)
    model = Q.train(edge_docs, labels)
    assert Q.keep_good(edge_docs, model).count() == edge_docs.count()
    assert Q.train(edge_docs.where("false"), labels).usable is False


def test_query_scores_every_document(spark):
    rows = op1_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
