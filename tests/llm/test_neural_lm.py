import math
import zlib
from collections import Counter

import numpy as np
import pytest

from flightperf.llm import neural_lm as L
from flightperf.llm.queries import op6_language_model


def base_rows(rows):
    """The contract's counts and base score."""
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    c = Counter()
    for i, t in rows:
        if train(i):
            c.update((t or "").encode().lower().split())
            c[b""] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        tokens = (t or "").encode().lower().split() + [b""]
        out.append((i, not train(i), len(tokens), sum(c[w] > 0 for w in tokens), n,
                    sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    return out


def check_base(got, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    want = sorted(base_rows(rows), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)


@pytest.fixture(scope="module")
def scored(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return docs, op6_language_model(spark, sf).collect()


def test_counts_and_base_score(scored):
    check_base(scored[1], scored[0])


def test_the_model_beats_the_base_on_held_out_documents(scored):
    held = [r for r in scored[1] if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held) and all(r["score"] < 0 for r in scored[1])


def vocab_of(texts):
    c = Counter()
    for t in texts:
        c.update(t.lower().split())
        c[b""] += 1
    tails = {}
    for w, k in c.items():
        if w:
            a, b = tails.get(zlib.crc32(w[-2:]) % L.HASHED, (0, 0))
            tails[zlib.crc32(w[-2:]) % L.HASHED] = (a + k, b + (k == 1))
    return c, L.Vocabulary(sum(c.values()), len(c), sorted(c.items(), key=lambda x: (-x[1], x[0])), tails)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(4)
    words = [b"w%d" % i for i in range(700)]
    texts = [b" ".join(rng.choice(words, 80, p=np.arange(700, 0, -1) / 245350)) for _ in range(30)]
    counts, vocab = vocab_of(texts)
    model = L.LogBilinear(vocab.noise)
    h = np.array([0, 3, 460], dtype=np.int32)
    p = np.exp(model.vectors(h, h) @ model.target.T + model.bias - model.log_sums(h, h)[:, None])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # inside each hashed class: its seen words and its unseen event
    share = Counter()
    for w, i in vocab.index.items():
        share[int(vocab.klass[i])] += 10 ** vocab.share[i]
    for k, s in share.items():
        assert s + (10 ** vocab.unseen[k] if k > L.FREQUENT else 0) == pytest.approx(1, abs=1e-6)


def test_training_learns_a_context():
    """Words that follow each other in turn become likely after each other."""
    texts = [b" ".join([b"aa", b"bb", b"cc", b"dd"] * 50) for _ in range(200)]
    _, vocab = vocab_of(texts)
    model = L.LogBilinear(vocab.noise)
    held, rng = model.learner(), np.random.default_rng(0)
    h1, h2, w = L._contexts([L.classes_of(t.split(), vocab)[1] for t in texts])

    def mean():
        return float(np.mean(np.einsum("ij,ij->i", model.vectors(h1, h2), model.target[w]) + model.bias[w] - model.log_sums(h1, h2)))
    before = mean()
    for _ in range(10):
        for at in range(0, len(w), 2048):
            model.learn(h1[at:at + 2048], h2[at:at + 2048], w[at:at + 2048], held, rng)
    assert mean() > before + 0.5


def test_rare_words_meet_their_counts_in_the_join(spark, monkeypatch):
    monkeypatch.setattr(L, "COUNTED", 500)
    from tests.llm.test_neural_lm import check_base as check
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op6_language_model(spark, sf).collect(), docs)


def test_the_end_token_is_counted_when_it_is_rare(spark, table, monkeypatch):
    """One long text with more distinct words than COUNTED: its end token is as rare as its words."""
    from flightperf.llm.common import fold_column
    monkeypatch.setattr(L, "COUNTED", 500)
    for often in (1, 3):
        rows = [(1, " ".join(f"w{i}" for i in range(600) for _ in range(often))), (6, "w1 w2 nothing"), (6, None)]   # 6 is held out
        docs = table([(i, t, "en", "a", 1) for i, t in rows])
        got = L.scores(docs, L.learning_fold()).withColumn("held_out", fold_column("doc_id", 10) == 0).collect()
        check_base(got, rows)


def test_edges(spark, edge_docs, no_docs):
    from pyspark.sql import functions as F
    from flightperf.llm.common import fold_column
    from tests.llm.rows import EDGE_ROWS
    got = L.scores(edge_docs, L.learning_fold()).withColumn("held_out", fold_column("doc_id", 10) == 0).collect()
    check_base(got, [(r[0], r[1]) for r in EDGE_ROWS])
    assert L.scores(no_docs).count() == 0
    untaught = L.scores(edge_docs, F.lit(False)).collect()
    assert len(untaught) == len(EDGE_ROWS) and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in untaught)
