"""Character models against the plain definition; held-out accuracy; edge cases."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightperf.llm import languages as L
from flightperf.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
LETTERS = L._letters()
TEXTS = {"en": ["the cat sat on the mat", "the dog sat on the log, and the cat ran", "that thing there"],
         "fr": ["le chat est sur le tapis", "la nuit tombe sur la ville", "l'été à la plage"]}


def plain(text):
    """The text as the models read it."""
    out = ""
    for c in text:
        c = c.lower() if c.isalpha() else " "
        if c != " " or (out and out[-1] != " "):
            out += c
    return out


def kneser_ney(texts, order, alphabet):
    """c, h -> p(c | h), from dictionaries of counts."""
    pad = " " * (order - 1)
    counts = {order: Counter()}
    for t in map(plain, texts):
        s = pad + t
        counts[order].update(s[i - order + 1:i + 1] for i in range(order - 1, len(s)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    cut, total, kinds = {}, defaultdict(Counter), defaultdict(Counter)
    for n, table in counts.items():
        ones, twos = (sum(v == k for v in table.values()) for k in (1, 2))
        cut[n] = ones / (ones + 2 * twos) if ones and twos else 0.75
        for g, v in table.items():
            total[n][g[:-1]] += v
            kinds[n][g[:-1]] += 1

    def p(c, h, n=order):
        if n == 0:
            return 1 / (alphabet + 1)
        h = h[len(h) - n + 1:] if n > 1 else ""
        if not total[n][h]:
            return p(c, h, n - 1)
        return (max(counts[n][h + c] - cut[n], 0) + cut[n] * kinds[n][h] * p(c, h, n - 1)) / total[n][h]
    return p


def windows(texts, lang):
    codes, at, _ = L._sequence(texts, LETTERS)
    return [(lang, tuple(int(codes[a - i]) for i in range(L.ORDER - 1, -1, -1))) for a in at]


@pytest.fixture(scope="module")
def models():
    found = Counter(w for lang, texts in TEXTS.items() for w in windows(texts, lang))
    grams = sorted({g for _, g in found})
    counts = np.array([[found[lang, g] for lang in sorted(TEXTS)] for g in grams])
    return L.CharModels(sorted(TEXTS), np.array(grams, np.uint32), counts)


def test_probabilities_are_those_of_the_definition(models):
    assert models.order == L.ORDER
    alphabet = len({c for t in TEXTS.values() for x in t for c in plain(x)})
    tests = ["the mat", "The Cat, 12 on le tapis", "zzz the", "été", "a", "chat sat"]
    n, h = models.entropies(tests, LETTERS)
    for col, lang in enumerate(sorted(TEXTS)):
        p = kneser_ney(TEXTS[lang], L.ORDER, alphabet)
        for row, text in enumerate(tests):
            s = " " * (L.ORDER - 1) + plain(text)
            want = sum(-np.log(p(s[i], s[i - L.ORDER + 1:i])) for i in range(L.ORDER - 1, len(s)))
            assert n[row] == len(plain(text))
            assert h[row, col] == pytest.approx(want / n[row], abs=1e-5), (lang, text)


def test_long_texts_are_read_whole(models, monkeypatch):
    text = "the cat sat on the mat. " * 5000 + "la nuit tombe sur la ville " * 20000
    n, h = models.entropies([text, "", None, "123 !"], LETTERS)
    assert n.tolist() == [len(plain(text)), 0, 0, 0] and h[0, 1] < h[0, 0]
    monkeypatch.setattr(L, "SEGMENT", 1000)
    m, g = models.entropies([text], LETTERS)
    assert abs(g[0] - h[0]).max() < 0.05


@pytest.fixture(scope="module")
def answers(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    return QUERIES["op11_language_id"](spark, SF).join(docs, "doc_id").toPandas()


def test_held_out_accuracy(answers):
    held = answers[answers.held_out]
    assert len(answers) == 1000 and len(held) > 150
    for lang, of in held.groupby("lang"):
        assert (of.lang == of.lang_pred).mean() >= 0.97, lang
    assert set(answers.lang_pred) <= {"en", "de", "fr", "es"}
    assert answers.score.between(0, 1).all() and answers.rejected.mean() < 0.02


def test_foreign_letters_and_noise_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = L.train(docs)
    rng = np.random.default_rng(2)
    noise = ["".join(rng.permutation(list("etaoinshrdlucmfwypvbgkqjxz" * 8))) for _ in range(20)]
    noise += ["Съешь же ещё этих мягких французских булок да выпей чаю " * 4, "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏" * 5]
    rows = spark.createDataFrame(list(enumerate(noise)), "doc_id long, text string")
    got = L.identify(rows, known)
    assert got.where("rejected").count() >= 21


def test_labels_and_order_of_rows_play_no_part(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    first = L.identify(docs, L.train(docs, F.col("doc_id") % 2 == 0))
    other = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("xx")).repartition(7, "text")
    second = L.identify(other.withColumn("source", F.lit("s")), L.train(other, F.col("doc_id") % 2 == 0))
    a, b = (sorted(map(tuple, d.collect())) for d in (first, second))
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert max(abs(x[2] - y[2]) for x, y in zip(a, b)) < 1e-9


def test_every_passage_teaches_however_many_there_are(spark, monkeypatch):
    """1.5 million characters of a language; each text has a letter of its own."""
    texts = [chr(0x4E00 + i) + " " + "the cat sat on the mat " * 42 + str(i) for i in range(1500)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(L, "HELD", 50)      # equal windows are added up many times
    models = L.train(docs).models
    assert len(models.keys[0]) == len({c for c in plain("".join(texts))})


def test_order_does_not_depend_on_the_size(models, monkeypatch):
    tests = ["The cat, 12 on le tapis", "été zzz", "a"]
    n, h = models.entropies(tests, LETTERS)
    monkeypatch.setattr(L, "MAX_CELLS", 8)
    found = Counter(w for lang, texts in TEXTS.items() for w in windows(texts, lang))
    grams = sorted({g for _, g in found})
    again = L.CharModels(sorted(TEXTS), np.array(grams, np.uint32), np.array([[found[lang, g] for lang in sorted(TEXTS)] for g in grams]))
    assert again.order == L.ORDER
    m, g = again.entropies(tests, LETTERS)
    assert n.tolist() == m.tolist() and np.allclose(h, g, atol=1e-6)


def test_windows_of_large_and_small_alphabets():
    rng = np.random.default_rng(3)
    for size in (30, 9000):
        codes, at, _ = L._sequence(["".join(chr(0x4E00 + int(i)) for i in rng.integers(0, size, 20000))], LETTERS)
        marked = rng.random(len(at)) < .3
        grams, count, some = L._distinct_windows(codes, at, marked)
        want = Counter(tuple(int(codes[a - i]) for i in range(L.ORDER - 1, -1, -1)) for a in at)
        assert dict(zip(map(tuple, grams.astype(int).tolist()), count.tolist())) == want
        want = Counter(tuple(int(codes[a - i]) for i in range(L.ORDER - 1, -1, -1)) for a in at[marked])
        assert +Counter(dict(zip(map(tuple, grams.astype(int).tolist()), some.tolist()))) == want


def test_medians_and_fit_over_rows(spark, monkeypatch):
    """As numpy finds them from all rows at once."""
    monkeypatch.setattr(L, "BINS", 4)
    rng = np.random.default_rng(8)
    own, kind = rng.integers(0, 3, 600), rng.integers(0, 2, 600)
    e = np.where(own == 2, 1.5, rng.gamma(2.0, 1.0, 600).round(2))
    h = rng.gamma(2.0, 1.0, (600, 4))
    n = rng.integers(1, 900, 600)
    seen = spark.createDataFrame([(int(o), int(k), int(c), float(x), list(map(float, y))) for o, k, c, x, y in zip(own, kind, n, e, h)],
                                 L.ENTROPIES).repartition(3)
    got = L._medians(seen, 4)
    want = {i: np.median(e[(own == i) & (kind == 0)]) for i in range(3)}
    assert got == want
    centre = np.array([want.get(i, 0.0) for i in range(4)])
    assert L._medians(seen, 4, centre) == {i: np.median(np.abs(e - centre[own])[(own == i) & (kind == 0)]) for i in range(3)}
    known = L.Identifier(None, np.array([1.0, 2.0, 1.5, 2.0]), np.array([1.0, 0.5, 2.0, 1.0]))
    x, y = L._examples(known, own, kind, n, h)
    plain_fit = L.Logistic().fit(x, y, np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y))
    rows_fit = L.Logistic().fit_sums(L._summed(seen, known))
    assert np.allclose(plain_fit.coef, rows_fit.coef, atol=1e-6) and np.allclose(plain_fit.spread, rows_fit.spread)
    assert L.Logistic().fit_sums(L._summed(seen.where("false"), known)) is None


def test_edge_documents(spark, edge_docs, no_docs):
    known = L.train(edge_docs)
    got = L.identify(edge_docs, known)
    assert got.columns == ["doc_id", "lang_pred", "score", "rejected"]
    rows = got.collect()
    want = edge_docs.collect()
    assert len(rows) == len(want)
    assert sum(r.lang_pred == "und" for r in rows) == sum(not any(c.isalpha() for c in w.text or "") for w in want)
    assert {r.lang_pred for r in rows} <= {"en", "de", "und"} and all(0 <= r.score <= 1 for r in rows)
    assert L.identify(no_docs, known).collect() == []
    for nothing in (L.train(no_docs), L.train(edge_docs, F.lit(False)), L.train(edge_docs.where("doc_id = 4"))):
        assert {r.lang_pred for r in L.identify(edge_docs, nothing).collect()} == {"und"}


def test_one_language_and_very_many(spark, monkeypatch):
    one = spark.createDataFrame([(1, "only one language here", "en")], "doc_id long, text string, lang string")
    assert L.identify(one, L.train(one)).first().lang_pred == "en"
    monkeypatch.setattr(L, "MAX_CELLS", 3000)
    many = spark.createDataFrame([(i, chr(0x4E00 + 50 * i) * 5 + "".join(chr(0x4E00 + 50 * i + j % 40) for j in range(300)), f"l{i:03d}")
                                  for i in range(60)], "doc_id long, text string, lang string")
    got = L.identify(many, L.train(many)).join(many, "doc_id")
    assert got.where("lang = lang_pred").count() >= 55
