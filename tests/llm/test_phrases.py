"""The FM-index against plain counting, and ranked phrases against a brute-force version."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightperf.llm import phrases as P

LOWER = {i: i + 32 for i in range(65, 91)}


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", text.translate(LOWER))]


def brute(rows, least, top, covered=80):
    """(lang, text) rows -> ranked rows, by counting every place."""
    count, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for ws in pieces(text or ""):
            n[lang] += len(ws)
            for k in range(1, 5):
                count[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in count.items():
        cand = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        kept = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= covered * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, b in cand.items() if b * 100 >= covered * a):
                continue
            score, _, l, r = min((2000000 * a // (f[g[:i]] + f[g[i:]]), i, f[g[:i]], f[g[i:]]) for i in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB .,\t\n\réZ", max_size=40), max_size=6))
def test_words_and_levels(texts):
    words, ids = P.encoded([t.encode() for t in texts])
    words = words.to_pylist()
    want = Counter()
    for t in texts:
        for ws in pieces(t):
            for k in range(1, 5):
                want.update(" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1))
    got = {}
    seen = None
    for level in P.levels(P.transform(ids), len(words), 4):
        names = [" ".join(words[w - 1] for w in g) for g in zip(*level.words)]
        got |= dict(zip(names, level.count.tolist()))
        if seen is not None:        # both parents are the phrase without its last and its first word
            assert [seen[i] for i in level.without_last] == [n.rsplit(" ", 1)[0] for n in names]
            assert [seen[i] for i in level.without_first] == [n.split(" ", 1)[1] for n in names]
        seen = names
    assert got == dict(want)


def test_extension_of_allowed_phrases_only():
    words, ids = P.encoded([b"a b c a b d a b c"])
    ok = {"a", "b", "c", "a b", "b c"}
    names = words.to_pylist()

    def allowed(level, k):
        return np.array([" ".join(names[w - 1] for w in g) in ok for g in zip(*level.words)])

    *_, last = P.levels(P.transform(ids), len(names), 3, allowed)
    assert [" ".join(names[w - 1] for w in g) for g in zip(*last.words)] == ["a b c"] and last.count.tolist() == [2]


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    vocab = ["the", "of", "New", "york", "city", "big", "apple", "émile", "zola", "a"]
    rows = []
    for i in range(150):
        ws = []
        for _ in range(int(rng.integers(0, 60))):
            ws += [["New york", "new York city", "big apple", "Émile zola", "of the", "a"][int(rng.integers(0, 6))]] \
                if rng.random() < .5 else [vocab[int(rng.integers(0, len(vocab)))]]
        rows.append(([None, "en", "fr"][i % 3], "".join(w + [" ", " ", "  ", "\t", ". ", "\n"][int(rng.integers(0, 6))] for w in ws)))
    return rows + [("en", None), (None, ""), ("de", " .,\n"), ("es", "solo")] + [("en", "copy of the same line. ") for _ in range(9)]


@pytest.mark.parametrize("shard_bytes,bits", [(300, 1 << 28), (1 << 20, 1 << 10)])
def test_ranked_phrases(spark, corpus, shard_bytes, bits):
    """Many small shards; and a filter of so few bits that it lets everything pass."""
    df = spark.createDataFrame([(i, t, g, 1, "x") for i, (g, t) in enumerate(corpus)],
                               "doc_id long, text string, lang string, score int, phrase string").repartition(5)
    found, totals = P.frequent_phrases(P.write_index(df, shard_bytes), least=5, most_bits=bits)
    got = P.ranked(found, totals, top=40)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(corpus, 5, 40)


def reported(spark, rows):
    """Shards, rows and phrases in them that are reported for two-word phrases, and their summed counts."""
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    index = P.write_index(df, 2000)
    found, _ = P.frequent_phrases(index, least=30, depth=1)
    filters, bits = [P.frequent_filter(found)], 1 << 20
    full = P.full_counters(index, filters, 2, 30, bits)
    parts = index.select("lang", "words", "bwt").mapInArrow(P._phrases(filters, full, 2, bits), P.COUNTS).cache()
    sums = parts.repartition("lang", "block").sortWithinPartitions("lang", "block").mapInArrow(
        P._summed(30), "lang string, phrase string, f long")
    return (index.count(), parts.count(), parts.agg(F.sum(F.size("phrases"))).first()[0] or 0,
            {(r.lang, r.phrase): r.f for r in sums.collect()})


def test_rows_of_a_shard_do_not_grow_with_its_frequent_phrases(spark, monkeypatch):
    """With more texts more phrases become frequent; a shard has as many rows as before."""
    monkeypatch.setattr(P, "HELD", 50)      # equal phrases are added up many times
    rng = np.random.default_rng(6)
    rows = [("en" if i % 3 else "fr", " ".join(f"w{int(x)}" for x in rng.integers(0, 30, 100))) for i in range(1500)]
    few, many = reported(spark, rows[:300]), reported(spark, rows)
    for (shards, made, phrases, sums), part in ((few, rows[:300]), (many, rows)):
        assert made <= shards * P.BLOCKS
        count = Counter((lang, " ".join(g)) for lang, t in part for ws in [t.split()] for g in zip(ws, ws[1:]))
        assert sums == {g: f for g, f in count.items() if f >= 30}
    assert many[2] > 10 * few[2] and many[2] > many[1]
    assert many[1] <= 6 * max(few[1], few[0] * P.BLOCKS)


def test_edge_documents(spark, edge_docs, no_docs):
    rows = [(r.lang, r.text) for r in edge_docs.collect()]
    got = P.collocations(edge_docs, least=2)
    assert sorted(map(tuple, got.collect())) == brute(rows, 2, 2000)
    assert P.collocations(no_docs).collect() == []


def test_counts_beyond_64_bits(spark):
    big = 4_000_000_000_000_000_000
    found = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 1), ("en", "a b", 2, big - 1)],
                                  "lang string, phrase string, k int, f long")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, n long")
    r = P.ranked(found, totals).first()
    assert r.score == 2000000 * (big - 1) // (2 * big + 1) and (r.l, r.r) == (big, big + 1)


def test_one_long_piece(spark):
    text = "alpha beta gamma " * 60_000
    df = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = P.collocations(df).where(F.col("phrase") == "alpha beta gamma alpha").first()
    assert (got.a, got.l, got.r, got.n) == (59_999, 60_000, 60_000, 180_000)     # the last cut is the lowest
