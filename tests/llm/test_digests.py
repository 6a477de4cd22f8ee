import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightperf.llm import digests as D
from flightperf.llm.queries import op5_fingerprints


def brute_entropy(raw):
    return [-sum(c / 64 * math.log2(c / 64) for c in Counter(raw[i:i + 64]).values()) for i in range(len(raw) - 63)]


@pytest.mark.parametrize("raw", [b"a" * 100, bytes(range(256)), b"hello world how are you " * 9,
                                 np.random.default_rng(4).integers(97, 102, 400).astype(np.uint8).tobytes()])
def test_rolling_entropy(raw):
    got = D.window_entropy(np.frombuffer(raw, np.uint8)) / D._UNIT
    assert np.allclose(got, brute_entropy(raw), atol=1e-4)


def brute_places(raw):
    bits = D.window_entropy(np.frombuffer(raw, np.uint8))
    ranks = D._RANKS[bits * D._LEVELS // (6 * D._UNIT)].tolist()
    votes = Counter()
    for s in range(len(ranks) - 63):
        run = ranks[s:s + 64]
        votes[s + run.index(min(run))] += 1
    return [p for p in sorted(votes) if votes[p] >= D.MIN_VOTES and ranks[p] < D.NEVER]


def test_places_and_pieces(monkeypatch):
    raw = " ".join(str(i * i) for i in range(900)).encode()
    want = brute_places(raw)
    assert D.feature_places(np.frombuffer(raw, np.uint8)).tolist() == want
    monkeypatch.setattr(D, "PIECE", 500)
    assert D.feature_places(np.frombuffer(raw, np.uint8)).tolist() == want


def test_edited_digest_is_that_of_the_edited_text():
    rng = np.random.default_rng(6)
    for n in (0, 3, 70, 200, 400, 3000):
        a = "".join(map(chr, rng.integers(97, 123, n)))
        b = "".join(map(chr, rng.integers(65, 91, 50)))
        k = len(a) // 4
        kept = a[:len(a) - k].encode()
        raw = kept + b[:k].encode()
        assert str(D.digest_after_edit(raw, len(kept), D.digest_of(a.encode())[1])) == str(D.digest_of(raw)[0])


def test_likeness():
    words = np.random.default_rng(8).integers(0, 400, 3000)
    text = " ".join(f"w{i}" for i in words).encode()
    other = " ".join(f"q{i}" for i in np.random.default_rng(9).integers(0, 400, 3000)).encode()
    own = D.digest_of(text)[0]
    assert D.likeness(own, D.digest_of(text)[0]) == 1.0
    assert D.likeness(own, D.digest_of(text[:9000] + b"changed here" + text[9000:])[0]) > 0.5
    assert D.likeness(own, D.digest_of(other)[0]) < 0.1
    empty = D.digest_of(b"")[0]
    assert D.likeness(empty, empty) == 1.0 and D.likeness(empty, own) == 0.0


def want_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out = []
    for i, (doc_id, text) in enumerate(rows):
        text, nxt = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[:len(text) - k] + nxt[:k]
        own, after, following = (D.digest_of(x.encode())[0] for x in (text, edited, nxt))
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(after),
                    D.likeness(own, after), D.likeness(own, following)))
    return Counter(out)


def test_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert Counter(map(tuple, op5_fingerprints(spark, "/root/testdata/sf0.001").collect())) == want_rows(rows)


def test_edges(spark, edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    assert Counter(map(tuple, D.digests(edge_docs).collect())) == want_rows([(r[0], r[1]) for r in EDGE_ROWS])
    assert D.digests(no_docs).count() == 0
    one = D.digests(edge_docs.where(F.col("doc_id") == 1)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
