import random

import pytest

from flightperf.llm import pieces as P
from flightperf.llm.queries import op2_sentencepiece, tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.PieceModel(open(MODEL, "rb").read())


def brute_best(model, word):
    """Best score over all segmentations, by plain dynamic programming over all substrings."""
    score = {p: s for p, (_, _, s) in ((k, model.auto.get(k)) for k in model.auto.keys())}
    best = [0.0] + [float("-inf")] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - 20), e):
            piece = word[s:e]
            if piece in score:
                best[e] = max(best[e], best[s] + score[piece])
            elif e - s == 1:
                best[e] = max(best[e], best[s] + model.unknown_score)
    return best[-1]


def test_scores_are_the_best(model):
    rng = random.Random(2)
    for _ in range(200):
        word = "".join(rng.choice("▁theanion ☃Zq\n") for _ in range(rng.randrange(1, 14))).replace(" ", "▁")
        assert model.best(word)[1] == pytest.approx(brute_best(model, word))


def test_cut_texts_score_like_whole_ones(model):
    for text in ["a b  c   d", "  lead and trail  ", "x", " ", "one ☃☃ two \n three", "tab\there"]:
        ids = memoryview(model.encode(text)).cast("i").tolist() if text else []
        assert model.score(ids) == pytest.approx(brute_best(model, model.normalize(text)))
        assert model.decode(ids) == text


def test_ids_equal_the_library_s_unigram_search(model):
    """The same pieces and scores, declared a unigram model, give the library's own Viterbi ids."""
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL, "rb").read())
    proto.trainer_spec.model_type = 1
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["Hello world", "  two  spaces ", "naïve café 42", "x☃y", "The quick brown fox"]:
        ids = model.encode(text)
        got = memoryview(ids).cast("i").tolist()
        assert model.decode(got) == lib.decode(lib.encode(text))
        total = sum(lib.get_score(i) if not lib.is_byte(i) else 0 for i in got)
        want = sum(lib.get_score(i) if not lib.is_byte(i) else 0 for i in lib.encode(text))
        assert total == want


def test_round_trip_of_the_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op2_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["decoded"] == texts[r["doc_id"]] and r["n_ids"] == len(r["ids"])


def test_edges(edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    rows = P.encode_and_decode(edge_docs, MODEL).collect()
    assert sorted(r["decoded"] for r in rows) == sorted((r[1] or "") for r in EDGE_ROWS)
    assert all(r["n_ids"] == 0 and r["score"] == 0 for r in rows if not r["decoded"])
    assert P.encode_and_decode(no_docs, MODEL).count() == 0


def test_a_task_needs_one_python_worker(edge_docs):
    """Encoding and decoding share a worker and its model; the rows are those of the two steps."""
    keys = ("doc_id", "lang", "source")
    rows = P.encode_and_decode(edge_docs, MODEL, keys)
    steps = P.decode(P.encode(edge_docs, MODEL, keys), MODEL)
    assert rows._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert rows.schema == steps.schema
    assert sorted(map(repr, rows.collect())) == sorted(map(repr, steps.collect()))


def test_long_word_is_solved_whole(model):
    word = "antidisestablishment" * 500
    ids = memoryview(model.encode(word)).cast("i").tolist()
    assert model.decode(ids) == word
    assert model.score(ids) == pytest.approx(brute_best(model, "▁" + word))
