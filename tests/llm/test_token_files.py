import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flightperf.llm import token_files as T
from flightperf.llm.queries import op9_token_files, tokenizer_path
from flightperf.session import scratch_path

WORD_BPE = tokenizer_path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), max_size=300), max_size=8),
       st.sampled_from([32, 64, 1024]), st.sampled_from([1, 50, 90, 100]))
def test_segment_round_trip(docs, block, percentile):
    ids = np.array([i for d in docs for i in d], dtype=np.uint32)
    seg = T.Segment.parse(T.pack_segment(ids, np.array([len(d) for d in docs]), block, percentile))
    assert np.array_equal(seg.ids(), ids) and seg.doc_len.tolist() == [len(d) for d in docs]
    for a, b in ((0, 1), (len(ids) // 3, len(ids) // 2), (len(ids) - 1, len(ids) + 9)):
        if a >= 0:
            assert np.array_equal(seg.ids(a, b), ids[a:b])


def test_outliers_are_exceptions_and_save_bits():
    ids = np.full(4096, 7, dtype=np.uint32) + np.arange(4096, dtype=np.uint32) % 16
    ids[::100] = 4_000_000_000
    seg = T.Segment.parse(T.pack_segment(ids, np.array([4096])))
    assert set(seg.width.tolist()) == {4} and len(seg.ex_at) == 41 and np.array_equal(seg.ids(), ids)


def test_a_broken_segment_is_refused():
    with pytest.raises(ValueError):
        T.Segment.parse(b"\0" * 64)


def plain_ids(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(WORD_BPE)
    return [[*t.encode(x or "", add_special_tokens=False).ids, 1] for x in texts]


def test_word_by_word_equals_the_whole_text():
    spec = open(WORD_BPE, encoding="utf-8").read()
    assert T.splits_at_space(spec)
    encode = T.encoder(spec)
    for x in ["", "  a  b\tc\n", "Don't STOP, it's 12.5%!", "Größe ΑΣ ΣΑΣ. İstanbul", "é ́x àb", "a b c\x85d\x1ce",
              "<|startoftext|> x<|endoftext|>y", "<|STARTOFTEXT|> Ab", "The, end. x.. a., é. ,. .", "it's, I'M. rock'n'roll", "\U0001F600\U0001F601 ok", "漢字 かな", "x\x00y", "ﬁ K ſ"]:
        assert np.frombuffer(encode(x.encode()), "<u4").tolist() == plain_ids([x])[0][:-1], x


def want_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    out, at = [], 0
    for (doc_id, _), ids in zip(rows, plain_ids([t for _, t in rows])):
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def as_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query_equals_plain_encoding(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert as_rows(op9_token_files(spark, "/root/testdata/sf0.001")) == want_rows(rows)


def test_edges_and_small_segments(spark, edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    path = scratch_path(spark, "t")
    T.write_token_files(edge_docs, path, WORD_BPE, 1, block=32, segment_ids=40)
    assert as_rows(T.read_digests(spark, path)) == want_rows([(r[0], r[1]) for r in EDGE_ROWS])
    whole = {r["start"]: r["ids"] for r in T.read_token_files(spark, path).collect()}
    assert [len(whole[s]) for _, s, _, _ in want_rows([(r[0], r[1]) for r in EDGE_ROWS])] == [
        n for _, _, n, _ in want_rows([(r[0], r[1]) for r in EDGE_ROWS])]
    path = scratch_path(spark, "t")
    T.write_token_files(no_docs, path, WORD_BPE, 1)
    assert T.read_digests(spark, path).count() == 0
