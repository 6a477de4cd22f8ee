import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from flightperf.llm import simhash as S


def brute_fp(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(rows, k=4):
    fps = [brute_fp(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= k:
                    label[i] = label[j] = min(label[i], label[j])
    groups = {}
    for i, g in enumerate(label):
        groups.setdefault(g, []).append(i)
    low = {g: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for g, m in groups.items()}
    return Counter((rows[i][0], f"{fps[i]:016x}", low[label[i]]) for i in range(len(rows)))


def test_fingerprint_is_the_contract_s():
    rng = random.Random(3)
    for n in (0, 1, 3, 4, 5, 40, 700):
        text = " ".join(rng.choice(["The", "CAT", "über", "x1", "mat."]) for _ in range(n))
        assert S.fingerprint(text.encode()) == brute_fp(text)


def test_majority_over_many_hashes():
    h = np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64)
    assert S.majority_bits(h) == sum(1 << b for b in range(64) if sum(int(x) >> b & 1 for x in h) * 2 > len(h))


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(6)):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))))
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for k in (0, 1, 3, 4):
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= k}
        got = [(r["a"], r["b"]) for r in S.links(nodes, k).collect()]
        assert len(got) == len(set(got)) and {frozenset(p) for p in got} == want


def test_long_lists_connect_by_midpoints(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = {base} | {base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 9))) for _ in range(60)}
    signed = sorted(int(np.uint64(f).astype(np.int64)) for f in fps)
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    for k in (3, 4):
        def groups(list_max):
            root = {f: f for f in signed}
            root |= {r["node"]: r["root"] for r in S.stars(S.links(nodes, k, list_max)).collect()}
            out = {}
            for f, r in root.items():
                out.setdefault(r, set()).add(f)
            return sorted(sorted(g) for g in out.values())
        assert groups(2) == groups(1 << 20)


def test_components_and_keep_one_on_edges(spark, edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    rows = [(r[0], r[1]) for r in EDGE_ROWS]
    got = Counter(map(tuple, S.components(edge_docs).collect()))
    assert got == brute_components(rows)
    assert S.components(no_docs).count() == 0 and S.keep_one(no_docs).count() == 0
    kept = S.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    want = {c for _, _, c in brute_components(rows)}
    ids = [r["doc_id"] for r in kept.collect()]
    assert set(ids) == want and len(ids) == len(set(ids))


def test_query_equals_brute_force_on_the_smallest_table(spark):
    from flightperf.llm.queries import op10_simhash
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"])
                  for r in op10_simhash(spark, "/root/testdata/sf0.001").collect())
    assert got == brute_components(rows)


def test_large_group_of_copies_is_one_component(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one text that all rows share with each other").alias("text"))
    assert S.components(docs).select("component_id").distinct().count() == 1
    assert [r["doc_id"] for r in S.keep_one(docs).collect()] == [0]


def test_keep_one_moves_texts_once(spark, edge_docs):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = S.keep_one(edge_docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = plan.splitlines()
    assert sum("Exchange" in ln for ln in moved) == 2          # the documents and the kept keys
