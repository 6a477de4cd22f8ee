"""Blocks, bounds and mined rows, against every pair of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flightperf.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, score double, rank string"


def brute(rows, step=100, positives=5, negatives=10):
    """(vec_id, vector, label) rows of one length -> mined rows, with Python integers."""
    q = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows]
    out = []
    for i, a, y in q:
        if i % step:
            continue
        scored = [(sum(x * z for x, z in zip(a, b)), j, l) for j, b, l in q if j != i and len(a) == len(b)]
        best = sorted(((-s, j) for s, j, l in scored if l == y))[:positives]
        for s, j in best:
            p = -s
            fit = sorted((-n, k) for n, k, l in scored if l != y and 30 * p <= 100 * n <= 90 * p)[:negatives]
            out += [(i, j, r, k, p, -n) for r, (n, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], SCHEMA)
    got = H.mine(df, **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def vectors(n, dim, seed, centres=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) / np.sqrt(dim)
    if centres:
        x = 0.2 * x + rng.normal(size=(centres, dim))[rng.integers(0, centres, n)]
    return [(int(i), x[i].tolist(), int(rng.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("centres", [0, 6])
def test_mined_rows_are_those_of_every_pair(spark, monkeypatch, centres):
    monkeypatch.setattr(H, "BLOCK_ROWS", 16)
    monkeypatch.setattr(H, "PART_ROWS", 100)
    monkeypatch.setattr(H, "ANCHORS", 17)          # several groups
    rows = vectors(700, 8, 3, centres)
    assert mined(spark, rows, step=20) == brute(rows, step=20)


def test_ties_and_repeated_rows(spark):
    rows = [(i, [0.5, 0.25 * (i % 3)], i % 2) for i in range(60)]
    assert mined(spark, rows, step=10) == brute(rows, step=10)
    twice = rows + rows[:7] + [rows[20]] * 3
    got, want = mined(spark, twice, step=10), brute(twice, step=10)
    assert [r[:1] + r[2:] for r in got] == [r[:1] + r[2:] for r in want]


def test_rows_that_take_no_part(spark):
    rows = vectors(80, 4, 1)
    odd = [(100, None, 1), (200, [1.0, None, 0.0, 0.0], 1), (300, [float("nan")] * 4, 1), (400, [1.0, float("inf"), 0.0, 0.0], 2),
           (500, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1), (600, [], 1), (601, [], 2), (700, [0.5] * 3, 1)]
    assert mined(spark, rows + odd, step=10) == brute(rows, step=10)


def test_wide_values_are_exact(spark):
    rows = [(i, [2.0 ** 30 + i * 3.0, float(i % 5)], i % 3) for i in range(40)]
    rows = [(i, [v[0] / 2 ** 8, v[1]], y) for i, v, y in rows]
    assert mined(spark, rows, step=10, least=30, most=100) == [
        r for r in sorted(_brute_to(rows, 100))]
    huge = [(i, [1e300, 0.0], i % 2) for i in range(20)]
    assert mined(spark, huge, step=10, most=100)            # beyond 64 bits: the greatest integer, no crash


def _brute_to(rows, most):
    q = [(i, [int(np.floor(256 * x)) for x in v], y) for i, v, y in rows]
    for i, a, y in q:
        if i % 10:
            continue
        s = [(sum(x * z for x, z in zip(a, b)), j, l) for j, b, l in q if j != i]
        for m, j in sorted((-n, j) for n, j, l in s if l == y)[:5]:
            fit = sorted((-n, k) for n, k, l in s if l != y and 30 * -m <= 100 * n <= most * -m)[:10]
            for r, (n, k) in enumerate(fit, 1):
                yield (i, j, r, k, -m, -n)


def test_empty_and_lonely(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []


def test_bounds_hold_and_clusters_are_skipped(spark):
    rng = np.random.default_rng(0)
    box, a = rng.integers(-99, 99, (50, 6)).astype(float), rng.integers(-99, 99, (20, 6)).astype(float)
    least, most = H.bounds(a, box.min(0), box.max(0))
    s = H.products(a, box)
    assert (least <= s.min(1)).all() and (s.max(1) <= most).all()
    rows = vectors(4000, 4, 5, centres=12)
    df = spark.createDataFrame([(i, v, y) for i, v, y in rows], "row_id long, vec array<double>, label long")
    blocks = H.write_blocks(df.select("row_id", "label", "vec"))
    assert blocks.agg(F.sum("n")).first()[0] == 4000
    anchor = np.floor(256 * np.array([rows[0][1]]))
    group = H.Group(4, np.array([0]), np.array([0]), np.array([rows[0][2]]), anchor,
                    np.array([[float((anchor * anchor).sum()) * 0.9]]), np.array([[np.inf]]), False, 10)
    monkey = [group.needed(np.array(r.lo), np.array(r.hi), np.array(r.labels)).any() for r in blocks.collect()]
    assert len(monkey) >= 4


def test_curve_is_a_bijection_with_unit_steps():
    side = 8
    cells = np.array([[x, y] for x in range(side) for y in range(side)])
    keys = [int.from_bytes(k.tobytes(), "big") >> 2 for k in H.curve_keys(cells, 3)]
    assert sorted(keys) == list(range(side * side))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
