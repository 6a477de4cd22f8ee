import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flightperf.plans.cover import cover_segments, date_cover, direct_range, union_segments
from flightperf.plans.warehouse import Warehouse
from flightperf.sources.fixtures import flights

from tests.paths import SF001

dates = st.dates(min_value=dt.date(1985, 1, 1), max_value=dt.date(2016, 12, 31))


def _check(start, end):
    segs = date_cover(start, end)
    if start >= end:
        assert segs == []
        return
    assert segs[0][1] == start and segs[-1][2] == end
    for (_, _, e1), (_, s2, _) in zip(segs, segs[1:]):
        assert e1 == s2                       # contiguous
    for kind, s, e in segs:
        assert s < e
        if kind == "month":
            assert s.day == 1 and e.day == 1
        if kind == "year":
            assert (s.month, s.day) == (1, 1) and (e.month, e.day) == (1, 1)


@settings(max_examples=3000, deadline=None)
@given(dates, dates)
def test_cover_contiguous_and_exact(a, b):
    _check(a, b)


def test_cover_known_cases():
    d = dt.date
    # late December: no whole month inside
    assert date_cover(d(2013, 12, 15), d(2014, 1, 15)) == [("day", d(2013, 12, 15), d(2014, 1, 15))]
    # November start
    assert date_cover(d(1995, 11, 5), d(1996, 2, 3)) == [
        ("day", d(1995, 11, 5), d(1995, 12, 1)), ("month", d(1995, 12, 1), d(1996, 2, 1)),
        ("day", d(1996, 2, 1), d(1996, 2, 3))]
    # several years
    assert date_cover(d(1996, 3, 15), d(1999, 11, 20)) == [
        ("day", d(1996, 3, 15), d(1996, 4, 1)), ("month", d(1996, 4, 1), d(1997, 1, 1)),
        ("year", d(1997, 1, 1), d(1999, 1, 1)), ("month", d(1999, 1, 1), d(1999, 11, 1)),
        ("day", d(1999, 11, 1), d(1999, 11, 20))]
    assert date_cover(d(2000, 1, 1), d(2002, 1, 1)) == [("year", d(2000, 1, 1), d(2002, 1, 1))]


def test_column_cover_equals_python_cover(spark):
    rnd = random.Random(7)
    base = dt.date(1990, 1, 1)
    pairs = []
    for _ in range(400):
        a = base + dt.timedelta(days=rnd.randint(0, 9000))
        b = a + dt.timedelta(days=rnd.randint(1, 2000))
        pairs.append((a, b))
    for m in (11, 12):  # November / December starts
        pairs.append((dt.date(1999, m, 5), dt.date(2001, 2, 3)))
    df = spark.createDataFrame(pairs, "s date, e date")
    got = {}
    for r in df.select("s", "e", F.inline(cover_segments(F.col("s"), F.col("e")))).collect():
        got.setdefault((r.s, r.e), []).append((r.seg_ord, r.grain, r.seg_start, r.seg_end))
    for a, b in pairs:
        want = date_cover(a, b)
        have = [(g, s, e) for _, g, s, e in sorted(got.get((a, b), []))]
        assert have == want, (a, b)


def test_union_segments_equals_direct_scan(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    rnd = random.Random(11)
    ranges = [(dt.date(1995, 11, 5), dt.date(1996, 2, 3)), (dt.date(1996, 12, 5), dt.date(1998, 1, 20)),
              (dt.date(1995, 1, 1), dt.date(2002, 1, 1))]
    for _ in range(4):
        a = dt.date(1995, 1, 1) + dt.timedelta(days=rnd.randint(0, 2400))
        ranges.append((a, a + dt.timedelta(days=rnd.randint(1, 1500))))
    for a, b in ranges:
        u = sorted(tuple(r) for r in union_segments(wh, a, b, "carrier").collect())
        d = sorted(tuple(r) for r in direct_range(wh, a, b, "carrier").collect())
        assert u == d, (a, b)
    a, b = dt.date(1996, 3, 15), dt.date(1999, 11, 20)
    u = sorted(tuple(r) for r in union_segments(wh, a, b, "flight").collect())
    d = sorted(tuple(r) for r in direct_range(wh, a, b, "flight").collect())
    assert u == d
