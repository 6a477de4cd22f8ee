"""Reports served from a written warehouse (read through the date cover, pruned by year)
equal the same reports summed directly from the flights."""

import datetime as dt

import pytest

from flightperf.plans import reports as Q
from flightperf.plans.warehouse import Warehouse, build_all
from flightperf.sources.fixtures import flights

from tests.paths import SF01

RANGES = [(dt.date(1996, 3, 15), dt.date(1999, 11, 20)), (dt.date(1995, 11, 5), dt.date(1996, 2, 3)),
          (dt.date(1995, 12, 15), dt.date(1996, 1, 15)), (dt.date(1995, 1, 1), dt.date(2002, 1, 1))]


@pytest.fixture(scope="module")
def both(spark):
    f = flights(spark, SF01)
    return Warehouse.from_flights(f), build_all(f)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rng", RANGES)
def test_range_reports_equal(both, rng):
    lazy, built = both
    assert built.materialized and not lazy.materialized
    assert _rows(Q.delay_category(built, None, *rng)) == _rows(Q.delay_category(lazy, None, *rng))
    assert _rows(Q.flight_delay(built, None, None, *rng)) == _rows(Q.flight_delay(lazy, None, None, *rng))
    assert _rows(Q.airline_delays(built, *rng)) == _rows(Q.airline_delays(lazy, *rng))


def test_inclusive_end_adds_the_last_day(both):
    lazy, _ = both
    a = Q.delay_category(lazy, "AA", dt.date(1996, 3, 15), dt.date(1996, 3, 20), inclusive_end=True)
    b = Q.delay_category(lazy, "AA", dt.date(1996, 3, 15), dt.date(1996, 3, 21))
    assert _rows(a) == _rows(b)


def test_other_reports_equal(both):
    lazy, built = both
    for fn in (lambda w: Q.season_delay(w, None, None, 1997),
               lambda w: Q.season_delay(w, "AA", "2", 1997, labels="as_observed"),
               lambda w: Q.delay_holiday(w, None, None),
               lambda w: Q.delay_holiday(w, "AA", "Thanksgiving", (1995, 2001))):
        assert _rows(fn(built)) == _rows(fn(lazy))


def test_thanksgiving_in_holiday_report(both):
    lazy, _ = both
    rows = Q.delay_holiday(lazy, None, "Thanksgiving").collect()
    assert rows and {r.holiday for r in rows} == {"Thanksgiving"}
    assert all(0.0 <= r.ratio_baseline for r in rows)
