"""Deliveries added to a written warehouse: same tables as a full build, history not read, and no
build published whose grains don't hold the same flights."""

import pathlib

import pytest

from flightperf.operators import rollups as R
from flightperf.plans import reports as Q
from flightperf.plans import warehouse as W
from flightperf.plans.queries import RANGE1, dirty_flights
from flightperf.plans.warehouse import BUILD_ORDER, BuildMismatch, Warehouse, add_flights, build_all
from flightperf.session import scratch_path
from flightperf.sources.fixtures import flights

from tests.paths import SF001

Q3_1997 = "year < 1997 OR (year = 1997 AND quarter < 3)"


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def whole(spark):
    return build_all(dirty_flights(spark, SF001))


@pytest.fixture(scope="module")
def grown(spark):
    """A first build, the rest of 1997 added, then everything later."""
    f = dirty_flights(spark, SF001)
    home = scratch_path(spark, "grown")
    build_all(f.where(Q3_1997), home)
    add_flights(f.where(f"NOT ({Q3_1997}) AND year = 1997"), home)
    return add_flights(f.where("year > 1997"), home), home


def test_tables_equal_those_of_a_full_build(grown, whole):
    for grain in BUILD_ORDER:
        cols = whole.grain(grain).columns
        assert sorted(cols) == sorted(grown[0].grain(grain).columns)
        assert _rows(grown[0].grain(grain).select(*cols)) == _rows(whole.grain(grain)), grain
    for name in R.TABLES:
        assert _rows(grown[0].table(name)) == _rows(whole.table(name)), name


def test_reports_equal_those_of_a_full_build(grown, whole):
    for report in (lambda w: Q.delay_category(w, None, *RANGE1), lambda w: Q.season_delay(w, None, None, 1997),
                   lambda w: Q.delay_holiday(w, None, None, None)):
        assert _rows(report(grown[0])) == _rows(report(whole))


def _years(spark, path):
    return {r.year for r in spark.read.parquet(path).select("year").distinct().collect()}


def test_a_build_holds_only_the_years_of_its_delivery(spark, grown):
    wh, home = grown
    assert len(W._builds(spark, home)) == 3
    for grain in ("flight_date", "year_month", "year"):
        years = _years(spark, f"{wh.path}/{grain}")
        assert years and all(y is None or y > 1997 for y in years), grain


def test_old_years_are_not_opened(spark, tmp_path):
    """With every written file of the years before 1998 spoilt, a delivery of 1998 still comes in."""
    f = flights(spark, SF001)
    home = str(tmp_path / "wh")
    first = build_all(f.where("year <= 1998 AND NOT (year = 1998 AND quarter = 4)"), home)
    spoilt = 0
    for old in pathlib.Path(first.path).glob("*/year=199[0-7]/*.parquet"):
        old.write_bytes(b"no parquet")
        old.with_name(f".{old.name}.crc").unlink(missing_ok=True)
        spoilt += 1
    assert spoilt > 20
    wh = add_flights(f.where("year = 1998 AND quarter = 4"), home)
    want = Warehouse.from_flights(f)
    for grain in ("flight_date", "date", "year"):
        cols = [*R.GRAINS[grain].dims, *R.MEASURES]
        got = wh.grain(grain).where("year = 1998").select(*cols)
        assert _rows(got) == _rows(want.grain(grain).where("year = 1998").select(*cols)), grain
    with pytest.raises(Exception):
        wh.grain("date").groupBy().sum("num_flights").collect()


def test_first_delivery_into_an_undated_and_an_empty_warehouse(spark):
    f = dirty_flights(spark, SF001)
    home = scratch_path(spark, "grown")
    build_all(f.where("flight_date IS NULL"), home)
    wh = add_flights(f.where("flight_date IS NOT NULL"), home)
    want = build_all(f)
    for name in ("delay_date_count", "year_fcount", "quarterly_delays", "flightNum_month_fcount"):
        assert _rows(wh.table(name)) == _rows(want.table(name)), name
    home = scratch_path(spark, "grown")
    build_all(f.where("false"), home)
    assert _rows(add_flights(f, home).table("year_fcount")) == _rows(want.table("year_fcount"))
    assert _rows(add_flights(f.where("false"), home).table("year_fcount")) == _rows(want.table("year_fcount"))


def test_a_grain_that_loses_rows_stops_the_publish(spark, monkeypatch):
    f = flights(spark, SF001)
    home = scratch_path(spark, "lossy")
    build_all(f.where("year < 1997"), home)
    before = _rows(Warehouse.load(spark, home).table("year_fcount"))
    real = R.reaggregate

    def lossy(finer, grain):
        out = real(finer, grain)
        return out.where("carrier <> 'AA'") if grain == "year" else out

    monkeypatch.setattr(R, "reaggregate", lossy)
    with pytest.raises(BuildMismatch, match="year"):
        build_all(f, home)
    with pytest.raises(BuildMismatch):
        add_flights(f.where("year = 1997"), home)
    monkeypatch.setattr(R, "reaggregate", real)
    real_added = R.added
    monkeypatch.setattr(R, "added", lambda o, n, g: real_added(o, n, g).where("carrier <> 'AA'") if g == "date" else real_added(o, n, g))
    with pytest.raises(BuildMismatch, match="date"):
        add_flights(f.where("year = 1997"), home)
    assert _rows(Warehouse.load(spark, home).table("year_fcount")) == before


def test_published_totals_and_outdated_base(spark, monkeypatch):
    f = flights(spark, SF001)
    home = scratch_path(spark, "totals")
    build_all(f.where("year < 1997"), home)
    add_flights(f.where("year >= 1997"), home)
    n = f.where("cancelled <> 1").count()
    top = W._builds(spark, home)[0]
    assert top.flights == n and 0 < top.delayed < n and {r.grain for r in top.replaced} == set(BUILD_ORDER)
    real = W.reconciled

    def other_writer(totals):
        monkeypatch.setattr(W, "reconciled", real)
        build_all(f, home)
        return real(totals)

    monkeypatch.setattr(W, "reconciled", other_writer)
    with pytest.raises(RuntimeError, match="newer build"):
        add_flights(f.where("year = 1997"), home)
