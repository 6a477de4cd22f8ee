"""Plan checks: pruning and pushdown reach the scan, no Python in the hot path."""

import datetime as dt

from flightperf.plans import reports as Q
from flightperf.plans.warehouse import Warehouse, build_all
from flightperf.sources.fixtures import flights

from tests.paths import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_materialized_report_prunes_year_partitions(spark):
    wh = build_all(flights(spark, SF001))
    rep = Q.delay_category(wh, "AA", dt.date(1996, 3, 15), dt.date(1999, 11, 20))
    plan = _plan(rep)
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "PushedFilters: [IsNotNull(carrier), EqualTo(carrier,AA)" in plan
    assert "Python" not in plan


def test_lineitem_scan_is_pruned(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    plan = _plan(Q.delay_category(wh, None, dt.date(1996, 3, 15), dt.date(1999, 11, 20)))
    # only the lineitem columns the mapping needs are read
    assert "l_extendedprice" not in plan and "l_returnflag" not in plan
    assert "Python" not in plan


def test_reports_have_no_python_and_no_cartesian(spark):
    wh = build_all(flights(spark, SF001))
    for df in [Q.season_delay(wh, None, None, 1997), Q.delay_holiday(wh, None, None, None),
               Q.airline_delays(wh, dt.date(1996, 3, 15), dt.date(1999, 11, 20)),
               Q.flight_delay(wh, None, None, dt.date(1996, 3, 15), dt.date(1999, 11, 20))]:
        plan = _plan(df)
        assert "Python" not in plan
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_aggregations_combine_map_side(spark):
    """A hot key (one carrier with a third of all flights) is pre-aggregated before the
    shuffle: every report aggregation has a partial step below its exchange."""
    wh = build_all(flights(spark, SF001))
    for df in [Q.delay_category(wh, None, dt.date(1996, 3, 15), dt.date(1999, 11, 20)),
               Q.airline_delays(wh, dt.date(1996, 3, 15), dt.date(1999, 11, 20)),
               Q.season_delay(wh, None, None, 1997)]:
        plan = _plan(df)
        assert "partial_sum" in plan
        assert plan.index("Exchange hashpartitioning") < plan.index("partial_sum")


def test_rebuild_replaces_every_partition(spark):
    from flightperf.session import scratch_path
    f = flights(spark, SF001)
    path = scratch_path(spark, "rebuild")
    build_all(f, path)
    wh = build_all(f.where("year = 1997"), path)   # smaller input into the same place
    years = {r.year for r in wh.grain("year").select("year").distinct().collect()}
    assert years == {1997}


def test_build_writes_few_files_per_year(spark):
    """Rebalanced writes: the number of files per year partition stays bounded by the
    data size, not by shuffle partitions x years."""
    import glob
    import os
    wh = build_all(flights(spark, SF001))
    base = wh.path[len("file:"):] if wh.path.startswith("file:") else wh.path
    for grain in ("flight_date", "date", "year_month"):
        years = [d for d in os.listdir(os.path.join(base, grain)) if d.startswith("year=")]
        assert years
        for y in years:
            files = glob.glob(os.path.join(base, grain, y, "*.parquet"))
            assert 1 <= len(files) <= 2, (grain, y, len(files))
