"""Running totals, many ranges at once, the bucketed match and Bloom filters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flightperf.operators import joins as J
from flightperf.operators.rollups import MEASURES
from flightperf.plans import cover as CV
from flightperf.plans import reports as Q
from flightperf.plans.queries import dirty_flights
from flightperf.plans.running import RunningTotals
from flightperf.plans.warehouse import Warehouse
from flightperf.session import scratch_path
from flightperf.sources import sinks as S
from flightperf.sources.fixtures import flights

from tests.paths import SF001

D = dt.date


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def wh(spark):
    """A warehouse of written day grains, with its running totals."""
    path = scratch_path(spark, "days")
    lazy = Warehouse.from_flights(dirty_flights(spark, SF001))
    for g in ("date", "flight_date", "year_month", "year"):
        lazy.grain(g).write.parquet(f"{path}/{g}")
    out = Warehouse(lambda g: spark.read.parquet(f"{path}/{g}"))
    out.running = RunningTotals.write(out, scratch_path(spark, "running"))
    return out


@pytest.mark.parametrize("start,end", [
    (D(1996, 3, 15), D(1999, 11, 20)), (D(1996, 1, 1), D(1997, 1, 1)), (D(1995, 12, 31), D(1996, 1, 1)), (D(1900, 1, 1), D(2100, 1, 1)),
    (D(1997, 6, 1), D(1997, 6, 2)), (D(1800, 1, 1), D(1801, 1, 1)), (D(2050, 1, 1), D(2051, 1, 1)), (D(1997, 6, 1), D(1997, 6, 1))])
def test_a_range_is_the_difference_of_two_days(wh, start, end):
    for level in ("carrier", "flight"):
        want = CV.direct_range(wh, start, end, level)
        cols = [*CV.LEVEL_IDS[level], *MEASURES]
        assert _rows(wh.running.range_totals(start, end, level).select(*cols)) == _rows(want.select(*cols)), level


def test_reports_read_two_days(spark, wh):
    r = (D(1996, 3, 15), D(1999, 11, 20))
    for report in (lambda w, **k: Q.delay_category(w, None, *r, **k), lambda w, **k: Q.flight_delay(w, None, None, *r, **k),
                   lambda w, **k: Q.airline_delays(w, *r, **k), lambda w, **k: Q.delay_category(w, "ZZ", *r, **k),
                   lambda w, **k: Q.flight_delay(w, "AA", "2", *r, **k)):
        assert _rows(report(wh)) == _rows(report(wh, use_cover=False))
    plan = Q.delay_category(wh, "AA", *r)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "valid_from" in plan
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln]
    assert all("PartitionFilters: [isnotnull(year" in ln for ln in scans)


def test_many_ranges_at_once(spark, wh):
    rng = random.Random(3)
    asked = [("AA" if rng.random() < .3 else rng.choice(["DL", "UA", "ZZ", None]), D(1994, 1, 1) + dt.timedelta(rng.randrange(2500)),
              rng.choice([-5, 0, 1, 2, 27, 31, 59, 365, 366, 731, 1500]), i) for i in range(60)]
    asked = [(c, s, s + dt.timedelta(n), i) for c, s, n, i in asked]
    asked += asked[:3] + [("AA", None, D(1997, 1, 1), 99), ("AA", D(1997, 1, 1), None, 98)]
    df = spark.createDataFrame(asked, "carrier string, range_start date, range_end date, id int")
    clean = Warehouse.from_flights(flights(spark, SF001))
    got = CV.many_ranges(clean, df)
    assert got.columns == [*df.columns, *MEASURES]
    daily = {(r.carrier, r.flight_date): r for r in clean.grain("date").collect()}
    want = []
    for c, s, e, i in asked:
        hit = [r for (k, day), r in daily.items() if k == c and c and s and e and s <= day < e]
        want.append((c, s, e, i, *[sum(r[m] for r in hit) for m in MEASURES]))
    assert _rows(got) == sorted(want, key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        CV.many_ranges(clean, df.withColumn("num_flights", F.lit(1)))


def test_bucketed_match_moves_no_row(spark):
    wh = Warehouse.from_flights(dirty_flights(spark, SF001))
    path = scratch_path(spark, "families")
    J.write_families(wh.count("date"), wh.delay("date"), "match_test", path, 4)
    got = J.match_families(spark, "match_test", ["carrier", "flight_date"])
    want = J.join_delay_count(wh.count("date"), wh.delay("date"), ["carrier", "flight_date"])
    assert _rows(got) == _rows(want.select(*got.columns))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        c, d = spark.table("match_test_counts"), spark.table("match_test_delays")
        keyed = c.where("key IS NOT NULL").join(d.where("key IS NOT NULL").select("key", "nas_num"), "key", "left")
        plan = keyed._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        whole = J.match_families(spark, "match_test", ["carrier", "flight_date"])._jdf.queryExecution().executedPlan().toString()
        assert whole.count("Exchange") == 2             # both sides of the groups with a NULL part
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_bloom_filters_skip_row_groups(spark):
    """Row groups in date order say nothing about flight keys; the scan reads fewer rows with Bloom filters."""
    wh = Warehouse.from_flights(flights(spark, SF001))
    counts = wh.count("flight_date").coalesce(1)
    key = counts.select("key").first().key
    read = {}
    for name, bloom in (("plain", None), ("bloom", {"key": 2000})):
        path = scratch_path(spark, name)
        spark.conf.set("spark.sql.files.maxRecordsPerFile", "500")
        try:
            S.write_table(counts, path, order_by=["flight_date"], bloom=bloom)
        finally:
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        df = S.read_table(spark, path).where(F.col("key") == key)
        assert df.count() == 1
        read[name] = _scanned(spark, path, key)
    assert read["bloom"] <= 1000 < read["plain"]


def _scanned(spark, path, key):
    """Rows that the scan hands on, from its metrics."""
    df = spark.read.parquet(path).where(F.col("key") == key)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(p):
        if "FileSourceScan" in p.getClass().getSimpleName():
            found.append(p.metrics().apply("numOutputRows").value())
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            walk(p.executedPlan())
        for i in range(p.children().size()):
            walk(p.children().apply(i))
    walk(plan)
    return sum(found)
