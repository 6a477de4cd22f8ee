from pyspark.sql import functions as F

from flightperf.functions.dims import COUNTERS
from flightperf.operators import rollups as R
from flightperf.plans.warehouse import Warehouse, build_all, table_row_counts
from flightperf.sources.fixtures import flights

from tests.paths import SF001


def _sums(df, cols):
    return tuple(df.agg(*[F.sum(c).alias(c) for c in cols]).collect()[0])


def test_coarse_equals_fine(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    cols = COUNTERS + ["delayed_flights", "num_flights"]
    base = _sums(wh.grain("flight_date"), cols)
    for g in R.GRAINS:
        assert _sums(wh.grain(g), cols) == base, g


def test_delay_keys_subset_of_count_keys(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    for g in R.GRAINS:
        assert wh.delay(g).select("key").subtract(wh.count(g).select("key")).count() == 0


def test_built_warehouse_equals_lazy(spark):
    f = flights(spark, SF001)
    lazy = Warehouse.from_flights(f)
    built = build_all(f)
    for name in R.TABLES:
        a = sorted(tuple(r) for r in lazy.table(name).collect())
        b = sorted(tuple(r) for r in built.table(name).select(*lazy.table(name).columns).collect())
        assert a == b, name
    counts = {r.table_name: r.n_rows for r in table_row_counts(built).collect()}
    assert counts["date_fcount"] == 5055          # FIXTURES profile, sf0.001 carrier-days
    assert counts["flightNum_date_fcount"] == 5624


def test_grouping_sets_gid(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    gs = R.grouping_sets_rollup(wh.grain("date"))
    gids = sorted(r.gid for r in gs.select("gid").distinct().collect())
    # bits (carrier, flight_date, year, month), 1 = rolled up
    assert gids == [0b0011, 0b0100, 0b0101, 0b0110]
    per_set = {r.gid: r.n for r in gs.groupBy("gid").agg(F.sum("num_flights").alias("n")).collect()}
    assert len(set(per_set.values())) == 1       # every set sums to all flights


def test_build_reads_raw_flights_once(spark):
    f = flights(spark, SF001)
    plan = R.base_rollup(f)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    assert "Python" not in plan


def test_build_parallelism_does_not_change_results(spark):
    f = flights(spark, SF001)
    counts = []
    for jobs in (1, 2, 8):
        wh = build_all(f, parallel_jobs=jobs)
        counts.append(sorted(tuple(r) for r in table_row_counts(wh).collect()))
    assert counts[0] == counts[1] == counts[2]
