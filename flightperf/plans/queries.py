"""Named queries over the test data: one per inventory entry.

Each takes ``(spark, sf_dir)`` and returns a DataFrame over the *whole* flight relation
derived from ``lineitem``. It is lazy but for queries that exercise a sink, a source or the
built warehouse: those write to a fresh folder under the shared checkpoint folder when they
are called, then read it back.
Output dates are ``yyyy-MM-dd`` text so results compare across engines.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightperf.functions import exprs as X
from flightperf.functions.dims import CARRIER_CODES, COUNTERS
from flightperf.operators import classify as C
from flightperf.operators import joins as J
from flightperf.operators import reshape as RS
from flightperf.operators import rollups as R
from flightperf.plans import cover as CV
from flightperf.plans import reports as Q
from flightperf.plans.running import RunningTotals
from flightperf.plans.warehouse import Warehouse, add_flights, build_all, export_tables, table_row_counts
from flightperf.session import scratch_path
from flightperf.sources import csv as CSV
from flightperf.sources import sinks as S
from flightperf.sources import fixtures
from flightperf.sources.deliveries import FlightStore
from flightperf.sources.keyed_table import KeyedTable

flights = fixtures.flights


def dirty_flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights whose date can't be read on some days; year, quarter and month stay as given."""
    return flights(spark, sf_dir).withColumn(
        "flight_date", F.expr("CASE WHEN day_of_month = 5 AND month IN (1, 7) THEN CAST(NULL AS DATE) ELSE flight_date END"))


# Query parameters shared with the SQL oracle.
CARRIER = "AA"
FLIGHT = "2"
RANGE1 = (dt.date(1996, 3, 15), dt.date(1999, 11, 20))
RANGE2 = (dt.date(1995, 11, 5), dt.date(1996, 2, 3))
SEASON_YEAR = 1997
MERGE_YEAR = 1996
MATCH_BUCKETS = 16
HOLIDAY = "Christmas"
HOLIDAY_YEARS = (1995, 2001)
POINT_KEYS = [f"{CARRIER}_{FLIGHT}_{SEASON_YEAR}_{q}" for q in range(1, 5)]
# shortened allow-list for the semi join (the first half of the known codes)
SHORT_CARRIERS = CARRIER_CODES[:13]

SCAN_COLUMNS = ["carrier", "flight_num", "flight_date", "arr_delay", "arr_del15", "cancelled",
                "carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]


def text_dates(df: DataFrame) -> DataFrame:
    """DATE columns -> ``yyyy-MM-dd`` text (edge formatting only)."""
    return df.selectExpr(*[f"{X.date_text_sql(f.name)} AS {f.name}" if isinstance(f.dataType, T.DateType)
                           else f"`{f.name}`" for f in df.schema.fields])


def _wh(spark, sf_dir) -> Warehouse:
    return Warehouse.from_flights(flights(spark, sf_dir))


def _classified(spark, sf_dir) -> DataFrame:
    return C.classify(flights(spark, sf_dir))


# --- sources -----------------------------------------------------------------------

def q_scan_csv(spark, sf_dir):
    path = scratch_path(spark, "ontime-csv")
    CSV.write_ontime_csv(flights(spark, sf_dir), path)
    return text_dates(CSV.read_flights_csv(spark, path).select(*SCAN_COLUMNS))


def q_scan_csv_dir(spark, sf_dir):
    path = scratch_path(spark, "ontime-dir")
    CSV.write_ontime_csv(flights(spark, sf_dir), path, partition_col="month")
    return text_dates(CSV.read_flights_dir(spark, path).select(*SCAN_COLUMNS))


def q_scan_csv_header(spark, sf_dir):
    path = scratch_path(spark, "ontime-header")
    CSV.write_ontime_csv(flights(spark, sf_dir), path, header=True)
    return text_dates(CSV.read_flights_csv(spark, path, header=True).select(*SCAN_COLUMNS))


def q_scan_zip_csv(spark, sf_dir):
    csv_path = scratch_path(spark, "ontime-unzipped")
    zip_path = scratch_path(spark, "ontime-zip")
    CSV.write_ontime_csv(flights(spark, sf_dir), csv_path, header=True, partition_col="month")
    CSV.zip_csv_files(spark, csv_path, zip_path)
    return text_dates(CSV.read_flights_zip(spark, zip_path, header=True).select(*SCAN_COLUMNS))


def q_redelivered_month(spark, sf_dir):
    """A folder of monthly files taken in twice, then one month delivered again with all delays a minute longer:
    its rows replace those of the first delivery, and the old file is not read again."""
    f = flights(spark, sf_dir)
    first, again = scratch_path(spark, "delivery"), scratch_path(spark, "delivery")
    CSV.write_ontime_csv(f, first, header=True, partition_col="month")
    month = f.where((F.col("year") == MERGE_YEAR) & (F.col("month") == 6))
    CSV.write_ontime_csv(month.withColumn("arr_delay", F.col("arr_delay") + 1), again, header=True, partition_col="month")
    store = FlightStore(spark, scratch_path(spark, "flight-store"), "_part=([0-9]{4}-[0-9]{2})")
    for folder in (first, first, again, first):
        store.ingest(folder)
    return text_dates(store.flights().select(*SCAN_COLUMNS))


def q_cast_lenient_int(spark, sf_dir):
    f = flights(spark, sf_dir)
    txt = F.when(F.col("flight_num") == "1", F.lit("x")).otherwise(
        F.concat(F.col("arr_delay").cast("string"), F.lit(".00")))
    return f.select(txt.alias("txt")).select("txt", X.lenient_int("txt").alias("val"))


# --- sinks and keyed reads -------------------------------------------------------------

def q_sink_delay_parquet(spark, sf_dir):
    path = scratch_path(spark, "delay-year")
    S.write_table(_wh(spark, sf_dir).delay("year"), path, ["year"])
    return S.read_table(spark, path).select("key", "carrier", "year", *COUNTERS)


def q_sink_count_parquet(spark, sf_dir):
    path = scratch_path(spark, "count-year")
    S.write_table(_wh(spark, sf_dir).count("year"), path, ["year"])
    return S.read_table(spark, path).select("key", "carrier", "year", "num_flights")


def q_sink_tsv(spark, sf_dir):
    path = scratch_path(spark, "delay-date-tsv")
    S.write_tsv(text_dates(_wh(spark, sf_dir).delay("date")), path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("carrier", T.StringType()),
                           T.StructField("flight_date", T.StringType())]
                          + [T.StructField(c, T.LongType()) for c in COUNTERS])
    return S.read_tsv(spark, path, schema)


def q_key_point_read(spark, sf_dir):
    """Rows of four keys, from the files whose key interval holds one."""
    table = KeyedTable.write(_wh(spark, sf_dir).delay("flight_quarter"), scratch_path(spark, "quarterly-delays"))
    return table.read_keys(POINT_KEYS).select("key", "carrier", "flight_num", "year", "quarter", *COUNTERS)


def q_key_range_read(spark, sf_dir):
    path = scratch_path(spark, "date-fcount")
    c = _wh(spark, sf_dir).count("date").withColumn("year", F.year("flight_date"))
    S.write_table(c, path, ["year"])
    s, e = RANGE1
    t = S.read_table(spark, path)
    # typed dimensions instead of string keys: partition pruning on year, pushdown on the rest
    t = t.where((F.col("carrier") == CARRIER) & (F.col("flight_date") >= F.lit(s)) & (F.col("flight_date") < F.lit(e))
                & (F.col("year") >= s.year) & (F.col("year") <= e.year))
    return text_dates(t.select("key", "carrier", "flight_date", "num_flights"))


def q_key_range_read_text(spark, sf_dir):
    """The same rows by a half-open range of text keys, from the files that the range meets."""
    table = KeyedTable.write(_wh(spark, sf_dir).count("date"), scratch_path(spark, "date-fcount"))
    start, stop = (f"{CARRIER}_{d.isoformat()}" for d in RANGE1)
    return text_dates(table.read_range(start, stop).select("key", "carrier", "flight_date", "num_flights"))


def q_key_bloom_read(spark, sf_dir):
    """A week of one flight from daily flight counts that lie in date order: Bloom filters on the key tell which row
    groups can hold it."""
    path = scratch_path(spark, "flight-date-fcount")
    S.write_table(_wh(spark, sf_dir).count("flight_date"), path, order_by=["flight_date"], bloom={"key": 100_000})
    keys = [f"{CARRIER}_{FLIGHT}_{RANGE1[0] + dt.timedelta(days=i)}" for i in range(7)]
    return text_dates(S.read_table(spark, path).where(F.col("key").isin(keys)))


def q_merge_by_key(spark, sf_dir):
    """A keyed table written for the years up to MERGE_YEAR, then merged with counts of the days up to the 15th
    from that year on: keys in both have their newest row, all others stay."""
    f = flights(spark, sf_dir)
    path = scratch_path(spark, "merged")
    KeyedTable.write(Warehouse.from_flights(f.where(F.col("year") <= MERGE_YEAR)).count("flight_year"), path)
    updates = Warehouse.from_flights(f.where((F.col("year") >= MERGE_YEAR) & (F.col("day_of_month") <= 15))).count("flight_year")
    return KeyedTable.load(spark, path).merge(updates).scan()


def q_merge_deliveries(spark, sf_dir):
    """Two merges into the daily delay table, each with two deliveries of the days of June: of several rows of
    a key the one with the greatest delivery number counts."""
    day = _wh(spark, sf_dir).delay("date").select("key", "flight_date", *COUNTERS)
    table = KeyedTable.write(day.withColumn("delivery", F.lit(0)), scratch_path(spark, "merged"))
    june = day.where(F.month("flight_date") == 6)
    for first in (1, 3):
        both = june.withColumn("delivery", F.explode(F.array(F.lit(first), F.lit(first + 1))))
        both = both.where(F.dayofmonth("flight_date") % F.col("delivery") == 0)
        table = table.merge(both.withColumn("nas_num", F.col("nas_num") + F.col("delivery")), newest="delivery")
    return text_dates(table.scan())


def _all_tables(wh: Warehouse) -> DataFrame:
    """All 18 tables by content."""
    out = None
    for name, (grain, family) in R.TABLES.items():
        dims = R.GRAINS[grain].dims
        measures = COUNTERS if family == "delay" else ["num_flights"]
        t = text_dates(wh.table(name)).select(
            F.lit(name).alias("table_name"), "key",
            F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dims]).alias("dims"),
            F.concat_ws("|", *[F.col(m).cast("string") for m in measures]).alias("measures"))
        out = t if out is None else out.unionByName(t)
    return out


def q_built_tables(spark, sf_dir):
    """All 18 written tables by content, from flights with unreadable dates."""
    return _all_tables(build_all(dirty_flights(spark, sf_dir)))


def q_delta_tables(spark, sf_dir):
    """The same tables from a first build and two deliveries: the second half of a year, then all later years."""
    f = dirty_flights(spark, sf_dir)
    home = scratch_path(spark, "warehouse")
    first = f"year < {MERGE_YEAR} OR (year = {MERGE_YEAR} AND quarter < 3)"
    build_all(f.where(first), home)
    add_flights(f.where(f"year = {MERGE_YEAR} AND quarter >= 3"), home)
    return _all_tables(add_flights(f.where(f"year > {MERGE_YEAR} OR ({first}) IS NULL"), home))


def _built_report(report) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        return report(build_all(flights(spark, sf_dir)))
    return run


def q_export_tsv(spark, sf_dir):
    """The nine tab-separated outputs, line by line, rows without a key included."""
    path = scratch_path(spark, "export")
    out = None
    for name in export_tables(Warehouse.from_flights(dirty_flights(spark, sf_dir)), path):
        t = spark.read.text(f"{path}/{name}").select(F.lit(name).alias("table_name"), F.col("value").alias("line"))
        out = t if out is None else out.unionByName(t)
    return out


def q_build_all(spark, sf_dir):
    return table_row_counts(build_all(flights(spark, sf_dir)))


# --- projections, predicates, keys ----------------------------------------------------------

def q_project_flights(spark, sf_dir):
    return text_dates(C.project_flights(flights(spark, sf_dir)))


def q_project_flights_narrow(spark, sf_dir):
    """The projection without the five causes."""
    return text_dates(C.project_flights(flights(spark, sf_dir), with_causes=False))


def q_range_check(spark, sf_dir):
    """Whether each flight day can start a period that ends at RANGE1's start."""
    days = flights(spark, sf_dir).select("flight_date").distinct()
    return text_dates(days.select("flight_date", X.range_valid(F.col("flight_date"), F.lit(RANGE1[0])).alias("valid")))


def q_classify_causes(spark, sf_dir):
    df = C.classify_causes(C.project_flights(flights(spark, sf_dir)))
    return text_dates(df.select("carrier", "flight_num", "flight_date", "arr_delay", "arr_del15", "cancelled",
                                "carrier_b", "weather_b", "nas_b", "security_b", "late_aircraft_b"))


def q_classify_other(spark, sf_dir):
    df = _classified(spark, sf_dir)
    return text_dates(df.select("carrier", "flight_num", "flight_date", "arr_delay", "arr_del15", "cancelled",
                                "carrier_b", "weather_b", "nas_b", "security_b", "late_aircraft_b", "other_b"))


def q_filter_delayed(spark, sf_dir):
    return text_dates(C.filter_delayed(_classified(spark, sf_dir))
                      .select("carrier", "flight_num", "flight_date", "arr_delay", "cancelled"))


def q_filter_operated(spark, sf_dir):
    return text_dates(C.filter_operated(_classified(spark, sf_dir))
                      .select("carrier", "flight_num", "flight_date", "arr_delay", "cancelled"))


def q_make_keys(spark, sf_dir):
    op = C.filter_operated(flights(spark, sf_dir))
    dt_ = X.date_text_sql("flight_date")
    return text_dates(op.selectExpr(
        "carrier", "flight_num", "flight_date",
        f"{X.key_sql('carrier', dt_)} AS key2",
        f"{X.key_sql('carrier', 'flight_num', dt_)} AS key3",
        f"{X.key_sql('carrier', 'flight_num', 'year', 'quarter')} AS key4",
        f"{X.key_sql('carrier', X.year_month_text_sql('year', 'month'))} AS key_ym"))


def q_norm_params(spark, sf_dir):
    lower = flights(spark, sf_dir).select(F.lower("carrier").alias("carrier_in")).distinct()
    return lower.select("carrier_in", X.carrier_code(F.col("carrier_in")).alias("carrier"))


def q_date_transform(spark, sf_dir):
    d = flights(spark, sf_dir).select("flight_date").distinct()
    src = d.select(F.date_format("flight_date", "MM/dd/yyyy").alias("src"))
    return src.select("src", X.mdy_to_iso("src").alias("iso"))


def q_date_cover(spark, sf_dir):
    """Cover of every carrier's operated span, overall and per year."""
    op = C.filter_operated(flights(spark, sf_dir))
    by_year = op.groupBy("carrier", "year").agg(F.min("flight_date").alias("s"), F.max("flight_date").alias("m"))
    # the overall span from the per-year spans: one scan, the yearly aggregate is reused
    overall = by_year.groupBy("carrier").agg(F.min("s").alias("s"), F.max("m").alias("m"))
    spans = (by_year.select("carrier", F.col("year").cast("string").alias("span"), "s", "m")
             .unionByName(overall.select("carrier", F.lit("all").alias("span"), "s", "m")))
    segs = spans.select("carrier", "span", F.inline(CV.cover_segments(F.col("s"), F.date_add("m", 1))))
    return text_dates(segs.select("carrier", "span", F.col("seg_ord").cast("int").alias("seg_ord"),
                                  "grain", "seg_start", "seg_end"))


def q_union_segments(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    parts = []
    for i, (s, e) in enumerate([RANGE1, RANGE2], start=1):
        u = CV.union_segments(wh, s, e, "carrier")
        parts.append(u.select(F.lit(i).alias("range_id"), "carrier", *COUNTERS, "num_flights"))
    return parts[0].unionByName(parts[1])


def q_many_ranges(spark, sf_dir):
    """Some thousand ranges taken from the data, answered together: one a carrier and month, from its first flight
    day on and longer with every month of the year."""
    op = C.filter_operated(flights(spark, sf_dir))
    asked = op.groupBy("carrier", "year", "month").agg(F.min("flight_date").alias("range_start")).select(
        "carrier", "range_start", F.expr("date_add(range_start, month * month * 10 - 15)").alias("range_end"))
    return text_dates(CV.many_ranges(_wh(spark, sf_dir), asked))


def q_range_delay_totals(spark, sf_dir):
    s, e = RANGE1
    d = _wh(spark, sf_dir).delay("date").where((F.col("flight_date") >= F.lit(s)) & (F.col("flight_date") < F.lit(e)))
    return d.groupBy("carrier").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTERS])


def q_range_flight_total(spark, sf_dir):
    s, e = RANGE1
    c = _wh(spark, sf_dir).count("date").where((F.col("flight_date") >= F.lit(s)) & (F.col("flight_date") < F.lit(e)))
    return c.groupBy("carrier").agg(F.sum("num_flights").cast("long").alias("num_flights"))


def _rollup_query(family: str, grain: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf_dir):
        wh = _wh(spark, sf_dir)
        return text_dates(wh.delay(grain) if family == "delay" else wh.count(grain))
    run.__name__ = f"q_rollup_{family}_{grain}"
    return run


def q_rollup_grouping_sets(spark, sf_dir):
    return text_dates(R.grouping_sets_rollup(_wh(spark, sf_dir).grain("date")))


# --- joins -------------------------------------------------------------------------------

def q_join_delay_count(spark, sf_dir):
    wh = _wh(spark, sf_dir)
    return text_dates(J.join_delay_count(wh.count("date"), wh.delay("date"), ["carrier", "flight_date"]))


def q_join_delay_count_null(spark, sf_dir):
    """The same match where some groups have no readable date."""
    wh = Warehouse.from_flights(dirty_flights(spark, sf_dir))
    return text_dates(J.join_delay_count(wh.count("date"), wh.delay("date"), ["carrier", "flight_date"]))


def q_match_bucketed(spark, sf_dir):
    """The same match on two written tables with equal buckets: no shuffle below the join."""
    wh = Warehouse.from_flights(dirty_flights(spark, sf_dir))
    path = scratch_path(spark, "families")
    name = "families_" + path.rsplit("-", 1)[1]
    J.write_families(wh.count("date"), wh.delay("date"), name, path, buckets=MATCH_BUCKETS)
    return text_dates(J.match_families(spark, name, ["carrier", "flight_date"]))


def q_join_carrier_name(spark, sf_dir):
    per_carrier = _wh(spark, sf_dir).grain("year").groupBy("carrier").agg(
        F.sum("num_flights").cast("long").alias("num_flights"))
    return J.join_carrier_name(per_carrier).select("carrier", "carrier_name", "num_flights")


def q_semi_known_carriers(spark, sf_dir):
    return J.semi_known_carriers(_wh(spark, sf_dir).count("year"), SHORT_CARRIERS).select(
        "key", "carrier", "year", "num_flights")


# --- measures, ratios, reshapes ---------------------------------------------------------------

def _range1_totals(spark, sf_dir):
    return CV.direct_range(_wh(spark, sf_dir), *RANGE1, "carrier")


def q_on_time_count(spark, sf_dir):
    t = RS.with_on_time(_range1_totals(spark, sf_dir))
    return t.select("carrier", "num_flights", "delayed_flights", "flag_total", "on_time", "on_time_exact")


def _carrier_days_all(spark, sf_dir):
    """Every carrier-day of the data, fully cancelled ones included (0 flights)."""
    c = _classified(spark, sf_dir)
    return c.groupBy("carrier", "flight_date").agg(
        X.E(f"CAST(sum(CASE WHEN {X.DELAYED_SQL} THEN nas_b ELSE 0 END) AS BIGINT) AS nas_num"),
        X.E(f"count(CASE WHEN {X.OPERATED_SQL} THEN carrier END) AS num_flights"))


def q_ratio_guarded(spark, sf_dir):
    d = _carrier_days_all(spark, sf_dir)
    return text_dates(d.select("carrier", "flight_date", X.guarded_ratio("nas_num", "num_flights").alias("ratio")))


def q_ratio_percent(spark, sf_dir):
    d = _carrier_days_all(spark, sf_dir)
    return text_dates(d.select("carrier", "flight_date", X.percent("nas_num", "num_flights").alias("pct")))


def q_unpivot_categories(spark, sf_dir):
    t = _range1_totals(spark, sf_dir)
    return RS.unpivot_categories(t, ["carrier"]).select(
        "carrier", F.col("category_ord").cast("int").alias("category_ord"), "category", "value")


def q_category_nonzero(spark, sf_dir):
    t = _range1_totals(spark, sf_dir)
    return RS.category_rows(t, ["carrier"], drop_empty=True).select(
        "carrier", F.col("category_ord").cast("int").alias("category_ord"), "category", "value")


def q_pivot_seasons(spark, sf_dir):
    fq = _wh(spark, sf_dir).grain("flight_quarter")
    return RS.pivot_seasons(fq, ["carrier", "year"], labels="as_observed")


# --- reports ---------------------------------------------------------------------------------

def q_report_category(spark, sf_dir):
    return Q.delay_category(_wh(spark, sf_dir), CARRIER, *RANGE1)


def q_report_category_all(spark, sf_dir):
    return Q.delay_category(_wh(spark, sf_dir), None, *RANGE1)


def q_report_flight(spark, sf_dir):
    return Q.flight_delay(_wh(spark, sf_dir), CARRIER, FLIGHT, *RANGE1)


def q_report_flight_all(spark, sf_dir):
    return Q.flight_delay(_wh(spark, sf_dir), None, None, *RANGE1)


def q_report_season(spark, sf_dir):
    return Q.season_delay(_wh(spark, sf_dir), CARRIER, FLIGHT, SEASON_YEAR, labels="as_observed")


def q_report_season_all(spark, sf_dir):
    return Q.season_delay(_wh(spark, sf_dir), None, None, SEASON_YEAR, labels="as_observed")


def q_report_category_exact(spark, sf_dir):
    """Q1 with On Time = flights - delayed flights (each flight counted once)."""
    return Q.delay_category(_wh(spark, sf_dir), None, *RANGE1, on_time="exact")


def q_report_season_calendar(spark, sf_dir):
    """Q3 with meteorological season labels (quarter 1 = Winter)."""
    return Q.season_delay(_wh(spark, sf_dir), None, None, SEASON_YEAR, labels="calendar")


def q_report_airline(spark, sf_dir):
    return Q.airline_delays(_wh(spark, sf_dir), *RANGE1)


def q_report_holiday(spark, sf_dir):
    return Q.delay_holiday(_wh(spark, sf_dir), CARRIER, HOLIDAY, HOLIDAY_YEARS)


def q_report_holiday_all(spark, sf_dir):
    return Q.delay_holiday(_wh(spark, sf_dir), None, None, None)


def q_run_report(spark, sf_dir):
    return Q.run_report(_wh(spark, sf_dir), "delay_category", carrier=CARRIER.lower(),
                        start=RANGE1[0].strftime("%m/%d/%Y"), end=RANGE1[1].strftime("%m/%d/%Y"))


def q_report_json(spark, sf_dir):
    rep = Q.delay_category(_wh(spark, sf_dir), None, *RANGE1)
    return Q.report_json(rep, ["carrier"])


def q_display_category(spark, sf_dir):
    return Q.display_rank(Q.delay_category(_wh(spark, sf_dir), None, *RANGE1)).select(
        "carrier", F.col("carrier_ord").cast("int").alias("carrier_ord"), "position", "category")


def q_display_holiday(spark, sf_dir):
    return Q.display_rank(Q.delay_holiday(_wh(spark, sf_dir), None, HOLIDAY, HOLIDAY_YEARS)).select(
        "carrier", F.col("carrier_ord").cast("int").alias("carrier_ord"), "position", "year")


def q_payload_holiday(spark, sf_dir):
    """Years ascending and both ratios as parallel lists, one payload a carrier."""
    rep = Q.delay_holiday(_wh(spark, sf_dir), None, HOLIDAY, HOLIDAY_YEARS)
    return Q.parallel_lists_json(rep, ["carrier"], "year", ["ratio_holiday", "ratio_baseline"])


def q_payload_season(spark, sf_dir):
    """Seven category counts of each of the four seasons, one payload a flight and season."""
    rep = Q.season_delay(_wh(spark, sf_dir), None, None, SEASON_YEAR, labels="as_observed")
    return Q.report_json(rep, ["carrier", "flight_num", "season"], "value")


def q_payload_airline(spark, sf_dir):
    """Known carriers and their attributable shares as two lists (26 carriers at most)."""
    return Q.parallel_lists_json(Q.airline_delays(_wh(spark, sf_dir), *RANGE1), [], "carrier", ["ratio"])


BUILT_REPORTS = {
    "built_report_category_all": _built_report(lambda wh: Q.delay_category(wh, None, *RANGE1)),
    "built_report_flight_all": _built_report(lambda wh: Q.flight_delay(wh, None, None, *RANGE1)),
    "built_report_season_all": _built_report(
        lambda wh: Q.season_delay(wh, None, None, SEASON_YEAR, labels="as_observed")),
    "built_report_airline": _built_report(lambda wh: Q.airline_delays(wh, *RANGE1)),
    "built_report_holiday_all": _built_report(lambda wh: Q.delay_holiday(wh, None, None, None)),
}

def _running_report(report) -> Callable[[SparkSession, str], DataFrame]:
    """A report whose range is read as the difference of two written running totals."""
    def run(spark, sf_dir):
        wh = _wh(spark, sf_dir)
        wh.running = RunningTotals.write(wh, scratch_path(spark, "running"))
        return report(wh)
    return run


RUNNING_REPORTS = {
    "running_report_category_all": _running_report(lambda wh: Q.delay_category(wh, None, *RANGE1)),
    "running_report_flight_all": _running_report(lambda wh: Q.flight_delay(wh, None, None, *RANGE1)),
    "running_report_airline": _running_report(lambda wh: Q.airline_delays(wh, *RANGE1)),
}

ROLLUP_GRAINS = ["date", "year", "month", "flight_date", "flight_year", "flight_month", "flight_quarter",
                 "year_month", "flight_year_month"]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    q = {
        "scan_csv": q_scan_csv,
        "scan_csv_dir": q_scan_csv_dir,
        "scan_csv_header": q_scan_csv_header,
        "scan_zip_csv": q_scan_zip_csv,
        "redelivered_month": q_redelivered_month,
        "cast_lenient_int": q_cast_lenient_int,
        "sink_delay_parquet": q_sink_delay_parquet,
        "sink_count_parquet": q_sink_count_parquet,
        "sink_tsv": q_sink_tsv,
        "key_point_read": q_key_point_read,
        "key_range_read": q_key_range_read,
        "build_all": q_build_all,
        "project_flights": q_project_flights,
        "classify_causes": q_classify_causes,
        "classify_other": q_classify_other,
        "filter_delayed": q_filter_delayed,
        "filter_operated": q_filter_operated,
        "make_keys": q_make_keys,
        "norm_params": q_norm_params,
        "date_transform": q_date_transform,
        "date_cover": q_date_cover,
        "union_segments": q_union_segments,
        "range_delay_totals": q_range_delay_totals,
        "range_flight_total": q_range_flight_total,
    }
    for g in ROLLUP_GRAINS:
        q[f"rollup_delay_{g}"] = _rollup_query("delay", g)
        q[f"rollup_count_{g}"] = _rollup_query("count", g)
    q.update({
        "rollup_grouping_sets": q_rollup_grouping_sets,
        "join_delay_count": q_join_delay_count,
        "join_carrier_name": q_join_carrier_name,
        "semi_known_carriers": q_semi_known_carriers,
        "on_time_count": q_on_time_count,
        "ratio_guarded": q_ratio_guarded,
        "ratio_percent": q_ratio_percent,
        "unpivot_categories": q_unpivot_categories,
        "category_nonzero": q_category_nonzero,
        "pivot_seasons": q_pivot_seasons,
        "report_category": q_report_category,
        "report_category_all": q_report_category_all,
        "report_flight": q_report_flight,
        "report_flight_all": q_report_flight_all,
        "report_season": q_report_season,
        "report_season_all": q_report_season_all,
        "report_category_exact": q_report_category_exact,
        "report_season_calendar": q_report_season_calendar,
        "report_airline": q_report_airline,
        "report_holiday": q_report_holiday,
        "report_holiday_all": q_report_holiday_all,
        "run_report": q_run_report,
        "report_json": q_report_json,
        "key_range_read_text": q_key_range_read_text,
        "merge_by_key": q_merge_by_key,
        "merge_deliveries": q_merge_deliveries,
        "built_tables": q_built_tables,
        "delta_tables": q_delta_tables,
        "export_tsv": q_export_tsv,
        "project_flights_narrow": q_project_flights_narrow,
        "range_check": q_range_check,
        "join_delay_count_null": q_join_delay_count_null,
        "display_category": q_display_category,
        "display_holiday": q_display_holiday,
        "payload_holiday": q_payload_holiday,
        "payload_season": q_payload_season,
        "payload_airline": q_payload_airline,
        "many_ranges": q_many_ranges,
        "match_bucketed": q_match_bucketed,
        "key_bloom_read": q_key_bloom_read,
        **BUILT_REPORTS,
        **RUNNING_REPORTS,
    })
    return q
