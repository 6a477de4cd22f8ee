"""The five reports, each a lazy DataFrame over the rollup warehouse.

Every report answers one key (a carrier, a carrier + flight) or all keys at once
(``carrier=None``); the all-keys form is one aggregation, never a loop per key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightperf.functions import exprs as X
from flightperf.functions.dims import (CARRIER_CODES, CATEGORIES, CATEGORY_COLUMNS, COUNTERS, HOLIDAYS,
                                       SEASON_LABELS)
from flightperf.operators.joins import semi_known_carriers
from flightperf.operators.reshape import category_rows
from flightperf.operators.rollups import MEASURES
from flightperf.plans.cover import LEVEL_GRAINS, LEVEL_IDS, direct_range, union_segments

DEFAULT_CARRIER = "AA"
DEFAULT_RANGE = (dt.date(2014, 6, 1), dt.date(2014, 7, 31))


# --- parameters --------------------------------------------------------------

def parse_date(v) -> dt.date:
    """Accepts a date, ``YYYY-MM-DD`` or ``MM/DD/YYYY`` text."""
    if isinstance(v, dt.date):
        return v
    if v is None or not str(v).strip():
        raise ValueError("a report date is missing")
    s = str(v).strip()
    if "/" in s:
        m, d, y = s.split("/")
        return dt.date(int(y), int(m), int(d))
    y, m, d = s.split("-")
    return dt.date(int(y), int(m), int(d))


def norm_range(start, end, inclusive_end: bool = False) -> tuple[dt.date, dt.date]:
    s, e = parse_date(start), parse_date(end)
    if not X.range_valid(s, e):
        raise ValueError(f"range start {s} is after its end {e}")
    if inclusive_end:
        e = e + dt.timedelta(days=1)
    return s, e


def norm_carrier(c: str | None) -> str | None:
    return None if c is None else X.carrier_code(c)


def _key_filter(carrier: str | None, flight_num: str | None = None) -> Column | None:
    cond = None
    if carrier is not None:
        cond = F.col("carrier") == carrier
    if flight_num is not None:
        f = F.col("flight_num") == str(flight_num)
        cond = f if cond is None else cond & f
    return cond


def range_totals(wh, start, end, level: str = "carrier", carrier: str | None = None,
                 flight_num: str | None = None, use_cover: bool | None = None,
                 ensure_key: bool = False) -> DataFrame:
    """Per-key measure sums over [start, end). Read as the difference of two running totals when the
    warehouse has them (``wh.running``), else through the cover when the warehouse
    is materialized (coarse tables hold fewer rows); a lazy warehouse is summed from its
    daily grain directly since every grain would be derived from the same scan anyway.

    ``ensure_key``: the single requested key gets a row even without flights (a zero row
    joins the union before the one aggregation, so no second shuffle)."""
    kf = _key_filter(carrier, flight_num)
    cover = wh.materialized if use_cover is None else use_cover
    extra = None
    if ensure_key:
        ids = LEVEL_IDS[level]
        values = [carrier] + ([str(flight_num)] if level == "flight" else [])
        extra = _zero_row(wh.grain(LEVEL_GRAINS[level]["day"]).sparkSession, ids, values)
    if use_cover is None and wh.running is not None:
        return wh.running.range_totals(start, end, level, kf, extra)
    return (union_segments if cover else direct_range)(wh, start, end, level, kf, extra)


def _zero_row(spark, ids: list[str], values: list) -> DataFrame:
    return spark.createDataFrame([tuple(values) + (0,) * len(MEASURES)],
                                 ", ".join([f"{i} string" for i in ids] + [f"{m} long" for m in MEASURES]))


def _category_report(totals: DataFrame, ids: list[str], on_time: str = "observed") -> DataFrame:
    rows = category_rows(totals, ids, drop_empty=True, on_time=on_time)
    return rows.selectExpr(*ids, "CAST(category_ord AS INT) AS category_ord", "category",
                           "CAST(value AS BIGINT) AS value",
                           f"{X.guarded_ratio_sql('value', 'num_flights')} AS ratio")


# --- Q1 delay categorization ---------------------------------------------------

def delay_category(wh, carrier: str | None = DEFAULT_CARRIER, start=DEFAULT_RANGE[0], end=DEFAULT_RANGE[1],
                   inclusive_end: bool = False, use_cover: bool | None = None,
                   on_time: str = "observed") -> DataFrame:
    """On Time + six delay categories as shares of operated flights over [start, end).

    ``carrier=None`` answers every carrier with flights in the range. ``on_time="exact"``
    counts a flight with several cause flags once (see ``operators.reshape.category_rows``)."""
    s, e = norm_range(start, end, inclusive_end)
    carrier = norm_carrier(carrier)
    t = range_totals(wh, s, e, "carrier", carrier, None, use_cover, ensure_key=carrier is not None)
    if carrier is None:
        t = t.where(F.col("num_flights") > 0)
    return _category_report(t, ["carrier"], on_time)


# --- Q2 delay by flight number ---------------------------------------------------

def flight_delay(wh, carrier: str | None = DEFAULT_CARRIER, flight_num: str | None = None,
                 start=DEFAULT_RANGE[0], end=DEFAULT_RANGE[1], inclusive_end: bool = False,
                 use_cover: bool | None = None, on_time: str = "observed") -> DataFrame:
    """Q1 for one carrier + flight number, or for every (carrier, flight) when both are None."""
    s, e = norm_range(start, end, inclusive_end)
    carrier = norm_carrier(carrier)
    ids = LEVEL_IDS["flight"]
    single = carrier is not None and flight_num is not None
    t = range_totals(wh, s, e, "flight", carrier, flight_num, use_cover, ensure_key=single)
    if not single:
        t = t.where(F.col("num_flights") > 0)
    return _category_report(t, ids, on_time)


# --- Q3 delay by season ----------------------------------------------------------

def season_delay(wh, carrier: str | None = DEFAULT_CARRIER, flight_num: str | None = None,
                 year: int | None = None, labels: str = "calendar") -> DataFrame:
    """Counts of On Time + six categories for the four quarters of ``year``.

    One aggregation over the quarterly rollup per (carrier, flight, year) with the four
    quarters as conditional sums, then an in-row generator to 4 x 7 rows: a quarter with
    no flights gets zeros without any join. Keys with no flight in the year are absent.
    """
    if year is None:
        raise ValueError("season report needs a year")
    names = SEASON_LABELS[labels]
    carrier = norm_carrier(carrier)
    q = wh.grain("flight_quarter").where(F.col("year") == int(year))
    kf = _key_filter(carrier, flight_num)
    if kf is not None:
        q = q.where(kf)
    ids = ["carrier", "flight_num", "year"]
    aggs = []
    for qq in range(1, 5):
        aggs.append(f"CAST(sum(CASE WHEN quarter = {qq} THEN num_flights ELSE 0 END) AS BIGINT) AS n{qq}")
        for c in COUNTERS:
            aggs.append(f"CAST(sum(CASE WHEN quarter = {qq} THEN {c} ELSE 0 END) AS BIGINT) AS {c}{qq}")
    g = q.groupBy(*ids).agg(*[X.E(a) for a in aggs])
    cells = []
    for qq in range(1, 5):
        flags = " + ".join(f"{c}{qq}" for c in COUNTERS)
        values = [f"n{qq} - ({flags})"] + [f"{CATEGORY_COLUMNS[n]}{qq}" for n in CATEGORIES[1:]]
        for ordn, (name, v) in enumerate(zip(CATEGORIES, values)):
            cells.append(f"named_struct('season_ord', {qq}, 'season', '{names[qq]}', 'category_ord', {ordn}, "
                         f"'category', '{name}', 'value', CAST({v} AS BIGINT))")
    return g.selectExpr("carrier", "flight_num", "CAST(year AS INT) AS year", f"inline(array({', '.join(cells)}))")


# --- Q4 airline-attributable delays --------------------------------------------------

def airline_delays(wh, start=DEFAULT_RANGE[0], end=DEFAULT_RANGE[1], inclusive_end: bool = False,
                   carriers: list[str] | None = None, use_cover: bool | None = None) -> DataFrame:
    """Per carrier: (Carrier + Late Aircraft + Unclassified) flags / operated flights,
    only carriers of the list that flew in the range."""
    s, e = norm_range(start, end, inclusive_end)
    t = range_totals(wh, s, e, "carrier", None, None, use_cover)
    t = semi_known_carriers(t, carriers if carriers is not None else CARRIER_CODES)
    t = t.where(F.col("num_flights") > 0)
    attributable = "CAST(carrier_num + late_aircraft_num + other_num AS BIGINT)"
    return t.selectExpr("carrier", f"{attributable} AS attributable", "num_flights",
                        f"{X.guarded_ratio_sql(attributable, 'num_flights')} AS ratio")


# --- Q5 holiday trend ------------------------------------------------------------------

_holiday_month = X.holiday_month


def delay_holiday(wh, carrier: str | None = DEFAULT_CARRIER, holiday: str | None = "Christmas",
                  years: tuple[int, int] | None = None) -> DataFrame:
    """Per year: all-cause delay flags / operated flights on the holiday, and the same on
    the 15th of the holiday's month (0 when no flights that day).

    Daily rows that fall on a holiday or its baseline day are tagged in place (no join);
    a skeleton of (carrier, holiday, year) rows with zeros is unioned in so that every year
    of the range appears, then one aggregation per (carrier, holiday, year).
    ``carrier=None`` / ``holiday=None``: every carrier with flights / every holiday. ``years``
    (first, last) default to the years of the data, the same for every carrier.
    """
    carrier = norm_carrier(carrier)
    hols = HOLIDAYS if holiday is None else [holiday]
    for h in hols:
        _holiday_month(h)
    daily = wh.grain("date")
    if carrier is not None:
        daily = daily.where(F.col("carrier") == carrier)
    if years is not None:
        daily = daily.where((F.col("year") >= int(years[0])) & (F.col("year") <= int(years[1])))
    daily = daily.where(F.col("month").isin(sorted({_holiday_month(h) for h in hols})))
    flags = "CAST(" + " + ".join(COUNTERS) + " AS BIGINT)"
    tags = []
    for h in hols:
        is_h = f"flight_date = {X.holiday_date_sql(h, 'year')}"
        is_b = f"month = {_holiday_month(h)} AND dayofmonth(flight_date) = 15"
        tags.append(f"CASE WHEN ({is_h}) OR ({is_b}) THEN named_struct('holiday', '{h}', 'is_holiday', {is_h}) END")
    hits = daily.selectExpr("carrier", "year", "num_flights", f"{flags} AS flags",
                            f"explode(filter(array({', '.join(tags)}), t -> t IS NOT NULL)) AS t")
    if carrier is None:
        hits = hits.where("carrier IS NOT NULL")
    hits = hits.selectExpr(
        "carrier", "t.holiday AS holiday", "CAST(year AS INT) AS year",
        "CASE WHEN t.is_holiday THEN flags ELSE 0 END AS h_flags",
        "CASE WHEN t.is_holiday THEN num_flights ELSE 0 END AS h_n",
        "CASE WHEN NOT t.is_holiday THEN flags ELSE 0 END AS b_flags",
        "CASE WHEN NOT t.is_holiday THEN num_flights ELSE 0 END AS b_n")
    # skeleton: the years to report, with zero measures
    hol_arr = "array(" + ", ".join(f"'{h}'" for h in hols) + ")"
    flown = wh.grain("year").where("num_flights > 0 AND carrier IS NOT NULL AND year IS NOT NULL")
    if years is not None:
        span = F.sequence(F.lit(int(years[0])), F.lit(int(years[1])))
    else:   # the distinct years: a handful of numbers, one scalar subquery
        span = flown.agg(F.array_sort(F.collect_set(F.col("year").cast("int")))).scalar()
    if carrier is not None:
        who = wh.grain("year").sparkSession.range(1).select(F.lit(carrier).alias("carrier"))
    else:
        who = flown.select("carrier").distinct()
    skel = who.select("carrier", F.explode(span).alias("year"))
    skel = skel.selectExpr("carrier", f"explode({hol_arr}) AS holiday", "CAST(year AS INT) AS year",
                           *[f"CAST(0 AS BIGINT) AS {c}" for c in ("h_flags", "h_n", "b_flags", "b_n")])
    agg = hits.unionByName(skel).groupBy("carrier", "holiday", "year").agg(
        *[X.E(f"CAST(sum({c}) AS BIGINT) AS {c}") for c in ("h_flags", "h_n", "b_flags", "b_n")])
    return agg.selectExpr("carrier", "holiday", "year",
                          f"{X.guarded_ratio_sql('h_flags', 'h_n')} AS ratio_holiday",
                          f"{X.guarded_ratio_sql('b_flags', 'b_n')} AS ratio_baseline")


# --- Q6 dispatch + payload ---------------------------------------------------------------

# FIXED VALUES: report names of the application.
REPORTS = {
    "delay_category": (delay_category, {"carrier", "start", "end"}),
    "delay_flightNum": (flight_delay, {"carrier", "flight_num", "start", "end"}),
    "delay_season": (season_delay, {"carrier", "flight_num", "year"}),
    "delay_career": (airline_delays, {"start", "end"}),
    "delay_holiday": (delay_holiday, {"carrier", "holiday"}),
}
# END FIXED VALUES


def run_report(wh, name: str = "delay_category", **params) -> DataFrame:
    """Run a report by its name with its required inputs. With no name and no inputs it is
    the category report for the default carrier and period."""
    if name not in REPORTS:
        raise ValueError(f"unknown report {name!r}; known: {sorted(REPORTS)}")
    fn, required = REPORTS[name]
    if name == "delay_category" and not params:
        params = {"carrier": DEFAULT_CARRIER, "start": DEFAULT_RANGE[0], "end": DEFAULT_RANGE[1]}
    missing = [p for p in sorted(required) if p not in params]
    if missing:
        raise ValueError(f"report {name!r} needs {missing}")
    return fn(wh, **params)


def report_json(report: DataFrame, ids: list[str], value: str = "ratio") -> DataFrame:
    """One row per report instance: ``payload`` = ``[["On Time", 0.735063], ["NAS", ...], ...]``
    in category order, built per key from at most seven rows (bounded group). Shares are
    printed with six decimals (they are rounded to six), counts as integers."""
    is_double = dict(report.dtypes)[value] in ("double", "float")
    shown = f"format_string('%.6f', {value})" if is_double else f"CAST({value} AS STRING)"
    g = report.groupBy(*ids).agg(X.E(
        f"array_sort(collect_list(named_struct('o', category_ord, 'c', category, 'v', {shown}))) AS cells"))
    item = "x -> concat('[\"', x.c, '\", ', x.v, ']')"
    return g.selectExpr(*ids, f"concat('[', array_join(transform(cells, {item}), ', '), ']') AS payload")


def parallel_lists_json(report: DataFrame, ids: list[str], order: str, lists: list[str]) -> DataFrame:
    """Chart payload of parallel lists, one row per ``ids`` group: e.g. per (carrier,
    holiday) ``{"year": [1995, ...], "ratio_holiday": [...], "ratio_baseline": [...]}``,
    or with ``ids=[]`` one row ``{"carrier": [...], "ratio": [...]}`` for the airline
    report. Each group holds one element per ``order`` value (years of a carrier, known
    carriers), so it stays small; elements are sorted by ``order``."""
    cols = [order] + [c for c in lists if c != order]
    s = "named_struct(" + ", ".join(f"'{c}', {c}" for c in cols) + ")"
    g = report.groupBy(*ids).agg(X.E(f"array_sort(collect_list({s})) AS items"))
    obj = "named_struct(" + ", ".join(f"'{c}', transform(items, x -> x.{c})" for c in cols) + ")"
    return g.selectExpr(*ids, f"to_json({obj}) AS payload")


def _display_order(report: DataFrame) -> tuple[DataFrame, list[Column]]:
    from flightperf.functions.dims import carriers_df
    order = carriers_df(report.sparkSession).select("carrier", "carrier_ord")
    out = report.join(F.broadcast(order), on="carrier", how="left")
    keys = [F.col("carrier_ord").asc_nulls_last(), F.col("carrier")]
    for c in ("flight_num", "holiday", "year", "season_ord", "category_ord"):
        if c in report.columns:
            keys.append(F.col(c))
    return out, keys


def for_display(report: DataFrame) -> DataFrame:
    """Presentation order, applied at the edge only: carriers in list order, then the
    report's own ordinals (season, category) and years ascending."""
    out, keys = _display_order(report)
    return out.orderBy(*keys).drop("carrier_ord")


def display_rank(report: DataFrame) -> DataFrame:
    """The report with ``position``: each row's place (from 1) in its carrier's presentation
    order, next to the carrier's own ordinal. Ranked by carrier, so no single task sorts all."""
    out, keys = _display_order(report)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("carrier").orderBy(*keys)))
