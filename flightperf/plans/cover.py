"""Date-range cover: split a half-open range [start, end) into edge days, whole months
and whole years, so a long range reads the coarse rollups instead of daily rows.

``date_cover`` is a pure function over two dates (at most five segments, driver-side
like any query parameter). ``cover_segments`` is the same rule as Spark column
expressions, for ranges that come from data. ``union_segments`` reads each segment from
its rollup and unions them (UNION ALL) before the per-key sums.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightperf.operators.rollups import MEASURES

# grain of each segment kind, per report level
LEVEL_GRAINS = {
    "carrier": {"day": "date", "month": "year_month", "year": "year"},
    "flight": {"day": "flight_date", "month": "flight_year_month", "year": "flight_year"},
}
LEVEL_IDS = {"carrier": ["carrier"], "flight": ["carrier", "flight_num"]}


def _first_of_next_month(d: dt.date) -> dt.date:
    return dt.date(d.year + (d.month == 12), d.month % 12 + 1, 1)


def date_cover(start: dt.date, end: dt.date) -> list[tuple[str, dt.date, dt.date]]:
    """Segments (kind, seg_start, seg_end), kind in day/month/year, half-open, contiguous,
    in order; together exactly [start, end). Empty when start >= end."""
    if start >= end:
        return []
    a = start if start.day == 1 else _first_of_next_month(start)   # first whole month
    z = dt.date(end.year, end.month, 1)                            # end of whole months
    if a >= z:
        return [("day", start, end)]
    segs = []
    if start < a:
        segs.append(("day", start, a))
    ya = a if a.month == 1 else dt.date(a.year + 1, 1, 1)          # first whole year
    yz = dt.date(z.year, 1, 1)
    if ya < yz:
        if a < ya:
            segs.append(("month", a, ya))
        segs.append(("year", ya, yz))
        if yz < z:
            segs.append(("month", yz, z))
    else:
        segs.append(("month", a, z))
    if z < end:
        segs.append(("day", z, end))
    return segs


def cover_segments(start: Column, end: Column) -> Column:
    """The same cover as an array<struct<seg_ord, grain, seg_start, seg_end>> column."""
    a = F.when(F.dayofmonth(start) == 1, start).otherwise(F.add_months(F.trunc(start, "month"), 1))
    z = F.trunc(end, "month")
    ya = F.when(F.month(a) == 1, a).otherwise(F.make_date(F.year(a) + 1, F.lit(1), F.lit(1)))
    yz = F.make_date(F.year(z), F.lit(1), F.lit(1))
    months = a < z
    years = months & (ya < yz)
    nul = F.lit(None).cast("date")

    def seg(i, kind, s, e, cond=None):
        if cond is not None:
            s, e = F.when(cond, s).otherwise(nul), F.when(cond, e).otherwise(nul)
        return F.struct(F.lit(i).alias("seg_ord"), F.lit(kind).alias("grain"),
                        s.alias("seg_start"), e.alias("seg_end"))

    segs = F.array(
        seg(1, "day", start, F.when(months, a).otherwise(end)),
        seg(2, "month", a, F.when(years, ya).otherwise(z), months),
        seg(3, "year", ya, yz, years),
        seg(4, "month", yz, z, years),
        seg(5, "day", z, end, months),
    )
    return F.filter(segs, lambda s: s["seg_start"] < s["seg_end"])


def _segment_filter(kind: str, s: dt.date, e: dt.date) -> str:
    """Predicate (SQL text) selecting one segment's rows from its rollup: plain column
    comparisons, so Parquet gets them as pushed filters, plus explicit year bounds so the
    scan prunes ``year`` partitions of a written rollup."""
    if kind == "day":
        return (f"flight_date >= DATE'{s.isoformat()}' AND flight_date < DATE'{e.isoformat()}' "
                f"AND year >= {s.year} AND year <= {e.year}")
    if kind == "month":
        return (f"year >= {s.year} AND year <= {e.year} "
                f"AND (year > {s.year} OR (year = {s.year} AND month >= {s.month})) "
                f"AND (year < {e.year} OR (year = {e.year} AND month < {e.month}))")
    if kind == "year":
        return f"year >= {s.year} AND year < {e.year}"
    raise ValueError(kind)


_SUMS = [f"CAST(sum({m}) AS BIGINT) AS {m}" for m in MEASURES]


def union_segments(wh, start: dt.date, end: dt.date, level: str = "carrier",
                   key_filter: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Per-key sums of all measures over [start, end), read through the cover.

    Each segment reads its own rollup (days / year-months / years); the segments are
    concatenated with UNION ALL and summed per key. Equal to a direct daily scan.
    ``extra`` rows (same columns) join the union before the one aggregation.
    """
    ids = LEVEL_IDS[level]
    parts = []
    for kind, s, e in date_cover(start, end):
        g = wh.grain(LEVEL_GRAINS[level][kind]).where(_segment_filter(kind, s, e))
        if key_filter is not None:
            g = g.where(key_filter)
        parts.append(g.select(*ids, *MEASURES))
    if not parts:  # empty range: keep the schema, no rows
        g = wh.grain(LEVEL_GRAINS[level]["day"])
        parts.append(g.where("false").select(*ids, *MEASURES))
    if extra is not None:
        parts.append(extra.select(*ids, *MEASURES))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.groupBy(*ids).agg(*[F.expr(a) for a in _SUMS])


def direct_range(wh, start: dt.date, end: dt.date, level: str = "carrier",
                 key_filter: Column | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Per-key sums over [start, end) from the daily rollup only (``extra`` rows are
    unioned in before the aggregation)."""
    ids = LEVEL_IDS[level]
    g = wh.grain(LEVEL_GRAINS[level]["day"]).where(_segment_filter("day", start, end))
    if key_filter is not None:
        g = g.where(key_filter)
    g = g.select(*ids, *MEASURES)
    if extra is not None:
        g = g.unionByName(extra.select(*ids, *MEASURES))
    return g.groupBy(*ids).agg(*[F.expr(a) for a in _SUMS])


def many_ranges(wh, requests: DataFrame, level: str = "carrier", start: str = "range_start", end: str = "range_end") -> DataFrame:
    """Sums over many ranges at once: every row of ``requests`` (the level's ids, a start and an end date, any
    other columns) with the measures of its half-open range, 0 where nothing flew or the range is empty.

    Each range is taken apart into the days, months and years of its cover (at most 60 days, 22 months and
    its years), which find their sums by one equality join on (ids, kind, first day of the period)."""
    ids = LEVEL_IDS[level]
    taken = {c.lower() for c in requests.columns}
    if taken & {m.lower() for m in MEASURES}:
        raise ValueError(f"requests may not have the columns {MEASURES}")
    request = F.struct(*[F.col(f"`{c}`") for c in requests.columns]).alias("__request")
    # equal requests are answered once
    asked = requests.groupBy(request).agg(F.count(F.lit(1)).alias("__times")).select("__request", "__times", "__request.*")
    segs = asked.select("__request", "__times", *ids, F.inline_outer(cover_segments(F.col(start), F.col(end))))
    periods = segs.select(
        "__request", "__times", *ids, F.col("grain").alias("__kind"),
        F.explode_outer(F.expr("""CASE grain
            WHEN 'day' THEN sequence(seg_start, date_sub(seg_end, 1), INTERVAL 1 DAY)
            WHEN 'month' THEN sequence(seg_start, add_months(seg_end, -1), INTERVAL 1 MONTH)
            WHEN 'year' THEN sequence(seg_start, add_months(seg_end, -12), INTERVAL 1 YEAR) END""")).alias("__period"))
    first = {"day": "flight_date", "month": "make_date(year, month, 1)", "year": "make_date(year, 1, 1)"}
    sums = None
    for kind, grain in LEVEL_GRAINS[level].items():
        g = wh.groups(grain).selectExpr(*[f"{i} AS __{i}" for i in ids], f"'{kind}' AS __k", f"{first[kind]} AS __p", *MEASURES)
        sums = g if sums is None else sums.unionByName(g)
    same = [F.col(i) == F.col(f"__{i}") for i in ids] + [F.col("__kind") == F.col("__k"), F.col("__period") == F.col("__p")]
    found = periods.join(sums, same, "left").groupBy("__request", "__times").agg(
        *[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES])
    return found.select("__request.*", *MEASURES, F.explode(F.sequence(F.lit(1), F.col("__times"))).alias("__n")).drop("__n")
