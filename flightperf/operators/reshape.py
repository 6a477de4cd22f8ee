"""Reshapes: counters <-> category rows, quarters -> season columns, on-time arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.functions.dims import CATEGORIES, CATEGORY_COLUMNS, COUNTERS, SEASON_LABELS

_ORD = {name: i for i, name in enumerate(CATEGORIES)}


def with_on_time(totals: DataFrame) -> DataFrame:
    """Add ``flag_total`` (sum of the six counters), ``on_time`` = flights - flag_total
    (as the application computes it; a flight with several flags is subtracted several
    times, so it can go negative) and ``on_time_exact`` = flights - delayed flights."""
    flag_total = "CAST(" + " + ".join(COUNTERS) + " AS BIGINT)"
    extra = [f"{flag_total} AS flag_total", f"CAST(num_flights - {flag_total} AS BIGINT) AS on_time"]
    if "delayed_flights" in totals.columns:
        extra.append("CAST(num_flights - delayed_flights AS BIGINT) AS on_time_exact")
    return totals.selectExpr("*", *extra)


def unpivot_categories(totals: DataFrame, ids: list[str]) -> DataFrame:
    """Six counter columns -> six rows (ids..., category_ord, category, value)."""
    long = totals.selectExpr(*ids, *[f"CAST({c} AS BIGINT) AS {c}" for c in COUNTERS]).unpivot(
        ids, COUNTERS, "counter", "value")
    label = "CASE counter " + " ".join(f"WHEN '{c}' THEN '{n}'" for n, c in CATEGORY_COLUMNS.items()) + " END"
    ordn = "CASE counter " + " ".join(f"WHEN '{c}' THEN {_ORD[n]}" for n, c in CATEGORY_COLUMNS.items()) + " END"
    return long.selectExpr(*ids, f"{ordn} AS category_ord", f"{label} AS category", "CAST(value AS BIGINT) AS value")


def category_rows(totals: DataFrame, ids: list[str], drop_empty: bool = True,
                  on_time: str = "observed") -> DataFrame:
    """On Time + the six categories, one row each, as a narrow in-row generator (no join).

    ``drop_empty`` keeps On Time always and a category only if its count is at least 1.
    ``on_time="observed"``: flights - sum of the six flags (the application's figure);
    ``"exact"``: flights - delayed flights (a flight with several flags counted once).
    Output: ids..., num_flights, category_ord, category, value.
    """
    t = with_on_time(totals)
    ot = "on_time_exact" if on_time == "exact" else "on_time"
    cells = [f"named_struct('category_ord', 0, 'category', 'On Time', 'value', {ot})"]
    for name, counter in CATEGORY_COLUMNS.items():
        cells.append(f"named_struct('category_ord', {_ORD[name]}, 'category', '{name}', "
                     f"'value', CAST({counter} AS BIGINT))")
    out = t.selectExpr(*ids, "num_flights", f"inline(array({', '.join(cells)}))")
    if drop_empty:
        out = out.where("category_ord = 0 OR value >= 1")
    return out


def pivot_seasons(flights_by_quarter: DataFrame, ids: list[str], labels: str = "as_observed",
                  measure: str = "num_flights") -> DataFrame:
    """Quarter rows -> one column per season (lower-case label), 0 where a quarter is missing.

    Uses ``pivot`` with the value list given, so Spark needs no extra job to find values.
    """
    names = SEASON_LABELS[labels]
    season = "CASE quarter " + " ".join(f"WHEN {q} THEN '{n.lower()}'" for q, n in names.items()) + " END"
    order = [names[q].lower() for q in sorted(names)]
    piv = (flights_by_quarter.selectExpr("*", f"{season} AS season")
           .groupBy(*ids).pivot("season", order).agg(F.sum(measure)))
    return piv.selectExpr(*ids, *[f"CAST(coalesce({s}, 0) AS BIGINT) AS {s}" for s in order])
