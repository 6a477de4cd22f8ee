"""Projection, cause classification and the two row filters (narrow, codegen'd)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flightperf.functions import exprs as X
from flightperf.functions.dims import CAUSE_TO_FLAG

# The 11 calendar / identity / status columns every job keeps.
DIM_COLUMNS = [
    "carrier", "year", "quarter", "month", "day_of_month", "day_of_week",
    "flight_date", "flight_num", "arr_delay", "arr_del15", "cancelled",
]
CAUSE_COLUMNS = [c for c, _ in CAUSE_TO_FLAG]


def project_flights(df: DataFrame, with_causes: bool = True) -> DataFrame:
    """Prune a wide flight relation to the 16 columns the jobs read (11 without causes)."""
    return df.select(*(DIM_COLUMNS + (CAUSE_COLUMNS if with_causes else [])))


def classify_causes(df: DataFrame) -> DataFrame:
    """Replace the five cause-minute columns by 0/1 flags."""
    keep = [c for c in df.columns if c not in CAUSE_COLUMNS]
    return df.selectExpr(*keep, *[f"{X.cause_flag_sql(c)} AS {f}" for c, f in CAUSE_TO_FLAG])


def classify_other(df: DataFrame) -> DataFrame:
    """Add ``other_b`` (unclassified delay) to flagged rows."""
    return df.selectExpr("*", f"{X.other_flag_sql()} AS other_b")


def classify(df: DataFrame) -> DataFrame:
    """Both classification steps: five flags + unclassified (Catalyst collapses the
    projections into one)."""
    return classify_other(classify_causes(project_flights(df)))


def filter_operated(df: DataFrame) -> DataFrame:
    return df.where(X.is_operated())


def filter_delayed(df: DataFrame) -> DataFrame:
    return df.where(X.is_delayed())


def with_delay_marker(df: DataFrame) -> DataFrame:
    """Operated rows keep one int ``is_del`` so delay and count families share one pass."""
    return df.selectExpr("*", f"CASE WHEN {X.DELAYED_SQL} THEN 1 ELSE 0 END AS is_del")
