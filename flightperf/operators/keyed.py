"""Keyed reads on rollup tables: point reads and half-open key ranges.

Keys are ``_``-joined text (``AA_2014-06-01``); ranges compare as text like a sorted
key-value store does. Prefer typed dimension predicates where the caller knows them:
those prune ``year`` partitions and push down to Parquet row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _years(keys: list[str], part: int) -> list[int] | None:
    """The years that the keys name in one of their parts (of a date its first four digits)."""
    found = set()
    for k in keys:
        cells = k.split("_")
        year = cells[part][:4] if -len(cells) <= part < len(cells) else ""
        if not (len(year) == 4 and year.isdigit()):
            return None
        found.add(int(year))
    return sorted(found)


def read_keys(table: DataFrame, keys: list[str], year_part: int | None = None) -> DataFrame:
    """Rows whose ``key`` is in ``keys`` (missing keys simply produce no row): a semi join with
    the key list. ``year_part`` says which ``_``-part of a key holds the year; a table that is
    partitioned by ``year`` then reads those years only."""
    keys = list(dict.fromkeys(keys))
    years = _years(keys, year_part) if year_part is not None and "year" in table.columns else None
    if years:
        table = table.where(F.col("year").isin(years))
    return table.join(table.sparkSession.createDataFrame([(k,) for k in keys], "key string"), on="key", how="left_semi")


def read_key_range(table: DataFrame, start_key: str, stop_key: str) -> DataFrame:
    """Rows with ``start_key <= key < stop_key`` (stop exclusive)."""
    return table.where((F.col("key") >= start_key) & (F.col("key") < stop_key))
