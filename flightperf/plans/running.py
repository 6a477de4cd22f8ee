"""Running totals: any date range of a carrier or flight as the difference of two rows.

A table of running totals holds, for each carrier (or carrier and flight), one row a flight day with the
sums of all days up to and including it, valid until the next one. A row never stays valid beyond its
year: each later year of the data starts with a row of its own. So the totals before a day ``d`` are the rows of
one year that are valid on the day before it, and a range ``[start, end)`` is the totals before ``end``
less those before ``start``: two days are looked up in at most two year partitions, however long the
range is. (The cover of :mod:`flightperf.plans.cover` adds up to five segments of three grains.)

Flights without a readable date belong to no range.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightperf.operators.rollups import MEASURES
from flightperf.plans.cover import LEVEL_GRAINS, LEVEL_IDS

_IDS = {"carrier": "carrier string", "flight": "carrier string, flight_num string"}
_TOTALS = ", ".join(f"{m} bigint" for m in MEASURES)


def running_totals(wh, level: str = "carrier") -> DataFrame:
    """ids, valid_from, valid_to, the sums of all days up to ``valid_from``, year."""
    ids = LEVEL_IDS[level]
    daily = (wh.grain(LEVEL_GRAINS[level]["day"]).where("flight_date IS NOT NULL")
             .groupBy(*ids, "flight_date").agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES]))
    last = daily.agg(F.max(F.year("flight_date")).alias("y")).scalar()
    # the first day of every later year, without flights of its own
    starts = (daily.groupBy(*ids).agg(F.min(F.year("flight_date")).alias("first"))
              .select(*ids, F.explode(F.sequence(F.col("first"), last)).alias("y"))
              .groupBy(*ids, F.make_date("y", F.lit(1), F.lit(1)).alias("flight_date")).agg(
                  *[F.lit(0).cast("long").alias(m) for m in MEASURES]))
    days = daily.unionByName(starts).groupBy(*ids, "flight_date").agg(*[F.sum(m).alias(m) for m in MEASURES])
    w = Window.partitionBy(*ids).orderBy("flight_date")      # days of one carrier or flight: bounded by the calendar
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    next_year = F.make_date(F.year("flight_date") + 1, F.lit(1), F.lit(1))
    return days.select(*ids, F.col("flight_date").alias("valid_from"),
                       F.coalesce(F.lead("flight_date").over(w), next_year).alias("valid_to"),
                       *[F.sum(m).over(upto).alias(m) for m in MEASURES], F.year("flight_date").alias("year"))


class RunningTotals:
    """Written running totals of both levels."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.last_year = spark.read.schema("last_year int").parquet(f"{path}/span").agg(F.max("last_year")).first()[0]

    @classmethod
    def write(cls, wh, path: str, levels: tuple[str, ...] = ("carrier", "flight")) -> "RunningTotals":
        for level in levels:
            t = running_totals(wh, level).hint("rebalance", "year")
            (t.sortWithinPartitions("year", *LEVEL_IDS[level], "valid_from")
             .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("year").parquet(f"{path}/{level}"))
        spark = wh.grain("date").sparkSession
        years = spark.read.schema(f"{_IDS[levels[0]]}, year int").parquet(f"{path}/{levels[0]}")
        years.agg(F.max("year").alias("last_year")).write.mode("overwrite").parquet(f"{path}/span")
        return cls(spark, path)

    def before(self, day: dt.date, level: str = "carrier", key_filter: Column | None = None) -> DataFrame:
        """ids and the sums of all days before ``day``; one row for each id that flew by then."""
        x = day - dt.timedelta(days=1)
        if self.last_year is not None and x.year > self.last_year:
            x = dt.date(self.last_year, 12, 31)
        t = self.spark.read.schema(f"{_IDS[level]}, valid_from date, valid_to date, {_TOTALS}, year int").parquet(f"{self.path}/{level}")
        t = t.where((F.col("year") == x.year) & (F.col("valid_from") <= F.lit(x)) & (F.col("valid_to") > F.lit(x)))
        if key_filter is not None:
            t = t.where(key_filter)
        return t.select(*LEVEL_IDS[level], *MEASURES)

    def range_totals(self, start: dt.date, end: dt.date, level: str = "carrier", key_filter: Column | None = None,
                     extra: DataFrame | None = None) -> DataFrame:
        """Sums over ``[start, end)`` of each id with flights in it (as in ``cover.direct_range``; flights without a
        carrier count nowhere)."""
        ids = LEVEL_IDS[level]
        if start >= end:
            both = self.before(start, level, key_filter).where("false")
        else:
            less = self.before(start, level, key_filter).select(*ids, *[(-F.col(m)).alias(m) for m in MEASURES])
            both = self.before(end, level, key_filter).unionByName(less)
        # an id that flew before the range only has equal totals
        out = both.groupBy(*ids).agg(*[F.sum(m).cast("long").alias(m) for m in MEASURES]).where("num_flights <> 0")
        return out if extra is None else out.unionByName(extra.select(*ids, *MEASURES)).groupBy(*ids).agg(
            *[F.sum(m).cast("long").alias(m) for m in MEASURES])
