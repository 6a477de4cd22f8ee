"""Joins between rollup families and with the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightperf.functions.dims import CARRIER_CODES, COUNTERS, carriers_df


def join_delay_count(counts: DataFrame, delays: DataFrame, dims: list[str]) -> DataFrame:
    """Match delay counters to flight counts on the same key: counts LEFT JOIN delays.

    Groups without a delayed flight get 0 counters. No broadcast hint: both sides grow
    with the data, so the join strategy is left to AQE, which switches to a broadcast
    only when the runtime size of a side is under the threshold.
    """
    c, d = counts.select(*dims, "num_flights").alias("c"), delays.select(*dims, *COUNTERS).alias("d")
    same = [F.col(f"c.{x}").eqNullSafe(F.col(f"d.{x}")) for x in dims]   # NULL parts are a group too
    j = c.join(d, on=same, how="left")
    return j.select(*[F.col(f"c.{x}").alias(x) for x in dims], *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS],
                    "num_flights")


def write_families(counts: DataFrame, delays: DataFrame, name: str, path: str, buckets: int) -> None:
    """Write both families of a grain as tables ``<name>_counts`` and ``<name>_delays``, bucketed and sorted by
    their key into the same number of buckets, so that :func:`match_families` moves no row."""
    for part, df in (("counts", counts), ("delays", delays)):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}_{part}")
        # one file a bucket: rows are dealt by the hash that bucketing uses
        (df.repartition(buckets, "key").write.bucketBy(buckets, "key").sortBy("key").mode("overwrite")
         .option("path", f"{path}/{part}").saveAsTable(f"{name}_{part}"))


def match_families(spark: SparkSession, name: str, dims: list[str]) -> DataFrame:
    """The match of :func:`join_delay_count` on tables of :func:`write_families`: bucket by bucket on the
    key, without a shuffle. Groups with a NULL part have no key; these few are matched by their parts."""
    c, d = spark.table(f"{name}_counts"), spark.table(f"{name}_delays")
    keyed = c.where("key IS NOT NULL").alias("c").join(
        d.where("key IS NOT NULL").select("key", *COUNTERS).alias("d"), "key", "left")
    keyed = keyed.select(*dims, *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in COUNTERS], "num_flights")
    return keyed.unionByName(join_delay_count(c.where("key IS NULL"), d.where("key IS NULL"), dims))


def join_carrier_name(df: DataFrame) -> DataFrame:
    """Add ``carrier_name``; the dimension has 26 rows, so it is broadcast."""
    names = carriers_df(df.sparkSession).select("carrier", "carrier_name")
    return df.join(F.broadcast(names), on="carrier", how="left")


def semi_known_carriers(df: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Keep rows whose carrier is in the allow-list (default: all 26 known codes)."""
    known = carriers_df(df.sparkSession, codes if codes is not None else CARRIER_CODES).select("carrier")
    return df.join(F.broadcast(known), on="carrier", how="left_semi")
