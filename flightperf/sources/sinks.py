"""Sinks: keyed rollup tables as Parquet (delay / count families), tab-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, order_by: list[str] | None = None,
                bloom: dict[str, int] | None = None) -> None:
    """Overwrite semantics: a re-run replaces the table, equal keys keep one row.
    Rows with a NULL key are dropped (a keyed store cannot hold them).

    Files are in key order unless ``order_by`` says otherwise. ``bloom`` names columns (with the distinct
    values expected in a row group) that get a Bloom filter: an equality on a column that the file is not
    ordered by, such as the flight keys of a table ordered by date, then skips row groups that cannot hold it."""
    out = df.where(df["key"].isNotNull()) if "key" in df.columns else df
    lead = list(partition_by or [])
    order = lead + (order_by or [c for c in ("key",) if c in out.columns])
    if lead:
        out = out.hint("rebalance", *lead)      # files by data size, not tasks x partitions
    if order:
        out = out.sortWithinPartitions(*order)  # keys in order inside each file
    w = out.write.mode("overwrite").option("partitionOverwriteMode", "static")
    for column, distinct in (bloom or {}).items():
        w = (w.option(f"parquet.bloom.filter.enabled#{column}", "true")
             .option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))
    if lead:
        w = w.partitionBy(*lead)
    w.parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated text, no header, one folder of part files."""
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Read tab-separated text back with its schema (numbers typed on read)."""
    return spark.read.schema(schema).option("sep", "\t").option("header", False).csv(path)


def write_flights_parquet(flights: DataFrame, path: str) -> None:
    """Store parsed flights (working columns) once as Parquet, partitioned by ``year``
    and sorted by date inside each file, so later scans read 16 typed columns instead of
    tokenizing 109 CSV fields, prune years and skip row groups on ``flight_date``."""
    (flights.hint("rebalance", "year").sortWithinPartitions("year", "flight_date", "carrier", "flight_num")
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("year").parquet(path))


def read_flights_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Flights written by :func:`write_flights_parquet`, columns in working order."""
    from flightperf.sources.fixtures import FLIGHT_COLUMNS
    df = spark.read.parquet(path)
    return df.select(*[c for c in FLIGHT_COLUMNS if c in df.columns])
