"""Flights from the driver's test tables.

The test tables hold no flights, so ``lineitem`` is mapped to one flight per row with
integer arithmetic only (FIXTURES.md section 5). The result has the working columns of
a projected on-time file, so everything downstream is the engine's own code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from flightperf.functions.dims import CARRIER_CODES

FLIGHT_COLUMNS = [
    "carrier", "flight_num", "flight_date", "year", "quarter", "month", "day_of_month", "day_of_week",
    "arr_delay", "cancelled", "arr_del15",
    "carrier_delay", "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay",
]


def _utc_date_sql(dtype, c: str) -> str:
    """Calendar date of a ship timestamp, independent of the session time zone."""
    if isinstance(dtype, T.TimestampType):
        # instant semantics: take the UTC day from epoch microseconds
        return f"date_from_unix_date(CAST(floor(unix_micros({c}) / 86400000000) AS INT))"
    if isinstance(dtype, (T.TimestampNTZType, T.DateType)):
        return f"CAST({c} AS DATE)"
    return f"to_date({c})"


def flights_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Map lineitem rows to flights. Only 8 lineitem columns are read (column pruning).
    Doubles are rounded half away from zero before the int cast, as the mapping does."""
    codes = ", ".join(f"'{c}'" for c in CARRIER_CODES)
    ship = _utc_date_sql(lineitem.schema["l_shipdate"].dataType, "l_shipdate")
    b = lineitem.selectExpr(
        "l_orderkey", "l_linenumber",
        f"CASE WHEN l_suppkey % 26 >= 0 THEN try_element_at(array({codes}), CAST(l_suppkey % 26 + 1 AS INT)) "
        "END AS carrier",
        "CAST(l_partkey % 40 + 1 AS STRING) AS flight_num",
        f"{ship} AS flight_date",
        "CAST(round(l_quantity) AS INT) AS q",
        "CAST(round(l_discount * 100) AS INT) AS d",
        "CAST(round(l_tax * 100) AS INT) AS t",
    )
    c = b.selectExpr(
        "*",
        "CASE WHEN l_linenumber = 7 AND q % 5 = 0 THEN CAST(NULL AS INT) ELSE q - 25 END AS arr_delay",
        "CASE WHEN t = 8 AND l_linenumber = 6 THEN CAST(NULL AS INT) WHEN d = 10 THEN 1 ELSE 0 END AS cancelled",
    )

    def cause(mod: int, rem: int, name: str) -> str:
        return (f"CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % {mod} = {rem} THEN arr_delay ELSE 0 END "
                f"END AS {name}")

    return c.selectExpr(
        "carrier", "flight_num", "flight_date",
        "year(flight_date) AS year", "quarter(flight_date) AS quarter", "month(flight_date) AS month",
        "dayofmonth(flight_date) AS day_of_month",
        "weekday(flight_date) + 1 AS day_of_week",  # 1 = Monday .. 7 = Sunday
        "arr_delay", "cancelled",
        "CASE WHEN arr_delay IS NULL THEN CAST(NULL AS INT) WHEN arr_delay >= 15 THEN 1 ELSE 0 END AS arr_del15",
        cause(3, 0, "carrier_delay"), cause(11, 0, "weather_delay"), cause(4, 1, "nas_delay"),
        cause(97, 0, "security_delay"), cause(5, 2, "late_aircraft_delay"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flights relation of the test data at ``sf_dir``."""
    return flights_from_lineitem(read_table(spark, sf_dir, "lineitem"))


FLIGHTS_SCHEMA = T.StructType([
    T.StructField("carrier", T.StringType()),
    T.StructField("flight_num", T.StringType()),
    T.StructField("flight_date", T.DateType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("day_of_month", T.IntegerType()),
    T.StructField("day_of_week", T.IntegerType()),
    T.StructField("arr_delay", T.IntegerType()),
    T.StructField("cancelled", T.IntegerType()),
    T.StructField("arr_del15", T.IntegerType()),
    T.StructField("carrier_delay", T.IntegerType()),
    T.StructField("weather_delay", T.IntegerType()),
    T.StructField("nas_delay", T.IntegerType()),
    T.StructField("security_delay", T.IntegerType()),
    T.StructField("late_aircraft_delay", T.IntegerType()),
])
