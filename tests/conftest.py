import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests.paths import EDGE_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from flightperf.session import get_session
    s = get_session("local[*]", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def edge_flights(spark):
    """Hand-made edge rows (FIXTURES.md section 6) with calendar columns added."""
    import datetime as dt
    from pyspark.sql import functions as F
    d = dt.date
    rows = [
        ("AA", "1", d(2014, 6, 1), 20, 1, 0, 20, 0, 0, 0, 0),        # plain delay
        ("AA", "1", d(2014, 6, 1), 40, 1, 0, 20, 0, 20, 0, 0),       # two causes
        ("AA", "1", d(2014, 6, 2), 16, 1, 0, None, None, None, None, None),  # unclassified
        ("AA", "1", d(2014, 6, 2), 16, 1, 0, -1, 0, 0, 0, 0),        # negative cause
        ("AA", "1", d(2014, 6, 3), None, None, 1, None, None, None, None, None),  # cancelled
        ("AA", "1", d(2014, 6, 3), 20, 1, None, 20, 0, 0, 0, 0),     # null cancelled
        ("AA", "1", d(2014, 6, 3), None, None, 0, None, None, None, None, None),  # diverted
        (None, "1", d(2014, 6, 3), 0, 0, 0, None, None, None, None, None),  # null carrier
    ]
    df = spark.createDataFrame(rows, EDGE_SCHEMA)
    return df.select(
        "*", F.year("flight_date").alias("year"), F.quarter("flight_date").alias("quarter"),
        F.month("flight_date").alias("month"), F.dayofmonth("flight_date").alias("day_of_month"),
        (F.weekday("flight_date") + 1).alias("day_of_week"))
