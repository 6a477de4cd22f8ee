"""Small fixed dimensions of the domain.

Each one is a literal of a few dozen rows at most, so it is safe to broadcast;
their size does not grow with the flight data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the source application's for equal results)
# Carrier codes and display names, in the application's list order.
CARRIERS = [
    ("9E", "Pinnacle Airlines"),
    ("AA", "American Airlines"),
    ("AQ", "Aloha Airlines"),
    ("AS", "Alaska Airlines"),
    ("B6", "JetBlue Airways"),
    ("CO", "Continental Airlines"),
    ("DH", "Atlantic Coast Airlines"),
    ("DL", "Delta Air Lines"),
    ("E*", "ExpressJet Combined EV"),
    ("EV", "Atlantic Southeast Airlines"),
    ("F9", "Frontier Airlines"),
    ("FL", "AirTran Airways"),
    ("HA", "Hawaiian Airlines"),
    ("HP", "America West Airlines"),
    ("MQ", "American Eagle"),
    ("NW", "Northwest Airlines"),
    ("OH", "Comair"),
    ("OO", "SkyWest Airlines"),
    ("TW", "Trans World Airlines"),
    ("TZ", "ATA Airlines"),
    ("UA", "United Airlines"),
    ("US", "US Airways"),
    ("VX", "Virgin America"),
    ("WN", "Southwest Airlines"),
    ("XE", "ExpressJet Airlines"),
    ("YV", "Mesa Airlines"),
]

# Fixed-date holidays as (name, month, day); Thanksgiving is a movable feast
# (fourth Thursday of November) and is computed per year.
FIXED_HOLIDAYS = [
    ("New Year", 1, 1),
    ("Christmas", 12, 25),
    ("Independence Day", 7, 4),
]
THANKSGIVING = "Thanksgiving"
HOLIDAYS = ["New Year", "Christmas", "Thanksgiving", "Independence Day"]

# Report categories in display order (ordinal 0..6); On Time first.
CATEGORIES = ["On Time", "NAS", "Security", "Weather", "Late Aircraft", "Carrier", "Unclassified"]

# Counter column of each delay category.
CATEGORY_COLUMNS = {
    "NAS": "nas_num",
    "Security": "security_num",
    "Weather": "weather_num",
    "Late Aircraft": "late_aircraft_num",
    "Carrier": "carrier_num",
    "Unclassified": "other_num",
}

# Quarter -> season label. "as_observed" is the application's own labelling,
# "calendar" the meteorological one (quarter 1 = January..March = Winter).
SEASON_LABELS = {
    "as_observed": {1: "Fall", 2: "Winter", 3: "Spring", 4: "Summer"},
    "calendar": {1: "Winter", 2: "Spring", 3: "Summer", 4: "Fall"},
}
# END FIXED VALUES
# ---------------------------------------------------------------------------

CARRIER_CODES = [c for c, _ in CARRIERS]

# The six per-flight cause flags and the counters they sum into.
FLAG_TO_COUNTER = [
    ("carrier_b", "carrier_num"),
    ("weather_b", "weather_num"),
    ("nas_b", "nas_num"),
    ("security_b", "security_num"),
    ("late_aircraft_b", "late_aircraft_num"),
    ("other_b", "other_num"),
]
COUNTERS = [c for _, c in FLAG_TO_COUNTER]
FLAGS = [f for f, _ in FLAG_TO_COUNTER]
# raw cause minutes -> flag
CAUSE_TO_FLAG = [
    ("carrier_delay", "carrier_b"),
    ("weather_delay", "weather_b"),
    ("nas_delay", "nas_b"),
    ("security_delay", "security_b"),
    ("late_aircraft_delay", "late_aircraft_b"),
]


def carriers_df(spark: SparkSession, codes: list[str] | None = None) -> DataFrame:
    """Carrier dimension (carrier, carrier_name, carrier_ord); 26 rows at most."""
    keep = set(codes) if codes is not None else None
    rows = [(c, n, i) for i, (c, n) in enumerate(CARRIERS) if keep is None or c in keep]
    schema = T.StructType([
        T.StructField("carrier", T.StringType(), False),
        T.StructField("carrier_name", T.StringType(), False),
        T.StructField("carrier_ord", T.IntegerType(), False),
    ])
    return spark.createDataFrame(rows, schema)
