"""The positional 109-column on-time file layout."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES: column names of the on-time performance files, in file order
# (the 23rd is read as DestCityMarketID).
ONTIME_COLUMNS = [
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "FlightDate", "UniqueCarrier", "AirlineID",
    "Carrier", "TailNum", "FlightNum", "OriginAirportID", "OriginAirportSeqID", "OriginCityMarketID",
    "Origin", "OriginCityName", "OriginState", "OriginStateFips", "OriginStateName", "OriginWac",
    "DestAirportID", "DestAirportSeqID", "DestCityMarketID", "Dest", "DestCityName", "DestState",
    "DestStateFips", "DestStateName", "DestWac", "CRSDepTime", "DepTime", "DepDelay", "DepDelayMinutes",
    "DepDel15", "DepartureDelayGroups", "DepTimeBlk", "TaxiOut", "WheelsOff", "WheelsOn", "TaxiIn",
    "CRSArrTime", "ArrTime", "ArrDelay", "ArrDelayMinutes", "ArrDel15", "ArrivalDelayGroups", "ArrTimeBlk",
    "Cancelled", "CancellationCode", "Diverted", "CRSElapsedTime", "ActualElapsedTime", "AirTime",
    "Flights", "Distance", "DistanceGroup", "CarrierDelay", "WeatherDelay", "NASDelay", "SecurityDelay",
    "LateAircraftDelay", "FirstDepTime", "TotalAddGTime", "LongestAddGTime", "DivAirportLandings",
    "DivReachedDest", "DivActualElapsedTime", "DivArrDelay", "DivDistance",
    "Div1Airport", "Div1AirportID", "Div1AirportSeqID", "Div1WheelsOn", "Div1TotalGTime",
    "Div1LongestGTime", "Div1WheelsOff", "Div1TailNum",
    "Div2Airport", "Div2AirportID", "Div2AirportSeqID", "Div2WheelsOn", "Div2TotalGTime",
    "Div2LongestGTime", "Div2WheelsOff", "Div2TailNum",
    "Div3Airport", "Div3AirportID", "Div3AirportSeqID", "Div3WheelsOn", "Div3TotalGTime",
    "Div3LongestGTime", "Div3WheelsOff", "Div3TailNum",
    "Div4Airport", "Div4AirportID", "Div4AirportSeqID", "Div4WheelsOn", "Div4TotalGTime",
    "Div4LongestGTime", "Div4WheelsOff", "Div4TailNum",
    "Div5Airport", "Div5AirportID", "Div5AirportSeqID", "Div5WheelsOn", "Div5TotalGTime",
    "Div5LongestGTime", "Div5WheelsOff", "Div5TailNum",
]
# Columns the loader types as integers (all others are text).
INT_COLUMNS = [
    "Year", "Quarter", "Month", "DayofMonth", "DayOfWeek", "DepDelay", "DepDelayMinutes", "DepDel15",
    "ArrDelay", "ArrDelayMinutes", "ArrDel15", "Cancelled", "CarrierDelay", "WeatherDelay", "NASDelay",
    "SecurityDelay", "LateAircraftDelay",
]
# END FIXED VALUES
# ---------------------------------------------------------------------------

assert len(ONTIME_COLUMNS) == 109 and len(set(ONTIME_COLUMNS)) == 109

# The file is read as text in every column; integers are typed afterwards, leniently
# (see functions.exprs.lenient_int), because the published files write ``1.00``.
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in ONTIME_COLUMNS])

# on-time column -> working column name
WORKING_NAMES = {
    "UniqueCarrier": "carrier", "Year": "year", "Quarter": "quarter", "Month": "month",
    "DayofMonth": "day_of_month", "DayOfWeek": "day_of_week", "FlightDate": "flight_date",
    "FlightNum": "flight_num", "ArrDelay": "arr_delay", "ArrDel15": "arr_del15", "Cancelled": "cancelled",
    "CarrierDelay": "carrier_delay", "WeatherDelay": "weather_delay", "NASDelay": "nas_delay",
    "SecurityDelay": "security_delay", "LateAircraftDelay": "late_aircraft_delay",
}
