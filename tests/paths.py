"""Paths of the test data and the schema of hand-made flights, imported by name in the tests."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

EDGE_SCHEMA = ("carrier string, flight_num string, flight_date date, arr_delay int, arr_del15 int, cancelled int, "
               "carrier_delay int, weather_delay int, nas_delay int, security_delay int, late_aircraft_delay int")
