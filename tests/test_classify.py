from pyspark.sql import functions as F

from flightperf.operators import classify as C
from flightperf.operators import rollups as R
from flightperf.plans.warehouse import Warehouse


def test_flags_on_edge_rows(edge_flights):
    rows = C.classify(edge_flights).select("carrier_b", "nas_b", "other_b").collect()
    flags = [tuple(r) for r in rows]
    assert flags[0] == (1, 0, 0)           # plain delay: carrier flag
    assert flags[1] == (1, 1, 0)           # two causes, two flags
    assert flags[2] == (0, 0, 1)           # all causes null -> unclassified
    assert flags[3] == (1, 0, 0)           # negative minutes still flag


def test_filters_three_valued(edge_flights):
    c = C.classify(edge_flights)
    assert C.filter_operated(c).count() == 6       # cancelled=1 and cancelled=NULL dropped
    assert C.filter_delayed(c).count() == 4        # diverted and null-carrier (arr_del15=0) not delayed


def test_count_ignores_null_carrier_but_keeps_group(edge_flights):
    wh = Warehouse.from_flights(edge_flights)
    cnt = {(r.carrier, str(r.flight_date)): r.num_flights for r in wh.count("date").collect()}
    assert cnt[(None, "2014-06-03")] == 0          # group exists, COUNT(carrier) = 0
    assert cnt[("AA", "2014-06-03")] == 1          # only the diverted flight operated
    assert cnt[("AA", "2014-06-01")] == 2
    delay = {r.key: r for r in wh.delay("date").collect()}
    assert set(delay) == {"AA_2014-06-01", "AA_2014-06-02"}
    d1 = delay["AA_2014-06-01"]
    assert (d1.carrier_num, d1.nas_num, d1.other_num) == (2, 1, 0)
    d2 = delay["AA_2014-06-02"]
    assert (d2.carrier_num, d2.other_num) == (1, 1)


def test_null_key_dropped_at_sink(spark, edge_flights, tmp_path):
    from flightperf.sources import sinks as S
    wh = Warehouse.from_flights(edge_flights)
    p = str(tmp_path / "t")
    S.write_table(wh.count("date"), p)
    assert S.read_table(spark, p).where(F.col("key").isNull()).count() == 0


def test_keys_format(edge_flights):
    wh = Warehouse.from_flights(edge_flights)
    keys = {g: sorted(r.key for r in wh.count(g).where("carrier = 'AA'").collect()) for g in R.GRAINS}
    assert keys["date"][0] == "AA_2014-06-01"
    assert keys["year"] == ["AA_2014"]
    assert keys["month"] == ["AA_6"]
    assert keys["year_month"] == ["AA_2014-06"]
    assert keys["flight_date"][0] == "AA_1_2014-06-01"
    assert keys["flight_quarter"] == ["AA_1_2014_2"]
    assert keys["flight_month"] == ["AA_1_6"]
    assert keys["flight_year_month"] == ["AA_1_2014-06"]
