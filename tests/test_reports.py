import datetime as dt

import pytest
from pyspark.sql import functions as F

from flightperf.functions import exprs as X
from flightperf.plans import reports as Q
from flightperf.plans.warehouse import Warehouse
from flightperf.sources.fixtures import flights

from tests.paths import SF01

R1 = (dt.date(1996, 3, 15), dt.date(1999, 11, 20))
R2 = (dt.date(1995, 11, 5), dt.date(1996, 2, 3))


@pytest.fixture(scope="module")
def wh(spark):
    return Warehouse.from_flights(flights(spark, SF01))


def test_category_report_expected_numbers(wh):
    rows = {r.category: r for r in Q.delay_category(wh, "AA", *R1).collect()}
    got = {k: v.value for k, v in rows.items()}
    assert got == {"On Time": 935, "NAS": 57, "Security": 3, "Weather": 21, "Late Aircraft": 61,
                   "Carrier": 90, "Unclassified": 105}
    assert abs(sum(r.ratio for r in rows.values()) - 1.0) < 1e-5   # shares add up to 1
    # cover and direct scan agree
    via_cover = sorted(tuple(r) for r in Q.delay_category(wh, "AA", *R1, use_cover=True).collect())
    assert via_cover == sorted(tuple(r) for r in Q.delay_category(wh, "AA", *R1, use_cover=False).collect())


def test_category_report_november_range(wh):
    rows = Q.delay_category(wh, "aa", *R2).collect()
    on_time = [r.value for r in rows if r.category == "On Time"][0]
    flags = sum(r.value for r in rows if r.category != "On Time")
    assert (on_time + flags, flags) == (90, 32)


def test_unknown_carrier_gets_zero_on_time_row(wh):
    rows = Q.delay_category(wh, "ZZ", *R1).collect()
    assert [(r.category, r.value, r.ratio) for r in rows] == [("On Time", 0, 0.0)]


def test_flight_report(wh):
    rows = Q.flight_delay(wh, "AA", "2", *R1).collect()
    on_time = [r.value for r in rows if r.category == "On Time"][0]
    flags = sum(r.value for r in rows if r.category != "On Time")
    assert (on_time + flags, flags) == (35, 9)


def test_season_report(wh):
    rows = Q.season_delay(wh, "AA", "2", 1997, labels="as_observed").collect()
    assert len(rows) == 28
    n = {q: 0 for q in range(1, 5)}
    flags = {q: 0 for q in range(1, 5)}
    for r in rows:
        n[r.season_ord] += r.value
        if r.category != "On Time":
            flags[r.season_ord] += r.value
    assert [n[q] for q in range(1, 5)] == [2, 2, 4, 5]
    assert [flags[q] for q in range(1, 5)] == [1, 1, 2, 0]
    assert {r.season for r in rows if r.season_ord == 1} == {"Fall"}
    cal = Q.season_delay(wh, "AA", "2", 1997).collect()
    assert {r.season for r in cal if r.season_ord == 1} == {"Winter"}


def test_holiday_report(spark, wh):
    rows = {r.year: r for r in Q.delay_holiday(wh, "AA", "Christmas", (1995, 2001)).collect()}
    assert sorted(rows) == list(range(1995, 2002))
    # December flights on the 25th / 15th: 1995 1/1, 1997 2/2, 1998 2/0, 2000 2/1
    days = (wh.grain("date").where((F.col("carrier") == "AA") & (F.col("month") == 12))
            .where(F.dayofmonth("flight_date").isin(15, 25)).collect())
    n = {(r.year, r.flight_date.day): r.num_flights for r in days}
    assert n == {(1995, 25): 1, (1995, 15): 1, (1997, 25): 2, (1997, 15): 2, (1998, 25): 2,
                 (2000, 25): 2, (2000, 15): 1}
    assert rows[1996].ratio_holiday == 0.0 and rows[1996].ratio_baseline == 0.0


def test_thanksgiving(spark):
    df = spark.createDataFrame([(y,) for y in range(2010, 2020)], "y int")
    got = {r.y: r.d for r in df.select("y", X.thanksgiving("y").alias("d")).collect()}
    assert got[2012] == dt.date(2012, 11, 22)
    assert got[2013] == dt.date(2013, 11, 28)
    for y, d in got.items():
        assert d.weekday() == 3 and d.month == 11 and 22 <= d.day <= 28


def test_airline_report(wh):
    rows = Q.airline_delays(wh, *R1).collect()
    assert len(rows) == 26 and all(r.num_flights > 0 for r in rows)
    short = Q.airline_delays(wh, *R1, carriers=["AA", "DL"]).collect()
    assert sorted(r.carrier for r in short) == ["AA", "DL"]


def test_run_report_dispatch(wh):
    with pytest.raises(ValueError):
        Q.run_report(wh, "nope")
    with pytest.raises(ValueError):
        Q.run_report(wh, "delay_season", carrier="AA")
    with pytest.raises(ValueError):
        Q.run_report(wh, "delay_category", carrier="AA", start="2000-01-02", end="2000-01-01")
    with pytest.raises(ValueError):
        Q.run_report(wh, "delay_category", carrier="AA", start="", end="2000-01-01")
    a = Q.run_report(wh, "delay_category", carrier="aa", start="03/15/1996", end="11/20/1999").collect()
    b = Q.delay_category(wh, "AA", *R1).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_report_json(wh):
    rep = Q.delay_category(wh, "AA", *R1)
    payload = Q.report_json(rep, ["carrier"]).collect()[0].payload
    assert payload.startswith('[["On Time", 0.735063]')
    import json
    assert len(json.loads(payload)) == 7


def test_exact_on_time_and_display_order(wh):
    rows = {r.category: r.value for r in Q.delay_category(wh, "AA", *R1, on_time="exact").collect()}
    assert rows["On Time"] == 1272 - 279          # operated - delayed (FIXTURES numbers)
    shown = Q.for_display(Q.delay_category(wh, None, *R1)).collect()
    assert shown[0].carrier == "9E" and shown[0].category_ord == 0
    assert [r.category_ord for r in shown[:7]] == sorted(r.category_ord for r in shown[:7])


def test_keyed_reads(spark, wh):
    from flightperf.operators import keyed as K
    t = wh.count("date")
    keys = [r.key for r in t.limit(5).collect()]
    assert sorted(r.key for r in K.read_keys(t, keys + ["ZZ_1900-01-01"]).collect()) == sorted(keys)
    many = [f"XX_{i}" for i in range(1500)] + keys[:2]
    assert sorted(r.key for r in K.read_keys(t, many).collect()) == sorted(keys[:2])
    rng = K.read_key_range(t, "AA_1996-03-15", "AA_1999-11-20")
    assert rng.agg(F.sum("num_flights")).collect()[0][0] == 1272


def test_parallel_lists_payload(wh):
    import json
    rep = Q.delay_holiday(wh, "AA", "Christmas", (1995, 2001))
    row = Q.parallel_lists_json(rep, ["carrier", "holiday"], "year", ["ratio_holiday", "ratio_baseline"]).collect()[0]
    p = json.loads(row.payload)
    assert p["year"] == list(range(1995, 2002))
    assert len(p["ratio_holiday"]) == len(p["ratio_baseline"]) == 7
    air = Q.parallel_lists_json(Q.airline_delays(wh, *R1), [], "carrier", ["ratio"]).collect()
    assert len(air) == 1 and len(json.loads(air[0].payload)["carrier"]) == 26
