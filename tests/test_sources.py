import datetime as dt

from pyspark.sql import functions as F

from flightperf.functions import exprs as X
from flightperf.session import scratch_path
from flightperf.sources import csv as CSV
from flightperf.sources.fixtures import flights
from flightperf.sources.schema import ONTIME_COLUMNS

from tests.paths import SF001


def test_lenient_int(spark):
    df = spark.createDataFrame([("20.00",), ("1.00",), ("0.00",), ("",), ("x",), (None,), ("-5.00",), ("7.9",)], "t string")
    got = [r.v for r in df.select(X.lenient_int("t").alias("v")).collect()]
    assert got == [20, 1, 0, None, None, None, -5, 7]


def _line(values: dict) -> str:
    cells = []
    for c in ONTIME_COLUMNS:
        v = values.get(c, "")
        cells.append(v)
    return ",".join(cells) + ","   # surplus trailing field, as in the published files


def test_positional_csv_with_quotes(spark, tmp_path):
    row = {"Year": "2014", "Quarter": "2", "Month": "6", "DayofMonth": "1", "DayOfWeek": "7",
           "FlightDate": "2014-06-01", "UniqueCarrier": '"AA"', "FlightNum": "123",
           "OriginCityName": '"Dallas, TX"', "DestCityName": '"He said ""x"""',
           "ArrDelay": "20.00", "ArrDel15": "1.00", "Cancelled": "0.00", "CarrierDelay": "20.00",
           "WeatherDelay": "", "NASDelay": "x"}
    p = tmp_path / "f.csv"
    p.write_text(_line(row) + "\n")
    raw = CSV.read_raw_csv(spark, str(p)).collect()[0]
    assert raw.OriginCityName == "Dallas, TX"
    assert raw.DestCityName == 'He said "x"'
    w = CSV.read_flights_csv(spark, str(p)).collect()[0]
    assert (w.carrier, w.flight_num, w.flight_date) == ("AA", "123", dt.date(2014, 6, 1))
    assert (w.arr_delay, w.arr_del15, w.cancelled, w.carrier_delay, w.weather_delay, w.nas_delay) == (20, 1, 0, 20, None, None)


def _rows(df):
    cols = ["carrier", "flight_num", "flight_date", "arr_delay", "arr_del15", "cancelled", "carrier_delay",
            "weather_delay", "nas_delay", "security_delay", "late_aircraft_delay"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_roundtrips_match_flights(spark):
    f = flights(spark, SF001)
    want = _rows(f)
    p1 = scratch_path(spark, "t-plain")
    CSV.write_ontime_csv(f, p1)
    assert _rows(CSV.read_flights_csv(spark, p1)) == want
    p2 = scratch_path(spark, "t-header")
    CSV.write_ontime_csv(f, p2, header=True)
    assert _rows(CSV.read_flights_csv(spark, p2, header=True)) == want
    p3 = scratch_path(spark, "t-dir")
    CSV.write_ontime_csv(f, p3, partition_col="month")
    assert _rows(CSV.read_flights_dir(spark, p3)) == want
    p4, p5 = scratch_path(spark, "t-unz"), scratch_path(spark, "t-zip")
    CSV.write_ontime_csv(f, p4, header=True, partition_col="month")
    n = CSV.zip_csv_files(spark, p4, p5)
    assert n > 10
    assert _rows(CSV.read_flights_zip(spark, p5, header=True)) == want


def test_written_text_is_not_shuffled(spark):
    f = flights(spark, SF001)
    plan = CSV._to_write(f, None)._jdf.queryExecution().optimizedPlan().toString()
    assert "Rebalance" not in plan and "AS FlightDate#" in plan
    plan = CSV._to_write(f, "month")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("AS FlightDate#") < plan.index("Sort [_part") < plan.index("RebalancePartitions")   # text comes last


def test_rows_of_no_date_are_written(spark):
    f = flights(spark, SF001).limit(40).withColumn(
        "flight_date", F.when(F.col("flight_num") != "1", F.col("flight_date"))).unionByName(
        flights(spark, SF001).limit(3).withColumn("flight_date", F.lit(None).cast("date"))).localCheckpoint()
    path = scratch_path(spark, "t-no-date")
    CSV.write_ontime_csv(f, path, partition_col="month")
    assert _rows(CSV.read_flights_dir(spark, path)) == _rows(f)
    parts = {r._part for r in spark.read.text(path).select(F.col("_part").cast("string")).distinct().collect()}
    assert None in parts and len(parts) > 1


def test_zip_reader_has_no_python_in_parse(spark):
    p4, p5 = scratch_path(spark, "t-unz2"), scratch_path(spark, "t-zip2")
    CSV.write_ontime_csv(flights(spark, SF001).limit(50), p4, header=True)
    CSV.zip_csv_files(spark, p4, p5)
    plan = CSV.read_flights_zip(spark, p5, spread=True)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan             # the unzip step only (Arrow batches, no pandas)
    assert "BatchEvalPython" not in plan    # no row-at-a-time Python
    assert "RoundRobinPartitioning" in plan  # lines of a big archive are parsed by many tasks


def test_mdy_to_iso_is_lenient(spark):
    df = spark.createDataFrame([("06/01/2014",), ("",), ("2014-06-01",), (None,)], "s string")
    got = [r.v for r in df.select(X.mdy_to_iso("s").alias("v")).collect()]
    assert got == ["2014-06-01", "", None, None]


def test_flights_parquet_roundtrip_and_pushdown(spark):
    import datetime as dt
    from flightperf.plans import reports as Q
    from flightperf.plans.warehouse import Warehouse
    from flightperf.sources import sinks as S
    f = flights(spark, SF001)
    p = scratch_path(spark, "flights-pq")
    S.write_flights_parquet(f, p)
    back = S.read_flights_parquet(spark, p)
    assert _rows(back) == _rows(f)
    rep = Q.delay_category(Warehouse.from_flights(back), None, dt.date(1996, 3, 15), dt.date(1999, 11, 20))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")   # show every pushed filter
    try:
        plan = rep._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(flight_date,1996-03-15)" in plan
    assert sorted(map(tuple, rep.collect())) == sorted(
        map(tuple, Q.delay_category(Warehouse.from_flights(f), None, dt.date(1996, 3, 15), dt.date(1999, 11, 20)).collect()))


def test_zip_with_several_members_and_a_readme(spark, tmp_path):
    import zipfile
    header = ",".join(ONTIME_COLUMNS)
    row = {"Year": "2014", "Quarter": "2", "Month": "6", "DayofMonth": "1", "DayOfWeek": "7",
           "FlightDate": "2014-06-01", "UniqueCarrier": "AA", "FlightNum": "1", "ArrDelay": "20.00",
           "ArrDel15": "1.00", "Cancelled": "0.00", "CarrierDelay": "20.00"}
    z = tmp_path / "zips"
    z.mkdir()
    with zipfile.ZipFile(z / "month.zip", "w") as zf:
        zf.writestr("a.csv", header + "\n" + _line(row) + "\n")
        zf.writestr("b.csv", header + "\r\n" + _line(dict(row, FlightNum="2")) + "\r\n")
        zf.writestr("readme.html", "<html>not data</html>")
    got = sorted((r.carrier, r.flight_num, r.arr_delay) for r in CSV.read_flights_zip(spark, str(z)).collect())
    assert got == [("AA", "1", 20), ("AA", "2", 20)]


def test_each_member_is_a_task_of_its_own(spark, tmp_path):
    """One archive of twelve members (two of one name) and an empty one: twelve tasks inflate, same rows."""
    import zipfile

    from pyspark.sql import functions as F
    header = ",".join(ONTIME_COLUMNS)
    row = {"Year": "2014", "Month": "6", "FlightDate": "2014-06-01", "UniqueCarrier": "AA", "Cancelled": "0.00"}
    z = tmp_path / "zips"
    z.mkdir()
    names = [f"m{i:02d}.csv" for i in range(11)] + ["m00.csv"]
    with zipfile.ZipFile(z / "year.zip", "w") as zf:
        for i, name in enumerate(names):
            zf.writestr(name, header + "\n" + (_line(dict(row, FlightNum=str(i))) + "\n") * (i + 1))
        zf.writestr("notes.txt", "no data")
    zipfile.ZipFile(z / "empty.zip", "w").close()
    assert CSV.zip_members(spark, str(z)).count() == 12
    lines = CSV.read_zip_lines(spark, str(z), spread=False)
    tasks = lines.select(F.spark_partition_id().alias("task"), F.substring_index(F.substring_index("line", ",", 11), ",", -1).alias("f"))
    per_task = tasks.groupBy("task").agg(F.countDistinct("f").alias("n")).collect()
    assert len(per_task) == 12 and all(r.n == 1 for r in per_task)
    got = CSV.read_flights_zip(spark, str(z), keep_archive=True).groupBy("archive", "flight_num").count().collect()
    assert sorted((int(r.flight_num), r["count"]) for r in got) == [(i, i + 1) for i in range(12)]
    assert all(r.archive.endswith("year.zip") for r in got)
