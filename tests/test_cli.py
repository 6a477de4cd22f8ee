import os

from flightperf.__main__ import main
from flightperf.session import scratch_path
from flightperf.sources import csv as CSV
from flightperf.sources.fixtures import flights
from flightperf.plans.warehouse import Warehouse

from tests.paths import SF001


def test_build_report_export(spark, capsys):
    src = scratch_path(spark, "cli-src")
    CSV.write_ontime_csv(flights(spark, SF001), src, header=True, partition_col="month")
    wh_path = scratch_path(spark, "cli-wh")
    assert main(["build", "--input", src, "--format", "dir", "--header", "--warehouse", wh_path]) == 0
    wh = Warehouse.load(spark, wh_path)
    lazy = Warehouse.from_flights(flights(spark, SF001))
    assert wh.count("date").count() == lazy.count("date").count()
    out = scratch_path(spark, "cli-report")
    assert main(["report", "delay_category", "--warehouse", wh_path, "--from", "03/15/1996",
                 "--to", "11/20/1999", "--out", out]) == 0
    assert spark.read.parquet(out).where("category = 'On Time'").count() > 0
    main(["report", "delay_holiday", "--warehouse", wh_path, "--carrier", "aa", "--holiday", "Christmas"])
    assert "Christmas" in capsys.readouterr().out
    exp = scratch_path(spark, "cli-export")
    assert main(["export", "--warehouse", wh_path, "--out", exp, "--tables", "date_fcount,delay_month_count"]) == 0
    local = exp[len("file:"):] if exp.startswith("file:") else exp
    assert sorted(os.listdir(local)) == ["date_fcount", "delay_month_count"]
    back = spark.read.option("sep", "\t").csv(f"{exp}/date_fcount")
    assert back.count() == wh.count("date").count()


def test_add_a_delivery(spark, capsys):
    f = flights(spark, SF001)
    old, new, wh_path = (scratch_path(spark, "cli-add") for _ in range(3))
    CSV.write_ontime_csv(f.where("year < 1998"), old, header=True)
    CSV.write_ontime_csv(f.where("year >= 1998"), new, header=True)
    main(["build", "--input", old, "--header", "--warehouse", wh_path])
    main(["add", "--input", new, "--header", "--warehouse", wh_path])
    got, want = Warehouse.load(spark, wh_path).count("year"), Warehouse.from_flights(f).count("year")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
