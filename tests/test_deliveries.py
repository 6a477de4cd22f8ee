"""Monthly files taken in once, and replaced when a month is delivered again."""

import time

import pytest
from pyspark.sql import functions as F

from flightperf.sources import csv as CSV
from flightperf.sources.deliveries import FlightStore
from flightperf.sources.fixtures import FLIGHTS_SCHEMA, flights

from tests.paths import SF001

MONTH = "_part=([0-9]{4}-[0-9]{2})"


def _rows(df):
    return sorted((tuple(r) for r in df.select(*FLIGHTS_SCHEMA.names).collect()), key=repr)


@pytest.fixture(scope="module")
def months(spark, tmp_path_factory):
    """Twelve months as written files, and one of them again with other delays."""
    base = tmp_path_factory.mktemp("months")
    f = flights(spark, SF001).where("year = 1996")
    CSV.write_ontime_csv(f, str(base / "first"), header=True, partition_col="month")
    time.sleep(0.05)
    june = f.where("month = 6").withColumn("arr_delay", F.lit(99))
    CSV.write_ontime_csv(june, str(base / "again"), header=True, partition_col="month")
    return base, f, f.where("month <> 6").unionByName(june)


def test_a_delivery_is_read_once_and_replaced_by_a_younger_one(spark, months):
    base, before, after = months
    store = FlightStore(spark, str(base / "store"), MONTH)
    assert store.flights().count() == 0
    first = store.ingest(str(base / "first"))
    assert first == [f"1996-{m:02d}" for m in range(1, 13)]
    assert _rows(store.flights()) == _rows(before)
    assert store.ingest(str(base / "first")) == [] and _rows(store.flights()) == _rows(before)
    assert store.ingest(str(base / "again")) == ["1996-06"]
    assert _rows(store.flights()) == _rows(after)
    assert store.ingest(str(base / "first")) == []         # the older June is not read again
    assert _rows(FlightStore(spark, str(base / "store"), MONTH).flights()) == _rows(after)
    sizes = {r.delivery: r.n_rows for r in store.deliveries().collect()}
    assert sum(sizes.values()) == after.count() and len(sizes) == 12


def test_listing_opens_no_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "m.csv").write_bytes(b"\xff\x00 no text")
    (tmp_path / "in" / "readme.txt").write_text("no delivery")
    plan = FlightStore(spark, str(tmp_path / "store")).pending(str(tmp_path / "in"))
    assert plan.count() == 1 and "content" not in plan._jdf.queryExecution().executedPlan().toString()


def test_archives_of_a_month(spark, months, tmp_path):
    base, before, after = months
    for name in ("first", "again"):
        CSV.zip_csv_files(spark, str(base / name), str(tmp_path / name))
    store = FlightStore(spark, str(tmp_path / "store"), "part-([0-9]{4}-[0-9]{2})")
    assert len(store.ingest(str(tmp_path / "first"), zipped=True)) == 12
    assert _rows(store.flights()) == _rows(before)
    assert store.ingest(str(tmp_path / "again"), zipped=True) == ["1996-06"]
    assert store.ingest(str(tmp_path / "first"), zipped=True) == []
    assert _rows(store.flights()) == _rows(after)


def test_empty_and_failed_deliveries(spark, months, tmp_path):
    base, before, _ = months
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(",".join(CSV.ONTIME_COLUMNS) + "\n")
    store = FlightStore(spark, str(tmp_path / "store"))
    assert len(store.ingest(str(tmp_path / "in"))) == 1 and store.flights().count() == 0
    assert store.ingest(str(tmp_path / "in")) == []
    (tmp_path / "in" / "a.zip").write_bytes(b"no archive")
    with pytest.raises(Exception):
        store.ingest(str(tmp_path / "in"), zipped=True)
    assert store.deliveries().count() == 1 and store.flights().schema == FLIGHTS_SCHEMA
