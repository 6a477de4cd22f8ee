"""The written side: order of rows in files, row groups that can be skipped, whole builds,
whole exports, archives, point reads, and answers on odd input."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from flightperf.__main__ import main
from flightperf.operators import joins as J
from flightperf.operators import keyed as K
from flightperf.operators import rollups as R
from flightperf.plans import reports as Q
from flightperf.plans.queries import dirty_flights
from flightperf.plans.warehouse import SORT_KEYS, Warehouse, build_all, export_tables
from flightperf.session import cluster_conf, scratch_path
from flightperf.sources import csv as CSV
from flightperf.sources import sinks as S
from flightperf.sources.fixtures import flights

from tests.paths import SF001


def _files(path):
    local = path[len("file:"):] if path.startswith("file:") else path
    return glob.glob(f"{local}/**/*.parquet", recursive=True)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _sorted(path, keys):
    for f in _files(path):
        rows = [tuple((v is not None, v) for v in r) for r in zip(*(pq.ParquetFile(f).read(columns=[k])[k].to_pylist() for k in keys))]
        assert rows == sorted(rows), f


@pytest.fixture(scope="module")
def dirty(spark):
    f = dirty_flights(spark, SF001)
    return f, build_all(f)


def test_rows_are_in_key_order_in_every_file(spark, dirty):
    for grain in R.GRAINS:
        _sorted(f"{dirty[1].path}/{grain}", SORT_KEYS[grain])
    p = scratch_path(spark, "order")
    S.write_flights_parquet(flights(spark, SF001), p)
    _sorted(p, ["flight_date", "carrier", "flight_num"])
    p = scratch_path(spark, "order")
    S.write_table(Warehouse.from_flights(flights(spark, SF001)).delay("flight_quarter"), p, ["year"])
    _sorted(p, ["key"])


def test_row_groups_can_be_skipped(spark):
    """With small row groups, the statistics of most of them exclude one carrier."""
    wh = Warehouse.from_flights(flights(spark, SF001))
    p = scratch_path(spark, "groups")
    spark.conf.set("parquet.block.size", "1024")
    try:
        (wh.grain("flight_date").repartition(1).sortWithinPartitions("year", *SORT_KEYS["flight_date"])
         .write.option("parquet.block.size", 2048).option("parquet.page.row.count.limit", 100)
         .option("parquet.block.row.count.limit", 200).partitionBy("year").parquet(p))
    finally:
        spark.conf.unset("parquet.block.size")
    hit = total = 0
    for f in _files(p):
        m = pq.ParquetFile(f).metadata
        at = m.schema.names.index("carrier")
        for g in range(m.num_row_groups):
            s = m.row_group(g).column(at).statistics
            total += 1
            hit += s.min <= "AA" <= s.max
    assert total > len(_files(p)) and hit < total


def test_written_and_lazy_tables_agree_with_unreadable_dates(spark, dirty):
    f, built = dirty
    lazy = Warehouse.from_flights(f)
    for name, (grain, _) in R.TABLES.items():
        assert _rows(built.table(name)) == _rows(lazy.table(name)), name


def test_a_half_done_build_is_never_read(spark):
    home = scratch_path(spark, "half")
    build_all(flights(spark, SF001), home)
    before = _rows(Warehouse.load(spark, home).table("year_fcount"))
    broken = flights(spark, SF001).withColumn("arr_delay", F.expr("raise_error('stop')").cast("int"))
    with pytest.raises(Exception):
        build_all(broken, home)
    assert _rows(Warehouse.load(spark, home).table("year_fcount")) == before


def test_exports_keep_every_row(spark, dirty):
    f, built = dirty
    path = scratch_path(spark, "tsv")
    export_tables(built, path)
    for name in ("date_fcount", "delay_flightNum_date"):
        assert spark.read.text(f"{path}/{name}").count() == built.table(name).count()
    assert built.table("date_fcount").where("key IS NULL").count() > 0


def test_archives_of_the_same_name_stay_apart(spark, tmp_path):
    for y in (2013, 2014):
        d = tmp_path / "csv" / str(y) / "01"
        d.mkdir(parents=True)
        (d / "ontime.csv").write_text(f"Year,Quarter\n{y},1\n")
    out = scratch_path(spark, "zips")
    assert CSV.zip_csv_files(spark, str(tmp_path / "csv"), out) == 2
    assert sorted(r.year for r in CSV.read_flights_zip(spark, out).collect()) == [2013, 2014]


def test_a_line_longer_than_a_block(spark, tmp_path):
    import io
    import zipfile
    long = "x" * 1000
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", f"h\n{long}\nb\r\n\nlast")
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([str(tmp_path / "a.zip")]), pa.array([0])], names=["archive", "place"])
    got = [ln for b in CSV._unzip_lines(CSV._opener(), True, 64)([batch]) for ln in b.column("line").to_pylist()]
    assert got == [long, "b", "last"] and io


def test_point_reads_prune_years(spark):
    p = scratch_path(spark, "points")
    S.write_table(Warehouse.from_flights(flights(spark, SF001)).delay("flight_quarter"), p, ["year"])
    t = S.read_table(spark, p)
    some = [r.key for r in t.limit(5).collect()]
    got = K.read_keys(t, some + ["ZZ_1_1997_1"], year_part=-2)
    assert sorted(r.key for r in got.collect()) == sorted(some)
    plan = K.read_keys(t, ["AA_2_1997_1", "AA_2_1998_4"], year_part=-2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "1997" in plan.split("PartitionFilters: [")[1][:80]
    assert K.read_keys(t, [f"k{i}" for i in range(3000)] + some).count() == 5      # any number of keys, one way
    assert K.read_keys(t, ["no-year"], year_part=-2).count() == 0


def test_null_groups_match(spark, edge_flights):
    f = edge_flights.withColumn("flight_date", F.lit(None).cast("date"))
    wh = Warehouse.from_flights(f)
    rows = J.join_delay_count(wh.count("date"), wh.delay("date"), ["carrier", "flight_date"]).collect()
    assert sum(r.carrier_num for r in rows) == sum(r.carrier_num for r in wh.delay("date").collect()) > 0


def test_a_quote_in_the_carrier(spark):
    wh = Warehouse.from_flights(flights(spark, SF001))
    rows = Q.delay_holiday(wh, "O'X", "Christmas", (1995, 1996)).collect()
    assert [(r.carrier, r.year, r.ratio_holiday) for r in sorted(rows, key=lambda r: r.year)] == [
        ("O'X", 1995, 0.0), ("O'X", 1996, 0.0)]


def test_command_line_periods_and_years(spark, capsys):
    home = scratch_path(spark, "cli")
    build_all(flights(spark, SF001), home)
    for half in (["--from", "03/15/1996"], ["--to", "03/15/1996"]):
        with pytest.raises(SystemExit):
            main(["report", "delay_category", "--warehouse", home, *half])
    main(["report", "delay_holiday", "--warehouse", home, "--holiday", "Christmas", "--years", "1995-1996"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert lines[0].startswith("carrier\t") and {ln.split("\t")[2] for ln in lines[1:]} == {"1995", "1996"}
    main(["report", "delay_category", "--warehouse", home, "--from", "03/15/1996", "--to", "11/20/1999"])
    want = Q.delay_category(Warehouse.load(spark, home), None, dt.date(1996, 3, 15), dt.date(1999, 11, 20)).count()
    assert len(capsys.readouterr().out.strip().splitlines()) == want + 1


def test_shuffle_partitions_at_100_tb():
    n = int(cluster_conf(10_000, 100 << 40)["spark.sql.shuffle.partitions"])
    assert 20_000 <= n <= 100_000
    assert int(cluster_conf(8, 1 << 30)["spark.sql.shuffle.partitions"]) == 16
