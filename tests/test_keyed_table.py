"""Keyed tables: files that share no key, reads that open only what they need, merges by key."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flightperf.plans.warehouse import Warehouse
from flightperf.session import scratch_path
from flightperf.sources import keyed_table as K
from flightperf.sources.fixtures import flights
from flightperf.sources.keyed_table import KeyedTable

from tests.paths import SF001


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few KB, so that small tables have many files."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize",
             "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, ("2k", "1k", "16")):
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.fixture
def counts(spark):
    return Warehouse.from_flights(flights(spark, SF001)).count("date")


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _files(table):
    return {r.file: r for r in table.manifest().collect()}


def _opened(df):
    return {f.replace("file:///", "file:/") for f in df.inputFiles()}


def _disjoint(table):
    spans = sorted((r.min_key, r.max_key) for r in _files(table).values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])), spans
    return len(spans)


def test_files_share_no_key_and_reads_open_only_matching_ones(spark, small_ranges, counts):
    t = KeyedTable.write(counts, scratch_path(spark, "keyed"))
    assert _disjoint(t) >= 8
    files = _files(t)
    assert sum(r.rows for r in files.values()) == counts.where("key IS NOT NULL").count()
    start, stop = "AA_1996-03-15", "AA_1999-11-20"
    got = t.read_range(start, stop)
    assert _rows(got) == _rows(counts.where((F.col("key") >= start) & (F.col("key") < stop)))
    meet = {f for f, r in files.items() if r.max_key >= start and r.min_key < stop}
    assert _opened(got) == meet and 0 < len(meet) < len(files)
    some = [r.key for r in counts.where("key IS NOT NULL").orderBy("key").limit(3).collect()]
    got = t.read_keys([*some, "ZZ_none"])
    assert sorted(r.key for r in got.collect()) == some and len(_opened(got)) < len(files) / 2
    assert t.read_keys(["0", "~"]).count() == 0 and t.read_keys([]).count() == 0
    assert t.read_range("B", "A").count() == 0
    assert _rows(KeyedTable.load(spark, t.path).scan()) == _rows(counts.where("key IS NOT NULL"))


def test_a_merge_rewrites_only_the_slots_of_its_keys(spark, small_ranges, counts):
    t = KeyedTable.write(counts, scratch_path(spark, "keyed"))
    before = _files(t)
    updates = counts.where("carrier = 'DL' AND year(flight_date) = 1997").withColumn("num_flights", F.lit(-1).cast("long"))
    new = spark.createDataFrame([("DL_1997-00-00", "DL", None, 7), ("00", "00", None, 8), ("~", "~", None, 9)], counts.schema)
    after = t.merge(updates.unionByName(new))
    want = {r.key: tuple(r) for r in counts.where("key IS NOT NULL").collect()}
    want |= {r.key: tuple(r) for r in updates.unionByName(new).collect()}
    assert _rows(after.scan()) == sorted(want.values(), key=repr)
    _disjoint(after)
    changed = [f for f in before if f not in _files(after)]
    assert 0 < len(changed) < len(before) / 2
    first, last = min(before.values(), key=lambda r: r.min_key), max(before.values(), key=lambda r: r.min_key)
    for f in changed:       # the slots of DL's keys and the outermost ones
        r = before[f]
        assert (r.min_key <= "DL_1998" and r.max_key >= "DL_1997") or r.slot in (first.slot, last.slot), r
    assert _rows(t.scan()) == _rows(counts.where("key IS NOT NULL"))        # an older version stays readable


def test_merges_of_merges(spark, small_ranges):
    schema = "key string, at int, v string"
    t = KeyedTable.write(spark.createDataFrame([(f"k{i:03d}", 0, "a") for i in range(0, 400, 2)], schema), scratch_path(spark, "keyed"))
    want = {f"k{i:03d}": (0, "a") for i in range(0, 400, 2)}
    for step in range(1, 4):
        rows = [(f"k{i:03d}", step * 10 + j, f"{step}{j}") for i in range(step * 60, step * 60 + 90, 3) for j in (0, 2, 1)]
        t = t.merge(spark.createDataFrame(rows + [(None, 99, "x")], schema).repartition(5), newest="at")
        want |= {k: (step * 10 + 2, f"{step}2") for k, _, _ in rows}
        _disjoint(t)
        assert {r.key: (r.at, r.v) for r in KeyedTable.load(spark, t.path).scan().collect()} == want
        assert t.scan().count() == len(want)


def test_ties_nulls_and_empty_tables(spark):
    schema = "key string, v int, w string"
    path = scratch_path(spark, "keyed")
    t = KeyedTable.write(spark.createDataFrame([(None, 1, "a")], schema), path)
    assert t.scan().count() == 0 and t.scan().schema == T.StructType.fromDDL(schema)
    t = t.merge(spark.createDataFrame([("b", None, "x"), ("b", 1, None), ("b", 1, "q"), ("a", None, None)], schema))
    assert _rows(t.scan()) == [("a", None, None), ("b", 1, "q")]
    t = t.merge(spark.createDataFrame([], schema))
    assert t.scan().count() == 2
    t = t.merge(spark.createDataFrame([("b", None, None)], schema))         # an update wins over a stored row
    assert _rows(t.scan()) == [("a", None, None), ("b", None, None)]
    with pytest.raises(ValueError):
        t.merge(spark.createDataFrame([("a", 1)], "key string, v int"))
    with pytest.raises(ValueError):
        KeyedTable.load(spark, scratch_path(spark, "none"))


def test_a_failed_or_outdated_merge_publishes_nothing(spark):
    schema = "key string, v int"
    t = KeyedTable.write(spark.createDataFrame([("a", 1), ("b", 2)], schema), scratch_path(spark, "keyed"))
    bad = spark.createDataFrame([("a", 3)], schema).withColumn("v", F.expr("raise_error('stop')").cast("int"))
    with pytest.raises(Exception):
        t.merge(bad)
    assert _rows(KeyedTable.load(spark, t.path).scan()) == [("a", 1), ("b", 2)]
    t.merge(spark.createDataFrame([("a", 4)], schema))
    with pytest.raises(RuntimeError, match="another writer"):
        t.merge(spark.createDataFrame([("b", 5)], schema))                  # from the version before
    assert _rows(KeyedTable.load(spark, t.path).scan()) == [("a", 4), ("b", 2)]


def test_a_merge_shuffles_its_rows_once(spark, counts):
    path = scratch_path(spark, "rows")
    counts.select("key", F.length("key").alias("slot"), "num_flights", F.lit(1).alias(K.AGE)).write.parquet(path)
    rows = spark.read.parquet(path)
    kept = K._last_rows(rows.repartitionByRange("slot", "key"), ["slot", "key"], None)
    plan = kept.sortWithinPartitions("slot", "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "rangepartitioning(slot" in plan
