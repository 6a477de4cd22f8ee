"""The rollup warehouse: every grain of the combined rollup, either lazy (derived from a
flight DataFrame inside one plan) or materialized as Parquet tables.

``build_all`` is the batch job: one scan of the flights, the finest grain written first
(cutting lineage, so a lost executor recomputes from Parquet, not from the raw scan),
then each coarser grain re-aggregated from the written table one level finer.

``add_flights`` brings in a new delivery (a quarter, say) without reading history: every measure is
a sum, so the delivery is rolled up on its own and added to the years that it touches. The new build holds
these years only; for the others it points to the build that it is based on.

Every grain's write is measured while it runs (rows, flights, delayed flights). A build is published
only if all grains hold the same flights.
"""

from __future__ import annotations

import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from flightperf.operators import rollups as R
from flightperf.session import scratch_path

# grains in build order (each parent precedes its children)
BUILD_ORDER = ["flight_date", "flight_year_month", "flight_year", "flight_quarter", "flight_month",
               "date", "year_month", "year", "month"]

# clustering inside each written file, so Parquet row-group statistics skip by carrier/flight
SORT_KEYS = {
    "flight_date": ["carrier", "flight_num", "flight_date"],
    "flight_year_month": ["carrier", "flight_num", "month"],
    "flight_year": ["carrier", "flight_num"],
    "flight_quarter": ["carrier", "flight_num", "quarter"],
    "flight_month": ["carrier", "flight_num", "month"],
    "date": ["carrier", "flight_date"],
    "year_month": ["carrier", "month"],
    "year": ["carrier"],
    "month": ["carrier", "month"],
}


# ``replaced``: the years of each grain that a build holds (none named: the whole grain); the other
# years are those of its base
PUBLISHED = ("build string, at double, base string, replaced array<struct<grain: string, years: array<int>>>, "
             "flights bigint, delayed bigint")


class BuildMismatch(RuntimeError):
    """The grains of a build don't hold the same flights; it was not published."""


class Warehouse:
    """Grain name -> combined rollup DataFrame. Grains are built on first access, so a
    report touching two grains only plans those two."""

    def __init__(self, factory: Callable[[str], DataFrame], path: str | None = None):
        self._factory = factory
        self._grains: dict[str, DataFrame] = {}
        self.path = path
        self.running = None      # plans.running.RunningTotals, if written

    @property
    def materialized(self) -> bool:
        return self.path is not None

    @classmethod
    def from_flights(cls, flights: DataFrame) -> "Warehouse":
        ops = R.operated(flights)
        return cls(lambda g: R.aggregate_flights(ops, g))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Warehouse":
        """The build that ``path`` published last; a build that failed half way is never seen."""
        builds = _builds(spark, path)
        return cls(lambda g: _read_grain(spark, path, builds, g), f"{path}/{builds[0].build}")

    def grain(self, name: str) -> DataFrame:
        if name not in R.GRAINS:
            raise KeyError(f"unknown grain {name!r}; known: {sorted(R.GRAINS)}")
        if name not in self._grains:
            self._grains[name] = self._factory(name)
        return self._grains[name]

    def groups(self, grain: str) -> DataFrame:
        """One row for each public group (a written day grain holds one a calendar entry)."""
        return R.merged(self.grain(grain), grain)

    def delay(self, grain: str) -> DataFrame:
        return R.delay_view(self.groups(grain), grain)

    def count(self, grain: str) -> DataFrame:
        return R.count_view(self.groups(grain), grain)

    def table(self, name: str) -> DataFrame:
        """A table by its application name, e.g. ``delay_date_count`` or ``year_fcount``."""
        grain, family = R.TABLES[name]
        return self.delay(grain) if family == "delay" else self.count(grain)


def _builds(spark: SparkSession, path: str) -> list:
    """The newest published build and those that it is based on, newest first."""
    known = {r.build: r for r in spark.read.schema(PUBLISHED).json(f"{path}/published").toLocalIterator()}
    if not known:
        raise ValueError(f"no published build under {path}")
    chain = [max(known.values(), key=lambda r: r["at"])]
    while chain[-1].base:
        chain.append(known[chain[-1].base])
    return chain


def _in_years(years: list) -> Column:
    """Rows of these years, None for rows without one (pruned as partitions)."""
    dated = F.col("year").isin([y for y in years if y is not None])
    return dated | F.col("year").isNull() if None in years else F.col("year").isNotNull() & dated


def _read_grain(spark: SparkSession, path: str, builds: list, grain: str) -> DataFrame:
    """A grain from the newest build of each of its years."""
    out, covered = None, []
    for b in builds:
        held = {r.grain: r.years for r in b.replaced or []}
        if b.base and grain not in held:        # nothing new in this grain
            continue
        years = held.get(grain)
        part = spark.read.schema(R.written_schema(grain)).parquet(f"{path}/{b.build}/{grain}")
        if covered:
            part = part.where(~_in_years(covered))
        out = part if out is None else out.unionByName(part)
        if years is None:
            break
        covered = covered + [y for y in years if y not in covered]
    return out


def write_grain(df: DataFrame, grain: str, path: str, totals: Observation | None = None) -> None:
    """Write one combined grain, partitioned by year where the grain has one, clustered
    by key inside each file so Parquet row-group statistics skip by carrier / flight.

    Files are balanced with an AQE ``rebalance`` (big years split, small ones merged). The
    partition column leads the sort, so the writer needs no sort of its own and keeps the
    order of the keys inside each file. ``totals`` measures what is written."""
    g = R.GRAINS[grain]
    w = df.hint("rebalance", *(g.partition_by or ["carrier"]))
    w = w.sortWithinPartitions(*g.partition_by, *SORT_KEYS[grain])
    if totals is not None:
        w = measured(w, totals)
    # a build is a full rebuild of the grain: replace every partition, not only those present
    writer = w.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if g.partition_by:
        writer = writer.partitionBy(*g.partition_by)
    writer.parquet(path)


def measured(df: DataFrame, totals: Observation) -> DataFrame:
    """``df``, its rows, flights and delayed flights counted on the way by the job that reads it."""
    return df.observe(totals, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("num_flights"), F.lit(0)).alias("flights"),
                      F.coalesce(F.sum("delayed_flights"), F.lit(0)).alias("delayed"))


def _seen(totals: Observation) -> tuple[int, int]:
    """Measured flights and delayed flights; none where the optimizer found the input empty and
    planned nothing to measure."""
    try:
        return totals.get["flights"], totals.get["delayed"]
    except Py4JJavaError as e:
        if "assertion failed" not in str(e.java_exception):
            raise
        return 0, 0


def reconciled(totals: dict[str, Observation]) -> tuple[int, int]:
    """Flights and delayed flights, the same in every grain; raises :class:`BuildMismatch` if not."""
    seen = {grain: _seen(o) for grain, o in totals.items()}
    if len(set(seen.values())) > 1:
        raise BuildMismatch("flights and delayed flights by grain: " + ", ".join(f"{g} {s}" for g, s in seen.items()))
    return next(iter(seen.values()))


def _in_build_order(make: Callable[[str], None], parallel_jobs: int) -> None:
    """``make`` every grain, each as soon as its parent is made. Independent grains (the flight chain
    and the carrier chain) run as concurrent Spark jobs from a small thread pool, so the
    cluster is not idle while one small job finishes."""
    with ThreadPoolExecutor(max_workers=max(1, parallel_jobs)) as pool:
        done: dict[str, Future] = {}
        for grain in BUILD_ORDER:  # parents precede children
            parent = R.GRAINS[grain].parent

            def run(grain=grain, parent=parent):
                if parent is not None:
                    done[parent].result()  # wait for the written parent
                make(grain)

            done[grain] = pool.submit(run)
        for f in done.values():
            f.result()


def build_all(flights: DataFrame, path: str | None = None, parallel_jobs: int = 4) -> Warehouse:
    """Build every grain from one scan of ``flights``; returns the loaded warehouse.

    The finest grain is written first; every other grain is re-aggregated from its
    written parent as soon as that parent exists.
    """
    spark = flights.sparkSession
    home = path or scratch_path(spark, "warehouse")
    name = f"build-{uuid.uuid4().hex[:12]}"
    path = f"{home}/{name}"
    totals = {grain: Observation(f"{name}-{grain}") for grain in BUILD_ORDER}

    def build(grain: str) -> None:
        spark.sparkContext.setJobDescription(f"flightperf build_all: grain {grain}")  # per thread
        g = R.GRAINS[grain]
        if g.parent is None:
            df = R.base_rollup(flights)
        else:
            df = R.reaggregate(spark.read.schema(R.written_schema(g.parent)).parquet(f"{path}/{g.parent}"), grain)
        write_grain(df, grain, f"{path}/{grain}", totals[grain])

    _in_build_order(build, parallel_jobs)
    _publish(spark, home, name, None, [], reconciled(totals))
    return Warehouse.load(spark, home)


def add_flights(flights: DataFrame, path: str, parallel_jobs: int = 4) -> Warehouse:
    """Add a delivery of new flights to the warehouse under ``path``; returns the loaded warehouse.

    The delivery is rolled up on its own; of what is already written, only the years that it touches are
    read and written again (the two grains without a year are rewritten as a whole; they hold a row a
    carrier, flight and month). Flights must be new: one that is added twice counts twice.
    """
    spark = flights.sparkSession
    builds = _builds(spark, path)
    before = Warehouse.load(spark, path)
    name = f"build-{uuid.uuid4().hex[:12]}"
    home = f"{path}/{name}"
    measures = {grain: {k: Observation(f"{name}-{grain}-{k}") for k in ("new", "old", "both")} for grain in BUILD_ORDER}
    replaced: dict[str, list | None] = {}

    def build(grain: str) -> None:
        spark.sparkContext.setJobDescription(f"flightperf add_flights: grain {grain}")  # per thread
        g = R.GRAINS[grain]
        if g.parent is None:
            df = R.base_rollup(flights)
        else:
            df = R.reaggregate(spark.read.schema(R.written_schema(g.parent)).parquet(f"{home}/new/{g.parent}"), grain)
        write_grain(df, grain, f"{home}/new/{grain}")
        new = spark.read.schema(R.written_schema(grain)).parquet(f"{home}/new/{grain}")
        old = before.grain(grain)
        replaced[grain] = None
        if g.partition_by:
            # the years of the delivery: partition values, a handful
            years = new.groupBy("year").agg(F.lit(1)).agg(
                F.sort_array(F.collect_set("year")).alias("years"), F.max(F.col("year").isNull()).alias("undated")).first()
            replaced[grain] = list(years["years"]) + ([None] if years["undated"] else [])
            old = old.where(_in_years(replaced[grain]))
        m = measures[grain]
        write_grain(R.added(measured(old, m["old"]), measured(new, m["new"]), grain), grain, f"{home}/{grain}", m["both"])

    _in_build_order(build, parallel_jobs)
    for grain, m in measures.items():
        parts = tuple(a + b for a, b in zip(_seen(m["old"]), _seen(m["new"])))
        if parts != _seen(m["both"]):
            raise BuildMismatch(f"{grain}: flights and delayed flights {parts} to write, written {_seen(m['both'])}")
    added = reconciled({grain: m["new"] for grain, m in measures.items()})
    totals = [None if b is None else b + a for a, b in zip(added, (builds[0].flights, builds[0].delayed))]
    _publish(spark, path, name, builds[0].build, list(replaced.items()), totals)
    return Warehouse.load(spark, path)


def _publish(spark: SparkSession, home: str, name: str, base: str | None, replaced: list, totals) -> None:
    """Every grain is written: make the build the one that readers take, if its base still is."""
    if base is not None and _builds(spark, home)[0].build != base:
        raise RuntimeError(f"{home} has a newer build than {base}, which this one is based on")
    spark.createDataFrame([(name, time.time(), base, replaced, *totals)], PUBLISHED).coalesce(1).write.mode(
        "append").json(f"{home}/published")


def table_row_counts(wh: Warehouse) -> DataFrame:
    """(table_name, n_rows) for the delay and count table of every grain, one small
    aggregate per grain (no per-table job)."""
    parts = []
    for grain in BUILD_ORDER:
        g = R.GRAINS[grain]
        c = wh.groups(grain).agg(
            F.count(F.lit(1)).alias("n_count"),
            F.count(F.when(F.col("delayed_flights") > 0, F.lit(1))).alias("n_delay"))
        parts.append(c.select(F.inline(F.array(
            F.struct(F.lit(g.delay_table).alias("table_name"), F.col("n_delay").cast("long").alias("n_rows")),
            F.struct(F.lit(g.count_table).alias("table_name"), F.col("n_count").cast("long").alias("n_rows"))))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# the application's tab-separated export: 9 of the tables
TSV_EXPORT_TABLES = ["date_fcount", "delay_date_count", "delay_flightNum_date", "year_fcount", "delay_year_count",
                     "delay_flightNum_year", "month_fcount", "delay_month_count", "delay_flightNum_month"]


def export_tables(wh: Warehouse, path: str, names: list[str] | None = None, fmt: str = "tsv") -> list[str]:
    """Write keyed tables by name under ``path/<name>`` as tab-separated text (no header, dates
    as ``yyyy-MM-dd``, every row) or Parquet (rows without a key dropped, like in a keyed store)."""
    from flightperf.sources import sinks as S
    written = []
    for name in names or TSV_EXPORT_TABLES:
        t = wh.table(name)
        t = t.selectExpr(*[f"date_format({c}, 'yyyy-MM-dd') AS {c}" if c == "flight_date" else c
                           for c in t.columns])
        if fmt == "tsv":
            S.write_tsv(t, f"{path}/{name}")
        elif fmt == "parquet":
            S.write_table(t, f"{path}/{name}")
        else:
            raise ValueError(f"unknown format {fmt!r}")
        written.append(name)
    return written
