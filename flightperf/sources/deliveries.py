"""Flights of delivered files, each delivery taken in once and replaced when it comes again.

A publisher delivers a month as one or more files, and now and then delivers a month again, corrected. A
:class:`FlightStore` keeps the flights of every delivery as Parquet, together with what it has read:

* ``rows/load=<id>/delivery=<name>/*.parquet``: working columns of the files read in one load;
* ``loads``: for each load its deliveries, with a digest of their files (path, time, length), the latest of the
  files' times, and the rows read.

``ingest`` lists a folder without opening its files, leaves out what the store has already (an anti-join with
``loads``), and reads the rest: a delivery that is new, or whose files have changed and are younger than those
that were read. Readers see the last load of each delivery, so a corrected month replaces its rows and
an old file is not read twice. A load counts from the moment that its entry in ``loads`` is written.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flightperf.sources import csv as CSV
from flightperf.sources.fixtures import FLIGHTS_SCHEMA

LOADS = "load string, at double, delivery string, digest bigint, modified timestamp, n_rows bigint"


class FlightStore:
    """Flights under ``path``. ``name`` is a regular expression whose first group is a file's delivery (by default
    its whole path: every file is a delivery of its own)."""

    def __init__(self, spark: SparkSession, path: str, name: str = "(.*)"):
        self.spark, self.path, self.name = spark, path, name

    def deliveries(self) -> DataFrame:
        """The last load of each delivery: delivery, load, at, digest, modified, n_rows."""
        try:
            loads = self.spark.read.schema(LOADS).parquet(f"{self.path}/loads")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            loads = self.spark.createDataFrame([], LOADS)
        rest = [c for c in loads.columns if c != "delivery"]
        return loads.groupBy("delivery").agg(F.max_by(F.struct(*rest), "at").alias("e")).select("delivery", "e.*")

    def _delivery(self, path_column) -> F.Column:
        return F.regexp_extract(path_column, self.name, 1)

    def pending(self, folder: str, zipped: bool = False) -> DataFrame:
        """Deliveries in ``folder`` that are to be read: delivery, digest, modified, files. No file is opened."""
        files = (self.spark.read.format("binaryFile").option("pathGlobFilter", "*.zip" if zipped else "*.csv")
                 .option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length"))
        offered = (files.withColumn("delivery", self._delivery("path")).where("delivery <> ''").groupBy("delivery")
                   .agg(F.max("modificationTime").alias("modified"),
                        F.sort_array(F.collect_list(F.struct("path", "modificationTime", "length"))).alias("f"))
                   .select("delivery", "modified", F.xxhash64("f").alias("digest"), F.col("f.path").alias("files")))
        have = self.deliveries().select("delivery", F.col("digest").alias("have"), F.col("modified").alias("since"))
        same = [offered["delivery"] == have["delivery"], (offered["digest"] == have["have"]) | (offered["modified"] <= have["since"])]
        return offered.join(have, same, "left_anti")

    def ingest(self, folder: str, header: bool = True, zipped: bool = False) -> list[str]:
        """Read the pending deliveries of ``folder``; their names."""
        load = f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex[:8]}"
        todo = f"{self.path}/pending/{load}"
        self.pending(folder, zipped).write.parquet(todo)       # what this load takes, fixed once
        taken = self.spark.read.parquet(todo)
        paths = [r.path for r in taken.select(F.explode("files").alias("path")).toLocalIterator()]     # file names
        if not paths:
            return []
        if zipped:
            rows = CSV.read_flights_zip(self.spark, paths, header, keep_archive=True).withColumn("delivery", self._delivery("archive"))
        else:
            raw = CSV.read_raw_csv(self.spark, paths, header).withColumn("delivery", self._delivery("_metadata.file_path"))
            rows = CSV.to_working(CSV.type_columns(raw), ("delivery",))
        names = FLIGHTS_SCHEMA.names
        (rows.select("delivery", *names).hint("rebalance", "delivery").sortWithinPartitions("delivery", "flight_date", "carrier")
         .write.partitionBy("delivery").parquet(f"{self.path}/rows/load={load}"))
        read = self._rows([load]).groupBy("delivery").agg(F.count(F.lit(1)).alias("n_rows"))
        entry = taken.join(read, "delivery", "left").select(
            F.lit(load).alias("load"), F.lit(time.time()).alias("at"), "delivery", "digest", "modified",
            F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.path}/loads")
        return sorted(r.delivery for r in taken.select("delivery").toLocalIterator())

    def _rows(self, loads: list[str]) -> DataFrame:
        schema = FLIGHTS_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ")
        return (self.spark.read.schema(f"{schema}, load string, delivery string").option("basePath", f"{self.path}/rows")
                .parquet(*[f"{self.path}/rows/load={x}" for x in loads]))

    def flights(self) -> DataFrame:
        """The flights of every delivery, as last read. A load's folder is opened only while one of its
        deliveries is the last, and of it only these deliveries' folders."""
        live = [(r.load, r.delivery) for r in self.deliveries().where("n_rows > 0").orderBy("load", "delivery").toLocalIterator()]
        if not live:
            return self.spark.createDataFrame([], FLIGHTS_SCHEMA)
        loads = sorted({load for load, _ in live})
        rows, keep = self._rows(loads), F.lit(False)
        for load in loads:      # partition filters
            keep = keep | ((F.col("load") == load) & F.col("delivery").isin([d for x, d in live if x == load]))
        return rows.where(keep).select(*FLIGHTS_SCHEMA.names)
