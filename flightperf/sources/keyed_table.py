"""Keyed tables: one row a key, files that share no key, merged by key on write.

A table is a folder with

* ``data/<version>/slot=<n>/*.parquet``: rows in key order. A slot holds one interval of keys and its files
  are cut by key too, so no two files of a version overlap;
* ``manifest/<version>``: every file of a version with its first and last key and its rows;
* ``published``: the versions that are complete, in order. A reader takes the newest one, so a write
  that fails half way is never seen.

A read by key first asks the manifest and then opens only the files whose interval meets the request. A
merge rewrites only the slots that its keys fall into; all other files are carried over by name into the
next version. Keys compare as text (UTF-8), as in :mod:`flightperf.operators.keyed`.
"""

from __future__ import annotations

import bisect
import json
import time
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "slot int, file string, min_key string, max_key string, rows long"
AGE = "__age"       # 0: stored, 1: update
PUBLISHED = "version string, at double, base string, table_schema string"


class KeyedTable:
    """One published version of a keyed table."""

    def __init__(self, spark: SparkSession, path: str, version: str, schema: T.StructType):
        self.spark, self.path, self.version, self.schema = spark, path, version, schema

    # --- reading ---------------------------------------------------------------------

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "KeyedTable":
        """The version of the table that was published last."""
        newest = _newest(spark, path)
        if newest is None:
            raise ValueError(f"no published table under {path}")
        return cls(spark, path, newest["version"], T.StructType.fromJson(json.loads(newest["table_schema"])))

    def manifest(self) -> DataFrame:
        """One row a file: slot, file, min_key, max_key, rows."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{self.version}")

    def _rows_of(self, files: DataFrame) -> DataFrame:
        names = [r.file for r in files.select("file").toLocalIterator()]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*names)

    def scan(self) -> DataFrame:
        """All rows."""
        return self._rows_of(self.manifest())

    def read_range(self, start_key: str, stop_key: str) -> DataFrame:
        """Rows with ``start_key <= key < stop_key``; opens only files that can hold one."""
        files = self.manifest().where((F.col("max_key") >= start_key) & (F.col("min_key") < stop_key))
        return self._rows_of(files).where((F.col("key") >= start_key) & (F.col("key") < stop_key))

    def read_keys(self, keys: list[str]) -> DataFrame:
        """Rows whose key is in ``keys``; opens only files that can hold one."""
        keys = sorted(set(keys))
        if not keys:
            return self.spark.createDataFrame([], self.schema)
        asked = F.array(*[F.lit(k) for k in keys])
        files = self.manifest().where(F.exists(asked, lambda k: (k >= F.col("min_key")) & (k <= F.col("max_key"))))
        wanted = self.spark.createDataFrame([(k,) for k in keys], "key string")
        return self._rows_of(files).join(wanted, on="key", how="left_semi").select(*self.schema.names)

    # --- writing ---------------------------------------------------------------------

    @classmethod
    def write(cls, df: DataFrame, path: str) -> "KeyedTable":
        """Write ``df`` as a new version that replaces all rows. Its keys must be unique; rows with a NULL
        key are dropped (a keyed store cannot hold them)."""
        spark = df.sparkSession
        rows = df.where(F.col("key").isNotNull()).repartitionByRange(F.col("key"))
        rows = rows.withColumn("slot", F.spark_partition_id())      # a slot for each range
        version = f"v-{uuid.uuid4().hex[:12]}"
        files = _write_slots(rows, f"{path}/data/{version}")
        return _publish(spark, path, version, files, df.schema, _name(_newest(spark, path)))

    def merge(self, updates: DataFrame, newest: str | None = None) -> "KeyedTable":
        """The next version: each key of ``updates`` has its row from there, all other rows stay.

        Of several updates of one key the one with the greatest ``newest`` column counts, then the one with the
        greatest values. Only slots that hold or would hold an updated key are rewritten."""
        if sorted(updates.columns) != sorted(self.schema.names):
            raise ValueError(f"a merge needs the columns {self.schema.names}")
        updates = updates.select(*self.schema.names).where(F.col("key").isNotNull())
        starts = [(r.min_key, r.slot) for r in self.manifest().groupBy("slot").agg(F.min("min_key").alias("min_key"))
                  .orderBy("min_key").toLocalIterator()]
        if not starts:      # nothing to keep
            return KeyedTable.write(_last_rows(updates, ["key"], newest).select(*self.schema.names), self.path)
        manifest = self.manifest()
        updates = updates.withColumn("slot", _slot_of(self.spark, starts)("key"))
        touched = updates.agg(F.sort_array(F.collect_set("slot")).alias("slots")).first()["slots"]   # at most one a slot
        slot = F.regexp_extract("_metadata.file_path", "/slot=([0-9]+)/", 1).cast("int").alias("slot")
        both = updates.withColumn(AGE, F.lit(1))
        if touched:
            old = self._rows_of(manifest.where(F.col("slot").isin(touched)))
            both = old.select("*", slot, F.lit(0).alias(AGE)).unionByName(both)
        # dealt by (slot, key) ranges once: grouping and writing need no further shuffle
        kept = _last_rows(both.repartitionByRange("slot", "key"), ["slot", "key"], newest)
        version = f"v-{uuid.uuid4().hex[:12]}"
        files = _write_slots(kept.select("slot", *self.schema.names), f"{self.path}/data/{version}")
        carried = manifest.where(~F.col("slot").isin(touched)) if touched else manifest
        return _publish(self.spark, self.path, version, carried.unionByName(files), self.schema, self.version)


# --- helpers ------------------------------------------------------------------------------

def _newest(spark: SparkSession, path: str):
    """The last published entry, or None."""
    try:
        found = spark.read.schema(PUBLISHED).json(f"{path}/published")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.agg(F.max_by(F.struct(*found.columns), "at").alias("e")).first()["e"]


def _last_rows(rows: DataFrame, keys: list[str], newest: str | None) -> DataFrame:
    """One row a key: the youngest (AGE, if given), then the greatest ``newest``, then the greatest values."""
    first = [c for c in (AGE, newest) if c in rows.columns]
    order = first + [c for c in rows.columns if c not in (*first, *keys)]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order)).alias("row")).select(*keys, "row.*")


def _name(entry) -> str | None:
    return None if entry is None else entry["version"]


def _publish(spark, path, version, files: DataFrame, schema, base: str | None) -> KeyedTable:
    """Write the version's manifest, then make it the newest one, if its base still is."""
    files.coalesce(1).write.parquet(f"{path}/manifest/{version}")
    if _name(_newest(spark, path)) != base:
        raise RuntimeError(f"{path} was changed by another writer since version {base}")
    spark.createDataFrame([(version, time.time(), base, schema.json())], PUBLISHED).coalesce(1).write.mode(
        "append").json(f"{path}/published")
    return KeyedTable(spark, path, version, schema)


def _write_slots(rows: DataFrame, path: str) -> DataFrame:
    """Write rows that are dealt by key ranges, a folder a slot, and list the files with their keys."""
    rows.sortWithinPartitions("slot", "key").write.partitionBy("slot").parquet(path)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("slot", T.IntegerType())])
    keys = rows.sparkSession.read.schema(schema).parquet(path)          # the key column only
    return keys.groupBy("slot", F.col("_metadata.file_path").alias("file")).agg(
        F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count(F.lit(1)).alias("rows"))


def _slot_of(spark: SparkSession, starts: list[tuple[str, int]]):
    """key -> the slot whose interval holds it: from its first key to the next slot's (the first slot
    also holds all lesser keys). One short text a slot is broadcast, a few dozen bytes for each 64 MB or
    more of the table."""
    shared = spark.sparkContext.broadcast(([k for k, _ in starts], [s for _, s in starts]))

    @F.pandas_udf("int")
    def find(keys: pd.Series) -> pd.Series:
        first, slots = shared.value
        return pd.Series([slots[max(0, bisect.bisect_right(first, k) - 1)] for k in keys], dtype="int32")

    return find
