"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pickle
import sys
import types
import zlib
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightperf.session import scratch_path

# Every text is turned into Arrow batches of few rows, so a batch of very long texts stays small.
BATCH_ROWS = 512


def few_rows_a_batch(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on jobs of this session hand at most so many rows to Python at once. Spark's default of
    10,000 rows takes some 100 MB outside the heap for each task that reads texts of a few KB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared scratch folder (a folder for each value of ``folders``)
    and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs run inside hand rows to Python this many at a time (for rows of many MB)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def rows_digest(df: DataFrame) -> Column:
    """A 64-bit digest of a whole row. With doc_id it names a row; equal rows share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))


def id_fold(doc_id: int | None, folds: int) -> int:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds


def fold_column(col: str, folds: int) -> Column:
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % folds


def per_process(name: str, make):
    """An object kept in this Python worker until another one is asked for (task code travels by
    value, so module globals would be rebuilt for every task). One at a time: a worker lives through
    many stages, and their models would add up."""
    held = sys.modules.setdefault("_flightperf_llm_held", types.ModuleType("_flightperf_llm_held"))
    if not hasattr(held, name):
        for other in [x for x in vars(held) if not x.startswith("__")]:
            delattr(held, other)
        setattr(held, name, make())
    return getattr(held, name)


def share(spark: SparkSession, thing):
    """A broadcast of an object of this package, its classes by value; ``taken`` gives it in a task."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def taken(shared):
    return pickle.loads(shared.value)


def small_batches(batches):
    """Arrow batches cut to BATCH_ROWS rows."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)
