"""flightperf: airline on-time performance analytics on Spark.

Layers:
  sources/    flight scans (positional CSV, directories, zip archives), lenient typing,
              the test-data mapping, Parquet/TSV sinks
  functions/  column expressions (cause flags, keys, ratios, dates) and small fixed dimensions
  operators/  classification, filters, rollups at every grain, joins, keyed reads, reshapes
  plans/      date-range cover, the rollup warehouse and the five reports
  streaming/  empty: the application is batch only

Typical use::

    from flightperf import get_session, read_flights_zip, build_all, reports
    wh = build_all(read_flights_zip(spark, "/data/ontime"), "/data/wh")
    reports.delay_category(wh, None, "1996-03-15", "1999-11-20")
"""

from flightperf.plans import reports
from flightperf.plans.warehouse import Warehouse, add_flights, build_all, export_tables
from flightperf.session import cluster_conf, get_session, scratch_path
from flightperf.sources.csv import read_flights_csv, read_flights_dir, read_flights_zip

__all__ = ["Warehouse", "add_flights", "build_all", "cluster_conf", "export_tables", "get_session", "read_flights_csv",
           "read_flights_dir", "read_flights_zip", "reports", "scratch_path"]
