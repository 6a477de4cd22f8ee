"""Command line: build the warehouse, add a delivery to it, run a report, export tables.

  python -m flightperf build  --input PATH [--format csv|dir|zip] [--header] --warehouse PATH
  python -m flightperf add    --input PATH [--format csv|dir|zip] [--header] --warehouse PATH   (new flights only)
  python -m flightperf report NAME --warehouse PATH [--carrier AA] [--flight 2] [--from D] [--to D]
                              [--year Y] [--holiday H] [--years FIRST-LAST] [--labels calendar|as_observed] [--out PATH]
  python -m flightperf export --warehouse PATH --out PATH [--tables a,b] [--format tsv|parquet]

Report names: delay_category, delay_flightNum, delay_season, delay_career, delay_holiday.
Without ``--carrier`` (and ``--flight``) a report answers every key at once. Results are
written with Spark (``--out``) or printed row by row, all of them, tab-separated under a header.
A period needs both ends; without either it is the application's default period.
"""

from __future__ import annotations

import argparse
import sys

from flightperf.plans import reports as Q
from flightperf.plans.warehouse import Warehouse, add_flights, build_all, export_tables
from flightperf.session import get_session
from flightperf.sources import csv as CSV


def _args(argv):
    p = argparse.ArgumentParser(prog="flightperf")
    sub = p.add_subparsers(dest="cmd", required=True)
    b, n = sub.add_parser("build"), sub.add_parser("add")
    for sp in (b, n):
        sp.add_argument("--input", required=True)
        sp.add_argument("--format", choices=["csv", "dir", "zip"], default="dir")
        sp.add_argument("--header", action="store_true")
        sp.add_argument("--warehouse", required=True)
    r = sub.add_parser("report")
    r.add_argument("name", choices=sorted(Q.REPORTS))
    r.add_argument("--warehouse", required=True)
    r.add_argument("--carrier")
    r.add_argument("--flight")
    r.add_argument("--from", dest="start")
    r.add_argument("--to", dest="end")
    r.add_argument("--inclusive-end", action="store_true")
    r.add_argument("--year", type=int)
    r.add_argument("--holiday")
    r.add_argument("--years", help="first and last year of the holiday report, e.g. 1995-2001")
    r.add_argument("--labels", choices=["calendar", "as_observed"], default="calendar")
    r.add_argument("--out")
    e = sub.add_parser("export")
    e.add_argument("--warehouse", required=True)
    e.add_argument("--out", required=True)
    e.add_argument("--tables")
    e.add_argument("--format", choices=["tsv", "parquet"], default="tsv")
    for sp in (b, n, r, e):
        sp.add_argument("--master", help="only for local runs, e.g. local[8]")
    return p.parse_args(argv)


def _report(wh, a):
    name = a.name
    if name == "delay_category":
        return Q.delay_category(wh, a.carrier, a.start, a.end, inclusive_end=a.inclusive_end)
    if name == "delay_flightNum":
        return Q.flight_delay(wh, a.carrier, a.flight, a.start, a.end, inclusive_end=a.inclusive_end)
    if name == "delay_season":
        return Q.season_delay(wh, a.carrier, a.flight, a.year, labels=a.labels)
    if name == "delay_career":
        return Q.airline_delays(wh, a.start, a.end, inclusive_end=a.inclusive_end)
    years = tuple(int(y) for y in a.years.split("-", 1)) if a.years else None
    if years and (len(years) != 2 or years[0] > years[1]):
        raise ValueError(f"--years needs FIRST-LAST, got {a.years!r}")
    return Q.delay_holiday(wh, a.carrier, a.holiday, years)


def main(argv=None) -> int:
    a = _args(argv if argv is not None else sys.argv[1:])
    spark = get_session(a.master)
    if a.cmd in ("build", "add"):
        if a.format == "zip":
            flights = CSV.read_flights_zip(spark, a.input, header=a.header)
        elif a.format == "dir":
            flights = CSV.read_flights_dir(spark, a.input, header=a.header)
        else:
            flights = CSV.read_flights_csv(spark, a.input, header=a.header)
        (build_all if a.cmd == "build" else add_flights)(flights, a.warehouse)
        print(f"warehouse written to {a.warehouse}")
    elif a.cmd == "report":
        if bool(a.start) != bool(a.end):
            raise SystemExit("a report period needs both --from and --to")
        if a.name in ("delay_category", "delay_flightNum", "delay_career") and not a.start:
            a.start, a.end = Q.DEFAULT_RANGE
        df = _report(Warehouse.load(spark, a.warehouse), a)
        if a.out:
            df.write.mode("overwrite").parquet(a.out)
            print(f"report written to {a.out}")
        else:
            shown = Q.for_display(df)
            print("\t".join(shown.columns))
            for row in shown.toLocalIterator():     # one partition at a time
                print("\t".join("" if v is None else str(v) for v in row))
    else:
        names = a.tables.split(",") if a.tables else None
        done = export_tables(Warehouse.load(spark, a.warehouse), a.out, names, a.format)
        print("exported:", ", ".join(done))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
