"""Write PLANS.md: physical plans of the headline jobs (build step and reports served from
a written warehouse), to review shuffles, pushdown and pruning.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import datetime as dt
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

R1 = (dt.date(1996, 3, 15), dt.date(1999, 11, 20))


def _plan(df) -> str:
    jvm = df.sparkSession._jvm
    text = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    text = re.sub(r"#\d+L?", "", text)                     # attribute ids
    text = re.sub(r"file:[^\],]*/flightperf/", ".../", text)  # scratch paths
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    return "\n".join(line[:400] for line in text.splitlines())


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    from flightperf.session import get_session
    from flightperf.operators import rollups as R
    from flightperf.plans import reports as Q
    from flightperf.plans.warehouse import build_all
    from flightperf.sources.fixtures import flights

    spark = get_session("local[8]", 8)
    f = flights(spark, sf)
    wh = build_all(f)
    jobs = [
        ("build: finest grain from raw flights (one scan, one shuffle)", R.base_rollup(f)),
        ("build: carrier-day grain from the written flight-day table",
         R.reaggregate(spark.read.parquet(f"{wh.path}/flight_date"), "date")),
        ("Q1 all carriers, range via cover (days + months + years)", Q.delay_category(wh, None, *R1)),
        ("Q2 one flight: partition pruning + pushed carrier / flight filters", Q.flight_delay(wh, "AA", "2", *R1)),
        ("Q3 all flights of a year: conditional sums + generator, no join", Q.season_delay(wh, None, None, 1997)),
        ("Q4 airline-attributable: broadcast 26-row allow-list semi join", Q.airline_delays(wh, *R1)),
        ("Q5 all carriers x holidays: tagged daily rows + zero skeleton, no join", Q.delay_holiday(wh, None, None)),
    ]
    out = ["# Physical plans of the headline jobs", "",
           f"Generated by `tools/plans.py` on `{sf}` (local[8], AQE on; initial plans before AQE re-planning).",
           "Attribute ids and scratch paths are stripped.", ""]
    for title, df in jobs:
        out += [f"## {title}", "", "```", _plan(df), "```", ""]
    open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w").write(
        "\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
