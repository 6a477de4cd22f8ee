"""The driver contract in a fresh process with a plain session (no engine settings,
another time zone, timestamps read with instant semantics)."""

import json
import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import json, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "America/Los_Angeles")
         .config("spark.sql.parquet.inferTimestampNTZ.enabled", "false").getOrCreate())
import __spark_entry__ as E
out = {"entry_rows": E.entry(spark).count()}
qs = E.queries()
for name in ["report_category", "report_holiday", "rollup_count_date"]:
    out[name] = sorted(map(str, qs[name](spark, "/root/testdata/sf0.001").collect()))
print("RESULT " + json.dumps(out))
"""


def test_contract_in_plain_session(spark):
    import __spark_entry__ as E
    r = subprocess.run([sys.executable, "-c", SCRIPT, REPO], capture_output=True, text=True, timeout=600)
    line = [ln for ln in r.stdout.splitlines() if ln.startswith("RESULT ")]
    assert line, r.stderr[-2000:]
    got = json.loads(line[0][len("RESULT "):])
    assert got["entry_rows"] > 0
    qs = E.queries()
    for name in ["report_category", "report_holiday", "rollup_count_date"]:
        want = sorted(map(str, qs[name](spark, "/root/testdata/sf0.001").collect()))
        assert got[name] == want, name


FOREIGN = r"""
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as E
q = E.queries()
print("RESULT", q["scan_zip_csv"](spark, "/root/testdata/sf0.001").count(),
      q["report_category_all"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_tasks_need_no_package_on_executors(tmp_path):
    """Run from a folder outside the repo with no PYTHONPATH: the Python workers cannot
    import the package, so everything shipped to them must travel by value."""
    import os
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", FOREIGN, REPO], capture_output=True, text=True, timeout=600,
                       cwd=str(tmp_path), env=env)
    line = [ln for ln in r.stdout.splitlines() if ln.startswith("RESULT")]
    assert line, r.stderr[-3000:]
    n_zip, n_rep = map(int, line[0].split()[1:])
    assert n_zip == 6000 and n_rep > 0
