"""The library never pulls data to the driver, never uses localCheckpoint or cross
joins, and never runs row-at-a-time Python UDFs. (The optional training-data operators have
their own check: there, small bounded results do reach the driver.)"""

import pathlib
import re

LIB = pathlib.Path(__file__).resolve().parents[1] / "flightperf"
FORBIDDEN = [r"\.collect\(\)", r"\.toPandas\(\)", r"localCheckpoint", r"crossJoin", r"\bF\.udf\b", r"@udf\b",
             r"\.rdd\.map", r"\.take\(", r"\.head\("]


def test_no_driver_side_data_paths():
    hits = []
    for p in LIB.rglob("*.py"):
        if "llm" in p.relative_to(LIB).parts:
            continue
        for i, line in enumerate(p.read_text().splitlines(), 1):
            if line.strip().startswith("#"):
                continue
            for pat in FORBIDDEN:
                if re.search(pat, line):
                    hits.append(f"{p.relative_to(LIB)}:{i}: {line.strip()}")
    assert hits == []
