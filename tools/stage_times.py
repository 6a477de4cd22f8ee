"""Longest stages of a Spark event log (plain or zstd-compressed, v1 file or v2 folder).

usage: python tools/stage_times.py EVENT_LOG_DIR [N]

Run the job with ``spark.eventLog.enabled=true`` and ``spark.eventLog.dir`` pointing at a
scratch folder (the UI stays off).
"""

from __future__ import annotations

import glob
import json
import os
import sys


def _lines(path: str):
    raw = open(path, "rb").read()
    if path.endswith(".zstd"):
        import zstandard
        raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
    return raw.decode("utf-8", "replace").splitlines()


def main():
    root = sys.argv[1]
    top = int(sys.argv[2]) if len(sys.argv) > 2 else 15
    files = [p for p in glob.glob(os.path.join(root, "**", "*"), recursive=True)
             if os.path.isfile(p) and "appstatus" not in os.path.basename(p) and not p.endswith(".crc")]
    stages, desc = [], {}
    for f in files:
        for line in _lines(f):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") == "SparkListenerStageSubmitted":
                props = e.get("Properties") or {}
                if props.get("spark.job.description"):
                    desc[e["Stage Info"]["Stage ID"]] = props["spark.job.description"]
            if e.get("Event") == "SparkListenerStageCompleted":
                si = e["Stage Info"]
                ms = si.get("Completion Time", 0) - si.get("Submission Time", 0)
                stages.append((ms, si["Stage ID"], si["Number of Tasks"], si["Stage Name"][:70]))
    stages = [(ms, sid, n, desc.get(sid, name)[:70]) for ms, sid, n, name in stages]
    stages.sort(reverse=True)
    print(f"{len(stages)} stages, {sum(s[0] for s in stages)} ms in total")
    for ms, sid, n, name in stages[:top]:
        print(f"{ms:8d} ms  stage {sid:4d}  tasks {n:5d}  {name}")


if __name__ == "__main__":
    main()
