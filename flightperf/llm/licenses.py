"""License scans: ordered signature rules behind a keyword prefilter.

A text is read as its lower-cased words. A rule is searched only if its keyword occurs, and each
place it matches is a detection with a word interval. Where detections overlap, the stronger one
(kind priority, then rule order) suppresses every weaker one whose interval lies inside its own;
partial overlaps both stay. The base phrases are rules too: their places are all counted, and
their labels are never suppressed. The score joins the kept detections' confidences as
independent evidence: 1 - product(1 - confidence).

Defined cases: a null or empty text has no words, no detections and score 0; repeated rows are
scanned each; any text length is read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import small_batches, text_bytes
from flightperf.llm.license_rules import BASE_PHRASES, KINDS, parse_rules

# ASCII punctuation, controls and spaces part words; digits, letters and all else make them.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_SPACE = bytes(c if c >= 0x80 or bytes([c]) in _WORD else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_TO_SPACE).split()


class Scanner:
    """Compiled rules; ``scan`` gives the detections of a text."""

    def __init__(self, rules=None):
        self.rules = [(label, *KINDS[kind], keyword, self._compile(pattern), False)
                      for label, kind, keyword, pattern in (parse_rules() if rules is None else rules)]
        # base phrases: same priority as names, never suppressed
        self.rules += [(label, *KINDS["name"], phrase, self._compile(phrase), True) for phrase, label in BASE_PHRASES]
        by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            by_keyword.setdefault(r[3], []).append(i)
        self.by_keyword = list(by_keyword.items())
        self.roots = self._roots([k.encode() for k in by_keyword])

    @staticmethod
    def _compile(pattern: str):
        return re.compile(f"(?:^|(?<= ))(?:{pattern})(?= |$)")

    @staticmethod
    def _roots(keywords: list[bytes]) -> list[bytes]:
        """The keywords that contain no other: a text without them has no keyword at all."""
        return [k for k in keywords if not any(o != k and o in k for o in keywords)]

    def detections(self, joined: str) -> list[tuple[int, int, int, int]]:
        """(priority, rule number, first word, end word) of all places, suppressed ones included."""
        found, starts = [], None
        for keyword, rules in self.by_keyword:
            if keyword in joined:
                for i in rules:
                    for m in self.rules[i][4].finditer(joined):
                        if starts is None:
                            starts = [0, *(x.end() for x in re.finditer(" ", joined))]
                        first = bisect_left(starts, m.start())
                        found.append((self.rules[i][1], i, first, first + m.group().count(" ") + 1))
        return sorted(found)

    @staticmethod
    def suppress(found):
        """``found`` without detections that lie inside a stronger one."""
        kept, reach = [], {}                            # first word -> largest end of a kept detection
        longest = max((d[3] - d[2] for d in found), default=0)
        for d in sorted(found):
            if not any(reach.get(at, -1) >= d[3] for at in range(d[3] - longest, d[2] + 1)):
                kept.append(d)
                reach[d[2]] = max(reach.get(d[2], -1), d[3])
        return kept

    def scan(self, text: bytes) -> dict:
        words = words_of(text)
        joined = b" ".join(words)
        out = {"n_words": len(words), "n_base": 0, "first_word": None, "last_word": None, "base_labels": "",
               "labels": "", "score": 0.0, "spans": []}
        if not any(k in joined for k in self.roots):
            return out
        found = self.detections(joined.decode("utf-8", "replace"))
        base = [d for d in found if self.rules[d[1]][5]]
        kept = self.suppress(found)
        if base:
            starts = [d[2] for d in base]
            out.update(n_base=len(base), first_word=min(starts), last_word=max(starts))
        base_labels = {self.rules[d[1]][0] for d in base}
        out["base_labels"] = ",".join(sorted(base_labels))
        out["labels"] = ",".join(sorted(base_labels | {self.rules[d[1]][0] for d in kept}))
        miss = 1.0
        for d in kept:
            miss *= 1 - self.rules[d[1]][2]
        out["score"] = 1 - miss
        out["spans"] = sorted((d[2], d[3], self.rules[d[1]][0]) for d in kept)
        return out


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, spans array<struct<first:int,end:int,label:string>>")


def scan(docs: DataFrame, rules=None) -> DataFrame:
    """(doc_id, text) -> one row per row with counts, labels, score and the kept detections' word spans."""
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("label", pa.string())]))
    kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
             "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(),
             "spans": span}

    def run(batches):
        scanner = Scanner(rules)
        for b in small_batches(batches):
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            cols = {"doc_id": b.column(0)}
            for name, kind in kinds.items():
                if name == "spans":
                    cols[name] = pa.array([[dict(zip(("first", "end", "label"), s)) for s in r[name]] for r in rows], kind)
                elif name != "doc_id":
                    cols[name] = pa.array([r[name] for r in rows], kind)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.select(F.col("doc_id").cast("long"), text_bytes().alias("bytes")).mapInArrow(run, SCHEMA)
