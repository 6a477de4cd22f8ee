import re

import pytest

from flightperf.llm import license_rules as R
from flightperf.llm import licenses as L
from flightperf.llm.queries import op4_license_scan

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = []
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in hits]
    return (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))


def test_there_are_hundreds_of_rules_and_each_has_its_keyword():
    rules = R.parse_rules()
    assert len(rules) >= 200 and len(set(rules)) == len(rules)
    for label, kind, keyword, pattern in rules:
        assert kind in R.KINDS
        re.compile(pattern)


def wordings(pattern):
    """Texts that a pattern matches: every alternative and letter, repeats at their least and once more."""
    def of(items):
        out = [""]
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                some = [chr(arg)]
            elif name == "IN":
                some = [chr(a) if str(o) == "LITERAL" else "1" if "DIGIT" in str(a) else "x" for o, a in arg]
            elif name == "BRANCH":
                some = [x for branch in arg[1] for x in of(branch)]
            elif name == "SUBPATTERN":
                some = of(arg[-1])
            else:
                assert name == "MAX_REPEAT", name
                least, most, body = arg
                some = [x * n for n in {least, min(most, least + 1)} for x in of(body)]
            out = [a + b for a in out for b in dict.fromkeys(some)]
        return out
    return of(re._parser.parse(pattern))


def test_every_wording_of_a_pattern_holds_its_keyword():
    for label, _, keyword, pattern in R.parse_rules():
        for text in wordings(pattern):
            assert re.fullmatch(pattern, text), (pattern, text)
            assert keyword in text, (label, keyword, text)
    scan = L.Scanner().scan
    assert scan(b"PostgreSQL Licence")["labels"] == "postgresql" and scan(b"Simplified License")["labels"] == "bsd-2-clause"


@pytest.mark.parametrize("text,labels", [
    ("Released under the MIT License.", "mit"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause,unknown-license"),
    ("Creative Commons Attribution-NonCommercial 4.0 International", "cc-by-nc"),
    ("permit license terms, by the way", ""),
])
def test_labels(text, labels):
    assert L.Scanner().scan(text.encode())["labels"] == labels


def test_suppression_is_by_containment_and_priority():
    rules = [("long", "text", "aa", "aa bb cc"), ("short", "name", "bb", "bb"), ("strong", "spdx", "cc", "cc dd"),
             ("weak", "hint", "aa", "aa bb cc dd")]
    got = L.Scanner(rules).scan(b"aa bb cc dd")
    # short lies inside long; weak holds long but isn't held; strong overlaps long only in part
    assert got["spans"] == [(0, 3, "long"), (0, 4, "weak"), (2, 4, "strong")]
    same = L.Scanner([("first", "name", "aa", "aa"), ("second", "name", "aa", "aa")]).scan(b"aa")
    assert same["labels"] == "first"


def test_keyword_dense_text_stays_linear():
    got = L.Scanner().scan(b"cc by and mit license " * 20_000)
    assert got["n_base"] == 40_000 and got["first_word"] == 0 and got["last_word"] == 99_998


def check(rows, texts):
    assert len(rows) == len(texts)
    want = sorted((d, *brute_base(t)) for d, t in texts)
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                  for r in rows) == want
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(op4_license_scan(spark, "/root/testdata/sf0.001").collect(), docs)


def test_edges(edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    rows = L.scan(edge_docs).collect()
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"]) for r in rows), key=key) == sorted(
        ((d, *brute_base(t)[:2]) for d, t, *_ in EDGE_ROWS), key=key)
    assert L.scan(no_docs).count() == 0
