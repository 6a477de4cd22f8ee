from collections import Counter

from pyspark.sql import functions as F

from flightperf.llm import line_dedup as L


def brute(rows, ratio, least):
    """(doc_id, text, host) rows -> Counter of (doc_id, text without boilerplate)."""
    pages, holds = Counter(), Counter()
    for _, text, host in rows:
        pages[host] += 1
        holds.update((host, x) for x in {ln.strip(" ") for ln in (text or "").split("\n")} if x)
    bad = {k for k, n in holds.items() if n >= least and n > ratio * pages[k[0]]}
    return Counter((d, None if t is None else "\n".join(ln for ln in t.split("\n") if (h, ln.strip(" ")) not in bad))
                   for d, t, h in rows)


def rows_of(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_boilerplate_is_relative_to_the_host(spark, table):
    rows = [(i, f"menu\n\nbody {i}\n menu \nrare", "en", "big" if i < 30 else "small", 1) for i in range(33)]
    rows += [(100 + i, "shared line\nown %d" % i, "en", None, 1) for i in range(6)] + [(200, None, "en", "big", 1)]
    docs = table(rows)
    got = L.drop_boilerplate(docs, "source", 0.5, 5)
    assert got.columns == docs.columns
    assert rows_of(got) == brute([(r[0], r[1], r[3]) for r in rows], 0.5, 5)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[0] == "\nbody 0" and texts[31] == "menu\n\nbody 31\n menu \nrare" and texts[100] == "own 0"


def test_edges(edge_docs, no_docs):
    from tests.llm.rows import EDGE_ROWS
    assert rows_of(L.drop_boilerplate(edge_docs)) == Counter((r[0], r[1]) for r in EDGE_ROWS)
    assert L.drop_boilerplate(no_docs, counts=True).count() == 0


def test_plan_has_no_python(spark, edge_docs):
    plan = L.drop_boilerplate(edge_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hot_host_and_one_line_everywhere(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("top\nline "), "id").alias("text"),
                                    F.when(F.col("id") % 3 > 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("source"))
    got = L.drop_boilerplate(docs).collect()
    assert len(got) == 4000 and all(r["text"] == f"line {r['doc_id']}" for r in got)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"menu\nown {i}", "a", 7, "x") for i in range(40)],
                                 "doc_id long, text string, source string, n_lines int, N_Dropped string")
    got = L.drop_boilerplate(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines_", "n_dropped_"]
    assert {(r.n_lines, r.N_Dropped, r.n_lines_, r.n_dropped_) for r in got.collect()} == {(7, "x", 2, 1)}


def test_a_very_long_text(spark):
    long = "\n".join(["menu"] + [f"line {i}" for i in range(300_000)])
    docs = spark.createDataFrame([(0, long, "a")] + [(i, f"menu\nown {i}", "a") for i in range(1, 40)], "doc_id long, text string, source string")
    got = L.drop_boilerplate(docs, counts=True).where("doc_id = 0").first()
    assert (got.n_lines, got.n_dropped) == (300_001, 1) and got.text == long[5:]
