"""Site-relative line dedup: lines on more than a share of a host's pages are boilerplate.

Pages are grouped by host; a line's pages are divided by the host's pages, and lines over
``RATIO`` that at least ``MIN_PAGES`` pages hold are dropped from every page of that host.

A line is counted by a 128-bit digest of its trimmed text, once a page, so the count shuffles
fixed-size rows and is summed before the shuffle: a line that all pages share is one row a task.
The boilerplate lines of one host are at most (mean distinct lines of its pages) / RATIO, so one
array a host holds them. Pages meet that array by a join that Spark plans from the written
table's size: a broadcast when it is small, else a shuffle join whose skewed hosts AQE splits.

Defined cases: a null text stays null, with no lines; blank lines are kept and never counted;
lines are parted at ``\\n`` alone; a null host is a host of its own; a host with fewer than
``MIN_PAGES`` pages drops nothing; repeated rows count as pages each; a page may end up with an
empty text but is never dropped; an empty table gives no rows; extra columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flightperf.llm.common import fresh, written

RATIO = 0.08
MIN_PAGES = 5

_DIGEST = "struct(xxhash64(trim(l)) AS a, xxhash64(trim(l), 1) AS b)"


def boilerplate(pages: DataFrame, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host_key, lines): the digests of every host's boilerplate lines; hosts without any are left out."""
    keyed = pages.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key"),
                         F.col(host).isNull().alias("no_host"), "text")
    keyed = keyed.select(F.struct("no_host", "host_key").alias("host_key"), "text")
    lines = keyed.select("host_key", F.explode(F.expr(
        "transform(array_distinct(transform(filter(split(text, '\\n'), l -> trim(l) <> ''), l -> trim(l))), l -> " + _DIGEST + ")")).alias("line"))
    counts = lines.groupBy("host_key", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    totals = keyed.groupBy("host_key").agg(F.count("*").alias("pages"))
    return (counts.join(totals, "host_key").where(F.col("n") > F.lit(ratio) * F.col("pages"))
            .groupBy("host_key").agg(F.collect_list("line").alias("lines")))


def drop_boilerplate(pages: DataFrame, host: str = "source", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``pages`` with boilerplate lines taken out of ``text``; with ``counts``, n_lines and n_dropped follow (with
    an underscore more where ``pages`` has such a column)."""
    found = written(boilerplate(pages, host, ratio, min_pages), "boilerplate")
    lines, mine, kept = (fresh(pages, c) for c in ("boilerplate_lines", "page_lines", "kept_lines"))
    key = F.struct(F.col(host).isNull().alias("no_host"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host_key"))
    joined = pages.join(found.select(F.col("host_key").alias(fresh(pages, "host_key")), F.col("lines").alias(lines)),
                        key == F.col(fresh(pages, "host_key")), "left")
    split = joined.withColumn(mine, F.split("text", "\n"))
    kept_lines = F.when(F.col(lines).isNull(), F.col(mine)).otherwise(F.expr(
        f"filter(`{mine}`, l -> trim(l) = '' OR NOT array_contains(`{lines}`, {_DIGEST}))"))
    out = split.withColumn(kept, kept_lines)
    columns = [F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"`{c}`") for c in pages.columns]
    if counts:
        columns += [F.coalesce(F.size(mine), F.lit(0)).alias(fresh(pages, "n_lines")),
                    F.coalesce(F.size(mine) - F.size(kept), F.lit(0)).alias(fresh(pages, "n_dropped"))]
    return out.select(*columns)


def sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """DuckDB SQL for the rows of op3 (documents; the source column is the host)."""
    return f"""
WITH doc AS (SELECT row_number() OVER () AS rn, doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT DISTINCT rn, source, trim(l) AS line
         FROM (SELECT rn, source, unnest(ls) AS l FROM doc) WHERE trim(l) <> ''),
total AS (SELECT source, count(*) AS pages FROM doc GROUP BY source),
common AS (SELECT line.source, line.line, count(*) AS n FROM line GROUP BY 1, 2),
bad AS (SELECT c.source, list(c.line) AS bad FROM common c JOIN total t ON c.source IS NOT DISTINCT FROM t.source
        WHERE c.n >= {min_pages} AND c.n > {ratio}::DOUBLE * t.pages GROUP BY c.source),
cut AS (SELECT d.doc_id, d.ls, CASE WHEN b.bad IS NULL THEN d.ls ELSE
               list_filter(d.ls, lambda l: trim(l) = '' OR NOT list_contains(b.bad, trim(l))) END AS kept
        FROM doc d LEFT JOIN bad b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, CASE WHEN kept IS NULL THEN NULL ELSE array_to_string(kept, chr(10)) END AS text,
       CAST(coalesce(len(ls), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS INTEGER) AS n_dropped
FROM cut"""
