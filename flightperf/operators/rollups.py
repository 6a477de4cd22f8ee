"""Delay and flight-count rollups at every grain.

One pass over operated flights builds a *combined* rollup at the finest grain
(carrier, flight, date): the six cause counters and ``delayed_flights`` over delayed
rows, ``num_flights`` = ``count(carrier)`` over operated rows. Because every delayed row
is also an operated row, one conditional aggregation feeds both families:

* delay family at grain G = combined rows with ``delayed_flights > 0``, six counters
* count family at grain G = all combined rows, ``num_flights``

All measures are sums. A lazy grain is aggregated straight from the operated flights
(one shuffle each); a written warehouse re-aggregates every coarser grain from the next
finer written rollup instead of the raw flights (``plans.warehouse.build_all``).
Map-side partial aggregation applies at every step.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from flightperf.functions import exprs as X
from flightperf.functions.dims import COUNTERS, FLAG_TO_COUNTER
from flightperf.operators.classify import classify, filter_operated, with_delay_marker

MEASURES = COUNTERS + ["delayed_flights", "num_flights"]


@dataclass(frozen=True)
class Grain:
    name: str
    dims: list[str]                 # group columns = public dimensions
    parent: str | None              # finer grain it is re-aggregated from when materialized
    key_sql: str                    # SQL text of the composite key
    delay_table: str
    count_table: str
    partition_by: list[str] = field(default_factory=list)
    # columns derived after aggregation, as SQL text (functions of the dims, so they never
    # widen the shuffle key and the output stays hash-partitioned on the dims)
    derived: dict[str, str] = field(default_factory=dict)
    # the input's own calendar columns, carried in the written table under these names so that
    # coarser grains group on them (a date may be unreadable or disagree); never public
    carried: dict[str, str] = field(default_factory=dict)
    # dimensions that a written parent holds under another name
    source: dict[str, str] = field(default_factory=dict)

    def key(self) -> Column:
        return X.E(self.key_sql)


_FROM_DATE = {"year": "year(flight_date)", "quarter": "quarter(flight_date)", "month": "month(flight_date)"}
_FROM_MONTH = {"quarter": "CAST((month + 2) DIV 3 AS INT)"}


_k = X.key_sql


# ---------------------------------------------------------------------------
# FIXED VALUES: delay-family and count-family table names of the application,
# per grain (the two year-month grains are ours: the readers ask for them).
TABLE_NAMES = {
    "date": ("delay_date_count", "date_fcount"),
    "year": ("delay_year_count", "year_fcount"),
    "month": ("delay_month_count", "month_fcount"),
    "flight_date": ("delay_flightNum_date", "flightNum_date_fcount"),
    "flight_year": ("delay_flightNum_year", "flightNum_year_fcount"),
    "flight_month": ("delay_flightNum_month", "flightNum_month_fcount"),
    "flight_quarter": ("quarterly_delays", "quarterly_delays_fcount"),
    "year_month": ("delay_year_month_count", "year_month_fcount"),
    "flight_year_month": ("delay_flightNum_year_month", "flightNum_year_month_fcount"),
}
# END FIXED VALUES
# ---------------------------------------------------------------------------

_YM = X.year_month_text_sql("year", "month")
_DT = X.date_text_sql("flight_date")

GRAINS: dict[str, Grain] = {g.name: g for g in [
    Grain("flight_date", ["carrier", "flight_num", "flight_date"], None,
          _k("carrier", "flight_num", _DT), *TABLE_NAMES["flight_date"], ["year"],
          _FROM_DATE, {"in_year": "year", "in_quarter": "quarter", "in_month": "month"}),
    Grain("flight_year_month", ["carrier", "flight_num", "year", "month"], "flight_date",
          _k("carrier", "flight_num", _YM), *TABLE_NAMES["flight_year_month"], ["year"], _FROM_MONTH,
          {"in_quarter": "quarter"}, {"year": "in_year", "month": "in_month"}),
    Grain("flight_year", ["carrier", "flight_num", "year"], "flight_year_month",
          _k("carrier", "flight_num", "year"), *TABLE_NAMES["flight_year"], ["year"]),
    Grain("flight_quarter", ["carrier", "flight_num", "year", "quarter"], "flight_year_month",
          _k("carrier", "flight_num", "year", "quarter"), *TABLE_NAMES["flight_quarter"], ["year"],
          source={"quarter": "in_quarter"}),
    Grain("flight_month", ["carrier", "flight_num", "month"], "flight_year_month",
          _k("carrier", "flight_num", "month"), *TABLE_NAMES["flight_month"], []),
    Grain("date", ["carrier", "flight_date"], "flight_date",
          _k("carrier", _DT), *TABLE_NAMES["date"], ["year"], _FROM_DATE,
          {"in_year": "year", "in_month": "month"}),
    Grain("year_month", ["carrier", "year", "month"], "date",
          _k("carrier", _YM), *TABLE_NAMES["year_month"], ["year"], _FROM_MONTH,
          source={"year": "in_year", "month": "in_month"}),
    Grain("year", ["carrier", "year"], "year_month",
          _k("carrier", "year"), *TABLE_NAMES["year"], ["year"]),
    Grain("month", ["carrier", "month"], "year_month",
          _k("carrier", "month"), *TABLE_NAMES["month"], []),
]}

# table name -> (grain, family)
TABLES = {}
for _g in GRAINS.values():
    TABLES[_g.delay_table] = (_g.name, "delay")
    TABLES[_g.count_table] = (_g.name, "count")


def operated(flights: DataFrame) -> DataFrame:
    """Classified operated rows with the ``is_del`` marker: input of every rollup."""
    return with_delay_marker(filter_operated(classify(flights)))


def _derive(df: DataFrame, grain: str) -> DataFrame:
    g = GRAINS[grain]
    if not g.derived:
        return df
    return df.selectExpr("*", *[f"{sql} AS {name}" for name, sql in g.derived.items()])


def aggregate_flights(ops: DataFrame, grain: str, carry: bool = False) -> DataFrame:
    """Combined rollup at ``grain`` straight from operated rows (see :func:`operated`); with
    ``carry``, the grain's carried columns are group columns too (the written form).

    One shuffle keyed on the grain's dimensions; partial aggregation runs map-side, so
    a carrier holding a third of all rows sends at most one partial row per task and key.
    """
    g = GRAINS[grain]
    aggs = [f"CAST(sum({flag} * is_del) AS BIGINT) AS {cnt}" for flag, cnt in FLAG_TO_COUNTER]
    aggs += ["CAST(sum(is_del) AS BIGINT) AS delayed_flights", "count(carrier) AS num_flights"]
    cols = [*g.dims, *[X.E(src, name) for name, src in g.carried.items()]] if carry else g.dims
    return _derive(ops.groupBy(*cols).agg(*[X.E(a) for a in aggs]), grain)


def base_rollup(flights: DataFrame) -> DataFrame:
    """Combined rollup at the finest grain (carrier, flight, date, the input's calendar
    columns); the shuffle key is high-cardinality, so no hot key even if one carrier holds a
    third of all flights."""
    return aggregate_flights(operated(flights), "flight_date", carry=True)


def reaggregate(finer: DataFrame, grain: str) -> DataFrame:
    """Coarser combined rollup from a finer written one (sums of sums), grouped on the input's
    own year, quarter and month."""
    g = GRAINS[grain]
    cols = [X.E(g.source.get(d, d), d) for d in g.dims] + list(g.carried)
    out = finer.groupBy(*cols).agg(*[X.E(f"CAST(sum({m}) AS BIGINT) AS {m}") for m in MEASURES])
    return _derive(out, grain)


def added(old: DataFrame, new: DataFrame, grain: str) -> DataFrame:
    """Two written parts of one grain (the same groups may be in both), summed group by group."""
    g = GRAINS[grain]
    cols = [*g.dims, *g.carried]
    both = old.select(*cols, *MEASURES).unionByName(new.select(*cols, *MEASURES))
    return _derive(both.groupBy(*cols).agg(*[X.E(f"CAST(sum({m}) AS BIGINT) AS {m}") for m in MEASURES]), grain)


def written_schema(grain: str) -> str:
    """Columns of a written grain, the partition column last."""
    g = GRAINS[grain]
    kinds = {"carrier": "string", "flight_num": "string", "flight_date": "date"}
    cols = [*g.dims, *g.carried, *MEASURES, *[d for d in g.derived if d not in g.dims]]
    typed = [(c, "bigint" if c in MEASURES else kinds.get(c, "int")) for c in dict.fromkeys(cols)]
    typed.sort(key=lambda c: c[0] in g.partition_by)
    return ", ".join(f"{c} {t}" for c, t in typed)


def merged(combined: DataFrame, grain: str) -> DataFrame:
    """A written grain with carried columns, summed to one row for each public group."""
    g = GRAINS[grain]
    if not any(c in combined.columns for c in g.carried):
        return combined
    out = combined.groupBy(*g.dims).agg(*[X.E(f"CAST(sum({m}) AS BIGINT) AS {m}") for m in MEASURES])
    return _derive(out, grain)


def delay_view(combined: DataFrame, grain: str) -> DataFrame:
    """Delay-family table: key, dims, six counters; only groups with a delayed flight."""
    g = GRAINS[grain]
    return (combined.where("delayed_flights > 0")
            .selectExpr(f"{g.key_sql} AS key", *g.dims, *COUNTERS))


def count_view(combined: DataFrame, grain: str) -> DataFrame:
    """Count-family table: key, dims, num_flights; every group with an operated row."""
    g = GRAINS[grain]
    return combined.selectExpr(f"{g.key_sql} AS key", *g.dims, "num_flights")


def grouping_sets_rollup(date_grain: DataFrame) -> DataFrame:
    """All carrier grains in one aggregation: (carrier, date), (carrier, year),
    (carrier, year, month), (carrier, month), told apart by ``gid`` (grouping_id bits,
    first column most significant, 1 = rolled up). Runs on the carrier-day rollup, never on
    raw flights, since grouping sets multiply the input rows by the number of sets."""
    sets = [["carrier", "flight_date"], ["carrier", "year"], ["carrier", "year", "month"], ["carrier", "month"]]
    return (date_grain
            .groupingSets(sets, "carrier", "flight_date", "year", "month")
            .agg(X.E("CAST(grouping_id() AS INT) AS gid"),
                 *[X.E(f"CAST(sum({c}) AS BIGINT) AS {c}") for c in COUNTERS + ["num_flights"]]))
