"""Reference SQL for the named queries, runnable by DuckDB on the test tables.

Each text starts with the flight mapping of FIXTURES.md section 5 (``classified`` and its
inputs as CTEs) and then states the query in plain SQL, straight from the raw rows (no
rollups, no cover), so it checks the engine's plans rather than repeating them.
"""

from __future__ import annotations

import datetime as dt

from flightperf.functions.dims import CARRIERS, CARRIER_CODES
from flightperf.plans import queries as QS

# FIXTURES.md section 5, verbatim.
PREFIX = """WITH b AS (
  SELECT l_orderkey, l_linenumber,
    CASE l_suppkey % 26 WHEN 0 THEN '9E' WHEN 1 THEN 'AA' WHEN 2 THEN 'AQ' WHEN 3 THEN 'AS' WHEN 4 THEN 'B6' WHEN 5 THEN 'CO' WHEN 6 THEN 'DH' WHEN 7 THEN 'DL' WHEN 8 THEN 'E*' WHEN 9 THEN 'EV' WHEN 10 THEN 'F9' WHEN 11 THEN 'FL' WHEN 12 THEN 'HA' WHEN 13 THEN 'HP' WHEN 14 THEN 'MQ' WHEN 15 THEN 'NW' WHEN 16 THEN 'OH' WHEN 17 THEN 'OO' WHEN 18 THEN 'TW' WHEN 19 THEN 'TZ' WHEN 20 THEN 'UA' WHEN 21 THEN 'US' WHEN 22 THEN 'VX' WHEN 23 THEN 'WN' WHEN 24 THEN 'XE' WHEN 25 THEN 'YV' END AS carrier,
    CAST(l_partkey % 40 + 1 AS VARCHAR(10)) AS flight_num,
    CAST(l_shipdate AS DATE) AS flight_date,
    CAST(l_quantity AS INT) AS q,
    CAST(round(l_discount * 100) AS INT) AS d,
    CAST(round(l_tax * 100) AS INT) AS t
  FROM lineitem),
c AS (
  SELECT *,
    CASE WHEN l_linenumber = 7 AND q % 5 = 0 THEN NULL ELSE q - 25 END AS arr_delay,
    CASE WHEN t = 8 AND l_linenumber = 6 THEN NULL WHEN d = 10 THEN 1 ELSE 0 END AS cancelled
  FROM b),
flights AS (
  SELECT carrier, flight_num, flight_date,
    CAST(year(flight_date) AS INT) AS year, CAST(quarter(flight_date) AS INT) AS quarter,
    CAST(month(flight_date) AS INT) AS month, CAST(day(flight_date) AS INT) AS day_of_month,
    arr_delay, cancelled,
    CASE WHEN arr_delay IS NULL THEN NULL WHEN arr_delay >= 15 THEN 1 ELSE 0 END AS arr_del15,
    CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % 3 = 0 THEN arr_delay ELSE 0 END END AS carrier_delay,
    CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % 11 = 0 THEN arr_delay ELSE 0 END END AS weather_delay,
    CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % 4 = 1 THEN arr_delay ELSE 0 END END AS nas_delay,
    CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % 97 = 0 THEN arr_delay ELSE 0 END END AS security_delay,
    CASE WHEN arr_delay >= 15 THEN CASE WHEN l_orderkey % 5 = 2 THEN arr_delay ELSE 0 END END AS late_aircraft_delay
  FROM c),
k AS (
  SELECT *,
    CASE WHEN carrier_delay IS NULL OR carrier_delay = 0 THEN 0 ELSE 1 END AS carrier_b,
    CASE WHEN weather_delay IS NULL OR weather_delay = 0 THEN 0 ELSE 1 END AS weather_b,
    CASE WHEN nas_delay IS NULL OR nas_delay = 0 THEN 0 ELSE 1 END AS nas_b,
    CASE WHEN security_delay IS NULL OR security_delay = 0 THEN 0 ELSE 1 END AS security_b,
    CASE WHEN late_aircraft_delay IS NULL OR late_aircraft_delay = 0 THEN 0 ELSE 1 END AS late_aircraft_b
  FROM flights),
classified AS (
  SELECT *,
    CASE WHEN carrier_b = 1 OR weather_b = 1 OR nas_b = 1 OR security_b = 1 OR late_aircraft_b = 1 THEN 0 ELSE 1 END AS other_b
  FROM k)"""

# classified rows with the date as text (fd), so grouping and output never clash on names
CL = ",\ncl AS (SELECT *, CAST(flight_date AS VARCHAR) AS fd FROM classified)"

OP = "cancelled <> 1"
DEL = "(arr_delay IS NOT NULL AND arr_del15 = 1 AND cancelled <> 1)"
FLAG_COUNTER = [("carrier_b", "carrier_num"), ("weather_b", "weather_num"), ("nas_b", "nas_num"),
                ("security_b", "security_num"), ("late_aircraft_b", "late_aircraft_num"), ("other_b", "other_num")]
COUNTERS_SQL = ", ".join(c for _, c in FLAG_COUNTER)
ALL_FLAGS = " + ".join(f for f, _ in FLAG_COUNTER)


def _d(x) -> str:
    return f"DATE '{x.isoformat()}'"


def _range(r) -> str:
    return f"flight_date >= {_d(r[0])} AND flight_date < {_d(r[1])}"


def sums_del() -> str:
    """Six counters over rows already filtered to delayed flights."""
    return ", ".join(f"CAST(sum({f}) AS BIGINT) AS {c}" for f, c in FLAG_COUNTER)


def sums_cond() -> str:
    """Six counters over operated rows, counting only the delayed ones."""
    return ", ".join(f"CAST(sum(CASE WHEN {DEL} THEN {f} ELSE 0 END) AS BIGINT) AS {c}" for f, c in FLAG_COUNTER)


def _in_list(codes) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


YM = "CAST(year AS VARCHAR) || '-' || lpad(CAST(month AS VARCHAR), 2, '0')"

# grain -> (group columns in cl, select list for dims, key expression)
GRAIN_SQL = {
    "date": (["carrier", "fd"], "carrier, fd AS flight_date", "carrier || '_' || fd"),
    "year": (["carrier", "year"], "carrier, year", "carrier || '_' || CAST(year AS VARCHAR)"),
    "month": (["carrier", "month"], "carrier, month", "carrier || '_' || CAST(month AS VARCHAR)"),
    "flight_date": (["carrier", "flight_num", "fd"], "carrier, flight_num, fd AS flight_date",
                    "carrier || '_' || flight_num || '_' || fd"),
    "flight_year": (["carrier", "flight_num", "year"], "carrier, flight_num, year",
                    "carrier || '_' || flight_num || '_' || CAST(year AS VARCHAR)"),
    "flight_month": (["carrier", "flight_num", "month"], "carrier, flight_num, month",
                     "carrier || '_' || flight_num || '_' || CAST(month AS VARCHAR)"),
    "flight_quarter": (["carrier", "flight_num", "year", "quarter"], "carrier, flight_num, year, quarter",
                       "carrier || '_' || flight_num || '_' || CAST(year AS VARCHAR) || '_' || CAST(quarter AS VARCHAR)"),
    "year_month": (["carrier", "year", "month"], "carrier, year, month", f"carrier || '_' || {YM}"),
    "flight_year_month": (["carrier", "flight_num", "year", "month"], "carrier, flight_num, year, month",
                          f"carrier || '_' || flight_num || '_' || {YM}"),
}

TABLE_ORDER = ["flight_date", "flight_year_month", "flight_year", "flight_quarter", "flight_month",
               "date", "year_month", "year", "month"]


def rollup_body(family: str, grain: str, where: str = "") -> str:
    group, dims, key = GRAIN_SQL[grain]
    extra = f" AND {where}" if where else ""
    if family == "delay":
        return f"SELECT {key} AS key, {dims}, {sums_del()} FROM cl WHERE {DEL}{extra} GROUP BY {', '.join(group)}"
    return (f"SELECT {key} AS key, {dims}, CAST(count(carrier) AS BIGINT) AS num_flights FROM cl "
            f"WHERE {OP}{extra} GROUP BY {', '.join(group)}")


def rollup_sql(family: str, grain: str, where: str = "") -> str:
    return PREFIX + CL + "\n" + rollup_body(family, grain, where)


def _build_all_sql() -> str:
    from flightperf.operators.rollups import GRAINS
    parts = []
    for grain in TABLE_ORDER:
        group = ", ".join(GRAIN_SQL[grain][0])
        g = GRAINS[grain]
        parts.append(f"SELECT '{g.delay_table}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM "
                     f"(SELECT 1 AS one FROM cl WHERE {DEL} GROUP BY {group}) x")
        parts.append(f"SELECT '{g.count_table}' AS table_name, CAST(count(*) AS BIGINT) AS n_rows FROM "
                     f"(SELECT 1 AS one FROM cl WHERE {OP} GROUP BY {group}) x")
    return PREFIX + CL + "\n" + "\nUNION ALL\n".join(parts)


SCAN_SQL = PREFIX + """
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date, arr_delay, arr_del15, cancelled,
  carrier_delay, weather_delay, nas_delay, security_delay, late_aircraft_delay FROM flights"""


def _cells(src: str, ids: str, exact: bool = False) -> str:
    """On Time + six category rows from a CTE holding num_flights and the counters
    (On Time = flights - flags, or flights - delayed flights when ``exact``)."""
    six = " + ".join(c for _, c in FLAG_COUNTER)
    on_time = "num_flights - delayed_flights" if exact else f"num_flights - ({six})"
    rows = [f"SELECT {ids}, num_flights, 0 AS category_ord, 'On Time' AS category, {on_time} AS value FROM {src}"]
    names = [("NAS", "nas_num", 1), ("Security", "security_num", 2), ("Weather", "weather_num", 3),
             ("Late Aircraft", "late_aircraft_num", 4), ("Carrier", "carrier_num", 5), ("Unclassified", "other_num", 6)]
    for name, col, o in names:
        rows.append(f"SELECT {ids}, num_flights, {o} AS category_ord, '{name}' AS category, {col} AS value FROM {src}")
    return "\nUNION ALL ".join(rows)


def _category_report_sql(ids: list[str], where: str, keys_values: str | None, exact: bool = False) -> str:
    idl = ", ".join(ids)
    t = (f",\nt AS (SELECT {idl}, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights, "
         f"CAST(sum(CASE WHEN {DEL} THEN 1 ELSE 0 END) AS BIGINT) AS delayed_flights FROM classified "
         f"WHERE {OP} AND {where} GROUP BY {idl})")
    if keys_values is not None:
        # a single requested key: one row even without flights (zeros)
        on = " AND ".join(f"kk.{i} = t.{i}" for i in ids)
        cols = ", ".join(f"kk.{i} AS {i}" for i in ids)
        t += (f",\nkk AS (SELECT * FROM (VALUES {keys_values}) v({idl})),\n"
              f"t2 AS (SELECT {cols}, "
              + ", ".join(f"coalesce(t.{c}, 0) AS {c}" for _, c in FLAG_COUNTER)
              + f", coalesce(t.num_flights, 0) AS num_flights, coalesce(t.delayed_flights, 0) AS delayed_flights"
              f" FROM kk LEFT JOIN t ON {on})")
        src = "t2"
    else:
        t += ",\nt2 AS (SELECT * FROM t WHERE num_flights > 0)"
        src = "t2"
    cells = f",\ncells AS ({_cells(src, idl, exact=exact)})"
    return (PREFIX + t + cells + f"""
SELECT {idl}, CAST(category_ord AS INTEGER) AS category_ord, category, CAST(value AS BIGINT) AS value,
  round(CASE WHEN num_flights = 0 THEN 0.0 ELSE CAST(value AS DOUBLE) / CAST(num_flights AS DOUBLE) END, 6) AS ratio
FROM cells WHERE category_ord = 0 OR value >= 1""")


def _season_sql(where: str, labels=("Fall", "Winter", "Spring", "Summer")) -> str:
    s = (PREFIX + f""",
t AS (SELECT carrier, flight_num, year, quarter, CAST(count(carrier) AS BIGINT) AS num_flights, {sums_cond()}
  FROM classified WHERE {OP} AND year = {QS.SEASON_YEAR}{where} GROUP BY carrier, flight_num, year, quarter),
keys AS (SELECT DISTINCT carrier, flight_num, year FROM t),
qs AS (SELECT * FROM (VALUES """ + ", ".join(f"({i}, '{n}')" for i, n in enumerate(labels, 1)) + """) v(season_ord, season)),
m AS (SELECT keys.carrier, keys.flight_num, keys.year, qs.season_ord, qs.season,
  coalesce(t.num_flights, 0) AS num_flights, """
         + ", ".join(f"coalesce(t.{c}, 0) AS {c}" for _, c in FLAG_COUNTER)
         + """
  FROM keys CROSS JOIN qs LEFT JOIN t ON t.carrier = keys.carrier AND t.flight_num = keys.flight_num
   AND t.year = keys.year AND t.quarter = qs.season_ord),
cells AS (""" + _cells("m", "carrier, flight_num, year, season_ord, season") + """)
SELECT carrier, flight_num, CAST(year AS INTEGER) AS year, CAST(season_ord AS INTEGER) AS season_ord, season,
  CAST(category_ord AS INTEGER) AS category_ord, category, CAST(value AS BIGINT) AS value FROM cells""")
    return s


HOLIDAY_SQL = {
    "New Year": ("make_date(CAST(y AS INTEGER), 1, 1)", "make_date(CAST(y AS INTEGER), 1, 15)"),
    "Christmas": ("make_date(CAST(y AS INTEGER), 12, 25)", "make_date(CAST(y AS INTEGER), 12, 15)"),
    "Independence Day": ("make_date(CAST(y AS INTEGER), 7, 4)", "make_date(CAST(y AS INTEGER), 7, 15)"),
    "Thanksgiving": ("make_date(CAST(y AS INTEGER), 11, 1) + CAST((11 - isodow(make_date(CAST(y AS INTEGER), 11, 1))) % 7 + 21 AS INTEGER)",
                     "make_date(CAST(y AS INTEGER), 11, 15)"),
}


def _holiday_sql(skeleton: str, holidays: list[str], day_where: str = "") -> str:
    hol_rows = "\nUNION ALL ".join(
        f"SELECT carrier, '{h}' AS holiday, y AS year, {hd} AS hdate, {bd} AS bdate FROM sk"
        for h, (hd, bd) in ((h, HOLIDAY_SQL[h]) for h in holidays))
    return (PREFIX + f""",
sk AS ({skeleton}),
want AS ({hol_rows}),
dd AS (SELECT carrier, flight_date, CAST(count(carrier) AS BIGINT) AS n,
  CAST(sum(CASE WHEN {DEL} THEN {ALL_FLAGS} ELSE 0 END) AS BIGINT) AS f
  FROM classified WHERE {OP}{day_where} GROUP BY carrier, flight_date)
SELECT w.carrier, w.holiday, CAST(w.year AS INTEGER) AS year,
  round(CASE WHEN coalesce(h.n, 0) = 0 THEN 0.0 ELSE CAST(h.f AS DOUBLE) / CAST(h.n AS DOUBLE) END, 6) AS ratio_holiday,
  round(CASE WHEN coalesce(b.n, 0) = 0 THEN 0.0 ELSE CAST(b.f AS DOUBLE) / CAST(b.n AS DOUBLE) END, 6) AS ratio_baseline
FROM want w
LEFT JOIN dd h ON h.carrier = w.carrier AND h.flight_date = w.hdate
LEFT JOIN dd b ON b.carrier = w.carrier AND b.flight_date = w.bdate""")


# flights whose date can't be read on some days
DIRTY = (",\ncl AS (SELECT *, CASE WHEN day(flight_date) = 5 AND month IN (1, 7) THEN NULL "
         "ELSE CAST(flight_date AS VARCHAR) END AS fd FROM classified)")


def _built_tables_sql() -> str:
    from flightperf.operators.rollups import TABLES
    parts = []
    for name, (grain, family) in TABLES.items():
        group = GRAIN_SQL[grain][0]
        dims = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in group)
        cols = [c for _, c in FLAG_COUNTER] if family == "delay" else ["num_flights"]
        measures = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
        body = rollup_body(family, grain).replace("fd AS flight_date", "fd")
        parts.append(f"SELECT '{name}' AS table_name, key, {dims} AS dims, {measures} AS measures FROM ({body}) t")
    return PREFIX + DIRTY + "\n" + "\nUNION ALL\n".join(parts)


def _export_sql() -> str:
    from flightperf.operators.rollups import TABLES
    from flightperf.plans.warehouse import TSV_EXPORT_TABLES
    parts = []
    for name in TSV_EXPORT_TABLES:
        grain, family = TABLES[name]
        cols = ["key", *GRAIN_SQL[grain][0], *([c for _, c in FLAG_COUNTER] if family == "delay" else ["num_flights"])]
        line = " || chr(9) || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols)
        body = rollup_body(family, grain).replace("fd AS flight_date", "fd")
        parts.append(f"SELECT '{name}' AS table_name, {line} AS line FROM ({body}) t")
    return PREFIX + DIRTY + "\n" + "\nUNION ALL\n".join(parts)


def _more_sql(sql: dict[str, str]) -> dict[str, str]:
    """Written tables, exports, display order and chart payloads."""
    carrier_ord = "CASE rep.carrier " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CARRIER_CODES)) + " END"
    y0, y1 = QS.HOLIDAY_YEARS
    r1 = QS.RANGE1
    holiday = _holiday_sql(
        f"SELECT carrier, range AS y FROM (SELECT DISTINCT carrier FROM classified WHERE {OP}), range({y0}, {y1 + 1})",
        [QS.HOLIDAY])

    def over(name_or_sql: str, select: str) -> str:
        return f"WITH rep AS ({name_or_sql})\n{select}"
    return {
        "redelivered_month": PREFIX + f"""
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date,
  CASE WHEN year = {QS.MERGE_YEAR} AND month = 6 THEN arr_delay + 1 ELSE arr_delay END AS arr_delay, arr_del15, cancelled,
  carrier_delay, weather_delay, nas_delay, security_delay, late_aircraft_delay FROM flights""",
        "key_range_read_text": sql["key_range_read"],
        "many_ranges": PREFIX + CL + f""",
r AS (SELECT carrier, min(flight_date) AS s, min(flight_date) + CAST(any_value(month * month * 10 - 15) AS INTEGER) AS e
  FROM cl WHERE {OP} GROUP BY carrier, year, month)
SELECT r.carrier, CAST(s AS VARCHAR) AS range_start, CAST(e AS VARCHAR) AS range_end,
  {", ".join(f"CAST(coalesce(sum(CASE WHEN {DEL} THEN {f} ELSE 0 END), 0) AS BIGINT) AS {c}" for f, c in FLAG_COUNTER)},
  CAST(count(CASE WHEN {DEL} THEN 1 END) AS BIGINT) AS delayed_flights, CAST(count(cl.carrier) AS BIGINT) AS num_flights
FROM r LEFT JOIN cl ON cl.carrier = r.carrier AND flight_date >= s AND flight_date < e AND {OP} GROUP BY r.carrier, s, e""",
        "match_bucketed": PREFIX + DIRTY + f"""
SELECT carrier, fd AS flight_date, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights
FROM cl WHERE {OP} GROUP BY carrier, fd""",
        "key_bloom_read": PREFIX + CL + f"""
SELECT * FROM ({rollup_body("count", "flight_date")}) x WHERE key >= '{QS.CARRIER}_{QS.FLIGHT}_{r1[0]}'
  AND key < '{QS.CARRIER}_{QS.FLIGHT}_{r1[0] + dt.timedelta(days=7)}'""",
        **{f"running_{name}": sql[name] for name in ("report_category_all", "report_flight_all", "report_airline")},
        "merge_by_key": PREFIX + CL + f""",
first AS ({rollup_body("count", "flight_year", f"year <= {QS.MERGE_YEAR}")}),
later AS ({rollup_body("count", "flight_year", f"year >= {QS.MERGE_YEAR} AND day_of_month <= 15")})
SELECT * FROM later WHERE key IS NOT NULL
UNION ALL SELECT * FROM first WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM later WHERE key IS NOT NULL)""",
        "merge_deliveries": PREFIX + CL + f""",
t AS ({rollup_body("delay", "date")}),
d AS (SELECT t.* REPLACE (CAST(nas_num + n AS BIGINT) AS nas_num), CAST(n AS INTEGER) AS delivery
  FROM t, range(0, 5) r(n) WHERE n = 0 OR (month(CAST(flight_date AS DATE)) = 6 AND day(CAST(flight_date AS DATE)) % n = 0))
SELECT * EXCLUDE (carrier) FROM d WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY delivery DESC) = 1""",
        "built_tables": _built_tables_sql(),
        "delta_tables": _built_tables_sql(),
        "export_tsv": _export_sql(),
        "project_flights_narrow": PREFIX + """
SELECT carrier, year, quarter, month, day_of_month, CAST(isodow(flight_date) AS INTEGER) AS day_of_week,
  CAST(flight_date AS VARCHAR) AS flight_date, flight_num, arr_delay, arr_del15, cancelled FROM flights""",
        "range_check": PREFIX + f"""
SELECT DISTINCT CAST(flight_date AS VARCHAR) AS flight_date, flight_date <= {_d(QS.RANGE1[0])} AS valid FROM flights""",
        "join_delay_count_null": PREFIX + DIRTY + f"""
SELECT carrier, fd AS flight_date, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights
FROM cl WHERE {OP} GROUP BY carrier, fd""",
        "display_category": over(sql["report_category_all"], f"""SELECT carrier, {carrier_ord} AS carrier_ord,
  CAST(row_number() OVER (PARTITION BY carrier ORDER BY category_ord) AS INTEGER) AS position, category FROM rep"""),
        "display_holiday": over(holiday, f"""SELECT carrier, {carrier_ord} AS carrier_ord,
  CAST(row_number() OVER (PARTITION BY carrier ORDER BY holiday, year) AS INTEGER) AS position, year FROM rep"""),
        "payload_holiday": over(holiday, """SELECT carrier, '{"year":[' || string_agg(CAST(year AS VARCHAR), ',' ORDER BY year)
  || '],"ratio_holiday":[' || string_agg(CAST(ratio_holiday AS VARCHAR), ',' ORDER BY year)
  || '],"ratio_baseline":[' || string_agg(CAST(ratio_baseline AS VARCHAR), ',' ORDER BY year) || ']}' AS payload
FROM rep GROUP BY carrier"""),
        "payload_season": over(sql["report_season_all"], """SELECT carrier, flight_num, season,
  '[' || string_agg('["' || category || '", ' || CAST(value AS VARCHAR) || ']', ', ' ORDER BY category_ord) || ']' AS payload
FROM rep GROUP BY carrier, flight_num, season"""),
        "payload_airline": over(sql["report_airline"], """SELECT '{"carrier":[' || string_agg('"' || carrier || '"', ',' ORDER BY carrier)
  || '],"ratio":[' || string_agg(CAST(ratio AS VARCHAR), ',' ORDER BY carrier) || ']}' AS payload FROM rep"""),
        **{f"built_{name}": sql[name] for name in ("report_category_all", "report_flight_all", "report_season_all",
                                                   "report_airline", "report_holiday_all")},
    }


def all_sql() -> dict[str, str]:
    r1, r2 = QS.RANGE1, QS.RANGE2
    sql: dict[str, str] = {}
    sql["scan_csv"] = SCAN_SQL
    sql["scan_csv_dir"] = SCAN_SQL
    sql["scan_csv_header"] = SCAN_SQL
    sql["scan_zip_csv"] = SCAN_SQL
    sql["cast_lenient_int"] = PREFIX + """,
x AS (SELECT CASE WHEN flight_num = '1' THEN 'x' ELSE CAST(arr_delay AS VARCHAR) || '.00' END AS txt FROM flights)
SELECT txt, CAST(trunc(TRY_CAST(txt AS DOUBLE)) AS INTEGER) AS val FROM x"""
    sql["sink_delay_parquet"] = rollup_sql("delay", "year")
    sql["sink_count_parquet"] = rollup_sql("count", "year")
    sql["sink_tsv"] = rollup_sql("delay", "date")
    sql["key_point_read"] = (PREFIX + CL + "\nSELECT * FROM (" + rollup_body("delay", "flight_quarter")
                             + f") x WHERE key IN {_in_list(QS.POINT_KEYS)}")
    sql["key_range_read"] = rollup_sql("count", "date", f"carrier = '{QS.CARRIER}' AND {_range(r1)}")
    sql["build_all"] = _build_all_sql()
    sql["project_flights"] = PREFIX + """
SELECT carrier, year, quarter, month, day_of_month, CAST(isodow(flight_date) AS INTEGER) AS day_of_week,
  CAST(flight_date AS VARCHAR) AS flight_date, flight_num, arr_delay, arr_del15, cancelled,
  carrier_delay, weather_delay, nas_delay, security_delay, late_aircraft_delay FROM flights"""
    sql["classify_causes"] = PREFIX + """
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date, arr_delay, arr_del15, cancelled,
  carrier_b, weather_b, nas_b, security_b, late_aircraft_b FROM classified"""
    sql["classify_other"] = PREFIX + """
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date, arr_delay, arr_del15, cancelled,
  carrier_b, weather_b, nas_b, security_b, late_aircraft_b, other_b FROM classified"""
    sql["filter_delayed"] = PREFIX + f"""
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date, arr_delay, cancelled FROM classified WHERE {DEL}"""
    sql["filter_operated"] = PREFIX + f"""
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date, arr_delay, cancelled FROM classified WHERE {OP}"""
    sql["make_keys"] = PREFIX + f"""
SELECT carrier, flight_num, CAST(flight_date AS VARCHAR) AS flight_date,
  carrier || '_' || CAST(flight_date AS VARCHAR) AS key2,
  carrier || '_' || flight_num || '_' || CAST(flight_date AS VARCHAR) AS key3,
  carrier || '_' || flight_num || '_' || CAST(year AS VARCHAR) || '_' || CAST(quarter AS VARCHAR) AS key4,
  carrier || '_' || {YM} AS key_ym
FROM flights WHERE {OP}"""
    sql["norm_params"] = PREFIX + """
SELECT DISTINCT lower(carrier) AS carrier_in, upper(lower(carrier)) AS carrier FROM flights"""
    sql["date_transform"] = PREFIX + """,
s AS (SELECT DISTINCT strftime(flight_date, '%m/%d/%Y') AS src FROM flights)
SELECT src, split_part(src, '/', 3) || '-' || split_part(src, '/', 1) || '-' || split_part(src, '/', 2) AS iso FROM s"""
    sql["date_cover"] = PREFIX + f""",
op AS (SELECT * FROM classified WHERE {OP}),
spans AS (
  SELECT carrier, CAST(year AS VARCHAR) AS span, min(flight_date) AS s, max(flight_date) + 1 AS e FROM op GROUP BY carrier, year
  UNION ALL
  SELECT carrier, 'all' AS span, min(flight_date) AS s, max(flight_date) + 1 AS e FROM op GROUP BY carrier),
p1 AS (SELECT *, CASE WHEN day(s) = 1 THEN s ELSE CAST(make_date(year(s), month(s), 1) + INTERVAL 1 MONTH AS DATE) END AS a,
  make_date(year(e), month(e), 1) AS z FROM spans),
p2 AS (SELECT *, CASE WHEN month(a) = 1 THEN a ELSE make_date(year(a) + 1, 1, 1) END AS ya, make_date(year(z), 1, 1) AS yz FROM p1),
p3 AS (SELECT *, a < z AS has_m, (a < z AND ya < yz) AS has_y FROM p2),
segs AS (
  SELECT carrier, span, 1 AS seg_ord, 'day' AS grain, s AS seg_start, CASE WHEN has_m THEN a ELSE e END AS seg_end FROM p3
  UNION ALL SELECT carrier, span, 2, 'month', a, CASE WHEN has_y THEN ya ELSE z END FROM p3 WHERE has_m
  UNION ALL SELECT carrier, span, 3, 'year', ya, yz FROM p3 WHERE has_y
  UNION ALL SELECT carrier, span, 4, 'month', yz, z FROM p3 WHERE has_y
  UNION ALL SELECT carrier, span, 5, 'day', z, e FROM p3 WHERE has_m)
SELECT carrier, span, CAST(seg_ord AS INTEGER) AS seg_ord, grain, CAST(seg_start AS VARCHAR) AS seg_start,
  CAST(seg_end AS VARCHAR) AS seg_end FROM segs WHERE seg_start < seg_end"""
    sql["union_segments"] = PREFIX + "\n" + "\nUNION ALL\n".join(
        f"SELECT {i} AS range_id, carrier, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights "
        f"FROM classified WHERE {OP} AND {_range(r)} GROUP BY carrier"
        for i, r in ((1, r1), (2, r2)))
    sql["range_delay_totals"] = PREFIX + f"""
SELECT carrier, {sums_del()} FROM classified WHERE {DEL} AND {_range(r1)} GROUP BY carrier"""
    sql["range_flight_total"] = PREFIX + f"""
SELECT carrier, CAST(count(carrier) AS BIGINT) AS num_flights FROM classified WHERE {OP} AND {_range(r1)} GROUP BY carrier"""
    for g in QS.ROLLUP_GRAINS:
        sql[f"rollup_delay_{g}"] = rollup_sql("delay", g)
        sql[f"rollup_count_{g}"] = rollup_sql("count", g)
    sql["rollup_grouping_sets"] = PREFIX + CL + f"""
SELECT carrier, fd AS flight_date, year, month, CAST(GROUPING(carrier, fd, year, month) AS INTEGER) AS gid,
  {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights
FROM cl WHERE {OP}
GROUP BY GROUPING SETS ((carrier, fd), (carrier, year), (carrier, year, month), (carrier, month))"""
    sql["join_delay_count"] = PREFIX + CL + f"""
SELECT carrier, fd AS flight_date, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights
FROM cl WHERE {OP} GROUP BY carrier, fd"""
    names = ", ".join("('{}', '{}')".format(c, n.replace("'", "''")) for c, n in CARRIERS)
    sql["join_carrier_name"] = PREFIX + f""",
names AS (SELECT * FROM (VALUES {names}) v(carrier, carrier_name)),
t AS (SELECT carrier, CAST(count(carrier) AS BIGINT) AS num_flights FROM classified WHERE {OP} GROUP BY carrier)
SELECT t.carrier, names.carrier_name, t.num_flights FROM t LEFT JOIN names ON t.carrier = names.carrier"""
    sql["semi_known_carriers"] = rollup_sql("count", "year", f"carrier IN {_in_list(QS.SHORT_CARRIERS)}")
    sql["on_time_count"] = PREFIX + f""",
t AS (SELECT carrier, CAST(count(carrier) AS BIGINT) AS num_flights,
  CAST(sum(CASE WHEN {DEL} THEN 1 ELSE 0 END) AS BIGINT) AS delayed_flights,
  CAST(sum(CASE WHEN {DEL} THEN {ALL_FLAGS} ELSE 0 END) AS BIGINT) AS flag_total
  FROM classified WHERE {OP} AND {_range(r1)} GROUP BY carrier)
SELECT carrier, num_flights, delayed_flights, flag_total, num_flights - flag_total AS on_time,
  num_flights - delayed_flights AS on_time_exact FROM t"""
    days_all = (CL + f""",
dd AS (SELECT carrier, fd, CAST(sum(CASE WHEN {DEL} THEN nas_b ELSE 0 END) AS BIGINT) AS nas,
  CAST(count(CASE WHEN {OP} THEN carrier END) AS BIGINT) AS n FROM cl GROUP BY carrier, fd)""")
    sql["ratio_guarded"] = PREFIX + days_all + """
SELECT carrier, fd AS flight_date,
  round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(nas AS DOUBLE) / CAST(n AS DOUBLE) END, 6) AS ratio FROM dd"""
    sql["ratio_percent"] = PREFIX + days_all + """
SELECT carrier, fd AS flight_date,
  round(CASE WHEN n = 0 THEN 0.0 ELSE CAST(nas AS DOUBLE) * 100.0 / CAST(n AS DOUBLE) END, 2) AS pct FROM dd"""
    totals_r1 = (f",\nt AS (SELECT carrier, {sums_cond()}, CAST(count(carrier) AS BIGINT) AS num_flights "
                 f"FROM classified WHERE {OP} AND {_range(r1)} GROUP BY carrier)")
    sql["unpivot_categories"] = PREFIX + totals_r1 + ",\ncells AS (" + _cells("t", "carrier") + """)
SELECT carrier, CAST(category_ord AS INTEGER) AS category_ord, category, CAST(value AS BIGINT) AS value
FROM cells WHERE category_ord > 0"""
    sql["category_nonzero"] = PREFIX + totals_r1 + ",\ncells AS (" + _cells("t", "carrier") + """)
SELECT carrier, CAST(category_ord AS INTEGER) AS category_ord, category, CAST(value AS BIGINT) AS value
FROM cells WHERE category_ord = 0 OR value >= 1"""
    sql["pivot_seasons"] = PREFIX + f"""
SELECT carrier, year,
  CAST(count(CASE WHEN quarter = 1 THEN carrier END) AS BIGINT) AS fall,
  CAST(count(CASE WHEN quarter = 2 THEN carrier END) AS BIGINT) AS winter,
  CAST(count(CASE WHEN quarter = 3 THEN carrier END) AS BIGINT) AS spring,
  CAST(count(CASE WHEN quarter = 4 THEN carrier END) AS BIGINT) AS summer
FROM classified WHERE {OP} GROUP BY carrier, year"""
    sql["report_category"] = _category_report_sql(["carrier"], f"{_range(r1)} AND carrier = '{QS.CARRIER}'",
                                                  f"('{QS.CARRIER}')")
    sql["report_category_all"] = _category_report_sql(["carrier"], _range(r1), None)
    sql["report_flight"] = _category_report_sql(
        ["carrier", "flight_num"], f"{_range(r1)} AND carrier = '{QS.CARRIER}' AND flight_num = '{QS.FLIGHT}'",
        f"('{QS.CARRIER}', '{QS.FLIGHT}')")
    sql["report_flight_all"] = _category_report_sql(["carrier", "flight_num"], _range(r1), None)
    sql["report_season"] = _season_sql(f" AND carrier = '{QS.CARRIER}' AND flight_num = '{QS.FLIGHT}'")
    sql["report_season_all"] = _season_sql("")
    sql["report_season_calendar"] = _season_sql("", ("Winter", "Spring", "Summer", "Fall"))
    sql["report_category_exact"] = _category_report_sql(["carrier"], _range(r1), None, exact=True)
    sql["report_airline"] = PREFIX + f""",
t AS (SELECT carrier, CAST(count(carrier) AS BIGINT) AS n,
  CAST(sum(CASE WHEN {DEL} THEN carrier_b + late_aircraft_b + other_b ELSE 0 END) AS BIGINT) AS a
  FROM classified WHERE {OP} AND {_range(r1)} GROUP BY carrier)
SELECT carrier, a AS attributable, n AS num_flights,
  round(CAST(a AS DOUBLE) / CAST(n AS DOUBLE), 6) AS ratio
FROM t WHERE n > 0 AND carrier IN {_in_list(CARRIER_CODES)}"""
    y0, y1 = QS.HOLIDAY_YEARS
    sql["report_holiday"] = _holiday_sql(
        f"SELECT '{QS.CARRIER}' AS carrier, range AS y FROM range({y0}, {y1 + 1})", [QS.HOLIDAY],
        f" AND carrier = '{QS.CARRIER}'")
    # years of the data, the same for every carrier with flights
    sql["report_holiday_all"] = _holiday_sql(
        f"SELECT c.carrier, y.y FROM (SELECT DISTINCT carrier FROM classified WHERE {OP} AND carrier IS NOT NULL) c, "
        f"(SELECT DISTINCT year AS y FROM classified WHERE {OP} AND carrier IS NOT NULL) y",
        ["New Year", "Christmas", "Thanksgiving", "Independence Day"])
    sql["run_report"] = sql["report_category"]
    sql |= _more_sql(sql)
    rep = sql["report_category_all"]
    body = rep[len(PREFIX):]
    # the category report as a CTE, then one payload string per carrier
    head, final = body.rsplit("\nSELECT ", 1)
    sql["report_json"] = (PREFIX + head + ",\nrep AS (SELECT " + final + """)
SELECT carrier, '[' || string_agg('["' || category || '", ' || printf('%.6f', ratio) || ']', ', ' ORDER BY category_ord)
  || ']' AS payload FROM rep GROUP BY carrier""")
    return sql
