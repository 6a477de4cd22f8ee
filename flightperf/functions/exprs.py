"""Column expressions used across the engine.

All are built-in Spark SQL functions, so they stay inside whole-stage codegen; nothing
here runs Python per row. Each expression is written once as SQL text (``*_sql``) and
handed to Spark in a single call (``F.expr``): building a plan then costs one driver round
trip per expression instead of one per sub-expression. Arguments are column names or SQL
text of other expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightperf.functions.dims import CAUSE_TO_FLAG, FIXED_HOLIDAYS, THANKSGIVING


def E(sql: str, alias: str | None = None) -> Column:
    """SQL text -> Column (optionally named)."""
    c = F.expr(sql)
    return c.alias(alias) if alias else c


# --- typing ----------------------------------------------------------------

def lenient_int_sql(c: str) -> str:
    """Numeric text such as ``1.00`` / ``-5.00`` -> 1 / -5 (fraction truncated), anything
    else NULL. Never raises under ANSI mode."""
    return f"try_cast(try_cast({c} AS DOUBLE) AS INT)"


def lenient_int(c: str) -> Column:
    return E(lenient_int_sql(c))


# --- classification ----------------------------------------------------------

def cause_flag_sql(c: str) -> str:
    """0 when the cause minutes are NULL or exactly 0, else 1 (negative counts too)."""
    return f"CASE WHEN {c} IS NULL OR {c} = 0 THEN 0 ELSE 1 END"


def other_flag_sql(flag_cols: list[str] | None = None) -> str:
    """Unclassified: 1 iff none of the five cause flags is set."""
    flags = flag_cols or [f for _, f in CAUSE_TO_FLAG]
    return "CASE WHEN " + " OR ".join(f"{f} = 1" for f in flags) + " THEN 0 ELSE 1 END"


# SQL three-valued logic: a NULL ``cancelled`` is neither operated nor delayed.
OPERATED_SQL = "cancelled <> 1"
DELAYED_SQL = "arr_delay IS NOT NULL AND arr_del15 = 1 AND cancelled <> 1"


def is_operated() -> Column:
    """Not cancelled."""
    return E(OPERATED_SQL)


def is_delayed() -> Column:
    """Arrived 15+ minutes late and operated; a NULL in any test drops the row."""
    return E(DELAYED_SQL)


# --- keys --------------------------------------------------------------------

def key_sql(*parts: str) -> str:
    """``_``-joined composite key; NULL if any part is NULL (``concat``, never ``concat_ws``)."""
    cells = []
    for i, p in enumerate(parts):
        if i:
            cells.append("'_'")
        cells.append(f"CAST({p} AS STRING)")
    return "concat(" + ", ".join(cells) + ")"


def date_text_sql(c: str) -> str:
    return f"date_format({c}, 'yyyy-MM-dd')"


def year_month_text_sql(year: str, month: str) -> str:
    """``2014-06`` from int year and month."""
    return f"concat(CAST({year} AS STRING), '-', lpad(CAST({month} AS STRING), 2, '0'))"


# --- ratios ------------------------------------------------------------------

def guarded_ratio_sql(num: str, den: str, scale: int = 6) -> str:
    """num / den, 0 when den is 0 or NULL, rounded for stable comparison."""
    return f"round(coalesce(try_divide(CAST({num} AS DOUBLE), CAST({den} AS DOUBLE)), 0.0D), {scale})"


def guarded_ratio(num: str, den: str, scale: int = 6) -> Column:
    return E(guarded_ratio_sql(num, den, scale))


def percent(num: str, den: str) -> Column:
    """Share as a percentage with two decimals (chart label format)."""
    return E(f"round(coalesce(try_divide(CAST({num} AS DOUBLE) * 100.0D, CAST({den} AS DOUBLE)), 0.0D), 2)")


# --- parameters --------------------------------------------------------------

def range_valid(start, end):
    """A period may not start after its end. One rule for dates and for date columns."""
    return start <= end


def carrier_code(c):
    """A carrier code as given by a user, without blanks around it and in capitals; text or column."""
    return F.upper(F.trim(c)) if isinstance(c, Column) else str(c).strip().upper()


# --- dates -------------------------------------------------------------------

def mdy_to_iso_sql(c: str) -> str:
    """``MM/DD/YYYY`` text -> ``YYYY-MM-DD`` text by rearranging the parts; empty stays empty."""
    part = lambda i: f"try_element_at(split({c}, '/'), {i})"  # noqa: E731  (NULL, not an error, if malformed)
    return f"CASE WHEN {c} = '' THEN '' ELSE concat({part(3)}, '-', {part(1)}, '-', {part(2)}) END"


def mdy_to_iso(c: str) -> Column:
    return E(mdy_to_iso_sql(c))


def thanksgiving_sql(year: str) -> str:
    """Fourth Thursday of November of ``year``."""
    return f"date_add(next_day(make_date({year}, 10, 31), 'THU'), 21)"


def thanksgiving(year: str) -> Column:
    return E(thanksgiving_sql(year))


def holiday_month(name: str) -> int:
    if name == THANKSGIVING:
        return 11
    for n, m, _ in FIXED_HOLIDAYS:
        if n == name:
            return m
    raise ValueError(f"unknown holiday {name!r}")


def holiday_date_sql(name: str, year: str) -> str:
    """Date of a named holiday in ``year`` (int column or SQL)."""
    if name == THANKSGIVING:
        return thanksgiving_sql(year)
    for n, m, d in FIXED_HOLIDAYS:
        if n == name:
            return f"make_date({year}, {m}, {d})"
    raise ValueError(f"unknown holiday {name!r}")


