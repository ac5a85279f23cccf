"""Column-expression helpers shared by all operators.

Everything here returns a ``Column`` built from built-in Spark functions, so
it stays inside whole-stage codegen.  Rounding is done on integers (exact
rational arithmetic) rather than floats so that Spark and any SQL oracle
agree bit for bit.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Lead status words; the first group that matches (case-folded substring)
# wins, in this order; no match or an empty value means "new".
LEAD_STATUS_WORDS = [
    ("converted", ["converted", "הפך", "member"]),
    ("lost", ["lost", "אבד", "לא רלוונטי"]),
    ("trial_booked", ["trial", "נסיון", "ניסיון"]),
    ("in_progress", ["process", "בתהליך", "follow"]),
]
# Plan-name capacity rules (monthly check-ins).  First match wins.
PLAN_UNLIMITED_PATTERN = "(?i)ללא הגבלה|unlimited"      # -> 28
PLAN_WEEKLY_PATTERN = "(\\d+) כניסות בשבוע"             # -> n * 4
PLAN_MONTHLY_PATTERN = "(\\d+) כניסות (חודשיות|בחודש)"  # -> n
PLAN_UNLIMITED_CAPACITY = 28
PLAN_DEFAULT_CAPACITY = 12
# Funnel order of lead statuses.
FUNNEL_ORDER = {"converted": 4, "trial_booked": 3, "in_progress": 2, "new": 1, "lost": 0}
# International dialling prefix used by the alert list's phone rewrite.
INTL_PREFIX = "972"
# ---------------------------------------------------------------------------


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_date(d: _dt.date | str) -> Column:
    return F.lit(d if isinstance(d, _dt.date) else _dt.date.fromisoformat(d))


def as_date(d: _dt.date | str) -> _dt.date:
    return d if isinstance(d, _dt.date) else _dt.date.fromisoformat(d)


# ----- integer / rounding -----------------------------------------------------

def idiv(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Exact integral division (``a div b``), truncating toward zero."""
    return F.call_function("div", col(a), col(b))


def half_up_ratio(num: ColumnOrName, den: ColumnOrName, scale: int = 0) -> Column:
    """round(num / den, scale) with halves away from zero, for integer inputs.

    NULL when ``den`` is 0 or NULL (``x / nullif(den, 0)``).  Works on the
    absolute value and restores the sign, so negative ratios round like
    PostgreSQL numeric ``round``.  Result is a double with ``scale`` digits.
    """
    n = col(num).cast("decimal(38,0)")
    d = F.nullif(col(den).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    p = 10 ** scale
    an, ad = F.abs(n), F.abs(d)
    q = idiv(an * (2 * p) + ad, ad * 2)
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    return (q * sign).cast("double") / F.lit(float(p)) if scale else (q * sign).cast("bigint")


def pct_half_up(num: ColumnOrName, den: ColumnOrName, scale: int = 1) -> Column:
    """round(num / nullif(den, 0) * 100, scale), exact half-up, as double."""
    return half_up_ratio(col(num).cast("decimal(38,0)") * 100, den, scale).cast("double")


def js_round(x: ColumnOrName) -> Column:
    """JavaScript ``Math.round``: halves go toward +infinity."""
    return F.floor(col(x) + F.lit(0.5)).cast("bigint")


# ----- dates ------------------------------------------------------------------

def dow0(d: ColumnOrName) -> Column:
    """Day of week with 0 = Sunday ... 6 = Saturday."""
    return (F.dayofweek(col(d)) - 1).cast("int")


def week_start(d: ColumnOrName) -> Column:
    """Monday of the week containing ``d`` (as a date)."""
    return F.date_trunc("week", col(d)).cast("date")


def month_start(d: ColumnOrName) -> Column:
    return F.trunc(col(d), "MM")


def days_between(later: ColumnOrName, earlier: ColumnOrName) -> Column:
    """``later - earlier`` in whole days (PostgreSQL date minus date)."""
    return F.datediff(col(later), col(earlier))


def month_diff(later_month: ColumnOrName, earlier_month: ColumnOrName) -> Column:
    """Whole months between two month starts: 12*dy + dm."""
    a, b = col(later_month), col(earlier_month)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def age_quarter_days(end: ColumnOrName, start: ColumnOrName) -> Column:
    """Length of ``age(end, start)`` in quarter days.

    ``age`` is a symbolic years/months/days difference; its epoch counts a
    year as 365.25 days and a month as 30 days.  Quarter days keep the value
    an exact integer: y*1461 + m*120 + d*4 (with m the leftover months).
    Borrowing follows the day-of-month rule: if the end day is before the
    start day, one month is borrowed and the length of the start's month is
    added to the day difference.
    """
    e, s = col(end), col(start)
    months = (F.year(e) - F.year(s)) * 12 + (F.month(e) - F.month(s))
    days = F.dayofmonth(e) - F.dayofmonth(s)
    borrow = days < 0
    months = F.when(borrow, months - 1).otherwise(months)
    days = F.when(borrow, days + F.dayofmonth(F.last_day(s))).otherwise(days)
    yrs = idiv(months, F.lit(12))
    rem = months - yrs * 12
    return (yrs * 1461 + rem * 120 + days * 4).cast("bigint")


# ----- ingest cleaning ------------------------------------------------------

def _is_junk_date_text(c: Column) -> Column:
    return c.isNull() | (c == "") | c.startswith("0000") | c.startswith("-")


def clean_date(c: ColumnOrName) -> Column:
    """NULL for empty, ``0000...`` or ``-...`` text; else the first 10 chars as a date."""
    c = col(c)
    return F.when(_is_junk_date_text(c), F.lit(None).cast("date")).otherwise(
        F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))


def clean_ts(c: ColumnOrName) -> Column:
    """As :func:`clean_date` but keeps the full datetime text (no trim).  The text's separator tells the one form that can
    fit: each form that doesn't costs an exception a row."""
    c = col(c)
    form = lambda f: F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz")
    return (F.when(_is_junk_date_text(c), F.lit(None).cast("timestamp_ntz"))
             .when(c.contains("T") | c.contains("t"), form("yyyy-MM-dd'T'HH:mm:ss"))
             .when(c.contains(" "), form("yyyy-MM-dd HH:mm:ss"))
             .otherwise(form("yyyy-MM-dd")))


def phone_key(c: ColumnOrName) -> Column:
    """Digits only; the last 9 when there are at least 9; NULL when none."""
    digits = F.regexp_replace(col(c), "[^0-9]", "")
    return F.when(digits == "", F.lit(None).cast("string")).otherwise(
        F.when(F.length(digits) >= 9, F.substring(digits, -9, 9)).otherwise(digits))


def lead_status(c: ColumnOrName) -> Column:
    """Map a free-text pipeline status to new|in_progress|trial_booked|converted|lost."""
    low = F.lower(col(c))
    out = F.lit("new")
    for status, words in reversed(LEAD_STATUS_WORDS):
        hit = None
        for w in words:
            h = low.contains(w)
            hit = h if hit is None else (hit | h)
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(status)).otherwise(out)
    return out


def plan_capacity(plan: ColumnOrName) -> Column:
    """Monthly visit capacity derived from the plan name (first rule wins)."""
    p = col(plan)
    weekly = F.regexp_extract(p, PLAN_WEEKLY_PATTERN, 1)
    monthly = F.regexp_extract(p, PLAN_MONTHLY_PATTERN, 1)
    return (F.when(p.rlike(PLAN_UNLIMITED_PATTERN), F.lit(PLAN_UNLIMITED_CAPACITY))
            .when(p.rlike(PLAN_WEEKLY_PATTERN), weekly.cast("int") * 4)
            .when(p.rlike(PLAN_MONTHLY_PATTERN), monthly.cast("int"))
            .otherwise(F.lit(PLAN_DEFAULT_CAPACITY))).cast("int")


def funnel_stage_order(status: ColumnOrName) -> Column:
    s = col(status)
    out = F.lit(None).cast("int")
    for k, v in reversed(list(FUNNEL_ORDER.items())):
        out = F.when(s == k, F.lit(v)).otherwise(out)
    return out


def intl_phone(c: ColumnOrName) -> Column:
    """Alert-list phone rewrite: drop one leading 0, strip hyphens and blanks, prefix 972."""
    s = F.regexp_replace(F.regexp_replace(col(c), "^0", ""), "[-\\s]", "")
    return F.concat(F.lit(INTL_PREFIX), s)


def yes(c: ColumnOrName) -> Column:
    """'yes' (any case) -> true; anything else (incl. NULL) -> false."""
    return F.coalesce(F.lower(col(c)) == "yes", F.lit(False))


def digits_only_int(c: ColumnOrName) -> Column:
    """An int when the text is all digits, else NULL."""
    c = col(c).cast("string")
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def null_if_blank(c: ColumnOrName) -> Column:
    t = F.trim(col(c))
    return F.when(t == "", F.lit(None).cast("string")).otherwise(t)
