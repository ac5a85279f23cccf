"""Registered queries: trends and cohorts."""

from __future__ import annotations

from studiolake.operators import trends as T
from studiolake.plans.oracle_base import AS_OF, pct
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF as D

# Weeks are numbered by days since a Monday, months by year * 12 + month; periods and ages are differences of numbers.
MONDAY = "DATE '1970-01-05'"


def _week(d: str) -> str:
    return f"(({d} - {MONDAY}) // 7)"


def _month(d: str) -> str:
    return f"(year({d}) * 12 + month({d}) - 1)"


def _week_day(n: str) -> str:
    return f"({MONDAY} + CAST(({n}) * 7 AS INTEGER))"


def _month_day(n: str) -> str:
    return f"make_date(({n}) // 12, ({n}) % 12 + 1, 1)"


PERIODS = f"""
pd_spine AS (
  SELECT DISTINCT box_id, {_week(AS_OF)} - ago AS week_no, {_month(AS_OF)} - ago AS month_no FROM stg_members, range(12) AS r(ago)
),
pd_visits AS (
  SELECT box_id, member_id, booked_date, {_week('booked_date')} AS week_no, {_month('booked_date')} AS month_no
  FROM stg_bookings WHERE checked_in
),
pd_week_visitors AS (
  SELECT box_id, week_no, count(*) AS cumulative_active
  FROM (SELECT DISTINCT box_id, week_no, member_id FROM pd_visits WHERE {AS_OF} - booked_date <= 84 AND member_id IS NOT NULL) GROUP BY ALL
),
pd_month_visitors AS (
  SELECT box_id, month_no, count(*) AS cumulative_active
  FROM (SELECT DISTINCT box_id, month_no, member_id FROM pd_visits WHERE {AS_OF} - booked_date <= 365 AND member_id IS NOT NULL) GROUP BY ALL
),
pd_joined AS (
  SELECT box_id, member_id, join_date, {_week('join_date')} AS week_no, {_month('join_date')} AS month_no
  FROM stg_members WHERE join_date IS NOT NULL
),
pd_week_joins AS (SELECT box_id, week_no, count(*) AS new_members FROM pd_joined GROUP BY ALL),
pd_month_joins AS (SELECT box_id, month_no, count(*) AS new_members FROM pd_joined GROUP BY ALL),
pd_trends AS (
  SELECT box_id, 'weekly' AS period_type, {_week_day('week_no')} AS period_start, ifnull(new_members, 0) AS new_members,
         ifnull(cumulative_active, 0) AS cumulative_active
  FROM pd_spine LEFT JOIN pd_week_joins USING (box_id, week_no) LEFT JOIN pd_week_visitors USING (box_id, week_no)
  UNION ALL BY NAME
  SELECT box_id, 'monthly' AS period_type, {_month_day('month_no')} AS period_start, ifnull(new_members, 0) AS new_members,
         ifnull(cumulative_active, 0) AS cumulative_active
  FROM pd_spine LEFT JOIN pd_month_joins USING (box_id, month_no) LEFT JOIN pd_month_visitors USING (box_id, month_no)
),
pd_cohort AS (
  SELECT box_id, member_id, month_no FROM pd_joined WHERE month_no < {_month(AS_OF)} AND join_date >= {AS_OF} - INTERVAL 13 MONTH
),
pd_cohort_size AS (SELECT box_id, month_no, count(*) AS cohort_size FROM pd_cohort GROUP BY ALL),
pd_member_months AS (SELECT DISTINCT box_id, member_id, month_no AS active_no FROM pd_visits),
pd_kept AS (
  SELECT box_id, month_no, active_no - month_no AS period_number, count(DISTINCT member_id) AS retained_members
  FROM pd_cohort JOIN pd_member_months USING (box_id, member_id) WHERE active_no - month_no BETWEEN 1 AND 12 GROUP BY ALL
  UNION ALL BY NAME
  SELECT box_id, month_no, 0 AS period_number, cohort_size AS retained_members FROM pd_cohort_size
),
pd_retention AS (
  SELECT box_id, {_month_day('month_no')} AS cohort_month, cohort_size, period_number, retained_members,
         {pct('retained_members', 'cohort_size', 1)} AS retention_pct
  FROM pd_kept JOIN pd_cohort_size USING (box_id, month_no)
)"""

_P = [0, 1, 2, 3, 4, 5, 6, 9, 12]


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, (PERIODS,))


ENTRIES = [
    _e("week_spine", lambda t: T.week_spine(t, D), "box_id:l, period_start:t", f"SELECT box_id, {_week_day('week_no')} AS period_start FROM pd_spine"),
    _e("month_spine", lambda t: T.month_spine(t, D), "box_id:l, period_start:t", f"SELECT box_id, {_month_day('month_no')} AS period_start FROM pd_spine"),
    _e("active_weekly", lambda t: T.active_weekly(t, D), "box_id:l, period_start:t, cumulative_active:l",
       f"SELECT *, {_week_day('week_no')} AS period_start FROM pd_week_visitors"),
    _e("active_monthly", lambda t: T.active_monthly(t, D), "box_id:l, period_start:t, cumulative_active:l",
       f"SELECT *, {_month_day('month_no')} AS period_start FROM pd_month_visitors"),
    _e("new_members_weekly", lambda t: T.new_members(t, "week"), "box_id:l, period_start:t, new_members:l",
       f"SELECT *, {_week_day('week_no')} AS period_start FROM pd_week_joins"),
    _e("new_members_monthly", lambda t: T.new_members(t, "month"), "box_id:l, period_start:t, new_members:l",
       f"SELECT *, {_month_day('month_no')} AS period_start FROM pd_month_joins"),
    _e("member_trends", lambda t: T.member_trends(t, D),
       "box_id:l, period_type:s, period_start:t, new_members:l, cumulative_active:l", "SELECT * FROM pd_trends"),
    _e("cohort_sizes", lambda t: T.cohort_sizes(t, D), "box_id:l, cohort_month:t, cohort_size:l",
       f"SELECT *, {_month_day('month_no')} AS cohort_month FROM pd_cohort_size"),
    _e("active_months", T.active_months, "box_id:l, member_id:l, active_month:t",
       f"SELECT *, {_month_day('active_no')} AS active_month FROM pd_member_months"),
    _e("cohort_retention", lambda t: T.cohort_retention(t, D),
       "box_id:l, cohort_month:t, cohort_size:l, period_number:l, retained_members:l, retention_pct:d",
       "SELECT * FROM pd_retention"),
    _e("cohort_matrix", lambda t: T.cohort_matrix(t, D),
       "box_id:l, cohort_month:t, cohort_size:l, " + ", ".join(f"p{p}:d" for p in _P),
       "SELECT box_id, cohort_month, cohort_size, "
       + ", ".join(f"max(retention_pct) FILTER (WHERE period_number = {p}) AS p{p}" for p in _P)
       + " FROM pd_retention GROUP BY box_id, cohort_month, cohort_size"),
]
