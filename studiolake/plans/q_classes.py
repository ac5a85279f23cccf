"""Registered queries: classes and usage (H1-H8)."""

from __future__ import annotations

from studiolake.operators import classes as C
from studiolake.plans.oracle_base import hu, pct
from studiolake.plans.registry import Entry


def _t(num: str, den: str) -> str:
    return hu(f"CAST({num} AS HUGEINT) * 1000", den, 0)


# Sessions once, then every report as one grouping set over them; a coach's usual class is the head of an ordered list.
USAGE = f"""
us_seats AS (
  SELECT box_id, class_name, class_date AS booked_date, class_time AS booked_time, max_capacity FROM stg_classes
),
us_visits AS (SELECT * FROM stg_bookings JOIN us_seats USING (box_id, class_name, booked_date, booked_time)),
us_sessions AS (
  SELECT box_id, class_name, coach, booked_date, booked_time, booked_week, day_of_week, hour_of_day, max_capacity,
         count(*) AS registrations, count_if(checked_in) AS checkins, count_if(is_first_session) AS first_timers
  FROM us_visits GROUP BY ALL
),
us_rates AS (
  SELECT *, {_t('checkins', 'max_capacity')} AS fill, {_t('registrations', 'max_capacity')} AS booked, {_t('checkins', 'registrations')} AS shown
  FROM us_sessions
),
us_reports AS (
  SELECT box_id, coach, class_name, booked_week, day_of_week, hour_of_day,
         grouping_id(coach, class_name, booked_week, day_of_week) AS report,
         count(*) AS total_sessions, sum(registrations) AS total_registrations, sum(checkins) AS total_checkins,
         sum(first_timers) AS total_first_timers, {hu('sum(fill)', 'count(fill)')} / 10.0 AS avg_fill_rate,
         {hu('sum(booked)', 'count(booked)')} / 10.0 AS avg_registration_rate,
         {pct('sum(checkins)', 'sum(registrations)', 1)} AS avg_showup_rate
  FROM us_rates
  GROUP BY GROUPING SETS ((box_id), (box_id, coach), (box_id, class_name), (box_id, booked_week), (box_id, day_of_week, hour_of_day))
),
us_usual AS (
  SELECT box_id, coach, list(class_name ORDER BY n DESC, class_name)[1] AS top_class
  FROM (SELECT box_id, coach, class_name, count(*) AS n FROM us_sessions GROUP BY ALL) GROUP BY box_id, coach
),
us_summary AS (SELECT * FROM us_reports WHERE report = 15),
us_coaches AS (
  SELECT r.* EXCLUDE (class_name), coach AS label, top_class FROM us_reports r JOIN us_usual USING (box_id, coach) WHERE report = 7 AND coach <> ''
),
us_kinds AS (SELECT *, class_name AS label FROM us_reports WHERE report = 11),
us_weeks AS (SELECT *, booked_week AS period_start FROM us_reports WHERE report = 13),
us_hours AS (SELECT * FROM us_reports WHERE report = 14)"""

SESSION_SPEC = ("box_id:l, class_name:s, coach:s, booked_date:t, booked_time:s, booked_week:t, day_of_week:l, "
                "hour_of_day:l, max_capacity:l, registrations:l, checkins:l, first_timers:l, fill_rate:d, "
                "registration_rate:d, showup_rate:d")
CLASSES_SPEC = ("record_type:s, box_id:l, label:s, total_sessions:l, total_registrations:l, total_checkins:l, "
                "total_first_timers:l, avg_fill_rate:d, avg_showup_rate:d, period_start:t, day_of_week:l, "
                "hour_of_day:l, top_class:s")


def _union_sql() -> str:
    from studiolake.plans.spec import parse
    cols = [n for n, _ in parse(CLASSES_SPEC)]

    def branch(rt, src, provided):
        sel = [f"'{rt}' AS record_type" if c == "record_type" else (c if c in provided else f"NULL AS {c}")
               for c in cols]
        return f"SELECT {', '.join(sel)} FROM {src}"

    common = ["box_id", "total_sessions", "total_registrations", "total_checkins", "avg_fill_rate"]
    return "\nUNION ALL\n".join([
        branch("summary", "us_summary", common + ["total_first_timers", "avg_showup_rate"]),
        branch("by_coach", "us_coaches", common + ["label", "avg_showup_rate", "top_class"]),
        branch("by_class_type", "us_kinds", common + ["label", "avg_showup_rate"]),
        branch("weekly_trend", "us_weeks", common + ["period_start"]),
        branch("heatmap", "us_hours", ["box_id", "total_sessions", "total_checkins", "avg_fill_rate",
                                        "day_of_week", "hour_of_day"]),
    ])


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, (USAGE,))


ENTRIES = [
    _e("enriched_bookings", C.enriched_bookings,
       "box_id:l, member_id:l, class_name:s, coach:s, booked_date:t, booked_time:s, booked_week:t, day_of_week:l, "
       "hour_of_day:l, checked_in:b, is_first_session:b, max_capacity:l", "SELECT * FROM us_visits"),
    _e("class_sessions", C.class_sessions, SESSION_SPEC,
       "SELECT *, fill / 10.0 AS fill_rate, booked / 10.0 AS registration_rate, shown / 10.0 AS showup_rate FROM us_rates"),
    _e("class_summary", C.class_summary,
       "box_id:l, total_sessions:l, total_registrations:l, total_checkins:l, total_first_timers:l, "
       "avg_fill_rate:d, avg_registration_rate:d, avg_showup_rate:d", "SELECT * FROM us_summary"),
    _e("coach_leaderboard", C.coach_leaderboard,
       "box_id:l, label:s, total_sessions:l, total_registrations:l, total_checkins:l, avg_fill_rate:d, "
       "avg_showup_rate:d, top_class:s", "SELECT * FROM us_coaches"),
    _e("class_types", C.class_types,
       "box_id:l, label:s, total_sessions:l, total_registrations:l, total_checkins:l, avg_fill_rate:d, "
       "avg_showup_rate:d", "SELECT * FROM us_kinds"),
    _e("class_weekly", C.class_weekly,
       "box_id:l, period_start:t, total_sessions:l, total_registrations:l, total_checkins:l, avg_fill_rate:d",
       "SELECT * FROM us_weeks"),
    _e("class_heatmap", C.class_heatmap,
       "box_id:l, day_of_week:l, hour_of_day:l, total_sessions:l, total_checkins:l, avg_fill_rate:d",
       "SELECT * FROM us_hours"),
    _e("classes", C.classes_mart, CLASSES_SPEC, _union_sql()),
]
