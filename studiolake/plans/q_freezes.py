"""Registered queries: plan changes, freeze events / outcomes, LTV."""

from __future__ import annotations

from studiolake.operators import lifecycle as J
from studiolake.plans.oracle_base import AS_OF, hu, pct
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF as D

# Each result is written as its definition: a member's memberships as one ordered list whose neighbours are compared,
# a hold's return by the member's last check-in, and box totals as tables of their own.
LIFECYCLE = f"""
lc_history AS (
  SELECT member_id,
         list({{'box': box_id, 'plan': plan_type, 'price': price, 'since': start_date}} ORDER BY start_date, membership_id) AS steps
  FROM stg_memberships GROUP BY member_id
),
lc_neighbours AS (
  SELECT member_id, steps[i] AS cur, steps[i - 1] AS old FROM lc_history, range(2, len(steps) + 1) AS r(i)
),
lc_moves AS (
  SELECT member_id, cur.box AS box_id, cur.plan AS new_plan, old.plan AS prev_plan, cur.price AS new_price,
         old.price AS prev_price, cur.price - old.price AS revenue_delta, cur.since AS changed_at,
         ['downgrade', 'lateral', 'upgrade'][sign(cur.price - old.price)::INT + 2] AS change_type
  FROM lc_neighbours
  WHERE least(cur.price, old.price) > 100 AND cur.price - old.price <> 0 AND cur.price IS NOT NULL AND old.price IS NOT NULL
),
lc_move_totals AS (
  SELECT box_id, count_if(revenue_delta > 0) AS total_upgrades, count_if(revenue_delta < 0) AS total_downgrades,
         sum(CASE WHEN revenue_delta > 0 THEN revenue_delta END) AS upgrade_revenue_gain,
         -sum(CASE WHEN revenue_delta < 0 THEN revenue_delta END) AS downgrade_revenue_lost
  FROM lc_moves GROUP BY box_id
),
lc_events AS (
  SELECT h.*, who.name AS member_name, score.health_tier, score.health_score
  FROM stg_freezes h
  LEFT JOIN (SELECT member_id, name FROM stg_members) who USING (member_id)
  LEFT JOIN (SELECT member_id, health_tier, health_score FROM activity) score USING (member_id)
),
lc_last_visit AS (
  SELECT box_id, member_id, max(CASE WHEN checked_in THEN booked_date END) AS seen FROM stg_bookings GROUP BY box_id, member_id
),
lc_ended AS (
  SELECT h.freeze_id, box_id, member_id, who.name AS member_name, who.status AS member_status, h.plan_type, h.price,
         h.freeze_start, h.freeze_end, h.total_days, h.reason, date_diff('day', h.freeze_end, {AS_OF}) AS days_since_ended,
         v.seen IS NOT NULL AND v.seen > h.freeze_end AS returned
  FROM stg_freezes h JOIN stg_members who USING (box_id, member_id) LEFT JOIN lc_last_visit v USING (box_id, member_id)
  WHERE NOT h.is_active AND h.freeze_end IS NOT NULL
),
lc_outcome AS (
  SELECT *, if(returned, 'returned', if(days_since_ended < 15, 'unknown', if(member_status = 'inactive', 'churned', 'at_risk'))) AS outcome
  FROM lc_ended
),
lc_outcome_totals AS (
  SELECT box_id, count_if(outcome = 'returned') AS total_returned, count_if(outcome = 'churned') AS total_churned,
         count_if(outcome = 'at_risk') AS total_at_risk, count_if(outcome <> 'unknown') AS total_completed
  FROM lc_outcome GROUP BY box_id
),
lc_stays AS (
  SELECT box_id, plan_type, member_id, status = 'active' AS live, CAST(price * 100 AS HUGEINT) AS cents,
         CAST(round(epoch(age(if(end_date IS NULL, {AS_OF}, end_date), start_date)) / 21600) AS HUGEINT) AS quarter_days
  FROM stg_memberships WHERE start_date IS NOT NULL AND NOT coalesce(price <> 0 AND price <= 100, false)
),
lc_plans AS (
  SELECT box_id, plan_type, count(*) AS stays, count(cents) AS priced, sum(cents) AS cents, sum(quarter_days) AS quarter_days,
         count(DISTINCT member_id) AS member_count, count_if(live) AS active_count, count_if(NOT live) AS past_count
  FROM lc_stays GROUP BY box_id, plan_type
),
lc_ltv AS (
  SELECT box_id, plan_type, member_count, {hu('cents', 'priced * 100')} AS avg_price, {hu('quarter_days * 250', 'stays * 3044')} / 10.0 AS avg_tenure_months,
         {hu('cents * quarter_days * 25', 'priced * stays * 304400')} AS avg_ltv, active_count, past_count
  FROM lc_plans
)"""


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, (LIFECYCLE,))


ENTRIES = [
    _e("membership_changes", lambda t: J.membership_changes(t, D),
       "member_id:l, box_id:l, new_plan:s, prev_plan:s, new_price:d, prev_price:d, revenue_delta:d, changed_at:t, "
       "change_type:s", "SELECT * FROM lc_moves"),
    _e("plan_changes", lambda t: J.plan_changes(t, D),
       "box_id:l, member_id:l, name:s, email:s, phone:s, change_type:s, prev_plan:s, new_plan:s, prev_price:d, "
       "new_price:d, revenue_delta:d, changed_at:t, total_upgrades:l, total_downgrades:l, upgrade_revenue_gain:d, "
       "downgrade_revenue_lost:d", "SELECT * FROM lc_moves JOIN (SELECT member_id, name, email, phone FROM stg_members) USING (member_id) "
       "JOIN lc_move_totals USING (box_id)"),
    _e("freeze_events", lambda t: J.freeze_events(t, D),
       "box_id:l, source_hold_id:l, member_id:l, member_name:s, plan_type:s, health_tier:s, health_score:l, "
       "freeze_start:t, freeze_end:t, total_days:l, reason:s, price:d, task_status:s, is_active:b",
       "SELECT * FROM lc_events"),
    _e("freeze_outcomes", lambda t: J.freeze_outcomes(t, D),
       "box_id:l, freeze_id:l, member_id:l, member_name:s, member_status:s, plan_type:s, price:d, freeze_start:t, "
       "freeze_end:t, total_days:l, reason:s, outcome:s, returned:b, days_since_ended:l, total_returned:l, "
       "total_churned:l, total_at_risk:l, total_completed:l, return_rate_pct:d",
       f"SELECT *, {pct('total_returned', 'total_completed', 1)} AS return_rate_pct FROM lc_outcome JOIN lc_outcome_totals USING (box_id)"),
    _e("ltv_by_plan", lambda t: J.ltv_by_plan(t, D),
       "box_id:l, plan_type:s, member_count:l, avg_price:d, avg_tenure_months:d, avg_ltv:d, active_count:l, "
       "past_count:l",
       "SELECT * FROM lc_ltv"),
]
