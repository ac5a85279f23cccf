"""Registered queries: tenant scoping and dashboard maths.

Drill-downs take their click arguments as parameters; the registered
instances use one fixed argument each (the drill-down's point filter is the
feature itself), over the whole tables.
"""

from __future__ import annotations

import datetime as dt

from studiolake.operators import dashboard as K
from studiolake.operators import health as H
from studiolake.operators import money as M
from studiolake.plans.oracle_base import AS_OF, AS_OF_LEADS
from studiolake.plans.q_classes import USAGE
from studiolake.plans.q_core import HEALTH_SPEC
from studiolake.plans.q_freezes import LIFECYCLE
from studiolake.plans.q_leads import FUNNEL
from studiolake.plans.q_money import LEDGER
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF as D, AS_OF_LEADS as DL

TOKEN = "tok-2"
DRILL_WEEK = dt.date(2001, 7, 2)        # a Monday inside the fixture's join-date range
DRILL_MONTH = dt.date(2001, 5, 1)
FREEZE_RANGE = (dt.date(2001, 6, 1), dt.date(2001, 6, 30))


def jsr(num: str, den: str) -> str:
    """SQL Math.round(num/den) for den > 0: floor((2n + d) / 2d), exact."""
    x = f"(CAST(({num}) AS HUGEINT) * 2 + CAST(({den}) AS HUGEINT))"
    y = f"(CAST(NULLIF(({den}), 0) AS HUGEINT) * 2)"
    return f"CAST(CASE WHEN {x} >= 0 THEN {x} // {y} ELSE -((-{x} + {y} - 1) // {y}) END AS BIGINT)"


HEALTH_SQL = ("SELECT *, CASE WHEN days_since_last_checkin >= 14 THEN true ELSE false END AS alert_inactive, "
              "CASE WHEN has_overdue = 1 THEN true ELSE false END AS alert_overdue, "
              "CASE WHEN days_until_expiry BETWEEN 0 AND 14 THEN true ELSE false END AS alert_expiring FROM activity")

DASH_CTES = f"""
k_health AS ({HEALTH_SQL}),
k_snapshot AS (
  SELECT *, CAST(date_trunc('week', join_date) AS DATE) AS join_week,
         CAST(date_trunc('month', join_date) AS DATE) AS join_month FROM activity WHERE member_status = 'active'
),
k_fe AS (SELECT * FROM lc_events)"""

DRILL_FREEZE_SPEC = ("box_id:l, member_name:s, plan_type:s, health_tier:s, health_score:l, freeze_start:t, "
                     "freeze_end:t, total_days:l, reason:s, price:d, is_active:b")
DRILL_FREEZE_SQL = ("SELECT box_id, member_name, plan_type, health_tier, health_score, freeze_start, freeze_end, "
                    "total_days, reason, price, is_active FROM k_fe")
ALL = (LEDGER, USAGE, FUNNEL, LIFECYCLE, DASH_CTES)


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, ALL)


ENTRIES = [
    _e("resolve_box", lambda t: K.resolve_box(t, TOKEN), "box_id:l",
       f"SELECT id AS box_id FROM boxes WHERE access_token = '{TOKEN}' LIMIT 1"),
    _e("tenant_scope", lambda t: K.tenant_scope(H.health_scores(t, D), t, TOKEN), HEALTH_SPEC,
       f"SELECT * FROM k_health WHERE box_id IN (SELECT id FROM boxes WHERE access_token = '{TOKEN}' LIMIT 1)"),
    _e("tenant_scoped_health", lambda t: H.health_scores(K.scope_inputs(t, TOKEN), D), HEALTH_SPEC,
       f"SELECT * FROM k_health WHERE box_id IN (SELECT id FROM boxes WHERE access_token = '{TOKEN}' LIMIT 1)"),
    _e("plan_arpu", lambda t: K.plan_arpu(t, D), "box_id:l, name:s, value:d, members:l, arpu:l",
       f"SELECT box_id, plan_type AS name, plan_revenue AS value, plan_member_count AS members, "
       f"CASE WHEN plan_member_count > 0 THEN {jsr('plan_revenue * 100', 'plan_member_count * 100')} ELSE 0 END "
       f"AS arpu FROM mo_plans"),
    _e("mom_delta", lambda t: K.mom_delta(t, D), "box_id:l, last_month_collected:d, prev_month_collected:d, mo_delta:l",
       f"SELECT box_id, last_month_collected, prev_month_collected, CASE WHEN prev_month_collected > 0 THEN "
       f"{jsr('(last_month_collected - prev_month_collected) * 10000', 'prev_month_collected * 100')} END AS mo_delta "
       f"FROM mo_summary"),
    _e("series_weekly_revenue",
       lambda t: K.series(t, D, "weekly_revenue", ["period_revenue"]),
       "box_id:l, period_start:t, period_revenue:d", "SELECT box_id, period_start, period_revenue FROM mo_week_income"),
    _e("series_freeze_by_reason",
       lambda t: K.series(t, D, "freeze_by_reason", ["freeze_count", "avg_freeze_days"], order_col="reason"),
       "box_id:l, reason:s, freeze_count:l, avg_freeze_days:d",
       "SELECT box_id, reason, freeze_count, avg_freeze_days FROM mo_by_reason"),
    _e("ltv_rank", lambda t: K.ltv_rank(t, D),
       "box_id:l, plan_type:s, member_count:l, avg_price:d, avg_tenure_months:d, avg_ltv:d, active_count:l, "
       "past_count:l, rank:l",
       "SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY avg_ltv DESC NULLS LAST, plan_type ASC NULLS LAST) "
       "AS rank FROM lc_ltv"),
    _e("tier_counts", lambda t: K.tier_counts(t, D), "box_id:l, healthy:l, at_risk:l, critical:l, avg:l",
       f"SELECT box_id, count(*) FILTER (WHERE health_tier = 'healthy') AS healthy, "
       f"count(*) FILTER (WHERE health_tier = 'at_risk') AS at_risk, "
       f"count(*) FILTER (WHERE health_tier = 'critical') AS critical, "
       f"{jsr('sum(coalesce(health_score, 0))', 'count(*)')} AS avg FROM k_health GROUP BY box_id"),
    _e("plan_change_kpis", lambda t: K.plan_change_kpis(t, D), "box_id:l, upgrades:l, downgrades:l, gain:d, lost:d",
       "SELECT box_id, total_upgrades AS upgrades, total_downgrades AS downgrades, "
       "coalesce(upgrade_revenue_gain, 0) AS gain, coalesce(downgrade_revenue_lost, 0) AS lost FROM lc_move_totals"),
    _e("drill_members_week", lambda t: K.drill_members(t, D, "weekly", DRILL_WEEK),
       "box_id:l, name:s, plan_type:s, health_tier:s, health_score:l",
       f"SELECT box_id, name, plan_type, health_tier, health_score FROM k_snapshot WHERE join_week = DATE '{DRILL_WEEK}'"),
    _e("drill_members_month", lambda t: K.drill_members(t, D, "monthly", DRILL_MONTH),
       "box_id:l, name:s, plan_type:s, health_tier:s, health_score:l",
       f"SELECT box_id, name, plan_type, health_tier, health_score FROM k_snapshot "
       f"WHERE join_month = DATE '{DRILL_MONTH}'"),
    _e("drill_tier_critical", lambda t: K.drill_tier(t, D, "critical"), HEALTH_SPEC,
       "SELECT * FROM k_health WHERE health_tier = 'critical'"),
    _e("intl_phone", K.intl_phones, "member_id:l, box_id:l, phone:s, intl_phone:s",
       "SELECT id AS member_id, box_id, phone, "
       "'972' || regexp_replace(regexp_replace(phone, '^0', ''), '[-\\s]', '', 'g') AS intl_phone FROM members"),
    _e("drill_frozen", lambda t: K.drill_frozen(t, D), DRILL_FREEZE_SPEC, DRILL_FREEZE_SQL + " WHERE is_active = true"),
    _e("drill_freeze_range", lambda t: K.drill_freeze_range(t, D, *FREEZE_RANGE), DRILL_FREEZE_SPEC,
       DRILL_FREEZE_SQL + f" WHERE freeze_start >= DATE '{FREEZE_RANGE[0]}' AND freeze_start <= DATE '{FREEZE_RANGE[1]}'"),
    _e("drill_freeze_week", lambda t: K.drill_freeze_period(t, D, "weekly", DRILL_WEEK), DRILL_FREEZE_SPEC,
       DRILL_FREEZE_SQL + f" WHERE freeze_start BETWEEN DATE '{DRILL_WEEK}' AND DATE '{DRILL_WEEK}' + 6"),
    _e("drill_freeze_month", lambda t: K.drill_freeze_period(t, D, "monthly", DRILL_MONTH), DRILL_FREEZE_SPEC,
       DRILL_FREEZE_SQL + f" WHERE freeze_start BETWEEN DATE '{DRILL_MONTH}' AND last_day(DATE '{DRILL_MONTH}')"),
    _e("freeze_total", lambda t: K.freeze_total(t, D), "box_id:l, total:l",
       "SELECT box_id, sum(freeze_count) AS total FROM mo_by_reason GROUP BY box_id"),
    _e("freeze_funnel", lambda t: K.freeze_funnel(t, D), "box_id:l, step_order:l, step:s, count:l, pct:l",
       f"""SELECT box_id, step_order, step, cnt AS count,
                  CASE WHEN step_order = 0 THEN 100 WHEN total_completed > 0 THEN {jsr('cnt * 100', 'total_completed')}
                       ELSE 0 END AS pct
           FROM lc_outcome_totals o,
                LATERAL (VALUES (0, 'completed', o.total_completed), (1, 'returned', o.total_returned),
                                (2, 'at_risk', o.total_at_risk), (3, 'churned', o.total_churned)) s(step_order, step, cnt)"""),
    _e("freeze_funnel_drill_at_risk", lambda t: K.freeze_funnel_drill(t, D, "at_risk"),
       "box_id:l, freeze_id:l, member_id:l, member_name:s, outcome:s, days_since_ended:l",
       "SELECT box_id, freeze_id, member_id, member_name, outcome, days_since_ended FROM lc_outcome "
       "WHERE outcome = 'at_risk'"),
    _e("top_classes_checkins", lambda t: K.top_classes(t, "checkins", 10),
       "box_id:l, rank:l, label:s, value:d, bar_pct:l",
       f"""SELECT box_id, rank, label, v AS value, {jsr('v * 100', 'mx')} AS bar_pct FROM (
             SELECT box_id, label, total_checkins AS v, max(total_checkins) OVER (PARTITION BY box_id) AS mx,
                    row_number() OVER (PARTITION BY box_id ORDER BY total_checkins DESC NULLS LAST, label) AS rank
             FROM us_kinds) WHERE rank <= 10"""),
    _e("top_classes_fill", lambda t: K.top_classes(t, "fill_rate", 10),
       "box_id:l, rank:l, label:s, value:d, bar_pct:l",
       f"""SELECT box_id, rank, label, v / 10.0 AS value, {jsr('v * 100', 'mx')} AS bar_pct FROM (
             SELECT box_id, label, CAST(round(avg_fill_rate * 10) AS BIGINT) AS v,
                    max(CAST(round(avg_fill_rate * 10) AS BIGINT)) OVER (PARTITION BY box_id) AS mx,
                    row_number() OVER (PARTITION BY box_id ORDER BY CAST(round(avg_fill_rate * 10) AS BIGINT)
                                       DESC NULLS LAST, label) AS rank
             FROM us_kinds) WHERE rank <= 10"""),
    _e("coach_ranking", K.coach_ranking,
       "box_id:l, label:s, total_sessions:l, total_registrations:l, total_checkins:l, avg_fill_rate:d, "
       "avg_showup_rate:d, top_class:s", "SELECT * FROM us_coaches"),
    _e("heatmap_intensity", K.heatmap_intensity, "box_id:l, day_of_week:l, hour_of_day:l, fill_rate:d, intensity:d",
       """SELECT box_id, day_of_week, hour_of_day, coalesce(avg_fill_rate, 0.0) AS fill_rate,
                 coalesce(avg_fill_rate, 0.0) / greatest(max(avg_fill_rate) OVER (PARTITION BY box_id), 1.0)
                   AS intensity FROM us_hours"""),
    _e("checkins_by_hour", K.checkins_by_hour, "box_id:l, hour:l, checkins:l",
       """SELECT b.box_id, h.hour, coalesce(sum(m.total_checkins), 0) AS checkins
          FROM (SELECT DISTINCT box_id FROM us_hours WHERE day_of_week BETWEEN 0 AND 6) b
          CROSS JOIN generate_series(6, 21) h(hour)
          LEFT JOIN us_hours m ON m.box_id = b.box_id AND m.hour_of_day = h.hour AND m.day_of_week BETWEEN 0 AND 6
          GROUP BY b.box_id, h.hour"""),
    _e("funnel_stages", lambda t: K.funnel_stages(t, DL), "box_id:l, record_type:s, stage:s, value:l",
       """SELECT box_id, record_type, stage, value FROM ld_funnel
          UNPIVOT (value FOR stage IN (new_leads, in_progress, trial_booked, converted, lost))"""),
    _e("drill_leads_converted_30d", lambda t: K.drill_leads(t, DL, "converted", 30),
       "box_id:l, lead_id:l, full_name:s, phone:s, email:s, source:s, status:s, trial_date:t, created_at:ts, "
       "lost_reason:s, days_in_pipeline:l, days_ago:l",
       f"""SELECT box_id, lead_id, full_name, phone, email, source, status, trial_date, created_at, lost_reason,
                  days_in_pipeline, CAST({AS_OF_LEADS} - CAST(created_at AS DATE) AS BIGINT) AS days_ago
           FROM stg_leads WHERE status = 'converted' AND created_at >= {AS_OF_LEADS} - 30"""),
    _e("source_rates", lambda t: K.source_rates(t, DL),
       "box_id:l, record_type:s, pos:l, source:s, total:l, converted:l, win_pct:l",
       f"""SELECT box_id, record_type,
                  row_number() OVER (PARTITION BY box_id, record_type ORDER BY total DESC, coalesce(source, 'null'))
                    - 1 AS pos,
                  source, total, converted,
                  CASE WHEN total > 0 THEN {jsr('converted * 100', 'total')} ELSE 0 END AS win_pct
           FROM (SELECT box_id, record_type, source, count(*) AS total,
                        count(*) FILTER (WHERE status = 'converted') AS converted FROM ld_seen GROUP BY ALL)"""),
    _e("lost_reason_value", lambda t: K.lost_reason_value(t, DL),
       "box_id:l, record_type:s, pos:l, reason:s, count:l, value:d",
       """SELECT r.box_id, r.record_type,
                 row_number() OVER (PARTITION BY r.box_id, r.record_type ORDER BY cnt DESC, reason) - 1 AS pos,
                 reason, cnt AS count, cnt * coalesce(a.avg_mrr, 0) AS value
          FROM (SELECT box_id, record_type, lost_reason AS reason, count(*) AS cnt FROM ld_seen
                WHERE lost_reason IS NOT NULL GROUP BY ALL) r LEFT JOIN ld_ticket a ON a.box_id = r.box_id"""),
    _e("stage_value", lambda t: K.stage_value(t, DL), "box_id:l, record_type:s, converted_value:d, lost_value:d",
       "SELECT box_id, record_type, converted * coalesce(avg_mrr, 0) AS converted_value, "
       "lost * coalesce(avg_mrr, 0) AS lost_value FROM ld_funnel"),
]
