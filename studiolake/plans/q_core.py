"""Registered queries: staging (C), member activity (D), health marts (E)."""

from __future__ import annotations

from studiolake.operators import activity as A
from studiolake.operators import health as H
from studiolake.operators import staging as S
from studiolake.plans.oracle_base import AS_OF, hu, pct
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF as D, AS_OF_LEADS as DL

ACTIVITY_SPEC = (
    "member_id:l, box_id:l, name:s, email:s, phone:s, member_status:s, join_date:t, tenure_days:l, "
    "plan_type:s, monthly_price:d, membership_end_date:t, days_until_expiry:l, membership_status:s, "
    "plan_monthly_capacity:l, last_payment_date:t, total_paid:d, total_overdue:d, has_overdue:l, "
    "checkins_last_7d:l, checkins_last_30d:l, total_checkins_90d:l, checkins_ytd:l, last_checkin_date:t, "
    "days_since_last_checkin:l, utilization_pct:l, is_frozen:b, health_score:l, health_tier:s")

HEALTH_SPEC = (
    "member_id:l, box_id:l, name:s, email:s, phone:s, member_status:s, tenure_days:l, plan_type:s, "
    "monthly_price:d, membership_end_date:t, days_until_expiry:l, membership_status:s, last_payment_date:t, "
    "total_paid:d, total_overdue:d, has_overdue:l, plan_monthly_capacity:l, utilization_pct:l, "
    "checkins_last_7d:l, checkins_last_30d:l, total_checkins_90d:l, last_checkin_date:t, "
    "days_since_last_checkin:l, health_score:l, health_tier:s, alert_inactive:b, alert_overdue:b, "
    "alert_expiring:b")

ENTRIES = [
    Entry("stg_members", lambda t: S.stg_members(t),
          "member_id:l, box_id:l, source_member_id:l, name:s, email:s, phone:s, status:s, join_date:t, created_at:ts",
          "SELECT * FROM stg_members"),
    Entry("stg_memberships", lambda t: S.stg_memberships(t, D),
          "membership_id:l, box_id:l, member_id:l, source_membership_id:l, plan_type:s, price:d, start_date:t, "
          "end_date:t, status:s, days_until_expiry:l, created_at:ts",
          "SELECT * FROM stg_memberships"),
    Entry("stg_payments", lambda t: S.stg_payments(t),
          "payment_id:l, box_id:l, member_id:l, source_payment_id:l, amount:d, status:s, payment_date:t, "
          "payment_month:t, created_at:ts",
          "SELECT * FROM stg_payments"),
    Entry("stg_classes", lambda t: S.stg_classes(t),
          "class_id:l, box_id:l, source_class_id:l, class_name:s, coach:s, scheduled_at:ts, class_date:t, "
          "class_time:s, day_of_week:l, day_name:s, hour_of_day:l, max_capacity:l, created_at:ts",
          "SELECT * FROM stg_classes"),
    Entry("stg_attendance", lambda t: S.stg_attendance(t),
          "attendance_id:s, box_id:l, member_id:l, class_id:l, checked_in:b, attended_at:ts, attended_date:t, "
          "day_of_week:l, hour_of_day:l, created_at:ts",
          "SELECT * FROM stg_attendance"),
    Entry("stg_bookings", lambda t: S.stg_bookings(t),
          "id:s, box_id:l, member_id:l, source_user_id:l, class_name:s, space_name:s, coach:s, booked_date:t, "
          "booked_time:s, checked_in:b, is_first_session:b, membership_type:s, sessions_left:l, booked_week:t, "
          "booked_month:t, day_of_week:l, hour_of_day:l",
          "SELECT * FROM stg_bookings"),
    Entry("stg_leads", lambda t: S.stg_leads(t, DL),
          "lead_id:l, box_id:l, source_lead_id:l, first_name:s, last_name:s, full_name:s, email:s, phone:s, "
          "source:s, status:s, lost_reason:s, trial_date:t, funnel_stage_order:l, days_in_pipeline:l, created_at:ts",
          "SELECT * FROM stg_leads"),
    Entry("stg_freezes", lambda t: S.stg_freezes(t, D),
          "freeze_id:l, box_id:l, member_id:l, source_hold_id:l, source_membership_id:l, plan_type:s, "
          "freeze_start:t, freeze_end:t, total_days:l, reason:s, task_status:s, price:d, is_active:b, synced_at:ts",
          "SELECT * FROM stg_freezes"),
    # D1-D4 building blocks
    Entry("latest_membership", lambda t: A.latest_membership(t, D),
          "member_id:l, plan_type:s, price:d, end_date:t, days_until_expiry:l, membership_status:s",
          "SELECT member_id, plan_type, price, end_date, days_until_expiry, membership_status FROM mb_latest"),
    Entry("payment_rollup", lambda t: A.payment_rollup(t),
          "member_id:l, last_payment_date:t, total_payments:l, total_paid:d, total_overdue:d, has_overdue:l",
          "SELECT * FROM mb_money"),
    Entry("checkin_rollup", lambda t: A.checkin_rollup(t, D),
          "member_id:l, checkins_last_7d:l, checkins_last_30d:l, checkins_last_90d:l, checkins_ytd:l, "
          "last_checkin_date:t",
          "SELECT * FROM mb_visits"),
    Entry("frozen_now", lambda t: A.frozen_now(t, D), "member_id:l", "SELECT member_id FROM mb_frozen"),
    Entry("plan_capacity", lambda t: A.latest_membership(t, D).select(
              "member_id", A.X.plan_capacity("plan_type").alias("monthly_capacity")),
          "member_id:l, monthly_capacity:l",
          "SELECT a.member_id, a.plan_monthly_capacity AS monthly_capacity FROM activity a "
          "JOIN mb_latest m ON a.member_id = m.member_id"),
    Entry("member_activity", lambda t: A.member_activity(t, D), ACTIVITY_SPEC, "SELECT * FROM activity"),
    Entry("health_scores", lambda t: H.health_scores(t, D), HEALTH_SPEC,
          "SELECT *, CASE WHEN days_since_last_checkin >= 14 THEN true ELSE false END AS alert_inactive, "
          "CASE WHEN has_overdue = 1 THEN true ELSE false END AS alert_overdue, "
          "CASE WHEN days_until_expiry BETWEEN 0 AND 14 THEN true ELSE false END AS alert_expiring FROM activity"),
    Entry("members_snapshot", lambda t: H.members_snapshot(t, D),
          "member_id:l, box_id:l, name:s, email:s, join_date:t, join_week:t, join_month:t, plan_type:s, "
          "monthly_price:d, health_tier:s, health_score:l, membership_status:s, has_overdue:l, is_frozen:b",
          "SELECT member_id, box_id, name, email, join_date, CAST(date_trunc('week', join_date) AS DATE) AS join_week, "
          "CAST(date_trunc('month', join_date) AS DATE) AS join_month, plan_type, monthly_price, health_tier, "
          "health_score, membership_status, has_overdue, is_frozen FROM activity WHERE member_status = 'active'"),
    Entry("retention", lambda t: H.retention(t, D),
          "box_id:l, total_active:l, frozen_count:l, new_this_month:l, cancelled_count:l, churned_90d:l, "
          "retention_rate_pct:d, healthy_count:l, at_risk_count:l, critical_count:l, avg_health_score:l",
          # members as zeros and ones, then sums of them
          f"""SELECT box_id, sum(live) AS total_active, sum(held) AS frozen_count, sum(live * fresh) AS new_this_month, sum(ended) AS cancelled_count,
                     sum(lapsed) AS churned_90d, {pct('sum(live)', 'sum(live) + sum(ended)', 1)} AS retention_rate_pct,
                     sum(if(health_tier = 'healthy', live, 0)) AS healthy_count, sum(if(health_tier = 'at_risk', live, 0)) AS at_risk_count,
                     sum(if(health_tier = 'critical', live, 0)) AS critical_count, {hu('sum(live * health_score)', 'sum(live)')} AS avg_health_score
              FROM (SELECT box_id, health_tier, health_score, if(member_status = 'active' AND NOT is_frozen, 1, 0) AS live,
                           if(member_status = 'active' AND is_frozen, 1, 0) AS held, if(join_date >= date_trunc('month', {AS_OF}), 1, 0) AS fresh,
                           if(membership_status = 'cancelled', 1, 0) AS ended,
                           if(member_status = 'inactive' AND {AS_OF} - last_payment_date <= 90, 1, 0) AS lapsed FROM activity) GROUP BY box_id"""),
]
