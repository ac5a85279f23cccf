"""Health-score mart, active-member snapshot, retention by box."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators.activity import member_activity

Tables = dict[str, DataFrame]

HEALTH_COLUMNS = [
    "member_id", "box_id", "name", "email", "phone", "member_status", "tenure_days", "plan_type",
    "monthly_price", "membership_end_date", "days_until_expiry", "membership_status",
    "last_payment_date", "total_paid", "total_overdue", "has_overdue", "plan_monthly_capacity",
    "utilization_pct", "checkins_last_7d", "checkins_last_30d", "total_checkins_90d",
    "last_checkin_date", "days_since_last_checkin", "health_score", "health_tier",
]


def _flag(cond) -> F.Column:
    # CASE WHEN cond THEN true ELSE false: a NULL comparison lands on false.
    return F.when(cond, True).otherwise(False)


def health_scores(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """Per-member health row with three alert flags."""
    a = activity if activity is not None else member_activity(t, as_of)
    return a.select(
        *HEALTH_COLUMNS,
        _flag(F.col("days_since_last_checkin") >= 14).alias("alert_inactive"),
        _flag(F.col("has_overdue") == 1).alias("alert_overdue"),
        _flag(F.col("days_until_expiry").between(0, 14)).alias("alert_expiring"))


def members_snapshot(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """Active members (frozen ones kept, flagged) with join week / month."""
    a = activity if activity is not None else member_activity(t, as_of)
    return a.filter(F.col("member_status") == "active").select(
        "member_id", "box_id", "name", "email", "join_date",
        X.week_start("join_date").alias("join_week"),
        X.month_start("join_date").alias("join_month"),
        "plan_type", "monthly_price", "health_tier", "health_score", "membership_status",
        "has_overdue", "is_frozen")


def retention(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """One row per box; one conditional-aggregate pass over the activity rows."""
    a = activity if activity is not None else member_activity(t, as_of)
    active = F.col("member_status") == "active"
    live = active & ~F.col("is_frozen")
    cancelled = F.col("membership_status") == "cancelled"
    tier = F.col("health_tier")
    agg = a.groupBy("box_id").agg(
        F.count_if(live).alias("total_active"),
        F.count_if(active & F.col("is_frozen")).alias("frozen_count"),
        F.count_if(live & (F.col("join_date") >= X.month_start(X.lit_date(as_of)))
                   & F.col("join_date").isNotNull()).alias("new_this_month"),
        F.count_if(cancelled).alias("cancelled_count"),
        F.count_if((F.col("member_status") == "inactive")
                   & (F.col("last_payment_date") >= F.date_sub(X.lit_date(as_of), 90))).alias("churned_90d"),
        F.count_if((tier == "healthy") & live).alias("healthy_count"),
        F.count_if((tier == "at_risk") & live).alias("at_risk_count"),
        F.count_if((tier == "critical") & live).alias("critical_count"),
        F.sum(F.when(live, F.col("health_score"))).alias("_score_sum"),
    )
    return agg.select(
        "box_id", "total_active", "frozen_count", "new_this_month", "cancelled_count", "churned_90d",
        X.pct_half_up("total_active", F.col("total_active") + F.col("cancelled_count"), 1)
         .alias("retention_rate_pct"),
        "healthy_count", "at_risk_count", "critical_count",
        X.half_up_ratio("_score_sum", "total_active").alias("avg_health_score"))
