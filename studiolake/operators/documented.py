"""KPIs specified in the reference's prose but not coded there.

Multi-tenant throughout: every KPI is per ``box_id``.  Top-k lists use
``row_number() <= k`` over ``partitionBy(box_id)``; Spark 3.5+ plans this as
a ``WindowGroupLimit`` that keeps only k rows per box in each map task
before the shuffle, so a dominant box never ships all its rows to one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import activity as A
from studiolake.operators import classes as C
from studiolake.operators import money as M
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]


def dim_members(t: Tables) -> DataFrame:
    """L1: one row per member (latest load wins), with an is_active flag."""
    m = t["members"]
    latest = F.max_by(F.struct("name", "email", "phone", "join_date", "status", "box_id"),
                      F.struct("created_at", "source_member_id"))
    d = m.groupBy(F.col("id").alias("member_id")).agg(latest.alias("r"))
    return d.select("member_id", F.col("r.box_id").alias("box_id"), F.col("r.name").alias("full_name"),
                    F.col("r.email").alias("email"), F.col("r.phone").alias("phone"),
                    F.col("r.join_date").alias("join_date"), (F.col("r.status") == "active").alias("is_active"))


def dim_subscriptions(t: Tables, as_of: dt.date) -> DataFrame:
    """L2: subscriptions with duration and an is-current flag."""
    ms = t["memberships"]
    return ms.select("id", "box_id", "member_id", F.col("plan_type").alias("plan_name"), "start_date", "end_date",
                     "price", "status", X.days_between("end_date", "start_date").alias("duration_days"),
                     ((F.col("end_date") >= X.lit_date(as_of)) & (F.col("status") == "active")).alias("is_current"))


def fct_attendance(t: Tables) -> DataFrame:
    """L3: attendance rows with class date / type and member name."""
    a = t["attendance"]
    c = t["classes"].select(F.col("id").alias("class_id"), F.col("name").alias("class_type"))
    m = dim_members(t).select("member_id", "full_name")
    return (a.join(c, "class_id", "left").join(m, "member_id", "left")
             .select("id", "box_id", "member_id", "class_id", F.col("attended_at").cast("date").alias("class_date"),
                     "class_type", "full_name"))


def kpi_active_members(t: Tables, as_of: dt.date) -> DataFrame:
    """L4: members with a current subscription, by plan."""
    s = dim_subscriptions(t, as_of).filter(F.col("is_current"))
    return s.groupBy("box_id", "plan_name").agg(F.count_distinct("member_id").alias("active_members")) \
            .withColumn("snapshot_date", X.lit_date(as_of))


def kpi_revenue_monthly(t: Tables, as_of: dt.date) -> DataFrame:
    """Active subscription revenue and paying members by start month."""
    s = dim_subscriptions(t, as_of).filter(F.col("status") == "active")
    return s.groupBy("box_id", X.month_start("start_date").alias("month")).agg(
        F.sum("price").alias("total_revenue"), F.count_distinct("member_id").alias("paying_members"))


def kpi_churn(t: Tables, as_of: dt.date) -> DataFrame:
    """Members with a cancelled subscription, by end month."""
    s = dim_subscriptions(t, as_of).filter((F.col("status") == "cancelled") & F.col("end_date").isNotNull())
    return s.groupBy("box_id", X.month_start("end_date").alias("month")).agg(
        F.count_distinct("member_id").alias("churned_members"))


def kpi_attendance_weekly(t: Tables) -> DataFrame:
    """Attendance rows and distinct members per week."""
    a = fct_attendance(t)
    return a.groupBy("box_id", X.week_start("class_date").alias("week_start")).agg(
        F.count(F.lit(1)).alias("total_checkins"), F.count_distinct("member_id").alias("unique_members"))


def _top(df: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("box_id").orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_overdue(t: Tables, k: int = 10) -> DataFrame:
    """The k members owing most, per box."""
    return _top(M.overdue_members(t), k, F.col("overdue_amount").desc(), F.col("member_id"))


def top_newest(t: Tables, k: int = 10) -> DataFrame:
    """The k most recently joined members, per box."""
    m = S.stg_members(t).filter(F.col("join_date").isNotNull()).select("box_id", "member_id", "name", "join_date")
    return _top(m, k, F.col("join_date").desc(), F.col("member_id").desc())


def top_coaches(t: Tables, k: int = 5) -> DataFrame:
    """The k coaches with most check-ins, per box."""
    c = C.coach_leaderboard(t).select("box_id", F.col("label").alias("coach"), "total_checkins")
    return _top(c, k, F.col("total_checkins").desc(), F.col("coach"))


def top_active(t: Tables, as_of: dt.date, k: int = 10) -> DataFrame:
    """The k members with most check-ins in the last 90 days, per box."""
    a = A.member_activity(t, as_of).select("box_id", "member_id", "name", "total_checkins_90d")
    return _top(a, k, F.col("total_checkins_90d").desc(), F.col("member_id"))


def popular_class(t: Tables) -> DataFrame:
    """Class type with most check-ins per box (ties: first by name)."""
    ct = C.class_types(t)
    return ct.groupBy("box_id").agg(
        F.min_by("label", F.struct(-F.col("total_checkins"), F.col("label"))).alias("class_name"),
        F.max("total_checkins").alias("checkins"))


def busiest_day(t: Tables) -> DataFrame:
    """Day of week (0 = Sunday) with most check-ins per box (ties: earliest day)."""
    b = S.stg_bookings(t).filter(F.col("checked_in"))
    d = b.groupBy("box_id", "day_of_week").agg(F.count(F.lit(1)).alias("checkins"))
    return d.groupBy("box_id").agg(F.min_by("day_of_week", F.struct(-F.col("checkins"), F.col("day_of_week")))
                                   .alias("day_of_week"), F.max("checkins").alias("checkins"))


def payment_split(t: Tables) -> DataFrame:
    """Paid / pending / overdue amounts and counts per box."""
    p = t["payments"]
    return p.groupBy("box_id", "status").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("payments"))


def avg_revenue_per_member(t: Tables, as_of: dt.date) -> DataFrame:
    """MRR / active members (half-up, 2 dp)."""
    mrr = M.mrr(t, as_of)
    act = S.stg_members(t).filter(F.col("status") == "active").groupBy("box_id").agg(
        F.count(F.lit(1)).alias("active_members"))
    j = mrr.join(act, "box_id", "left")
    return j.select("box_id", "mrr", "active_members",
                    (X.half_up_ratio((F.col("mrr") * 100).cast("decimal(38,0)"), "active_members") / 100.0)
                    .alias("avg_revenue_per_member"))


def churn_rate(t: Tables, as_of: dt.date) -> DataFrame:
    """Members churned this month (cancelled subscription ending this
    month) and churn % = churned / (members with an active subscription + churned)."""
    ms = t["memberships"]
    m0, m1 = X.month_start(X.lit_date(as_of)), F.add_months(X.month_start(X.lit_date(as_of)), 1)
    e = F.col("end_date")
    churned = F.count_distinct(F.when((F.col("status") == "cancelled") & (e >= m0) & (e < m1), F.col("member_id")))
    active = F.count_distinct(F.when(F.col("status") == "active", F.col("member_id")))
    agg = ms.groupBy("box_id").agg(churned.alias("churned_this_month"), active.alias("active_members"))
    return agg.select("*", X.pct_half_up("churned_this_month",
                                         F.col("active_members") + F.col("churned_this_month"), 1)
                      .alias("churn_rate_pct"))


def checkins_by_dow(t: Tables) -> DataFrame:
    """Check-ins by day of week (0 = Sunday)."""
    b = S.stg_bookings(t).filter(F.col("checked_in"))
    return b.groupBy("box_id", "day_of_week").agg(F.count(F.lit(1)).alias("checkins"))


def avg_attendance(t: Tables) -> DataFrame:
    """Mean check-ins per class session (1 dp, half-up)."""
    s = C.class_sessions(t)
    return s.groupBy("box_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("checkins").alias("checkins")) \
            .select("box_id", "sessions", "checkins",
                    (X.half_up_ratio(F.col("checkins") * 10, "sessions") / 10.0).alias("avg_attendance"))
