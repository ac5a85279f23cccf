"""One wide row per member with a 0-100 health score.

Plan shape: every input is first reduced to member grain with a hash
aggregate (partial aggregation before the shuffle), then the reduced sides
are left-joined onto members on ``member_id``.  All sides are hash
partitioned on the same key, so the joins reuse one partitioning instead of
re-shuffling per join.  The "latest membership" pick (D1) is an aggregate
(``max_by`` over an ordering struct) rather than a window, so a member with
very many memberships is combined map-side instead of being sorted in one
task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]


def latest_membership(t: Tables, as_of: dt.date) -> DataFrame:
    """Per member, the membership with the greatest end_date, an open
    (NULL) end date first; ties broken by the larger membership id."""
    ms = S.stg_memberships(t, as_of)
    order_key = F.struct(F.col("end_date").isNull(), F.col("end_date"), F.col("membership_id"))
    pick = F.struct("plan_type", "price", "end_date", "days_until_expiry",
                    F.col("status").alias("membership_status"))
    return (ms.groupBy("member_id").agg(F.max_by(pick, order_key).alias("m"))
              .select("member_id", "m.*"))


def payment_rollup(t: Tables) -> DataFrame:
    """Last payment date (any status), count, paid / overdue sums, overdue flag."""
    p = S.stg_payments(t)
    st = F.col("status")
    zero = F.lit(0).cast("decimal(10,2)")
    return p.groupBy("member_id").agg(
        F.max("payment_date").alias("last_payment_date"),
        F.count(F.lit(1)).alias("total_payments"),
        F.sum(F.when(st == "paid", F.col("amount")).otherwise(zero)).alias("total_paid"),
        F.sum(F.when(st == "overdue", F.col("amount")).otherwise(zero)).alias("total_overdue"),
        F.max(F.when(st == "overdue", 1).otherwise(0)).alias("has_overdue"))


def checkin_rollup(t: Tables, as_of: dt.date) -> DataFrame:
    """D3: check-ins in the last 7/30/90 days (lower bound only), total, last date."""
    b = S.stg_bookings(t).filter(F.col("member_id").isNotNull())
    ci = F.col("checked_in")
    d = F.col("booked_date")

    def since(n):
        return F.count_if(ci & (d >= F.date_sub(X.lit_date(as_of), n)))

    return b.groupBy("member_id").agg(
        since(7).alias("checkins_last_7d"),
        since(30).alias("checkins_last_30d"),
        since(90).alias("checkins_last_90d"),
        F.count_if(ci).alias("checkins_ytd"),
        F.max(F.when(ci, d)).alias("last_checkin_date"))


def frozen_now(t: Tables, as_of: dt.date) -> DataFrame:
    """Distinct members with a freeze active on ``as_of``."""
    f = S.stg_freezes(t, as_of)
    return f.filter(F.col("is_active") & F.col("member_id").isNotNull()).select("member_id").distinct()


def member_activity(t: Tables, as_of: dt.date) -> DataFrame:
    """D*: the wide per-member model (28 columns)."""
    today = X.lit_date(as_of)
    m = S.stg_members(t)
    ms = latest_membership(t, as_of).withColumn("monthly_capacity", X.plan_capacity("plan_type"))
    pay = payment_rollup(t)
    chk = checkin_rollup(t, as_of)
    frz = frozen_now(t, as_of).withColumn("frozen_flag", F.lit(True))

    j = (m.join(ms, "member_id", "left").join(pay, "member_id", "left")
          .join(chk, "member_id", "left").join(frz, "member_id", "left"))

    zero_money = F.lit(0).cast("decimal(10,2)")
    cap = F.coalesce(F.col("monthly_capacity"), F.lit(X.PLAN_DEFAULT_CAPACITY))
    c30 = F.coalesce(F.col("checkins_last_30d"), F.lit(0))
    tenure = X.days_between(today, "join_date")
    has_overdue = F.coalesce(F.col("has_overdue"), F.lit(0))
    util_pts = F.least(F.lit(40).cast("bigint"), X.half_up_ratio(c30 * 40, cap))
    pay_pts = F.when(has_overdue == 0, 30).otherwise(0)
    valid_pts = (F.when((F.col("membership_status") == "active")
                        & (F.coalesce(F.col("days_until_expiry"), F.lit(0)) > 14), 20)
                  .when(F.col("membership_status") == "active", 8).otherwise(0))
    tenure_pts = F.least(F.lit(10).cast("bigint"),
                         X.half_up_ratio(F.coalesce(tenure, F.lit(0)) * 10, F.lit(180)))
    score = (util_pts + pay_pts + valid_pts + tenure_pts).cast("bigint")

    out = j.select(
        "member_id", "box_id", "name", "email", "phone",
        F.col("status").alias("member_status"), "join_date",
        tenure.alias("tenure_days"),
        "plan_type", F.col("price").alias("monthly_price"),
        F.col("end_date").alias("membership_end_date"), "days_until_expiry", "membership_status",
        cap.cast("int").alias("plan_monthly_capacity"),
        "last_payment_date",
        F.coalesce(F.col("total_paid"), zero_money).alias("total_paid"),
        F.coalesce(F.col("total_overdue"), zero_money).alias("total_overdue"),
        has_overdue.alias("has_overdue"),
        F.coalesce(F.col("checkins_last_7d"), F.lit(0)).alias("checkins_last_7d"),
        c30.alias("checkins_last_30d"),
        F.coalesce(F.col("checkins_last_90d"), F.lit(0)).alias("total_checkins_90d"),
        F.coalesce(F.col("checkins_ytd"), F.lit(0)).alias("checkins_ytd"),
        "last_checkin_date",
        X.days_between(today, "last_checkin_date").alias("days_since_last_checkin"),
        F.least(F.lit(100).cast("bigint"), X.half_up_ratio(c30 * 100, cap)).alias("utilization_pct"),
        F.coalesce(F.col("frozen_flag"), F.lit(False)).alias("is_frozen"),
        score.alias("health_score"))
    return out.withColumn("health_tier", health_tier("health_score"))


def health_tier(score) -> F.Column:
    s = X.col(score)
    return F.when(s >= 70, "healthy").when(s >= 35, "at_risk").otherwise("critical")
