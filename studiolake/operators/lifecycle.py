"""Plan changes, freeze events and outcomes, lifetime value by plan.

Plan notes
* Box-wide totals that the reference writes as ``count(*) FILTER (...) OVER
  (PARTITION BY box_id)`` are computed as a grouped aggregate (partial
  aggregation map-side, one row per box) and joined back.  A window
  partitioned by box would put a whole tenant in one task; the aggregate
  side is one row per box, so AQE broadcasts it at runtime.
* The freeze "returned" test (EXISTS a check-in after the freeze end) is the
  same as ``max(check-in date) > freeze_end``: aggregate check-ins once to
  (box, member) and equi-join - no correlated subquery, no range join.
* Tenure uses the symbolic ``age()`` length in exact quarter days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S
from studiolake.operators.activity import member_activity

Tables = dict[str, DataFrame]
ANCILLARY_PRICE = 100   # fixed: plans at or below this price are add-ons (lockers etc.)


def membership_changes(t: Tables, as_of: dt.date) -> DataFrame:
    """Price moves between a member's consecutive memberships."""
    ms = S.stg_memberships(t, as_of)
    w = Window.partitionBy("member_id").orderBy("start_date", "membership_id")
    r = ms.select("member_id", "box_id", "plan_type", "price", "start_date", "status",
                  F.lag("price").over(w).alias("prev_price"), F.lag("plan_type").over(w).alias("prev_plan"))
    p, pp = F.col("price"), F.col("prev_price")
    c = r.filter(pp.isNotNull() & (p != pp) & (p > ANCILLARY_PRICE) & (pp > ANCILLARY_PRICE))
    return c.select("member_id", "box_id", F.col("plan_type").alias("new_plan"), "prev_plan",
                    F.col("price").alias("new_price"), "prev_price", (p - pp).alias("revenue_delta"),
                    F.col("start_date").alias("changed_at"),
                    F.when(p > pp, "upgrade").when(p < pp, "downgrade").otherwise("lateral").alias("change_type"))


def plan_change_totals(changes: DataFrame) -> DataFrame:
    up, down = F.col("change_type") == "upgrade", F.col("change_type") == "downgrade"
    return changes.groupBy("box_id").agg(
        F.count_if(up).alias("total_upgrades"), F.count_if(down).alias("total_downgrades"),
        F.sum(F.when(up, F.col("revenue_delta"))).alias("upgrade_revenue_gain"),
        F.sum(F.when(down, F.abs("revenue_delta"))).alias("downgrade_revenue_lost"))


def plan_changes(t: Tables, as_of: dt.date, changes: DataFrame | None = None) -> DataFrame:
    """Change rows with member contact and box totals on every row.  ``changes``: J1/J2 as stored, so that rows and
    totals don't compute them twice (``operators.build``)."""
    c = changes if changes is not None else membership_changes(t, as_of)
    m = S.stg_members(t).select("member_id", "name", "email", "phone")
    return (c.join(m, "member_id").join(plan_change_totals(c), "box_id", "left")
             .select("box_id", "member_id", "name", "email", "phone", "change_type", "prev_plan", "new_plan",
                     "prev_price", "new_price", "revenue_delta", "changed_at", "total_upgrades", "total_downgrades",
                     "upgrade_revenue_gain", "downgrade_revenue_lost"))


def freeze_events(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """Hold events with member name, health tier and score."""
    a = activity if activity is not None else member_activity(t, as_of)
    f = S.stg_freezes(t, as_of)
    m = S.stg_members(t).select("member_id", F.col("name").alias("member_name"))
    return (f.join(m, "member_id", "left").join(a.select("member_id", "health_tier", "health_score"),
                                                 "member_id", "left")
             .select("box_id", "source_hold_id", "member_id", "member_name", "plan_type", "health_tier",
                     "health_score", "freeze_start", "freeze_end", "total_days", "reason", "price", "task_status",
                     "is_active"))


def last_checkins(t: Tables) -> DataFrame:
    b = S.stg_bookings(t).filter(F.col("checked_in"))
    return b.groupBy("box_id", "member_id").agg(F.max("booked_date").alias("last_checkin"))


def classified_freezes(t: Tables, as_of: dt.date) -> DataFrame:
    """Completed holds with the return test and the outcome."""
    f = S.stg_freezes(t, as_of).filter((F.col("is_active") == F.lit(False)) & F.col("freeze_end").isNotNull())
    m = S.stg_members(t).select("member_id", "box_id", F.col("name").alias("member_name"),
                                F.col("status").alias("member_status"))
    j = (f.join(m, ["member_id", "box_id"]).join(last_checkins(t), ["box_id", "member_id"], "left"))
    returned = F.coalesce(F.col("last_checkin") > F.col("freeze_end"), F.lit(False))
    since = X.days_between(X.lit_date(as_of), "freeze_end")
    c = j.select("box_id", "freeze_id", "member_id", "member_name", "member_status", "plan_type", "price",
                 "freeze_start", "freeze_end", "total_days", "reason", returned.alias("returned"),
                 since.alias("days_since_ended"))
    return c.withColumn("outcome", F.when(F.col("returned"), "returned")
                                    .when(F.col("days_since_ended") <= 14, "unknown")
                                    .when(F.col("member_status") == "inactive", "churned").otherwise("at_risk"))


def freeze_outcome_totals(classified: DataFrame) -> DataFrame:
    """Per-box outcome counts and return rate (one row per box)."""
    o = F.col("outcome")
    totals = classified.groupBy("box_id").agg(
        F.count_if(o == "returned").alias("total_returned"), F.count_if(o == "churned").alias("total_churned"),
        F.count_if(o == "at_risk").alias("total_at_risk"),
        F.count_if(o.isin("returned", "churned", "at_risk")).alias("total_completed"))
    return totals.withColumn("return_rate_pct", X.pct_half_up("total_returned", "total_completed", 1))


def freeze_outcomes(t: Tables, as_of: dt.date, classified: DataFrame | None = None) -> DataFrame:
    """Completed holds classified returned / unknown / churned / at_risk,
    with box totals and the return rate on every row.  ``classified``: J5/J6 as
    stored, as in ``plan_changes``."""
    c = classified if classified is not None else classified_freezes(t, as_of)
    return c.join(freeze_outcome_totals(c), "box_id", "left").select(
        "box_id", "freeze_id", "member_id", "member_name", "member_status", "plan_type", "price", "freeze_start",
        "freeze_end", "total_days", "reason", "outcome", "returned", "days_since_ended", "total_returned",
        "total_churned", "total_at_risk", "total_completed", "return_rate_pct")


def ltv_by_plan(t: Tables, as_of: dt.date) -> DataFrame:
    """Per (box, plan): members, mean price, mean tenure in months (age()
    length / 30.44 days), LTV = mean price x mean tenure, active / past counts."""
    ms = S.stg_memberships(t, as_of)
    p = F.col("price")
    ms = ms.filter(((p > ANCILLARY_PRICE) | (p == 0) | p.isNull()) & F.col("start_date").isNotNull())
    q = X.age_quarter_days(F.coalesce(F.col("end_date"), X.lit_date(as_of)), F.col("start_date"))
    agg = ms.groupBy("box_id", "plan_type").agg(
        F.count_distinct("member_id").alias("member_count"),
        F.sum((p * 100).cast("decimal(38,0)")).alias("_p_cents"), F.count(p).alias("_p_n"),
        F.sum(q).alias("_q"), F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("status") == "active").alias("active_count"),
        F.count_if(F.col("status") != "active").alias("past_count"))
    d38 = lambda c: F.col(c).cast("decimal(38,0)")
    # months = q / 4 days / 30.44  =  q * 25 / 3044
    return agg.select(
        "box_id", "plan_type", "member_count",
        X.half_up_ratio("_p_cents", F.col("_p_n") * 100).alias("avg_price"),
        (X.half_up_ratio(d38("_q") * 250, d38("_n") * 3044) / 10.0).alias("avg_tenure_months"),
        X.half_up_ratio(d38("_p_cents") * d38("_q") * 25, d38("_p_n") * d38("_n") * 304400).alias("avg_ltv"),
        "active_count", "past_count")
