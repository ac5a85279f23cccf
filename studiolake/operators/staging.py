"""Staging projections over the canonical tables.

Lazy projections only: renames, casts and derived calendar columns.  Every
operator downstream calls these, and Catalyst collapses them into the scan's
projection (so column pruning still reaches the parquet reader).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.functions import exprs as X

Tables = dict[str, DataFrame]


def stg_members(t: Tables) -> DataFrame:
    m = t["members"]
    return m.select(F.col("id").alias("member_id"), "box_id", "source_member_id", "name", "email",
                    "phone", "status", "join_date", "created_at")


def stg_memberships(t: Tables, as_of: dt.date) -> DataFrame:
    m = t["memberships"]
    return m.select(F.col("id").alias("membership_id"), "box_id", "member_id", "source_membership_id",
                    "plan_type", "price", "start_date", "end_date", "status",
                    X.days_between("end_date", X.lit_date(as_of)).alias("days_until_expiry"),
                    "created_at")


def stg_payments(t: Tables) -> DataFrame:
    p = t["payments"]
    return p.select(F.col("id").alias("payment_id"), "box_id", "member_id", "source_payment_id",
                    "amount", "status", "payment_date",
                    X.month_start("payment_date").alias("payment_month"), "created_at")


def stg_classes(t: Tables) -> DataFrame:
    c = t["classes"]
    ts = F.col("scheduled_at")
    return c.select(F.col("id").alias("class_id"), "box_id", "source_class_id",
                    F.col("name").alias("class_name"), "coach", "scheduled_at",
                    ts.cast("date").alias("class_date"),
                    F.date_format(ts, "HH:mm").alias("class_time"),
                    X.dow0(ts).alias("day_of_week"),
                    F.date_format(ts, "EEEE").alias("day_name"),
                    F.hour(ts).alias("hour_of_day"),
                    "max_capacity", "created_at")


def stg_attendance(t: Tables) -> DataFrame:
    a = t["attendance"]
    ts = F.col("attended_at")
    return a.select(F.col("id").alias("attendance_id"), "box_id", "member_id", "class_id",
                    "checked_in", "attended_at", ts.cast("date").alias("attended_date"),
                    X.dow0(ts).alias("day_of_week"), F.hour(ts).alias("hour_of_day"), "created_at")


def stg_bookings(t: Tables) -> DataFrame:
    b = t["bookings"]
    return (b.filter(F.col("booked_date").isNotNull())
             .select("id", "box_id", "member_id", "source_user_id", "class_name", "space_name", "coach",
                     "booked_date", "booked_time", "checked_in", "is_first_session",
                     "membership_type", "sessions_left",
                     X.week_start("booked_date").alias("booked_week"),
                     X.month_start("booked_date").alias("booked_month"),
                     X.dow0("booked_date").alias("day_of_week"),
                     F.split_part(F.col("booked_time"), F.lit(":"), F.lit(1)).try_cast("int")
                      .alias("hour_of_day")))


def stg_leads(t: Tables, as_of: dt.date) -> DataFrame:
    lead = t["leads"]
    return lead.select(
        F.col("id").alias("lead_id"), "box_id", "source_lead_id", "first_name", "last_name",
        F.concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("full_name"),
        "email", "phone", "source", "status", "lost_reason", "trial_date",
        X.funnel_stage_order("status").alias("funnel_stage_order"),
        X.days_between(X.lit_date(as_of), F.col("created_at").cast("date")).alias("days_in_pipeline"),
        "created_at")


def stg_freezes(t: Tables, as_of: dt.date) -> DataFrame:
    f = t["freezes"]
    d = X.lit_date(as_of)
    return f.select(
        F.col("id").alias("freeze_id"), "box_id", "member_id", "source_hold_id", "source_membership_id",
        "plan_type", F.col("freeze_start").cast("date").alias("freeze_start"),
        F.col("freeze_end").cast("date").alias("freeze_end"), "total_days", "reason", "task_status",
        "price", ((F.col("freeze_start") <= d) & (F.col("freeze_end") >= d)).alias("is_active"),
        "synced_at")
