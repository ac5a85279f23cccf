"""Member trends (weekly / monthly) and join-cohort retention.

Plan notes
* Spines are built per box with ``explode`` of a 12-element date array -
  row-local, no cross join.
* Distinct active members per period use exact ``count_distinct``; Spark
  plans it as a two-level aggregate keyed by (box, period, member), so a hot
  box is spread over its members before the final count.
* Cohort retention joins cohort members to their distinct active months on
  (member, box) with the residual ``active_month > cohort_month``: an equi
  join with a filter, not a range join.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]

COHORT_PERIODS = [0, 1, 2, 3, 4, 5, 6, 9, 12]   # fixed: matrix columns shown


def _boxes(t: Tables) -> DataFrame:
    return S.stg_members(t).select("box_id").distinct()


def week_spine(t: Tables, as_of: dt.date) -> DataFrame:
    """the 12 most recent week starts for every box."""
    w0 = X.week_start(X.lit_date(as_of))
    weeks = F.array(*[F.date_sub(w0, 7 * n) for n in range(12)])
    return _boxes(t).select("box_id", F.explode(weeks).alias("period_start"))


def month_spine(t: Tables, as_of: dt.date) -> DataFrame:
    """the 12 most recent month starts for every box."""
    m0 = X.month_start(X.lit_date(as_of))
    months = F.array(*[F.add_months(m0, -n) for n in range(12)])
    return _boxes(t).select("box_id", F.explode(months).alias("period_start"))


def _active(t: Tables, as_of: dt.date, days: int, bucket) -> DataFrame:
    b = S.stg_bookings(t)
    b = b.filter(F.col("checked_in") & F.col("member_id").isNotNull()
                 & (F.col("booked_date") >= F.date_sub(X.lit_date(as_of), days)))
    return b.groupBy("box_id", bucket("booked_date").alias("period_start")).agg(
        F.count_distinct("member_id").alias("cumulative_active"))


def active_weekly(t: Tables, as_of: dt.date) -> DataFrame:
    """distinct checked-in members per box-week (last 84 days)."""
    return _active(t, as_of, 84, X.week_start)


def active_monthly(t: Tables, as_of: dt.date) -> DataFrame:
    """distinct checked-in members per box-month (last 365 days)."""
    return _active(t, as_of, 365, X.month_start)


def new_members(t: Tables, granularity: str = "week") -> DataFrame:
    """members by join week / month."""
    bucket = X.week_start if granularity == "week" else X.month_start
    m = S.stg_members(t).filter(F.col("join_date").isNotNull())
    return m.groupBy("box_id", bucket("join_date").alias("period_start")).agg(F.count(F.lit(1)).alias("new_members"))


def member_trends(t: Tables, as_of: dt.date) -> DataFrame:
    """zero-filled weekly and monthly trend rows."""
    def fill(spine, new, active, kind):
        return (spine.join(new, ["box_id", "period_start"], "left").join(active, ["box_id", "period_start"], "left")
                .select("box_id", F.lit(kind).alias("period_type"), "period_start",
                        F.coalesce("new_members", F.lit(0)).alias("new_members"),
                        F.coalesce("cumulative_active", F.lit(0)).alias("cumulative_active")))
    return fill(week_spine(t, as_of), new_members(t, "week"), active_weekly(t, as_of), "weekly").unionByName(
        fill(month_spine(t, as_of), new_members(t, "month"), active_monthly(t, as_of), "monthly"))


def cohort_members(t: Tables, as_of: dt.date) -> DataFrame:
    m = S.stg_members(t)
    d = X.lit_date(as_of)
    return (m.filter(F.col("join_date").isNotNull() & (F.col("join_date") < X.month_start(d))
                     & (F.col("join_date") >= F.add_months(d, -13)))
             .select("member_id", "box_id", X.month_start("join_date").alias("cohort_month")))


def cohort_sizes(t: Tables, as_of: dt.date) -> DataFrame:
    """completed join-month cohorts of the last 13 months."""
    return cohort_members(t, as_of).groupBy("box_id", "cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))


def active_months(t: Tables) -> DataFrame:
    """F8: distinct (box, member, month) with a check-in."""
    b = S.stg_bookings(t).filter(F.col("checked_in"))
    return b.select("box_id", "member_id", F.col("booked_month").alias("active_month")).distinct()


PERIODS = 12   # fixed: months after the cohort's own that are followed


def month_bits(t: Tables, first: dt.date, months: int) -> DataFrame:
    """Per (box, member) one number whose bit i says that there was a check-in in the i-th month from ``first``: a
    bit-or aggregate, so a member's visits are combined before the shuffle.  The bounds are literals on the booking date."""
    end = _plus_months(first, months)
    b = S.stg_bookings(t).filter(F.col("checked_in") & F.col("member_id").isNotNull() & (F.col("booked_date") >= F.lit(first)) & (F.col("booked_date") < F.lit(end)))
    place = X.month_diff("booked_month", F.lit(first))
    return b.groupBy("box_id", "member_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))


def cohort_retention(t: Tables, as_of: dt.date) -> DataFrame:
    """retained members per cohort and month offset 1..12, plus the
    synthetic 100 % period 0.

    A member is one row: its months as bits, shifted so that bit 0 is the month
    after its cohort's; one aggregate per cohort counts the members and each bit."""
    first = _plus_months(as_of, -13)
    c = cohort_members(t, as_of)
    bits = month_bits(t, first, 13 + PERIODS + 1)
    after = F.call_function("shiftrightunsigned", F.coalesce("bits", F.lit(0).cast("long")), X.month_diff("cohort_month", F.lit(first)) + 1)
    counts = [F.sum(F.call_function("shiftrightunsigned", F.col("after"), F.lit(p - 1)).bitwiseAND(F.lit(1))).alias(f"r{p}") for p in range(1, PERIODS + 1)]
    g = c.join(bits, ["box_id", "member_id"], "left").withColumn("after", after) \
         .groupBy("box_id", "cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"), *counts)
    cells = F.array(F.struct(F.lit(0).alias("period_number"), F.col("cohort_size").alias("retained_members")),
                    *(F.struct(F.lit(p).alias("period_number"), F.col(f"r{p}").alias("retained_members")) for p in range(1, PERIODS + 1)))
    r = g.select("box_id", "cohort_month", "cohort_size", F.inline(cells)).filter((F.col("period_number") == 0) | (F.col("retained_members") > 0))
    return r.withColumn("retention_pct", X.pct_half_up("retained_members", "cohort_size", 1))


def _plus_months(day: dt.date, n: int) -> dt.date:
    """First of the month n months on."""
    m = day.year * 12 + day.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def cohort_matrix(t: Tables, as_of: dt.date) -> DataFrame:
    """one row per cohort with retention % at the shown month offsets."""
    r = cohort_retention(t, as_of).filter(F.col("period_number").isin(COHORT_PERIODS))
    piv = r.groupBy("box_id", "cohort_month", "cohort_size").pivot("period_number", COHORT_PERIODS) \
           .agg(F.first("retention_pct"))
    return piv.select("box_id", "cohort_month", "cohort_size",
                      *[F.col(str(p)).alias(f"p{p}") for p in COHORT_PERIODS])
