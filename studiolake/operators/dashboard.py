"""Tenant-scoped reads and the dashboard's client-side maths,
re-expressed as DataFrame queries over the marts.

Per-box rankings (top-k, "first row" KPIs, bar percentages of the max) work
on mart rows whose count per box is bounded by a small vocabulary (plans,
class types, coaches, heatmap cells), and box-wide maxima are computed as an
aggregate joined back rather than a window over a whole tenant.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import classes as C
from studiolake.operators import health as H
from studiolake.operators import leads as L
from studiolake.operators import lifecycle as J
from studiolake.operators import money as M

Tables = dict[str, DataFrame]
CHECKIN_HOURS = list(range(6, 22))   # fixed: hours shown on the peak-hours chart (6..21)
FREEZE_STEPS = ["completed", "returned", "at_risk", "churned"]


def floor_div(a, b) -> F.Column:
    """floor(a / b) for b > 0, exact on integers/decimals."""
    a, b = X.col(a).cast("decimal(38,0)"), X.col(b).cast("decimal(38,0)")
    return X.idiv(a - F.pmod(a, b), b)


def js_round_ratio(num, den) -> F.Column:
    """Math.round(num / den) for den > 0 (halves toward +infinity), exact."""
    n = X.col(num).cast("decimal(38,0)")
    d = F.nullif(X.col(den).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    return floor_div(n * 2 + d, d * 2).cast("bigint")


def _cents(c) -> F.Column:
    return (X.col(c) * 100).cast("decimal(38,0)")


# ---- A11 / A12 ---------------------------------------------------------------

def resolve_box(t: Tables, token: str) -> DataFrame:
    """The box owning ``token`` (zero or one row)."""
    return t["boxes"].filter(F.col("access_token") == token).select(F.col("id").alias("box_id")).limit(1)


def tenant_scope(df: DataFrame, t: Tables, token: str) -> DataFrame:
    """Rows of ``df`` that belong to the caller's box.  The build side is
    ``resolve_box`` - at most one row by its ``limit(1)`` - so broadcasting it
    is safe; with ``box_id``-partitioned storage the semi join also drives
    dynamic partition pruning of the scan."""
    return df.join(F.broadcast(resolve_box(t, token)), "box_id", "left_semi")


def scope_inputs(t: Tables, token: str) -> Tables:
    """A12 applied to the inputs, in two phases: the box is looked up first (at
    most one row comes to the driver), then every table with a ``box_id`` is
    filtered by that literal.  On box-partitioned storage each scan is pruned
    while the query is planned, and any operator run on the result touches one
    tenant's folders; an unknown token reads none.  Assumes child rows carry
    their member's box (checked by ``dq_orphans`` style rules)."""
    row = resolve_box(t, token).first()
    own = F.lit(False) if row is None or row["box_id"] is None else F.col("box_id") == F.lit(row["box_id"])
    return {n: (df.filter(own) if "box_id" in df.columns else df) for n, df in t.items()}


# ---- K1-K4 revenue tab ---------------------------------------------------------

def plan_arpu(t: Tables, as_of: dt.date) -> DataFrame:
    """K1: revenue per member for each active plan (JS rounding), plans by ARPU desc."""
    p = M.revenue_by_plan(t, as_of)
    return p.select("box_id", F.col("plan_type").alias("name"), F.col("plan_revenue").alias("value"),
                    F.col("plan_member_count").alias("members"),
                    F.when(F.col("plan_member_count") > 0,
                           js_round_ratio(_cents("plan_revenue"), F.col("plan_member_count") * 100))
                     .otherwise(F.lit(0)).alias("arpu"))


def mom_delta(t: Tables, as_of: dt.date) -> DataFrame:
    """K2: last vs previous complete month, % change (NULL when base <= 0)."""
    s = M.monetization_summary(t, as_of)
    last, prev = F.col("last_month_collected"), F.col("prev_month_collected")
    return s.select("box_id", "last_month_collected", "prev_month_collected",
                    F.when(prev > 0, js_round_ratio(_cents(last - prev) * 100, _cents(prev))).alias("mo_delta"))


def record_type_series(mart: DataFrame, record_type: str, measures: list[str],
                       order_col: str = "period_start", descending: bool = False) -> DataFrame:
    """K3: one record type of a union mart, as a sorted series per box."""
    s = mart.filter(F.col("record_type") == record_type).select("box_id", order_col, *measures)
    return s.orderBy("box_id", F.col(order_col).desc() if descending else F.col(order_col))


#: Record types of the monetisation mart and the operator that computes each by itself.
SERIES = {"weekly_revenue": M.weekly_revenue, "monthly_revenue": M.monthly_revenue, "by_plan": M.revenue_by_plan,
          "freeze_by_reason": M.freeze_by_reason, "freeze_by_plan": M.freeze_by_plan, "freeze_monthly": M.freeze_monthly,
          "freeze_weekly": M.freeze_weekly, "frozen_mrr_monthly": M.frozen_mrr_monthly}


def series(t: Tables, as_of: dt.date, record_type: str, measures: list[str], order_col: str = "period_start",
           descending: bool = False) -> DataFrame:
    """K3 from the tables: only the operator of the record type runs, not the whole mart."""
    own = SERIES[record_type](t, as_of).withColumn("record_type", F.lit(record_type))
    return record_type_series(own, record_type, measures, order_col, descending)


def ltv_rank(t: Tables, as_of: dt.date) -> DataFrame:
    """K4: plans ranked by LTV within their box."""
    l = J.ltv_by_plan(t, as_of)
    w = Window.partitionBy("box_id").orderBy(F.col("avg_ltv").desc_nulls_last(), F.col("plan_type").asc_nulls_last())
    return l.withColumn("rank", F.row_number().over(w))


# ---- K5-K9 members / alerts tabs ---------------------------------------------

def tier_counts(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """K5: tier counts and mean score over ALL members of the box."""
    h = H.health_scores(t, as_of, activity)
    tier = F.col("health_tier")
    agg = h.groupBy("box_id").agg(
        F.count_if(tier == "healthy").alias("healthy"), F.count_if(tier == "at_risk").alias("at_risk"),
        F.count_if(tier == "critical").alias("critical"), F.count(F.lit(1)).alias("_n"),
        F.sum(F.coalesce(F.col("health_score"), F.lit(0))).alias("_s"))
    return agg.select("box_id", "healthy", "at_risk", "critical",
                      F.when(F.col("_n") > 0, js_round_ratio("_s", "_n")).otherwise(F.lit(0)).alias("avg"))


def plan_change_kpis(t: Tables, as_of: dt.date) -> DataFrame:
    """K6: upgrade / downgrade counts and revenue per box (boxes with changes)."""
    tot = J.plan_change_totals(J.membership_changes(t, as_of))
    zero = F.lit(0).cast("decimal(10,2)")
    return tot.select("box_id", F.col("total_upgrades").alias("upgrades"),
                      F.col("total_downgrades").alias("downgrades"),
                      F.coalesce("upgrade_revenue_gain", zero).alias("gain"),
                      F.coalesce("downgrade_revenue_lost", zero).alias("lost"))


def drill_members(t: Tables, as_of: dt.date, granularity: str, period_start: dt.date,
                  activity: DataFrame | None = None) -> DataFrame:
    """K7: members who joined in the clicked week / month, by name."""
    s = H.members_snapshot(t, as_of, activity)
    c = "join_week" if granularity == "weekly" else "join_month"
    return (s.filter(F.col(c) == X.lit_date(period_start))
             .select("box_id", "name", "plan_type", "health_tier", "health_score").orderBy("box_id", "name"))


def drill_tier(t: Tables, as_of: dt.date, tier: str = "all", activity: DataFrame | None = None) -> DataFrame:
    """K8: alert list filtered to a tier, lowest score first."""
    h = H.health_scores(t, as_of, activity)
    if tier != "all":
        h = h.filter(F.col("health_tier") == tier)
    return h.orderBy("box_id", "health_score", "member_id")


def intl_phones(t: Tables) -> DataFrame:
    """K9: the alert list's international phone form for every member."""
    return t["members"].select(F.col("id").alias("member_id"), "box_id", "phone",
                               X.intl_phone("phone").alias("intl_phone"))


# ---- K10-K14 freezes tab -------------------------------------------------------

DRILL_FREEZE_COLUMNS = ["box_id", "member_name", "plan_type", "health_tier", "health_score", "freeze_start",
                        "freeze_end", "total_days", "reason", "price", "is_active"]


def drill_frozen(t: Tables, as_of: dt.date, activity: DataFrame | None = None) -> DataFrame:
    """Holds active today, latest start first."""
    e = J.freeze_events(t, as_of, activity)
    return e.filter(F.col("is_active") == F.lit(True)).select(*DRILL_FREEZE_COLUMNS) \
            .orderBy("box_id", F.col("freeze_start").desc())


def drill_freeze_range(t: Tables, as_of: dt.date, start: dt.date, end: dt.date,
                       activity: DataFrame | None = None) -> DataFrame:
    """Holds starting within [start, end]."""
    e = J.freeze_events(t, as_of, activity)
    fs = F.col("freeze_start")
    return e.filter((fs >= X.lit_date(start)) & (fs <= X.lit_date(end))).select(*DRILL_FREEZE_COLUMNS) \
            .orderBy("box_id", fs.desc())


def drill_freeze_period(t: Tables, as_of: dt.date, granularity: str, period_start: dt.date,
                        activity: DataFrame | None = None) -> DataFrame:
    """Holds starting in the clicked week (start..start+6) or month (start..month end)."""
    p = X.as_date(period_start)
    if granularity == "weekly":
        end = p + dt.timedelta(days=6)
    else:
        nxt = dt.date(p.year + (p.month == 12), p.month % 12 + 1, 1)
        end = nxt - dt.timedelta(days=1)
    return drill_freeze_range(t, as_of, p, end, activity)


def freeze_total(t: Tables, as_of: dt.date) -> DataFrame:
    """Total holds over all reasons, per box."""
    return M.freeze_by_reason(t, as_of).groupBy("box_id").agg(F.sum("freeze_count").alias("total"))


def freeze_funnel(t: Tables, as_of: dt.date) -> DataFrame:
    """Completed -> returned / at_risk / churned steps with % of completed."""
    tot = J.freeze_outcome_totals(J.classified_freezes(t, as_of))
    def step(i, name, c):
        return F.struct(F.lit(i).alias("ord"), F.lit(name).alias("step"), F.col(c).alias("count"))

    steps = tot.select("box_id", "total_completed", F.explode(F.array(
        step(0, "completed", "total_completed"), step(1, "returned", "total_returned"),
        step(2, "at_risk", "total_at_risk"), step(3, "churned", "total_churned"))).alias("s"))
    tc = F.col("total_completed")
    return steps.select("box_id", F.col("s.ord").alias("step_order"), F.col("s.step").alias("step"),
                        F.col("s.count").alias("count"),
                        F.when(F.col("s.ord") == 0, F.lit(100))
                         .when(tc > 0, js_round_ratio(F.col("s.count") * 100, tc)).otherwise(F.lit(0)).alias("pct"))


def freeze_funnel_drill(t: Tables, as_of: dt.date, outcome: str) -> DataFrame:
    """K14 drill: the completed holds with the clicked outcome."""
    return J.classified_freezes(t, as_of).filter(F.col("outcome") == outcome)


# ---- K15-K17 classes tab --------------------------------------------------------

def top_classes(t: Tables, sort_key: str = "checkins", k: int = 10) -> DataFrame:
    """The top-k class types per box by check-ins or fill rate, with each
    bar as a % of the box maximum (the limit is the feature: a top-k list)."""
    ct = C.class_types(t)
    # values in integer units: check-ins, or fill rate in tenths of a percent
    val = F.col("total_checkins") if sort_key == "checkins" else F.round(F.col("avg_fill_rate") * 10).cast("bigint")
    ranked = ct.select("box_id", "label", val.alias("_v"))
    mx = ranked.groupBy("box_id").agg(F.max("_v").alias("_max"))
    w = Window.partitionBy("box_id").orderBy(F.col("_v").desc_nulls_last(), F.col("label"))
    top = ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    scale = 1.0 if sort_key == "checkins" else 10.0
    return top.join(mx, "box_id").select(
        "box_id", "rank", "label", (F.col("_v") / scale).alias("value"),
        js_round_ratio(F.col("_v") * 100, "_max").alias("bar_pct"))


def coach_ranking(t: Tables) -> DataFrame:
    """Coach leaderboard ordered by average fill rate."""
    return C.coach_leaderboard(t).orderBy("box_id", F.col("avg_fill_rate").desc_nulls_last(), "label")


def heatmap_intensity(t: Tables) -> DataFrame:
    """Fill / max fill of the box (max floored at 1)."""
    hm = C.class_heatmap(t)
    mx = hm.groupBy("box_id").agg(F.greatest(F.max("avg_fill_rate"), F.lit(1.0)).alias("_max"))
    fill = F.coalesce(F.col("avg_fill_rate"), F.lit(0.0))
    return hm.join(mx, "box_id").select("box_id", "day_of_week", "hour_of_day", fill.alias("fill_rate"),
                                        (fill / F.col("_max")).alias("intensity"))


def checkins_by_hour(t: Tables) -> DataFrame:
    """Check-ins per hour 6..21 over all days, zero-filled."""
    hm = C.class_heatmap(t).filter(F.col("day_of_week").between(0, 6))
    per_hour = hm.groupBy("box_id", F.col("hour_of_day").alias("hour")).agg(F.sum("total_checkins").alias("_c"))
    spine = hm.select("box_id").distinct().select("box_id", F.explode(F.array(*[F.lit(h) for h in CHECKIN_HOURS]))
                                                  .alias("hour"))
    return spine.join(per_hour, ["box_id", "hour"], "left").select(
        "box_id", "hour", F.coalesce("_c", F.lit(0)).alias("checkins"))


# ---- K18-K20 leads tab ----------------------------------------------------------

def funnel_stages(t: Tables, as_of: dt.date) -> DataFrame:
    """The five stage counts of each (box, period) as rows."""
    f = L.lead_funnel(t, as_of).select("box_id", "record_type", *L.STAGES)
    return f.unpivot(["box_id", "record_type"], L.STAGES, "stage", "value")


def drill_leads(t: Tables, as_of: dt.date, status: str, days: int | None) -> DataFrame:
    """Leads of one stage created in the period, newest first, with days ago."""
    d = L.leads_detail(t, as_of).filter(F.col("status") == status)
    if days is not None:
        d = d.filter(F.col("created_at") >= F.date_sub(X.lit_date(as_of), days))
    return d.select("box_id", "lead_id", "full_name", "phone", "email", "source", "status", "trial_date",
                    "created_at", "lost_reason", "days_in_pipeline",
                    X.days_between(X.lit_date(as_of), F.col("created_at").cast("date")).alias("days_ago")) \
            .orderBy("box_id", F.col("created_at").desc(), "lead_id")


def source_rates(t: Tables, as_of: dt.date) -> DataFrame:
    """Per-source win % (JS rounding) of each (box, period)."""
    s = L.lead_sources(t, as_of)
    e = s.select("box_id", "record_type", F.posexplode("source_breakdown").alias("pos", "x"))
    return e.select("box_id", "record_type", "pos", F.col("x.source").alias("source"), F.col("x.total").alias("total"),
                    F.col("x.converted").alias("converted"),
                    F.when(F.col("x.total") > 0, js_round_ratio(F.col("x.converted") * 100, F.col("x.total")))
                     .otherwise(F.lit(0)).alias("win_pct"))


def lost_reason_value(t: Tables, as_of: dt.date) -> DataFrame:
    """Value of each lost reason = count x average price."""
    r = L.lost_reasons(t, as_of).join(L.avg_mrr(t), "box_id", "left")
    e = r.select("box_id", "record_type", "avg_mrr", F.posexplode("lost_reasons").alias("pos", "x"))
    return e.select("box_id", "record_type", "pos", F.col("x.reason").alias("reason"), F.col("x.count").alias("count"),
                    (F.col("x.count") * F.coalesce("avg_mrr", F.lit(0))).alias("value"))


def stage_value(t: Tables, as_of: dt.date) -> DataFrame:
    """Drawer total value = stage count x average price (converted, lost)."""
    f = L.lead_funnel(t, as_of)
    mrr0 = F.coalesce("avg_mrr", F.lit(0))
    return f.select("box_id", "record_type", (F.col("converted") * mrr0).alias("converted_value"),
                    (F.col("lost") * mrr0).alias("lost_value"))
