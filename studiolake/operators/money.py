"""Monetisation mart (ten record types in one 30-column table).

Plan notes
* Month-equality predicates (``payment_month = this month``) are rewritten as
  half-open ranges on the raw ``payment_date`` column so they reach the
  parquet scan as pushed filters and prune row groups / partitions.
* Current month, last month and the month before come from ONE conditional
  aggregate pass over a 3-month slice of payments (the reference scans once
  per measure).
* Tenant-grain sides (one row per box) are joined to each other only; they
  are tiny, so AQE turns those joins into broadcast hash joins at runtime.
* The frozen-MRR overlap join (freeze interval x calendar month) is rewritten
  as ``explode(sequence(first_month, last_month))`` per freeze: linear in the
  number of freezes, no nested-loop join, no skew on the month key.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]


def _zero() -> F.Column:
    return F.lit(0).cast("decimal(10,2)")


def _months(as_of: dt.date, k: int) -> F.Column:
    return F.add_months(X.month_start(X.lit_date(as_of)), k)


def _paid(amount="amount") -> F.Column:
    return F.when(F.col("status") == "paid", F.col(amount)).otherwise(_zero())


def _cents(c) -> F.Column:
    return (X.col(c) * 100).cast("decimal(38,0)")


def mrr(t: Tables, as_of: dt.date) -> DataFrame:
    """G1: sum of active membership prices by box."""
    ms = S.stg_memberships(t, as_of)
    return ms.filter(F.col("status") == "active").groupBy("box_id").agg(F.sum("price").alias("mrr"))


def month_totals(t: Tables, as_of: dt.date) -> DataFrame:
    """G2 + G4 in one pass: this month's paid / pending / overdue, overdue
    members, collection rate; paid totals of the last two complete months."""
    p = S.stg_payments(t)
    m0, m1, mm1, mm2 = _months(as_of, 0), _months(as_of, 1), _months(as_of, -1), _months(as_of, -2)
    d, st, amt = F.col("payment_date"), F.col("status"), F.col("amount")
    cur = (d >= m0) & (d < m1)
    agg = (p.filter((d >= mm2) & (d < m1))
            .groupBy("box_id").agg(
                F.sum(F.when(cur & (st == "paid"), amt)).alias("collected_this_month"),
                F.sum(F.when(cur & (st == "pending"), amt)).alias("pending_this_month"),
                F.sum(F.when(cur & (st == "overdue"), amt)).alias("overdue_total"),
                F.count_distinct(F.when(cur & (st == "overdue"), F.col("member_id"))).alias("overdue_members_count"),
                F.sum(F.when(cur, amt)).alias("_cur_total"),
                F.count_if(cur).alias("_cur_rows"),
                F.sum(F.when((d >= mm1) & (d < m0) & (st == "paid"), amt)).alias("last_month_collected"),
                F.count_if((d >= mm1) & (d < m0)).alias("_lm_rows"),
                F.sum(F.when((d >= mm2) & (d < mm1) & (st == "paid"), amt)).alias("prev_month_collected"),
                F.count_if((d >= mm2) & (d < mm1)).alias("_pm_rows")))
    # A month with rows but no paid ones sums to 0 (CASE ... ELSE 0); a month
    # without rows has no group at all (NULL, coalesced to 0 in the summary).
    return agg.select(
        "box_id",
        F.when(F.col("_cur_rows") > 0, F.coalesce("collected_this_month", _zero())).alias("collected_this_month"),
        F.when(F.col("_cur_rows") > 0, F.coalesce("pending_this_month", _zero())).alias("pending_this_month"),
        F.when(F.col("_cur_rows") > 0, F.coalesce("overdue_total", _zero())).alias("overdue_total"),
        F.when(F.col("_cur_rows") > 0, F.col("overdue_members_count")).alias("overdue_members_count"),
        X.pct_half_up(_cents(F.coalesce("collected_this_month", _zero())), _cents("_cur_total"), 1)
         .alias("collection_rate_pct"),
        F.when(F.col("_lm_rows") > 0, F.coalesce("last_month_collected", _zero())).alias("last_month_collected"),
        F.when(F.col("_pm_rows") > 0, F.coalesce("prev_month_collected", _zero())).alias("prev_month_collected"))


def avg_monthly_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """Mean of monthly paid totals over complete months (aggregate of aggregate)."""
    p = S.stg_payments(t)
    monthly = (p.filter(F.col("payment_date") < _months(as_of, 0))
                .groupBy("box_id", "payment_month").agg(F.sum(_paid()).alias("monthly_total")))
    return monthly.groupBy("box_id").agg(
        X.half_up_ratio(F.sum(_cents("monthly_total")), F.count(F.lit(1)) * 100).alias("avg_monthly_revenue"))


def new_member_mrr(t: Tables, as_of: dt.date) -> DataFrame:
    """Active memberships that started in the last complete month."""
    ms = S.stg_memberships(t, as_of)
    sd = F.col("start_date")
    return (ms.filter((sd >= _months(as_of, -1)) & (sd < _months(as_of, 0)) & (F.col("status") == "active"))
              .groupBy("box_id").agg(F.count(F.lit(1)).alias("new_member_count"), F.sum("price").alias("new_mrr")))


def _avg_days(c="total_days") -> F.Column:
    return X.half_up_ratio(F.sum(c), F.count(c))


def freeze_summary(t: Tables, as_of: dt.date) -> DataFrame:
    """Holds active on as_of: count, price sum, mean days."""
    f = S.stg_freezes(t, as_of).filter(F.col("is_active"))
    return f.groupBy("box_id").agg(F.count(F.lit(1)).alias("frozen_count"),
                                   F.sum("price").alias("frozen_revenue_impact"),
                                   _avg_days().alias("avg_freeze_days"))


def monetization_summary(t: Tables, as_of: dt.date) -> DataFrame:
    """One summary row per box that has active memberships."""
    j = (mrr(t, as_of)
         .join(month_totals(t, as_of), "box_id", "left")
         .join(avg_monthly_revenue(t, as_of), "box_id", "left")
         .join(freeze_summary(t, as_of), "box_id", "left")
         .join(new_member_mrr(t, as_of), "box_id", "left"))
    z = lambda c, zero=_zero(): F.coalesce(F.col(c), zero).alias(c)
    return j.select(
        "box_id", "mrr", z("collected_this_month"), z("pending_this_month"), z("overdue_total"),
        z("overdue_members_count", F.lit(0)), z("collection_rate_pct", F.lit(0.0)),
        z("avg_monthly_revenue", F.lit(0)), z("frozen_count", F.lit(0)), z("frozen_revenue_impact"),
        z("avg_freeze_days", F.lit(0)), z("last_month_collected"), z("prev_month_collected"),
        z("new_member_count", F.lit(0)), F.coalesce(F.col("new_mrr"), _zero()).alias("new_member_mrr"))


def revenue_by_plan(t: Tables, as_of: dt.date) -> DataFrame:
    """Active memberships per (box, plan): count and price sum."""
    ms = S.stg_memberships(t, as_of)
    return (ms.filter(F.col("status") == "active").groupBy("box_id", "plan_type")
              .agg(F.count(F.lit(1)).alias("plan_member_count"), F.sum("price").alias("plan_revenue")))


def weekly_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """Paid revenue per week over the last 84 days."""
    p = S.stg_payments(t).filter(F.col("payment_date") >= F.date_sub(X.lit_date(as_of), 84))
    return (p.groupBy("box_id", X.week_start("payment_date").alias("period_start"))
             .agg(F.sum(_paid()).alias("period_revenue")))


def monthly_revenue(t: Tables, as_of: dt.date) -> DataFrame:
    """Paid revenue per month over the last 365 days."""
    p = S.stg_payments(t).filter(F.col("payment_date") >= F.date_sub(X.lit_date(as_of), 365))
    return (p.groupBy("box_id", X.month_start("payment_date").alias("period_start"))
             .agg(F.sum(_paid()).alias("period_revenue")))


def overdue_members(t: Tables) -> DataFrame:
    """Overdue amount and earliest overdue date per member (inner join to
    members).  Payments are aggregated to member grain before the join."""
    p = S.stg_payments(t).filter(F.col("status") == "overdue")
    per_member = p.groupBy("box_id", "member_id").agg(F.sum("amount").alias("overdue_amount"),
                                                      F.min("payment_date").alias("overdue_since"))
    m = S.stg_members(t).select("member_id", F.col("name").alias("member_name"),
                                F.col("email").alias("member_email"), F.col("phone").alias("member_phone"))
    return per_member.join(m, "member_id").select(
        "box_id", "member_id", "member_name", "member_email", "member_phone", "overdue_amount", "overdue_since")


def freeze_by_reason(t: Tables, as_of: dt.date) -> DataFrame:
    """All holds by reason (NULL -> 'Other')."""
    f = S.stg_freezes(t, as_of)
    return (f.groupBy("box_id", F.coalesce(F.col("reason"), F.lit("Other")).alias("reason"))
             .agg(F.count(F.lit(1)).alias("freeze_count"), _avg_days().alias("avg_freeze_days")))


def _freeze_starts(t: Tables, as_of: dt.date, days: int, bucket) -> DataFrame:
    f = S.stg_freezes(t, as_of).filter(F.col("freeze_start") >= F.date_sub(X.lit_date(as_of), days))
    return (f.groupBy("box_id", bucket("freeze_start").alias("period_start"))
             .agg(F.count(F.lit(1)).alias("freeze_count"), F.sum("total_days").alias("total_days_frozen")))


def freeze_monthly(t: Tables, as_of: dt.date) -> DataFrame:
    """Holds started per month, last 365 days."""
    return _freeze_starts(t, as_of, 365, X.month_start)


def freeze_weekly(t: Tables, as_of: dt.date) -> DataFrame:
    """Holds started per week, last 84 days."""
    return _freeze_starts(t, as_of, 84, X.week_start)


def freeze_by_plan(t: Tables, as_of: dt.date) -> DataFrame:
    """All holds by plan (NULL -> 'Unknown')."""
    f = S.stg_freezes(t, as_of)
    return (f.groupBy("box_id", F.coalesce(F.col("plan_type"), F.lit("Unknown")).alias("plan_type"))
             .agg(F.count(F.lit(1)).alias("freeze_count"), _avg_days().alias("avg_freeze_days"),
                  F.sum("price").alias("plan_revenue")))


def frozen_mrr_monthly(t: Tables, as_of: dt.date) -> DataFrame:
    """Per calendar month of the last 12, holds overlapping the month and
    their price sum.  A hold overlaps month M iff trunc(start) <= M <= trunc(end),
    so each hold explodes into its overlapping months within the window."""
    lo = X.month_start(F.add_months(X.lit_date(as_of), -11))
    hi = X.month_start(X.lit_date(as_of))
    f = S.stg_freezes(t, as_of)
    first = F.greatest(X.month_start("freeze_start"), lo)
    last = F.least(X.month_start("freeze_end"), hi)
    spans = (f.filter(F.col("freeze_start").isNotNull() & F.col("freeze_end").isNotNull())
              .select("box_id", "price", first.alias("m_first"), last.alias("m_last"))
              .filter(F.col("m_first") <= F.col("m_last")))
    months = spans.select("box_id", "price",
                          F.explode(F.sequence("m_first", "m_last", F.expr("INTERVAL 1 MONTH"))).alias("period_start"))
    return (months.groupBy("box_id", "period_start")
                  .agg(F.count(F.lit(1)).alias("freeze_count"),
                       F.coalesce(F.sum("price"), _zero()).alias("period_revenue")))


MONETIZATION_COLUMNS = [
    ("record_type", "string"), ("box_id", "bigint"), ("mrr", "decimal(20,2)"),
    ("collected_this_month", "decimal(20,2)"), ("pending_this_month", "decimal(20,2)"),
    ("overdue_total", "decimal(20,2)"), ("overdue_members_count", "bigint"), ("collection_rate_pct", "double"),
    ("avg_monthly_revenue", "bigint"), ("frozen_count", "bigint"), ("frozen_revenue_impact", "decimal(20,2)"),
    ("avg_freeze_days", "bigint"), ("last_month_collected", "decimal(20,2)"),
    ("prev_month_collected", "decimal(20,2)"), ("new_member_count", "bigint"), ("new_member_mrr", "decimal(20,2)"),
    ("plan_type", "string"), ("plan_member_count", "bigint"), ("plan_revenue", "decimal(20,2)"),
    ("period_start", "date"), ("period_revenue", "decimal(20,2)"), ("freeze_count", "bigint"),
    ("total_days_frozen", "bigint"), ("reason", "string"), ("member_id", "bigint"), ("member_name", "string"),
    ("member_email", "string"), ("member_phone", "string"), ("overdue_amount", "decimal(20,2)"),
    ("overdue_since", "date"),
]


def _shape(df: DataFrame, record_type: str | None) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.lit(record_type) if n == "record_type" and record_type else (F.col(n) if n in have else F.lit(None)))
        .cast(ty).alias(n) for n, ty in MONETIZATION_COLUMNS])


_CONTRIB = [
    ("act_n", "bigint"), ("act_sum", "decimal(20,2)"), ("new_n", "bigint"), ("new_sum", "decimal(20,2)"),
    ("cur_paid", "decimal(20,2)"), ("cur_pending", "decimal(20,2)"), ("cur_overdue", "decimal(20,2)"),
    ("cur_amount", "decimal(20,2)"), ("cur_rows", "bigint"), ("last_paid", "decimal(20,2)"), ("last_rows", "bigint"),
    ("prev_paid", "decimal(20,2)"), ("prev_rows", "bigint"), ("comp_paid", "decimal(20,2)"), ("comp_months", "bigint"),
    ("ovd_members", "bigint"), ("fz_n", "bigint"), ("fz_price", "decimal(20,2)"), ("fz_days", "bigint"),
    ("fz_days_n", "bigint"), ("n", "bigint"), ("price", "decimal(20,2)"), ("days", "bigint"), ("days_n", "bigint"),
    ("revenue", "decimal(20,2)"), ("overdue_amount", "decimal(20,2)"), ("overdue_since", "date"),
]
_KEYS = [("record_type", "string"), ("box_id", "bigint"), ("plan_type", "string"), ("period_start", "date"),
         ("reason", "string"), ("member_id", "bigint")]


class _Item:
    """One contribution of an aggregated row: a record key plus measures."""

    def __init__(self, record_type: str, box, cols: dict):
        self.record_type, self.box, self.cols, self.cond = record_type, box, cols, None


def _item(record_type: str, box, **cols) -> _Item:
    return _Item(record_type, box, cols)


def _when(cond, item: _Item) -> _Item:
    item.cond = cond
    return item


_TYPES = dict(_KEYS + _CONTRIB)


def _contrib(df: DataFrame, items: list[_Item]) -> DataFrame:
    """Explode each row into its contributions (skipping those whose condition
    is false).  The struct carries only the fields these items use, which keeps
    the expressions small; the union fills the other columns with NULL."""
    used = {n for it in items for n in it.cols}
    names = ["record_type", "box_id"] + [n for n, _ in _KEYS[2:] + _CONTRIB if n in used]
    structs = []
    for it in items:
        given = {"record_type": F.lit(it.record_type), "box_id": it.box, **it.cols}
        st = F.struct(*[(given[n] if n in given else F.lit(None)).cast(_TYPES[n]).alias(n) for n in names])
        structs.append(F.when(it.cond, st) if it.cond is not None else st)
    return df.select(F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("c")).select("c.*")


def monetization(t: Tables, as_of: dt.date) -> DataFrame:
    """The ten record types of the monetisation mart, one pass per source.

    * payments are read twice: a ledger of (box, month, week) feeds the
      monthly and weekly revenue and the summary's current / last / previous /
      complete-month figures; debts by member feed the overdue rows and the
      current month's count.  Names are joined to the debts after the merge, so
      it aggregates numbers and dates only (a hash aggregate);
    * memberships: one (box, plan) aggregate feeds by-plan rows and the
      summary's MRR / new-member figures;
    * holds: one aggregate keyed by every combination a hold feeds (reason,
      plan, start month / week inside their windows, active today), plus the
      month-overlap explode aggregated by (box, month).
    Each aggregated row is exploded into the record keys it contributes to and
    one final aggregate merges all contributions by (record type, key).  All
    shuffles carry partially aggregated rows; nothing is re-read per branch.
    """
    d = X.lit_date(as_of)
    m0, m1, mm1, mm2 = _months(as_of, 0), _months(as_of, 1), _months(as_of, -1), _months(as_of, -2)
    c365, c84 = F.date_sub(d, 365), F.date_sub(d, 84)
    box = F.col("box_id")

    # -- payments: one ledger of (box, month, week), and debts by member -----------
    p = S.stg_payments(t)
    st, amt, pd = F.col("status"), F.col("amount"), F.col("payment_date")
    ledger = p.groupBy("box_id", "payment_month", X.week_start("payment_date").alias("wk")).agg(
        F.sum(_paid()).alias("paid"), F.count(F.lit(1)).alias("rows"),
        F.sum(F.when(st == "pending", amt).otherwise(_zero())).alias("pending"),
        F.sum(F.when(st == "overdue", amt).otherwise(_zero())).alias("overdue"),
        F.sum(amt).alias("amount"),
        F.sum(F.when(pd >= c365, _paid())).alias("paid_365"), F.count_if(pd >= c365).alias("rows_365"),
        F.sum(F.when(pd >= c84, _paid())).alias("paid_84"), F.count_if(pd >= c84).alias("rows_84"))
    first = F.row_number().over(Window.partitionBy("box_id", "payment_month").orderBy("wk")) == 1
    mo = F.col("payment_month")
    pay_c = _contrib(ledger.withColumn("first", first), [
        _when(F.col("rows_365") > 0, _item("monthly_revenue", box, period_start=mo, revenue=F.col("paid_365"))),
        _when(F.col("rows_84") > 0, _item("weekly_revenue", box, period_start=F.col("wk"), revenue=F.col("paid_84"))),
        _item("summary", box,
              cur_paid=F.when(mo == m0, F.col("paid")), cur_pending=F.when(mo == m0, F.col("pending")),
              cur_overdue=F.when(mo == m0, F.col("overdue")), cur_amount=F.when(mo == m0, F.col("amount")),
              cur_rows=F.when(mo == m0, F.col("rows")),
              last_paid=F.when(mo == mm1, F.col("paid")), last_rows=F.when(mo == mm1, F.col("rows")),
              prev_paid=F.when(mo == mm2, F.col("paid")), prev_rows=F.when(mo == mm2, F.col("rows")),
              comp_paid=F.when(mo < m0, F.col("paid")), comp_months=F.when((mo < m0) & F.col("first"), F.lit(1)))])
    debts = (p.filter((st == "overdue") & F.col("member_id").isNotNull()).groupBy("box_id", "member_id")
              .agg(F.sum("amount").alias("owed"), F.min("payment_date").alias("since"),
                   F.max(((pd >= m0) & (pd < m1)).cast("int")).alias("now")))
    debt_c = _contrib(debts, [
        _item("overdue_members", box, member_id=F.col("member_id"), overdue_amount=F.col("owed"),
              overdue_since=F.col("since")),
        _when(F.col("now") == 1, _item("summary", box, ovd_members=F.lit(1)))])

    # -- memberships: (box, plan) aggregate, then its rows feed by_plan + summary --
    ms = S.stg_memberships(t, as_of)
    active = F.col("status") == "active"
    new = active & (F.col("start_date") >= mm1) & (F.col("start_date") < m0)
    msa = ms.groupBy("box_id", "plan_type").agg(
        F.count_if(active).alias("act_n"), F.sum(F.when(active, F.col("price"))).alias("act_sum"),
        F.count_if(new).alias("new_n"), F.sum(F.when(new, F.col("price"))).alias("new_sum"))
    ms_c = _contrib(msa, [
        _when(F.col("act_n") > 0, _item("by_plan", box, plan_type=F.col("plan_type"), n=F.col("act_n"),
                                         price=F.col("act_sum"))),
        _item("summary", box, act_n=F.col("act_n"), act_sum=F.col("act_sum"), new_n=F.col("new_n"),
              new_sum=F.col("new_sum"))])

    # -- holds: one aggregate over every key combination a hold feeds --------------
    f = S.stg_freezes(t, as_of)
    fs, fe = F.col("freeze_start"), F.col("freeze_end")
    fa = f.groupBy(
        "box_id", F.coalesce(F.col("reason"), F.lit("Other")).alias("r"),
        F.coalesce(F.col("plan_type"), F.lit("Unknown")).alias("pl"),
        F.when(fs >= c365, X.month_start(fs)).alias("sm"), F.when(fs >= c84, X.week_start(fs)).alias("sw"),
        F.coalesce(F.col("is_active"), F.lit(False)).alias("act")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("total_days").alias("days"), F.count("total_days").alias("days_n"),
        F.sum("price").alias("price"))
    n, days, dn, price = F.col("n"), F.col("days"), F.col("days_n"), F.col("price")
    f_c = _contrib(fa, [
        _item("freeze_by_reason", box, reason=F.col("r"), n=n, days=days, days_n=dn),
        _item("freeze_by_plan", box, plan_type=F.col("pl"), n=n, days=days, days_n=dn, price=price),
        _when(F.col("sm").isNotNull(), _item("freeze_monthly", box, period_start=F.col("sm"), n=n, days=days)),
        _when(F.col("sw").isNotNull(), _item("freeze_weekly", box, period_start=F.col("sw"), n=n, days=days)),
        _when(F.col("act"), _item("summary", box, fz_n=n, fz_price=price, fz_days=days, fz_days_n=dn)),
    ])
    lo, hi = X.month_start(F.add_months(d, -11)), X.month_start(d)
    first, last = F.greatest(X.month_start(fs), lo), F.least(X.month_start(fe), hi)
    spans = f.filter(fs.isNotNull() & fe.isNotNull()).select("box_id", "price", first.alias("a"), last.alias("b")) \
             .filter(F.col("a") <= F.col("b"))
    fm = spans.select("box_id", "price", F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 MONTH"))).alias("m")) \
              .groupBy("box_id", "m").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("price"))
    fm_c = _contrib(fm, [_item("frozen_mrr_monthly", box, period_start=F.col("m"), n=F.col("n"),
                               price=F.col("price"))])

    allc = pay_c
    for part in [debt_c, ms_c, f_c, fm_c]:
        allc = allc.unionByName(part, allowMissingColumns=True)
    allc = allc.select(*[F.col(n).cast(ty).alias(n) for n, ty in _KEYS + _CONTRIB])
    s = lambda c: F.sum(c).alias(c)
    g = allc.groupBy(*[k for k, _ in _KEYS]).agg(
        *[s(c) for c, _ in _CONTRIB if c != "overdue_since"], F.min("overdue_since").alias("overdue_since"))
    # Names come to the debts after the merge; all other rows have no member.
    m = S.stg_members(t).select(F.col("member_id").alias("_id"), F.col("name").alias("member_name"),
                                F.col("email").alias("member_email"), F.col("phone").alias("member_phone"))
    g = g.join(m, F.col("member_id") == F.col("_id"), "left").filter(F.col("member_id").isNull() | F.col("_id").isNotNull())

    rt = F.col("record_type")
    is_sum = rt == "summary"
    zero, z0 = _zero(), F.lit(0)
    cur = F.col("cur_rows") > 0

    def when_rt(value, *types):
        return F.when(rt.isin(*types), value)

    out = g.filter(~is_sum | (F.coalesce(F.col("act_n"), z0) > 0)).select(
        "record_type", "box_id",
        when_rt(F.col("act_sum"), "summary").alias("mrr"),
        when_rt(F.when(cur, F.coalesce("cur_paid", zero)).otherwise(zero), "summary").alias("collected_this_month"),
        when_rt(F.when(cur, F.coalesce("cur_pending", zero)).otherwise(zero), "summary").alias("pending_this_month"),
        when_rt(F.when(cur, F.coalesce("cur_overdue", zero)).otherwise(zero), "summary").alias("overdue_total"),
        when_rt(F.coalesce("ovd_members", z0), "summary").alias("overdue_members_count"),
        when_rt(F.coalesce(X.pct_half_up(_cents(F.coalesce("cur_paid", zero)), _cents("cur_amount"), 1),
                           F.lit(0.0)), "summary").alias("collection_rate_pct"),
        when_rt(F.coalesce(X.half_up_ratio(_cents("comp_paid"), F.col("comp_months") * 100), z0), "summary")
        .alias("avg_monthly_revenue"),
        when_rt(F.coalesce("fz_n", z0), "summary").alias("frozen_count"),
        when_rt(F.coalesce("fz_price", zero), "summary").alias("frozen_revenue_impact"),
        F.when(is_sum, F.coalesce(X.half_up_ratio("fz_days", "fz_days_n"), z0))
         .when(rt.isin("freeze_by_reason", "freeze_by_plan"), X.half_up_ratio("days", "days_n"))
         .alias("avg_freeze_days"),
        when_rt(F.when(F.col("last_rows") > 0, F.coalesce("last_paid", zero)).otherwise(zero), "summary")
        .alias("last_month_collected"),
        when_rt(F.when(F.col("prev_rows") > 0, F.coalesce("prev_paid", zero)).otherwise(zero), "summary")
        .alias("prev_month_collected"),
        when_rt(F.coalesce("new_n", z0), "summary").alias("new_member_count"),
        when_rt(F.coalesce("new_sum", zero), "summary").alias("new_member_mrr"),
        "plan_type",
        when_rt(F.col("n"), "by_plan").alias("plan_member_count"),
        when_rt(F.col("price"), "by_plan", "freeze_by_plan").alias("plan_revenue"),
        "period_start",
        F.when(rt.isin("weekly_revenue", "monthly_revenue"), F.col("revenue"))
         .when(rt == "frozen_mrr_monthly", F.coalesce(F.col("price"), zero)).alias("period_revenue"),
        when_rt(F.col("n"), "freeze_by_reason", "freeze_monthly", "freeze_weekly", "freeze_by_plan",
                "frozen_mrr_monthly").alias("freeze_count"),
        when_rt(F.col("days"), "freeze_monthly", "freeze_weekly").alias("total_days_frozen"),
        "reason", "member_id", "member_name", "member_email", "member_phone", "overdue_amount", "overdue_since")
    return _shape(out, None)
