"""Sales funnel marts.

Plan notes
* Period expansion (I2) is a row-local ``explode`` of at most four period
  structs per lead (no join, no shuffle).
* Nested outputs: lost-reason and source lists hold one element per distinct
  reason / source of a (box, period) - aggregated first, so their length is
  the category vocabulary, not the row count.  Upcoming trials grow with the
  data, so they are produced as flat rows (``upcoming_trials``) instead of
  one array per box.
* ``leads_mart`` reads the lead periods once: each row is exploded into its
  funnel / reason / source keys and counted in one aggregate.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]

# Funnel periods (name, days back; None = since 2000-01-01).
PERIODS = [("last_30d", 30), ("last_60d", 60), ("last_90d", 90), ("all_time", None)]
ALL_TIME_SINCE = dt.date(2000, 1, 1)
STAGES = ["new_leads", "in_progress", "trial_booked", "converted", "lost"]


def avg_mrr(t: Tables) -> DataFrame:
    """Mean active price (> 0) per box, rounded to whole units."""
    m = t["memberships"]
    return (m.filter((F.col("status") == "active") & (F.col("price") > 0)).groupBy("box_id")
             .agg(X.half_up_ratio(F.sum((F.col("price") * 100).cast("decimal(38,0)")),
                                  F.count("price") * 100).alias("avg_mrr")))


def lead_periods(t: Tables, as_of: dt.date) -> DataFrame:
    """Each lead once per period window it falls in."""
    lead = S.stg_leads(t, as_of)
    d = X.lit_date(as_of)
    periods = F.array(*[F.struct(F.lit(n).alias("record_type"),
                                 (F.date_sub(d, k) if k is not None else F.lit(ALL_TIME_SINCE)).alias("since_date"))
                        for n, k in PERIODS])
    created = F.col("created_at").cast("date")
    return (lead.withColumn("_p", F.explode(F.filter(periods, lambda p: p["since_date"] <= created)))
                .select("*", F.col("_p.record_type").alias("record_type"),
                        F.col("_p.since_date").alias("since_date")).drop("_p"))


def lead_funnel(t: Tables, as_of: dt.date, periods: DataFrame | None = None) -> DataFrame:
    """Funnel counts, conversion rate (non-new denominator), days to
    convert, time-to-convert buckets and value estimates per (box, period)."""
    pl = periods if periods is not None else lead_periods(t, as_of)
    st, days = F.col("status"), F.col("days_in_pipeline")
    conv = st == "converted"
    agg = pl.groupBy("box_id", "record_type").agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(st == "new").alias("new_leads"),
        F.count_if(st == "in_progress").alias("in_progress"),
        F.count_if(st == "trial_booked").alias("trial_booked"),
        F.count_if(conv).alias("converted"),
        F.count_if(st == "lost").alias("lost"),
        F.count_if(st != "new").alias("_non_new"),
        F.sum(F.when(conv, days)).alias("_conv_days"),
        F.count(F.when(conv, days)).alias("_conv_n"),
        F.struct(F.count_if(conv & (days == 0)).alias("same_day"),
                 F.count_if(conv & days.between(1, 3)).alias("1_3d"),
                 F.count_if(conv & days.between(4, 7)).alias("4_7d"),
                 F.count_if(conv & days.between(8, 30)).alias("8_30d"),
                 F.count_if(conv & (days > 30)).alias("30plus")).alias("convert_time_buckets"))
    j = agg.join(avg_mrr(t), "box_id", "left")
    mrr0 = F.coalesce(F.col("avg_mrr"), F.lit(0))
    return j.select(
        "box_id", "record_type", "total_leads", "new_leads", "in_progress", "trial_booked", "converted", "lost",
        X.pct_half_up("converted", "_non_new", 1).alias("conversion_rate_pct"),
        X.half_up_ratio("_conv_days", "_conv_n").alias("avg_days_to_convert"),
        "avg_mrr",
        (F.col("trial_booked") * mrr0).alias("pipeline_value"),
        (F.col("converted") * mrr0).alias("won_revenue"),
        (F.col("lost") * mrr0).alias("lost_revenue_est"),
        "convert_time_buckets")


def _sorted_list(df: DataFrame, keys: list[str], name_col: str, count_col: str, fields: list[str],
                 out: str) -> DataFrame:
    """Per ``keys``: array of structs ordered by ``count_col`` desc, then name."""
    item = F.struct((-F.col(count_col)).alias("_k1"),
                    F.coalesce(F.col(name_col), F.lit("null")).alias("_k2"),
                    *[F.col(f) for f in fields])
    return (df.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_l"))
              .select(*keys, F.transform("_l", lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(out)))


def lost_reasons(t: Tables, as_of: dt.date, periods: DataFrame | None = None) -> DataFrame:
    """Per (box, period), reasons with counts, most frequent first."""
    pl = periods if periods is not None else lead_periods(t, as_of)
    counts = (pl.filter(F.col("lost_reason").isNotNull())
                .groupBy("box_id", "record_type", F.col("lost_reason").alias("reason"))
                .agg(F.count(F.lit(1)).alias("count")))
    return _sorted_list(counts, ["box_id", "record_type"], "reason", "count", ["reason", "count"], "lost_reasons")


def lead_sources(t: Tables, as_of: dt.date, periods: DataFrame | None = None) -> DataFrame:
    """Per (box, period), sources (NULL kept) with total and converted."""
    pl = periods if periods is not None else lead_periods(t, as_of)
    counts = pl.groupBy("box_id", "record_type", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "converted").alias("converted"))
    return _sorted_list(counts, ["box_id", "record_type"], "source", "total",
                        ["source", "total", "converted"], "source_breakdown")


def _ranked(counts: DataFrame, label: str, measures: list[str], k: int) -> DataFrame:
    """Per (box, period) the ``k`` labels of most rows (ties: by name, a missing one as 'null'), each with its rank, and
    one row without a rank for all others: rows of one label each, however many free-text labels a box has."""
    keys, first = ["box_id", "record_type"], measures[0]
    w = Window.partitionBy(*keys).orderBy(F.desc(first), F.coalesce(F.col(label), F.lit("null")))
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    whole = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(m).alias(m) for m in measures))
    taken = top.groupBy(*keys).agg(*(F.sum(m).alias(f"_{m}") for m in measures))
    rest = whole.filter(F.col("_n") > k).join(taken, keys)
    return top.select(*keys, "rank", F.coalesce(F.col(label), F.lit("null")).alias("label"), F.lit(1).cast("long").alias("n_labels"), *measures).unionByName(
        rest.select(*keys, F.lit(None).cast("int").alias("rank"), F.lit(None).cast("string").alias("label"), (F.col("_n") - k).alias("n_labels"),
                    *((F.col(m) - F.col(f"_{m}")).alias(m) for m in measures)))


def lost_reason_rows(t: Tables, as_of: dt.date, k: int = 20) -> DataFrame:
    """I6 as rows: per (box, period) the ``k`` most frequent lost reasons, and the rest as one."""
    counts = (lead_periods(t, as_of).filter(F.col("lost_reason").isNotNull())
              .groupBy("box_id", "record_type", "lost_reason").agg(F.count(F.lit(1)).alias("total")))
    return _ranked(counts, "lost_reason", ["total"], k)


def lead_source_rows(t: Tables, as_of: dt.date, k: int = 20) -> DataFrame:
    """I7 as rows: per (box, period) the ``k`` most frequent sources with their conversions, and the rest as one."""
    counts = lead_periods(t, as_of).groupBy("box_id", "record_type", "source").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "converted").alias("converted"))
    return _ranked(counts, "source", ["total", "converted"], k)


def upcoming_trials(t: Tables, as_of: dt.date) -> DataFrame:
    """I8: trial_booked leads with a trial in [as_of, as_of + 7], one row each
    (read them per box ordered by ``trial_date``, as the reference's list is)."""
    lead = S.stg_leads(t, as_of)
    d = X.lit_date(as_of)
    return (lead.filter((F.col("status") == "trial_booked")
                        & F.col("trial_date").between(d, F.date_add(d, 7)))
                .select("box_id", F.col("full_name").alias("name"), "phone", "trial_date", "source", "lead_id"))


def leads_mart(t: Tables, as_of: dt.date) -> DataFrame:
    """I9 in one pass over the lead-period rows: each row is exploded into
    the keys it feeds - the (box, period) funnel, its lost reason, its source
    - one aggregate counts every key, and a second (per box and period, over
    already aggregated rows) assembles the funnel columns and the two ordered
    lists.  Trials per box are joined as a count (the rows themselves are
    ``upcoming_trials``)."""
    pl = lead_periods(t, as_of)
    st, days = F.col("status"), F.col("days_in_pipeline")
    conv = st == "converted"
    null_s = F.lit(None).cast("string")
    keys = F.array(F.struct(F.lit("funnel").alias("kind"), null_s.alias("label")),
                   F.when(F.col("lost_reason").isNotNull(),
                          F.struct(F.lit("reason").alias("kind"), F.col("lost_reason").alias("label"))),
                   F.struct(F.lit("source").alias("kind"), F.col("source").alias("label")))
    e = pl.select("box_id", "record_type", "status", "days_in_pipeline",
                  F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("*", "k.*").drop("k")
    g = e.groupBy("box_id", "record_type", "kind", "label").agg(
        F.count(F.lit(1)).alias("total_leads"),
        F.count_if(st == "new").alias("new_leads"), F.count_if(st == "in_progress").alias("in_progress"),
        F.count_if(st == "trial_booked").alias("trial_booked"), F.count_if(conv).alias("converted"),
        F.count_if(st == "lost").alias("lost"), F.count_if(st != "new").alias("_non_new"),
        F.sum(F.when(conv, days)).alias("_conv_days"), F.count(F.when(conv, days)).alias("_conv_n"),
        F.count_if(conv & (days == 0)).alias("same_day"), F.count_if(conv & days.between(1, 3)).alias("1_3d"),
        F.count_if(conv & days.between(4, 7)).alias("4_7d"), F.count_if(conv & days.between(8, 30)).alias("8_30d"),
        F.count_if(conv & (days > 30)).alias("30plus"))
    kind = F.col("kind")

    def fun(c):
        return F.max(F.when(kind == "funnel", F.col(c))).alias(c)

    measures = ["total_leads", "new_leads", "in_progress", "trial_booked", "converted", "lost", "_non_new",
                "_conv_days", "_conv_n", "same_day", "1_3d", "4_7d", "8_30d", "30plus"]
    reason_item = F.struct((-F.col("total_leads")).alias("_k1"), F.coalesce("label", F.lit("null")).alias("_k2"),
                           F.col("label").alias("reason"), F.col("total_leads").alias("count"))
    source_item = F.struct((-F.col("total_leads")).alias("_k1"), F.coalesce("label", F.lit("null")).alias("_k2"),
                           F.col("label").alias("source"), F.col("total_leads").alias("total"),
                           F.col("converted").alias("converted"))
    m = g.groupBy("box_id", "record_type").agg(
        *[fun(c) for c in measures],
        F.array_sort(F.collect_list(F.when(kind == "reason", reason_item))).alias("_lr"),
        F.array_sort(F.collect_list(F.when(kind == "source", source_item))).alias("_sb"))
    m = m.select("*",
                 F.when(F.size("_lr") > 0, F.transform("_lr", lambda x: F.struct(x["reason"].alias("reason"),
                                                                                 x["count"].alias("count"))))
                  .alias("lost_reasons"),
                 F.transform("_sb", lambda x: F.struct(x["source"].alias("source"), x["total"].alias("total"),
                                                       x["converted"].alias("converted"))).alias("source_breakdown"))
    trials = upcoming_trials(t, as_of).groupBy("box_id").agg(F.count(F.lit(1)).alias("upcoming_trial_count"))
    j = m.join(avg_mrr(t), "box_id", "left").join(trials, "box_id", "left")
    mrr0 = F.coalesce(F.col("avg_mrr"), F.lit(0))
    return j.select(
        "box_id", "record_type", "total_leads", "new_leads", "in_progress", "trial_booked", "converted", "lost",
        X.pct_half_up("converted", "_non_new", 1).alias("conversion_rate_pct"),
        X.half_up_ratio("_conv_days", "_conv_n").alias("avg_days_to_convert"),
        "avg_mrr",
        (F.col("trial_booked") * mrr0).alias("pipeline_value"),
        (F.col("converted") * mrr0).alias("won_revenue"),
        (F.col("lost") * mrr0).alias("lost_revenue_est"),
        F.struct("same_day", "1_3d", "4_7d", "8_30d", "30plus").alias("convert_time_buckets"),
        "lost_reasons", "source_breakdown", "upcoming_trial_count")


def leads_detail(t: Tables, as_of: dt.date) -> DataFrame:
    """Lead rows for the drill-down drawer."""
    return S.stg_leads(t, as_of).select(
        "lead_id", "box_id", "full_name", "first_name", "last_name", "phone", "email", "source", "status",
        "lost_reason", "trial_date", "created_at", "days_in_pipeline")


def leads_weekly(t: Tables, as_of: dt.date) -> DataFrame:
    """Per week of the last 84 days: total, converted, rate over all leads."""
    lead = S.stg_leads(t, as_of).filter(F.col("created_at") >= F.date_sub(X.lit_date(as_of), 84))
    agg = lead.groupBy("box_id", X.week_start("created_at").alias("week_start")).agg(
        F.count(F.lit(1)).alias("total_leads"), F.count_if(F.col("status") == "converted").alias("converted"))
    return agg.select("*", X.pct_half_up("converted", "total_leads", 1).alias("conversion_rate_pct"))


def leads_monthly(t: Tables, as_of: dt.date) -> DataFrame:
    """Per month of the last 12 months, with won / lost value."""
    lead = S.stg_leads(t, as_of).filter(F.col("created_at") >= F.add_months(X.lit_date(as_of), -12))
    st = F.col("status")
    agg = lead.groupBy("box_id", X.month_start("created_at").alias("month_start")).agg(
        F.count(F.lit(1)).alias("total_leads"), F.count_if(st == "converted").alias("converted"),
        F.count_if(st == "lost").alias("lost"), F.count_if(st == "trial_booked").alias("trial_booked"))
    mrr0 = F.coalesce(F.col("avg_mrr"), F.lit(0))
    return agg.join(avg_mrr(t), "box_id", "left").select(
        "box_id", "month_start", "total_leads", "converted", "lost", "trial_booked",
        X.pct_half_up("converted", "total_leads", 1).alias("conversion_rate_pct"),
        (F.col("converted") * mrr0).alias("won_revenue"), (F.col("lost") * mrr0).alias("lost_revenue_est"))


def lead_summary(t: Tables) -> DataFrame:
    """Status counts and conversion % over all leads, per box."""
    lead = t["leads"]
    st = F.col("status")
    agg = lead.groupBy("box_id").agg(
        F.count(F.lit(1)).alias("total_leads"), F.count_if(st == "converted").alias("converted"),
        F.count_if(st == "lost").alias("lost"), F.count_if(st == "trial_booked").alias("trial_booked"),
        F.count_if(st == "in_progress").alias("in_progress"), F.count_if(st == "new").alias("new"))
    return agg.select("*", X.pct_half_up("converted", "total_leads", 1).alias("conversion_rate_pct"))
