"""Registered queries: sales funnel.

Nested lists are compared as delimited strings built the same way on both
sides: ``name=count`` items joined by ``;`` in list order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from studiolake.operators import leads as L
from studiolake.plans.oracle_base import AS_OF_LEADS, hu, pct
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF_LEADS as DL

# Leads are counted once into cells of (window, status, age class, reason, source); every report sums cells.
FUNNEL = f"""
ld_ticket AS (
  SELECT box_id, {hu('sum(cents)', 'count(*) * 100')} AS avg_mrr
  FROM (SELECT box_id, CAST(price * 100 AS HUGEINT) AS cents FROM memberships WHERE status = 'active') WHERE cents > 0 GROUP BY ALL
),
ld_windows AS (
  SELECT ifnull('last_' || span || 'd', 'all_time') AS record_type, ifnull({AS_OF_LEADS} - span, DATE '2000-01-01') AS since_date
  FROM (SELECT unnest([30, 60, 90, NULL]) AS span)
),
ld_seen AS (SELECT * FROM stg_leads JOIN ld_windows ON since_date <= CAST(created_at AS DATE)),
ld_cells AS (
  SELECT box_id, record_type, status, lost_reason, source, days_in_pipeline AS age, count(*) AS n FROM ld_seen GROUP BY ALL
),
ld_counts AS (
  SELECT box_id, record_type, sum(n) AS total_leads,
         {', '.join(f"sum(if(status = '{s}', n, 0)) AS {c}" for s, c in (('new', 'new_leads'), ('in_progress', 'in_progress'), ('trial_booked', 'trial_booked'), ('converted', 'converted'), ('lost', 'lost')))},
         sum(if(status = 'converted', n * age, NULL)) AS days, sum(if(status = 'converted' AND age IS NOT NULL, n, NULL)) AS dated,
         {', '.join(f"sum(if(status = 'converted' AND age BETWEEN {lo} AND {hi}, n, 0)) AS {c}" for c, lo, hi in (('b_same_day', 0, 0), ('b_1_3d', 1, 3), ('b_4_7d', 4, 7), ('b_8_30d', 8, 30), ('b_30plus', 31, 10 ** 6)))}
  FROM ld_cells GROUP BY ALL
),
ld_funnel AS (
  SELECT *, {pct('converted', 'total_leads - new_leads', 1)} AS conversion_rate_pct, {hu('days', 'dated')} AS avg_days_to_convert,
         trial_booked * ifnull(avg_mrr, 0) AS pipeline_value, converted * ifnull(avg_mrr, 0) AS won_revenue, lost * ifnull(avg_mrr, 0) AS lost_revenue_est
  FROM ld_counts LEFT JOIN ld_ticket USING (box_id)
),
ld_reasons AS (SELECT box_id, record_type, lost_reason AS label, sum(n) AS n FROM ld_cells WHERE lost_reason IS NOT NULL GROUP BY ALL),
ld_origins AS (
  SELECT box_id, record_type, ifnull(source, 'null') AS label, sum(n) AS n, sum(if(status = 'converted', n, 0)) AS won FROM ld_cells GROUP BY box_id, record_type, source
),
ld_lost AS (
  SELECT box_id, record_type, array_to_string(list(label || '=' || n ORDER BY n DESC, label), ';') AS lost_reasons FROM ld_reasons GROUP BY ALL
),
ld_sources AS (
  SELECT box_id, record_type, array_to_string(list(label || '=' || n || '/' || won ORDER BY n DESC, label), ';') AS source_breakdown FROM ld_origins GROUP BY ALL
),
ld_trials AS (
  SELECT box_id, full_name AS name, phone, trial_date, source, lead_id FROM stg_leads
  WHERE status = 'trial_booked' AND trial_date - {AS_OF_LEADS} BETWEEN 0 AND 7
),
ld_days AS (
  SELECT box_id, CAST(created_at AS DATE) AS day, created_at, if(status = 'converted', 1, 0) AS won, if(status = 'lost', 1, 0) AS gone, if(status = 'trial_booked', 1, 0) AS tried
  FROM stg_leads
)"""

FUNNEL_SPEC = ("box_id:l, record_type:s, total_leads:l, new_leads:l, in_progress:l, trial_booked:l, converted:l, "
               "lost:l, conversion_rate_pct:d, avg_days_to_convert:l, avg_mrr:d, pipeline_value:d, won_revenue:d, "
               "lost_revenue_est:d, b_same_day:l, b_1_3d:l, b_4_7d:l, b_8_30d:l, b_30plus:l")


def _flat_funnel(df):
    b = F.col("convert_time_buckets")
    return df.select("*", b["same_day"].alias("b_same_day"), b["1_3d"].alias("b_1_3d"), b["4_7d"].alias("b_4_7d"),
                     b["8_30d"].alias("b_8_30d"), b["30plus"].alias("b_30plus"))


def _join_items(col, fmt):
    return F.array_join(F.transform(col, fmt), ";")


def _lost_str(df):
    return df.select("box_id", "record_type", _join_items(
        "lost_reasons", lambda x: F.concat(x["reason"], F.lit("="), x["count"].cast("string"))).alias("lost_reasons"))


def _src_str(df):
    return df.select("box_id", "record_type", _join_items(
        "source_breakdown", lambda x: F.concat(F.coalesce(x["source"], F.lit("null")), F.lit("="),
                                               x["total"].cast("string"), F.lit("/"),
                                               x["converted"].cast("string"))).alias("source_breakdown"))


def _mart(t):
    m = _flat_funnel(L.leads_mart(t, DL))
    lr = _join_items("lost_reasons", lambda x: F.concat(x["reason"], F.lit("="), x["count"].cast("string")))
    sb = _join_items("source_breakdown", lambda x: F.concat(
        F.coalesce(x["source"], F.lit("null")), F.lit("="), x["total"].cast("string"), F.lit("/"),
        x["converted"].cast("string")))
    return m.withColumn("lost_reasons", lr).withColumn("source_breakdown", sb)


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, (FUNNEL,))


ENTRIES = [
    _e("avg_mrr", L.avg_mrr, "box_id:l, avg_mrr:d", "SELECT * FROM ld_ticket"),
    _e("lead_periods", lambda t: L.lead_periods(t, DL),
       "lead_id:l, box_id:l, status:s, created_at:ts, days_in_pipeline:l, record_type:s, since_date:t",
       "SELECT * FROM ld_seen"),
    _e("lead_funnel", lambda t: _flat_funnel(L.lead_funnel(t, DL)), FUNNEL_SPEC, "SELECT * FROM ld_funnel"),
    _e("lost_reasons", lambda t: _lost_str(L.lost_reasons(t, DL)), "box_id:l, record_type:s, lost_reasons:s",
       "SELECT * FROM ld_lost"),
    _e("lead_sources", lambda t: _src_str(L.lead_sources(t, DL)), "box_id:l, record_type:s, source_breakdown:s",
       "SELECT * FROM ld_sources"),
    _e("upcoming_trials", lambda t: L.upcoming_trials(t, DL),
       "box_id:l, name:s, phone:s, trial_date:t, source:s, lead_id:l", "SELECT * FROM ld_trials"),
    _e("leads_mart", _mart,
       FUNNEL_SPEC + ", lost_reasons:s, source_breakdown:s, upcoming_trial_count:l",
       "SELECT * FROM ld_funnel LEFT JOIN ld_lost USING (box_id, record_type) LEFT JOIN ld_sources USING (box_id, record_type) "
       "LEFT JOIN (SELECT box_id, count(*) AS upcoming_trial_count FROM ld_trials GROUP BY ALL) USING (box_id)"),
    _e("leads_detail", lambda t: L.leads_detail(t, DL),
       "lead_id:l, box_id:l, full_name:s, first_name:s, last_name:s, phone:s, email:s, source:s, status:s, "
       "lost_reason:s, trial_date:t, created_at:ts, days_in_pipeline:l",
       "SELECT lead_id, box_id, full_name, first_name, last_name, phone, email, source, status, lost_reason, "
       "trial_date, created_at, days_in_pipeline FROM stg_leads"),
    _e("leads_weekly", lambda t: L.leads_weekly(t, DL),
       "box_id:l, week_start:t, total_leads:l, converted:l, conversion_rate_pct:d",
       f"SELECT box_id, day - CAST(isodow(day) - 1 AS INTEGER) AS week_start, count(*) AS total_leads, sum(won) AS converted, "
       f"{pct('sum(won)', 'count(*)', 1)} AS conversion_rate_pct FROM ld_days WHERE created_at >= {AS_OF_LEADS} - 84 GROUP BY ALL"),
    _e("leads_monthly", lambda t: L.leads_monthly(t, DL),
       "box_id:l, month_start:t, total_leads:l, converted:l, lost:l, trial_booked:l, conversion_rate_pct:d, "
       "won_revenue:d, lost_revenue_est:d",
       f"SELECT *, {pct('converted', 'total_leads', 1)} AS conversion_rate_pct, converted * ifnull(avg_mrr, 0) AS won_revenue, "
       f"lost * ifnull(avg_mrr, 0) AS lost_revenue_est FROM (SELECT box_id, make_date(year(day), month(day), 1) AS month_start, count(*) AS total_leads, "
       f"sum(won) AS converted, sum(gone) AS lost, sum(tried) AS trial_booked FROM ld_days WHERE created_at >= {AS_OF_LEADS} - INTERVAL 12 MONTH "
       f"GROUP BY ALL) LEFT JOIN ld_ticket USING (box_id)"),
    _e("lead_summary", L.lead_summary,
       "box_id:l, total_leads:l, converted:l, lost:l, trial_booked:l, in_progress:l, new:l, conversion_rate_pct:d",
       f"""SELECT box_id, count(*) AS total_leads, count(*) FILTER (WHERE status = 'converted') AS converted,
                  count(*) FILTER (WHERE status = 'lost') AS lost,
                  count(*) FILTER (WHERE status = 'trial_booked') AS trial_booked,
                  count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
                  count(*) FILTER (WHERE status = 'new') AS new,
                  {pct("count(*) FILTER (WHERE status = 'converted')", "count(*)", 1)} AS conversion_rate_pct
           FROM leads GROUP BY box_id"""),
]


def _ranked_sql(source: str, measures: list[str], k: int) -> str:
    """Every label ranked by window, and the sum of those beyond."""
    sums = ", ".join(f"sum({m}) AS {m}" for m in measures)
    return f"""
  WITH r AS (SELECT *, row_number() OVER (PARTITION BY box_id, record_type ORDER BY total DESC, label) AS place FROM {source})
  SELECT box_id, record_type, place AS rank, label, 1 AS n_labels, {", ".join(measures)} FROM r WHERE place <= {k}
  UNION ALL SELECT box_id, record_type, NULL, NULL, count(*), {sums} FROM r WHERE place > {k} GROUP BY box_id, record_type"""


ENTRIES += [
    _e("lost_reason_rows", lambda t: L.lost_reason_rows(t, DL, 2), "box_id:l, record_type:s, rank:l, label:s, n_labels:l, total:l",
       _ranked_sql("(SELECT box_id, record_type, label, n AS total FROM ld_reasons)", ["total"], 2)),
    _e("lead_source_rows", lambda t: L.lead_source_rows(t, DL, 3), "box_id:l, record_type:s, rank:l, label:s, n_labels:l, total:l, converted:l",
       _ranked_sql("(SELECT box_id, record_type, label, n AS total, won AS converted FROM ld_origins)", ["total", "converted"], 3)),
]
