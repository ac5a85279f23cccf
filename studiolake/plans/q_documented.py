"""Registered queries: prose-specified KPIs (L1-L12) and generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from studiolake.operators import datagen as G
from studiolake.operators import documented as L
from studiolake.plans.oracle_base import AS_OF, hu, pct
from studiolake.plans.q_classes import USAGE
from studiolake.plans.q_money import LEDGER
from studiolake.plans.registry import Entry
from studiolake.sources.adapter import AS_OF as D

DOC_CTES = f"""
l_dim_members AS (
  SELECT id AS member_id,
         arg_max(box_id, (created_at, source_member_id)) AS box_id,
         arg_max(name, (created_at, source_member_id)) AS full_name,
         arg_max(email, (created_at, source_member_id)) AS email,
         arg_max(phone, (created_at, source_member_id)) AS phone,
         arg_max(join_date, (created_at, source_member_id)) AS join_date,
         arg_max(status, (created_at, source_member_id)) = 'active' AS is_active
  FROM members GROUP BY id
),
l_dim_subs AS (
  SELECT id, box_id, member_id, plan_type AS plan_name, start_date, end_date, price, status,
         CAST(end_date - start_date AS BIGINT) AS duration_days,
         (end_date >= {AS_OF} AND status = 'active') AS is_current
  FROM memberships
),
l_fct_att AS (
  SELECT a.id, a.box_id, a.member_id, a.class_id, CAST(a.attended_at AS DATE) AS class_date, c.name AS class_type,
         m.full_name
  FROM attendance a LEFT JOIN classes c ON a.class_id = c.id LEFT JOIN l_dim_members m ON a.member_id = m.member_id
)"""


def _sql_functions(t):
    """A3: the same rules through the SQL surface (temp views + SQL functions)."""
    from studiolake.plans.sql_api import register_functions, register_views
    spark = t["members"].sparkSession
    register_functions(spark)
    register_views(t, D)
    return spark.sql("""SELECT member_id, sl_phone_key(phone) AS phone_key, sl_intl_phone(phone) AS intl_phone,
                               sl_week_start(join_date) AS week_start, sl_dow0(join_date) AS dow0,
                               sl_pct_half_up(member_id % 7, 7) AS renewal_pct
                        FROM stg_members""")


def _top(src: str, cols: str, order: str, k: int) -> str:
    return (f"SELECT {cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY {order}) AS rank "
            f"FROM {src}) WHERE rank <= {k}")


def _e(name, build, spec, sql):
    return Entry(name, build, spec, sql, (LEDGER, USAGE, DOC_CTES))


ENTRIES = [
    _e("dim_members", L.dim_members, "member_id:l, box_id:l, full_name:s, email:s, phone:s, join_date:t, is_active:b",
       "SELECT * FROM l_dim_members"),
    _e("dim_subscriptions", lambda t: L.dim_subscriptions(t, D),
       "id:l, box_id:l, member_id:l, plan_name:s, start_date:t, end_date:t, price:d, status:s, duration_days:l, "
       "is_current:b", "SELECT * FROM l_dim_subs"),
    _e("fct_attendance", L.fct_attendance,
       "id:s, box_id:l, member_id:l, class_id:l, class_date:t, class_type:s, full_name:s", "SELECT * FROM l_fct_att"),
    _e("kpi_active_members", lambda t: L.kpi_active_members(t, D),
       "box_id:l, plan_name:s, active_members:l, snapshot_date:t",
       f"SELECT box_id, plan_name, count(DISTINCT member_id) AS active_members, {AS_OF} AS snapshot_date "
       f"FROM l_dim_subs WHERE is_current = true GROUP BY box_id, plan_name"),
    _e("kpi_revenue_monthly", lambda t: L.kpi_revenue_monthly(t, D),
       "box_id:l, month:t, total_revenue:d, paying_members:l",
       "SELECT box_id, CAST(date_trunc('month', start_date) AS DATE) AS month, sum(price) AS total_revenue, "
       "count(DISTINCT member_id) AS paying_members FROM l_dim_subs WHERE status = 'active' GROUP BY ALL"),
    _e("kpi_churn", lambda t: L.kpi_churn(t, D), "box_id:l, month:t, churned_members:l",
       "SELECT box_id, CAST(date_trunc('month', end_date) AS DATE) AS month, count(DISTINCT member_id) "
       "AS churned_members FROM l_dim_subs WHERE status = 'cancelled' AND end_date IS NOT NULL GROUP BY ALL"),
    _e("kpi_attendance_weekly", L.kpi_attendance_weekly, "box_id:l, week_start:t, total_checkins:l, unique_members:l",
       "SELECT box_id, CAST(date_trunc('week', class_date) AS DATE) AS week_start, count(*) AS total_checkins, "
       "count(DISTINCT member_id) AS unique_members FROM l_fct_att GROUP BY ALL"),
    _e("top_overdue", lambda t: L.top_overdue(t, 10),
       "box_id:l, member_id:l, member_name:s, member_email:s, member_phone:s, overdue_amount:d, overdue_since:t, "
       "rank:l",
       _top("mo_overdue", "box_id, member_id, member_name, member_email, member_phone, overdue_amount, overdue_since",
            "overdue_amount DESC, member_id", 10)),
    _e("top_newest", lambda t: L.top_newest(t, 10), "box_id:l, member_id:l, name:s, join_date:t, rank:l",
       _top("(SELECT * FROM stg_members WHERE join_date IS NOT NULL)", "box_id, member_id, name, join_date",
            "join_date DESC, member_id DESC", 10)),
    _e("top_coaches", lambda t: L.top_coaches(t, 5), "box_id:l, coach:s, total_checkins:l, rank:l",
       _top("(SELECT box_id, label AS coach, total_checkins FROM us_coaches)", "box_id, coach, total_checkins",
            "total_checkins DESC, coach", 5)),
    _e("top_active", lambda t: L.top_active(t, D, 10), "box_id:l, member_id:l, name:s, total_checkins_90d:l, rank:l",
       _top("activity", "box_id, member_id, name, total_checkins_90d", "total_checkins_90d DESC, member_id", 10)),
    _e("popular_class", L.popular_class, "box_id:l, class_name:s, checkins:l",
       "SELECT box_id, arg_min(label, (-total_checkins, label)) AS class_name, max(total_checkins) AS checkins "
       "FROM us_kinds GROUP BY box_id"),
    _e("busiest_day", L.busiest_day, "box_id:l, day_of_week:l, checkins:l",
       "SELECT box_id, arg_min(day_of_week, (-checkins, day_of_week)) AS day_of_week, max(checkins) AS checkins "
       "FROM (SELECT box_id, day_of_week, count(*) AS checkins FROM stg_bookings WHERE checked_in GROUP BY ALL) "
       "GROUP BY box_id"),
    _e("payment_split", L.payment_split, "box_id:l, status:s, amount:d, payments:l",
       "SELECT box_id, status, sum(amount) AS amount, count(*) AS payments FROM payments GROUP BY ALL"),
    _e("avg_revenue_per_member", lambda t: L.avg_revenue_per_member(t, D),
       "box_id:l, mrr:d, active_members:l, avg_revenue_per_member:d",
       f"SELECT g.box_id, g.mrr, a.n AS active_members, ({hu('g.mrr * 100', 'a.n')}) / 100.0 AS avg_revenue_per_member "
       f"FROM mo_mrr g LEFT JOIN (SELECT box_id, count(*) AS n FROM members WHERE status = 'active' GROUP BY box_id) a "
       f"ON g.box_id = a.box_id"),
    _e("churn_rate", lambda t: L.churn_rate(t, D),
       "box_id:l, churned_this_month:l, active_members:l, churn_rate_pct:d",
       f"""SELECT box_id, c AS churned_this_month, a AS active_members, {pct('c', 'a + c', 1)} AS churn_rate_pct FROM (
             SELECT box_id,
               count(DISTINCT CASE WHEN status = 'cancelled' AND end_date >= date_trunc('month', {AS_OF})
                                    AND end_date < date_trunc('month', {AS_OF}) + INTERVAL 1 MONTH
                              THEN member_id END) AS c,
               count(DISTINCT CASE WHEN status = 'active' THEN member_id END) AS a
             FROM memberships GROUP BY box_id)"""),
    _e("checkins_by_dow", L.checkins_by_dow, "box_id:l, day_of_week:l, checkins:l",
       "SELECT box_id, day_of_week, count(*) AS checkins FROM stg_bookings WHERE checked_in GROUP BY ALL"),
    _e("avg_attendance", L.avg_attendance, "box_id:l, sessions:l, checkins:l, avg_attendance:d",
       f"SELECT box_id, count(*) AS sessions, sum(checkins) AS checkins, "
       f"({hu('sum(checkins) * 10', 'count(*)')}) / 10.0 AS avg_attendance FROM us_rates GROUP BY box_id"),
    _e("sql_functions", _sql_functions,
       "member_id:l, phone_key:s, intl_phone:s, week_start:t, dow0:l, renewal_pct:d",
       """SELECT id AS member_id,
                 CASE WHEN regexp_replace(phone, '[^0-9]', '', 'g') = '' THEN NULL
                      ELSE right(regexp_replace(phone, '[^0-9]', '', 'g'), 9) END AS phone_key,
                 '972' || regexp_replace(regexp_replace(phone, '^0', ''), '[-\\s]', '', 'g') AS intl_phone,
                 CAST(date_trunc('week', join_date) AS DATE) AS week_start, dayofweek(join_date) AS dow0,
                 CAST((id % 7 * 2000 + 7) // 14 AS DOUBLE) / 10.0 AS renewal_pct
          FROM members"""),
    _e("gen_classes", G.gen_classes, "box_id:l, name:s, coach:s, scheduled_at:ts, max_capacity:l",
       """SELECT s.box_id, tp.name, tp.coach, CAST(d.class_date AS TIMESTAMP) + tp.hour * INTERVAL 1 HOUR AS scheduled_at,
                 20 AS max_capacity
          FROM (SELECT box_id, min(booked_date) AS d0, max(booked_date) AS d1 FROM stg_bookings GROUP BY box_id) s,
               LATERAL (SELECT CAST(unnest(generate_series(CAST(s.d0 AS TIMESTAMP), CAST(s.d1 AS TIMESTAMP),
                                                           INTERVAL 1 DAY)) AS DATE) AS class_date) d,
               (VALUES ('Dawn lift', 'Coach one', 6), ('Early row', 'Coach one', 7), ('Noon mobility', 'Coach two', 12),
                       ('Evening lift', 'Coach one', 18), ('Late row', 'Coach two', 19)) tp(name, coach, hour)
          WHERE dayofweek(d.class_date) BETWEEN 0 AND 5"""),
    _e("sequential_ids", lambda t: G.sequential_ids(t["payments"].select("id", "box_id", "payment_date"),
                                                    [F.col("payment_date"), F.col("id")]),
       "id:l, box_id:l, payment_date:t, seq_id:l",
       "SELECT id, box_id, payment_date, row_number() OVER (ORDER BY payment_date, id) AS seq_id FROM payments"),
]
