"""DuckDB twin of ``sources.feeds``: the raw report feeds as SQL CTEs."""

from __future__ import annotations

from studiolake.plans.oracle_base import AS_OF

_PLAN = """CASE o_orderpriority
      WHEN '1-URGENT' THEN 'ללא הגבלה' WHEN '2-HIGH' THEN '8 כניסות חודשיות' WHEN '3-MEDIUM' THEN '5 כניסות בשבוע'
      WHEN '4-NOT SPECIFIED' THEN 'Monthly Unlimited' WHEN '5-LOW' THEN 'Annual Plan' END"""


def _ds(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


FEED_CTES = f"""
fd_active AS (
  SELECT box_id, c_custkey AS user_id, c_custkey AS feed_pos FROM cust_box WHERE c_custkey % 5 <> 0
),
fd_props AS (
  SELECT box_id, CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE c_custkey END AS user_id,
         CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE c_name END AS name,
         CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 'c' || c_custkey || '@example.test' END AS email,
         '05' || (c_custkey % 10) || '-' || lpad(CAST(c_custkey * 7919 % 10000000 AS VARCHAR), 7, '0') AS phone,
         c_custkey % 46 = 0 AS name_absent, c_custkey AS feed_pos
  FROM cust_box
),
fd_memberships AS (
  SELECT box_id, o_custkey AS user_id,
         CASE o_orderkey % 7 WHEN 0 THEN 'Active' WHEN 1 THEN 'on_hold' WHEN 2 THEN 'cancel' WHEN 3 THEN 'Cancelled'
              WHEN 4 THEN 'expired' WHEN 5 THEN 'EXPIRED' END AS status,
         o_orderkey AS membership_user_id, {_PLAN} AS membership_type_name,
         CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS price,
         CASE WHEN o_orderkey % 31 = 0 THEN '0000-00-00' WHEN o_orderkey % 37 = 0 THEN ''
              ELSE {_ds(f"{AS_OF} - CAST(o_orderkey * 13 % 800 AS INTEGER)")} END AS start_date,
         CASE WHEN o_orderkey % 43 = 0 THEN '-0001-11-30' WHEN o_orderkey % 29 = 0 THEN NULL
              ELSE {_ds(f"{AS_OF} - CAST(o_orderkey * 13 % 800 AS INTEGER) + CAST(30 + o_orderkey % 24 * 30 AS INTEGER)")}
                   || 'T00:00:00' END AS end_date,
         CASE WHEN o_orderkey % 31 = 0 THEN '0000-00-00 00:00:00'
              ELSE {_ds(f"{AS_OF} - CAST(o_orderkey * 13 % 800 AS INTEGER)")} || ' 10:30:00' END AS purchase_date,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN ''
              ELSE {_ds(f"{AS_OF} - CAST(o_custkey * 7 % 900 + o_orderkey % 5 AS INTEGER)")} END AS member_since,
         o_orderkey % 82 = 0 AS price_absent, o_orderkey AS feed_pos
  FROM ob
),
fd_li AS (
  SELECT l.*, o.o_custkey, o.o_totalprice, o.o_orderpriority, o.box_id,
         (l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS feed_pos
  FROM lineitem l JOIN ob o ON l.l_orderkey = o.o_orderkey
),
fd_sales AS (
  SELECT box_id, o_custkey AS user_id, l_orderkey AS sale_id, price,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE paid END AS paid,
         CASE WHEN l_returnflag = 'R' THEN price - paid ELSE 0.0 END AS debt,
         CASE WHEN l_linenumber = 6 THEN '0000-00-00'
              ELSE {_ds(f"{AS_OF} - CAST(l_orderkey % 400 AS INTEGER)")} END AS date,
         feed_pos
  FROM (SELECT *, CAST(floor(l_extendedprice / 100) AS DOUBLE) AS price,
               CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice / 100) AS DOUBLE)
                    ELSE CAST(floor(floor(l_extendedprice / 100) / 2) AS DOUBLE) END AS paid FROM fd_li)
),
fd_classes AS (
  SELECT box_id, CASE WHEN id % 101 = 0 THEN NULL ELSE id END AS schedule_id,
         {_ds("CAST(scheduled_at AS DATE)")} AS date,
         CASE WHEN id % 7 = 0 THEN NULL ELSE strftime(scheduled_at, '%H:%M') END AS start_time,
         CASE WHEN coach IS NULL THEN '' ELSE ' ' || coach || ' ' END AS staff_member,
         CASE WHEN id % 5 = 0 THEN NULL ELSE name END AS class_name,
         CASE WHEN id % 10 = 0 THEN 'Series ' || (id % 3) END AS series_name,
         CASE WHEN id % 11 = 0 THEN NULL ELSE max_capacity END AS max_participants,
         id AS feed_pos
  FROM classes
),
fd_bookings AS (
  SELECT box_id, CASE WHEN l_orderkey % 59 = 0 THEN NULL ELSE o_custkey END AS user_id,
         CASE WHEN l_linenumber = 7 THEN 'coach' WHEN l_linenumber = 6 THEN '' WHEN l_linenumber = 5 THEN NULL
              ELSE 'client' END AS user_role, l_linenumber = 5 AND l_orderkey % 2 = 0 AS role_absent,
         'Class ' || (l_partkey % 3) AS class_name, CAST(NULL AS VARCHAR) AS space_name,
         CASE WHEN l_partkey % 3 = 2 AND l_suppkey % 3 = 2 THEN '  '
              ELSE 'Coach ' || ((l_partkey % 3 + l_suppkey % 3) % 3) || ' ' END AS staff_member,
         CASE WHEN l_linenumber = 4 AND l_orderkey % 3 = 0 THEN '0000-00-00'
              ELSE {_ds(f"{AS_OF} - CAST((l_orderkey * 31 + l_linenumber * 17) % 364 AS INTEGER)")} END AS date,
         lpad(CAST(6 + l_suppkey % 3 * 6 AS VARCHAR), 2, '0') || ':00' AS time,
         CASE WHEN l_returnflag <> 'R' AND o_custkey % 8 <> 0 THEN 'Yes' ELSE 'no' END AS check_in,
         CASE WHEN l_linenumber = 1 THEN 'YES' ELSE 'No' END AS is_first_session,
         CAST(NULL AS VARCHAR) AS membership_type_name,
         CASE l_partkey % 4 WHEN 0 THEN '5' WHEN 1 THEN '' WHEN 2 THEN 'n/a' WHEN 3 THEN '12' END AS sessions_left,
         feed_pos
  FROM fd_li
),
fd_leads AS (
  SELECT CAST(user_id % 5 AS INTEGER) AS box_id, CASE WHEN event_id % 211 = 0 THEN NULL ELSE event_id END AS user_id,
         CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'F' || user_id END AS first_name,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'L' || event_id END AS last_name,
         'l' || event_id || '@example.test' AS email,
         CASE WHEN event_id % 13 = 0 THEN NULL
              ELSE '+972 5' || ((CASE WHEN event_id % 3 = 0 THEN event_id ELSE user_id END) % 10) || '-'
                   || lpad(CAST((CASE WHEN event_id % 3 = 0 THEN event_id ELSE user_id END) * 7919 % 10000000 AS VARCHAR),
                           7, '0') END AS phone,
         CASE event_type WHEN 'signup' THEN 'Converted - member' WHEN 'purchase' THEN 'ניסיון נקבע'
              WHEN 'click' THEN 'Follow up' WHEN 'view' THEN 'New lead' WHEN 'error' THEN 'Lost' END AS lead_status,
         CASE event_id % 5 WHEN 0 THEN 'Facebook' WHEN 1 THEN 'Instagram' WHEN 2 THEN 'Google'
              WHEN 3 THEN 'Referral' END AS lead_source,
         strftime(CAST(ts AS DATE) - CAST(event_id % 400 AS INTEGER), '%Y-%m-%d %H:%M:%S') AS created_time,
         event_id AS feed_pos
  FROM events
),
fd_later_leads AS (SELECT * FROM fd_leads WHERE feed_pos % 4 <> 0),
fd_holds AS (
  SELECT box_id,
         CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 AND l_orderkey % 5 = 0 THEN 0
              ELSE l_orderkey END AS membership_hold_id,
         o_custkey AS user_id, l_orderkey AS membership_user_id, {_PLAN} AS membership_type_name,
         {_ds("st")} || ' 00:00:00' AS start_suspend_time,
         CASE WHEN l_orderkey % 53 = 0 THEN '0000-00-00 00:00:00'
              ELSE {_ds("st + CAST(7 + l_partkey % 60 AS INTEGER)")} || ' 00:00:00' END AS end_suspend_time,
         CAST(7 + l_partkey % 60 AS INTEGER) AS total_days,
         CASE l_suppkey % 4 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Injury' WHEN 2 THEN 'Army reserve' END AS suspend_reason,
         CASE l_partkey % 4 WHEN 0 THEN 'taskNone' WHEN 1 THEN 'taskToday' WHEN 2 THEN 'taskFuture'
              WHEN 3 THEN 'taskPast' END AS task_status,
         CASE WHEN l_orderkey % 41 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 1000) AS DOUBLE) END AS price,
         l_orderkey % 82 = 0 AS price_absent, feed_pos
  FROM (SELECT *, {AS_OF} - CAST(l_orderkey * 11 % 397 AS INTEGER) + CAST(10 + l_linenumber AS INTEGER) AS st
        FROM fd_li)
)"""
