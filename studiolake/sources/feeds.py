"""Raw report feeds (API-shaped rows) derived from the driver tables.

The ingest operators (``operators.ingest``) turn these into canonical tables.
Values arrive as the reports deliver them: dates as text (with junk such as
``0000-00-00``, ``-0001-11-30`` and empty strings), yes/no flags as text,
free-text statuses, duplicate keys across overlapping monthly chunks.  Each
feed row carries ``box_id`` (the tenant it was landed for) and ``feed_pos``
(its position in the feed: any orderable value, here a number or a struct of
the source key); ``absent`` names the fields that a row does not have at all,
where other nulls are explicit.

Fixed values of the mapping are listed together below; the SQL twin lives in
``plans.oracle_feeds``.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.sources import adapter as AD

# ---------------------------------------------------------------------------
# Fixed values of the feed mapping
# ---------------------------------------------------------------------------
MEMBERSHIP_STATUS_TEXT = ["Active", "on_hold", "cancel", "Cancelled", "expired", "EXPIRED", None]  # by key % 7
LEAD_STATUS_TEXT = [("signup", "Converted - member"), ("purchase", "ניסיון נקבע"), ("click", "Follow up"),
                    ("view", "New lead"), ("error", "Lost")]
SESSIONS_LEFT_TEXT = ["5", "", "n/a", "12"]                                                      # by partkey % 4
HOLD_REASONS = ["Travel", "Injury", "Army reserve", None]                                        # by suppkey % 4
TASK_STATUS = ["taskNone", "taskToday", "taskFuture", "taskPast"]                               # by partkey % 4
# ---------------------------------------------------------------------------

A = AD.AS_OF


def _ds(d) -> F.Column:
    return F.date_format(d, "yyyy-MM-dd")


def _pick(k, values):
    m = F.pmod(k, F.lit(len(values)))
    out = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        if v is not None:
            out = F.when(m == i, F.lit(v)).otherwise(out)
    return out


def _absent(rows, field: str) -> F.Column:
    """``absent`` of a feed row: the fields that the report's row does not have (their column is null)."""
    return F.when(rows, F.array(F.lit(field))).alias("absent")


def _cust_box(raw):
    c, n = raw["customer"], raw["nation"]
    return c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey) \
            .select("c_custkey", "c_name", F.col("n_regionkey").alias("box_id"))


def active_members_feed(raw) -> DataFrame:
    cb = _cust_box(raw).filter(F.col("c_custkey") % 5 != 0)
    return cb.select("box_id", F.col("c_custkey").alias("user_id"), F.col("c_custkey").alias("feed_pos"))


def member_props_feed(raw) -> DataFrame:
    k = F.col("c_custkey")
    cb = _cust_box(raw)
    return cb.select(
        "box_id", F.when(k % 97 == 0, F.lit(None).cast("bigint")).otherwise(k).alias("user_id"),
        F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(F.col("c_name")).alias("name"),
        F.when(k % 11 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.test"))).alias("email"),
        AD._phone("05", k).alias("phone"), _absent(k % 46 == 0, "name"), k.alias("feed_pos"))


def memberships_feed(raw) -> DataFrame:
    o = AD._orders_with_box(raw)
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    start = F.date_sub(F.lit(A), (k * 13 % 800).cast("int"))
    end = F.date_add(start, (30 + k % 24 * 30).cast("int"))
    since = F.date_sub(F.lit(A), (c * 7 % 900 + k % 5).cast("int"))
    return o.select(
        "box_id", c.alias("user_id"), _pick(k, MEMBERSHIP_STATUS_TEXT).alias("status"),
        k.alias("membership_user_id"),
        AD._case(F.col("o_orderpriority"), AD.PLAN_BY_PRIORITY).cast("string").alias("membership_type_name"),
        F.when(k % 41 == 0, F.lit(None).cast("double")).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
         .alias("price"),
        F.when(k % 31 == 0, F.lit("0000-00-00")).when(k % 37 == 0, F.lit("")).otherwise(_ds(start)).alias("start_date"),
        F.when(k % 43 == 0, F.lit("-0001-11-30")).when(k % 29 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(_ds(end), F.lit("T00:00:00"))).alias("end_date"),
        F.when(k % 31 == 0, F.lit("0000-00-00 00:00:00"))
         .otherwise(F.concat(_ds(start), F.lit(" 10:30:00"))).alias("purchase_date"),
        F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, F.lit("")).otherwise(_ds(since))
         .alias("member_since"),
        _absent(k % 82 == 0, "price"), k.alias("feed_pos"))


def _lineitem_orders(raw) -> DataFrame:
    o = AD._orders_with_box(raw).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "box_id")
    li = raw["lineitem"]
    return li.join(o, li.l_orderkey == o.o_orderkey)


def _li_pos() -> F.Column:
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def sales_feed(raw) -> DataFrame:
    j = _lineitem_orders(raw)
    price = F.floor(F.col("l_extendedprice") / 100).cast("double")
    paid = F.when(F.col("l_linestatus") == "F", price).otherwise(F.floor(price / 2).cast("double"))
    return j.select(
        "box_id", F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("sale_id"), price.alias("price"),
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(paid).alias("paid"),
        F.when(F.col("l_returnflag") == "R", price - paid).otherwise(F.lit(0.0)).alias("debt"),
        F.when(F.col("l_linenumber") == 6, F.lit("0000-00-00"))
         .otherwise(_ds(F.date_sub(F.lit(A), (F.col("l_orderkey") % 400).cast("int")))).alias("date"),
        _li_pos().alias("feed_pos"))


def classes_feed(canon_classes: DataFrame) -> DataFrame:
    c = canon_classes
    k = F.col("id")
    return c.select(
        "box_id", F.when(k % 101 == 0, F.lit(None).cast("bigint")).otherwise(k).alias("schedule_id"),
        _ds(F.col("scheduled_at").cast("date")).alias("date"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.date_format("scheduled_at", "HH:mm"))
         .alias("start_time"),
        F.when(F.col("coach").isNull(), F.lit("")).otherwise(F.concat(F.lit(" "), F.col("coach"), F.lit(" ")))
         .alias("staff_member"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(F.col("name")).alias("class_name"),
        F.when(k % 10 == 0, F.concat(F.lit("Series "), (k % 3).cast("string"))).alias("series_name"),
        F.when(k % 11 == 0, F.lit(None).cast("int")).otherwise(F.col("max_capacity")).alias("max_participants"),
        k.alias("feed_pos"))


def bookings_feed(raw) -> DataFrame:
    j = _lineitem_orders(raw)
    ln, ok = F.col("l_linenumber"), F.col("l_orderkey")
    pk, sk = F.pmod(F.col("l_partkey"), F.lit(3)), F.pmod(F.col("l_suppkey"), F.lit(3))
    bdate = F.date_sub(F.lit(A), ((ok * 31 + ln * 17) % 364).cast("int"))
    return j.select(
        "box_id", F.when(ok % 59 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("user_id"),
        F.when(ln == 7, F.lit("coach")).when(ln == 6, F.lit("")).when(ln == 5, F.lit(None).cast("string"))
         .otherwise(F.lit("client")).alias("user_role"),
        F.concat(F.lit("Class "), pk.cast("string")).alias("class_name"),
        F.lit(None).cast("string").alias("space_name"),
        F.when((pk == 2) & (sk == 2), F.lit("  "))
         .otherwise(F.concat(F.lit("Coach "), F.pmod(pk + sk, F.lit(3)).cast("string"), F.lit(" "))).alias("staff_member"),
        F.when((ln == 4) & (ok % 3 == 0), F.lit("0000-00-00")).otherwise(_ds(bdate)).alias("date"),
        F.concat(F.lpad((6 + sk * 6).cast("string"), 2, "0"), F.lit(":00")).alias("time"),
        F.when((F.col("l_returnflag") != "R") & (F.col("o_custkey") % 8 != 0), F.lit("Yes")).otherwise(F.lit("no")).alias("check_in"),
        F.when(ln == 1, F.lit("YES")).otherwise(F.lit("No")).alias("is_first_session"),
        F.lit(None).cast("string").alias("membership_type_name"),
        _pick(F.col("l_partkey"), SESSIONS_LEFT_TEXT).alias("sessions_left"),
        _absent((ln == 5) & (ok % 2 == 0), "user_role"), _li_pos().alias("feed_pos"))


def leads_feed(raw) -> DataFrame:
    e = raw["events"]
    eid, uid = F.col("event_id"), F.col("user_id")
    pk = F.when(eid % 3 == 0, eid).otherwise(uid)
    return e.select(
        F.pmod(uid, F.lit(5)).cast("int").alias("box_id"),
        F.when(eid % 211 == 0, F.lit(None).cast("bigint")).otherwise(eid).alias("user_id"),
        F.when(eid % 19 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("F"), uid.cast("string")))
         .alias("first_name"),
        F.when(eid % 17 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("L"), eid.cast("string")))
         .alias("last_name"),
        F.concat(F.lit("l"), eid.cast("string"), F.lit("@example.test")).alias("email"),
        F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(AD._phone("+972 5", pk)).alias("phone"),
        AD._case(F.col("event_type"), LEAD_STATUS_TEXT).cast("string").alias("lead_status"),
        AD._by_mod(eid, AD.LEAD_SOURCES).alias("lead_source"),
        F.date_format(F.date_sub(F.col("ts").cast("date"), (eid % 400).cast("int")), "yyyy-MM-dd HH:mm:ss")
         .alias("created_time"),
        eid.alias("feed_pos"))


def later_leads_feed(leads: DataFrame) -> DataFrame:
    """The feed of a later day, in which one lead in four is gone: the input of
    the vanished-leads step, where absence is the feature."""
    return leads.filter(F.col("feed_pos") % 4 != 0)


def holds_feed(raw) -> DataFrame:
    j = _lineitem_orders(raw)
    ok, ln = F.col("l_orderkey"), F.col("l_linenumber")
    start = F.date_add(F.date_sub(F.lit(A), (ok * 11 % 397).cast("int")), (10 + ln).cast("int"))
    days = (7 + F.col("l_partkey") % 60).cast("int")
    return j.select(
        "box_id",
        F.when(ln == 7, F.lit(None).cast("bigint")).when((ln == 6) & (ok % 5 == 0), F.lit(0).cast("bigint"))
         .otherwise(ok).alias("membership_hold_id"),
        F.col("o_custkey").alias("user_id"), ok.alias("membership_user_id"),
        AD._case(F.col("o_orderpriority"), AD.PLAN_BY_PRIORITY).cast("string").alias("membership_type_name"),
        F.concat(_ds(start), F.lit(" 00:00:00")).alias("start_suspend_time"),
        F.when(ok % 53 == 0, F.lit("0000-00-00 00:00:00"))
         .otherwise(F.concat(_ds(F.date_add(start, days)), F.lit(" 00:00:00"))).alias("end_suspend_time"),
        days.alias("total_days"), _pick(F.col("l_suppkey"), HOLD_REASONS).alias("suspend_reason"),
        _pick(F.col("l_partkey"), TASK_STATUS).alias("task_status"),
        F.when(ok % 41 == 0, F.lit(None).cast("double")).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
         .alias("price"),
        _absent(ok % 82 == 0, "price"), _li_pos().alias("feed_pos"))


def all_feeds(raw) -> dict[str, DataFrame]:
    bk = AD.bookings(raw)
    leads = leads_feed(raw)
    return {
        "active_members": active_members_feed(raw), "member_props": member_props_feed(raw),
        "memberships": memberships_feed(raw), "sales": sales_feed(raw), "classes": classes_feed(AD.classes(bk)),
        "bookings": bookings_feed(raw), "leads": leads, "later_leads": later_leads_feed(leads),
        "holds": holds_feed(raw),
    }

