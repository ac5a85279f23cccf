"""Driver test tables -> canonical tables.

The driver ships TPC-H-like parquet (customer, orders, lineitem, events, ...).
This adapter derives the canonical membership-business tables from them with
integer arithmetic and ``%`` only, so the DuckDB oracle (``plans.oracle``)
builds exactly the same rows.  Every rule is a row-local expression or an
equi join on a key; nothing is collected, sorted globally or numbered with a
global ``row_number``.

Fixed values of the mapping (plan names by order priority, sources, reasons)
are listed together below.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.functions import exprs as X

# ---------------------------------------------------------------------------
# Fixed values of the fixture mapping
# ---------------------------------------------------------------------------
AS_OF = dt.date(2001, 8, 1)          # "today" for members/memberships/payments/bookings/freezes
AS_OF_LEADS = dt.date(2024, 1, 31)   # "today" for leads
PLAN_BY_PRIORITY = [
    ("1-URGENT", "ללא הגבלה"),
    ("2-HIGH", "8 כניסות חודשיות"),
    ("3-MEDIUM", "5 כניסות בשבוע"),
    ("4-NOT SPECIFIED", "Monthly Unlimited"),
    ("5-LOW", "Annual Plan"),
]
MEMBERSHIP_STATUS_BY_ORDER_STATUS = [("O", "active"), ("F", "expired"), ("P", "cancelled")]
LEAD_STATUS_BY_EVENT = [("signup", "converted"), ("purchase", "trial_booked"),
                        ("click", "in_progress"), ("view", "new"), ("error", "lost")]
LEAD_SOURCES = ["Facebook", "Instagram", "Google", "Referral", None]   # by event_id % 5
LOST_REASONS = ["Price", "Schedule", "Location"]                       # by event_id % 3
FREEZE_REASONS = ["Travel", "Injury", "Other", None]                   # by o_orderkey % 4
# ---------------------------------------------------------------------------

DRIVER_TABLES = ["region", "nation", "customer", "orders", "lineitem", "events"]


def read_driver(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in DRIVER_TABLES}


def _case(c, pairs, default=None):
    out = F.lit(default)
    for k, v in reversed(pairs):
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def _by_mod(c, values):
    m = F.pmod(c, F.lit(len(values)))
    out = F.lit(None).cast("string")
    for i, v in reversed(list(enumerate(values))):
        if v is not None:
            out = F.when(m == i, F.lit(v)).otherwise(out)
    return out


def _phone(prefix: str, k):
    return F.concat(F.lit(prefix), F.pmod(k, F.lit(10)).cast("string"), F.lit("-"),
                    F.lpad(F.pmod(k * 7919, F.lit(10_000_000)).cast("string"), 7, "0"))


def _days_before(anchor: dt.date, k):
    return F.date_sub(F.lit(anchor), k.cast("int"))


def _ts(d):
    return d.cast("timestamp_ntz")


def _price(o):
    return F.floor(o["o_totalprice"] / 1000).cast("decimal(10,2)")


def boxes(raw: dict[str, DataFrame]) -> DataFrame:
    r = raw["region"]
    return r.select(
        r.r_regionkey.alias("id"), r.r_name.alias("name"),
        F.concat(F.lit("box"), r.r_regionkey.cast("string"), F.lit("@example.test")).alias("email"),
        F.concat(F.lit("tok-"), r.r_regionkey.cast("string")).alias("access_token"),
        r.r_regionkey.alias("source_box_id"),
        _ts(F.lit(AS_OF)).alias("created_at"))


def members(raw: dict[str, DataFrame]) -> DataFrame:
    c, n = raw["customer"], raw["nation"]
    k = F.col("c_custkey")
    return (c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey)
            .select(
                k.alias("id"),
                F.col("n_regionkey").alias("box_id"),
                k.alias("source_member_id"),
                F.col("c_name").alias("name"),
                F.when(k % 11 == 0, F.lit(None).cast("string"))
                 .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit("@example.test"))).alias("email"),
                _phone("05", k).alias("phone"),
                F.when(k % 5 == 0, F.lit("inactive")).otherwise(F.lit("active")).alias("status"),
                F.when(k % 37 == 0, F.lit(None).cast("date"))
                 .otherwise(_days_before(AS_OF, k * 7 % 900)).alias("join_date"),
                _ts(_days_before(AS_OF, k % 1000)).alias("created_at")))


def _orders_with_box(raw: dict[str, DataFrame]) -> DataFrame:
    """orders joined to the member's box (customer -> nation -> region key)."""
    c, n = raw["customer"], raw["nation"]
    cust_box = c.join(n.select("n_nationkey", "n_regionkey"), c.c_nationkey == n.n_nationkey) \
                .select(F.col("c_custkey"), F.col("n_regionkey").alias("box_id"))
    o = raw["orders"]
    return o.join(cust_box, o.o_custkey == cust_box.c_custkey)


def memberships(raw: dict[str, DataFrame]) -> DataFrame:
    o = _orders_with_box(raw)
    k = F.col("o_orderkey")
    start = _days_before(AS_OF, k * 13 % 800)
    return o.select(
        k.alias("id"), F.col("box_id"), F.col("o_custkey").alias("member_id"),
        k.alias("source_membership_id"),
        _case(F.col("o_orderpriority"), PLAN_BY_PRIORITY).cast("string").alias("plan_type"),
        F.when(k % 41 == 0, F.lit(None).cast("decimal(10,2)")).otherwise(_price(o)).alias("price"),
        start.alias("start_date"),
        F.when(k % 29 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(start, (30 + k % 24 * 30).cast("int"))).alias("end_date"),
        _case(F.col("o_orderstatus"), MEMBERSHIP_STATUS_BY_ORDER_STATUS).cast("string").alias("status"),
        _ts(start).alias("created_at"))


def payments(raw: dict[str, DataFrame]) -> DataFrame:
    o = _orders_with_box(raw)
    k = F.col("o_orderkey")
    m = k % 7
    return o.select(
        k.alias("id"), F.col("box_id"), F.col("o_custkey").alias("member_id"),
        k.alias("source_payment_id"), _price(o).alias("amount"),
        F.when(m == 0, "overdue").when(m == 1, "pending").otherwise("paid").alias("status"),
        _days_before(AS_OF, k % 400).alias("payment_date"),
        _ts(_days_before(AS_OF, k % 400)).alias("created_at"))


def bookings(raw: dict[str, DataFrame]) -> DataFrame:
    o = _orders_with_box(raw).select("o_orderkey", "o_custkey", "box_id")
    li = raw["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    b = li.join(o, li.l_orderkey == o.o_orderkey)
    pk, sk = F.pmod(F.col("l_partkey"), F.lit(3)), F.pmod(F.col("l_suppkey"), F.lit(3))
    hour = 6 + sk * 6
    return b.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("box_id"),
        F.when(F.col("l_orderkey") % 59 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("o_custkey")).alias("member_id"),
        F.col("o_custkey").alias("source_user_id"),
        F.concat(F.lit("Class "), pk.cast("string")).alias("class_name"),
        F.lit(None).cast("string").alias("space_name"),
        F.when((pk == 2) & (sk == 2), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Coach "), F.pmod(pk + sk, F.lit(3)).cast("string"))).alias("coach"),
        _days_before(AS_OF, (F.col("l_orderkey") * 31 + F.col("l_linenumber") * 17) % 364).alias("booked_date"),
        F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00")).alias("booked_time"),
        # one customer in eight books but never comes
        ((F.col("l_returnflag") != "R") & (F.col("o_custkey") % 8 != 0)).alias("checked_in"),
        (F.col("l_linenumber") == 1).alias("is_first_session"),
        F.lit(None).cast("string").alias("membership_type"),
        F.lit(None).cast("int").alias("sessions_left"))


def classes(bk: DataFrame) -> DataFrame:
    """Distinct sessions of the bookings; capacity 0 for Class 1 on Fridays;
    Saturday's Class 0 takes place an hour after its booked time, so those
    bookings match no class."""
    hour = F.split_part(F.col("booked_time"), F.lit(":"), F.lit(1)).cast("int")
    dow = X.dow0("booked_date")
    s = (bk.groupBy("box_id", "class_name", "booked_date", "booked_time")
           .agg(F.min("coach").alias("coach"))
           .withColumn("hour", hour).withColumn("dow", dow))
    late = F.when((F.col("class_name") == "Class 0") & (F.col("dow") == 6), 1).otherwise(0)
    class_no = F.split_part(F.col("class_name"), F.lit(" "), F.lit(2)).cast("bigint")
    cid = ((F.col("box_id").cast("bigint") * 100000
            + F.datediff(F.col("booked_date"), F.lit(dt.date(1990, 1, 1)))) * 24 + F.col("hour")) * 10 + class_no
    sched = F.col("booked_date").cast("timestamp_ntz") + F.make_interval(hours=F.col("hour") + late)
    return s.select(
        cid.alias("id"), F.col("box_id"), cid.alias("source_class_id"),
        F.col("class_name").alias("name"), F.col("coach"),
        sched.cast("timestamp_ntz").alias("scheduled_at"),
        F.when((F.col("class_name") == "Class 1") & (F.col("dow") == 5), F.lit(0))
         .otherwise(3 + F.col("hour") % 5).cast("int").alias("max_capacity"),
        sched.cast("timestamp_ntz").alias("created_at"))


def attendance(bk: DataFrame, cl: DataFrame) -> DataFrame:
    """Bookings matched to their class, one row per (member, class)."""
    c = cl.select(F.col("id").alias("class_id"), F.col("box_id").alias("c_box"), F.col("name"),
                  F.col("scheduled_at"),
                  F.col("scheduled_at").cast("date").alias("c_date"),
                  F.date_format("scheduled_at", "HH:mm").alias("c_time"))
    j = bk.filter(F.col("member_id").isNotNull()).join(
        c, (bk.box_id == c.c_box) & (bk.class_name == c.name)
        & (bk.booked_date == c.c_date) & (bk.booked_time == c.c_time))
    a = j.groupBy("box_id", "member_id", "class_id").agg(
        F.bool_or("checked_in").alias("checked_in"), F.min("scheduled_at").alias("attended_at"))
    return a.select(
        F.concat_ws("-", "member_id", "class_id").alias("id"), "box_id", "member_id", "class_id",
        "checked_in", "attended_at", F.col("attended_at").alias("created_at"))


def freezes(raw: dict[str, DataFrame]) -> DataFrame:
    o = _orders_with_box(raw)
    k = F.col("o_orderkey")
    start = F.date_add(_days_before(AS_OF, k * 11 % 397), 10)
    total = (7 + F.col("o_custkey") % 60).cast("int")
    return o.select(
        k.alias("id"), F.col("box_id"),
        F.when(k % 47 == 0, F.lit(None).cast("bigint")).otherwise(F.col("o_custkey")).alias("member_id"),
        k.alias("source_hold_id"), k.alias("source_membership_id"),
        _case(F.col("o_orderpriority"), PLAN_BY_PRIORITY).cast("string").alias("plan_type"),
        start.alias("freeze_start"),
        F.when(k % 53 == 0, F.lit(None).cast("date")).otherwise(F.date_add(start, total)).alias("freeze_end"),
        total.alias("total_days"),
        _by_mod(k, FREEZE_REASONS).alias("reason"),
        F.lit("taskNone").alias("task_status"),
        F.when(k % 41 == 0, F.lit(None).cast("decimal(10,2)")).otherwise(_price(o)).alias("price"),
        _ts(F.lit(AS_OF)).alias("synced_at"))


def leads(raw: dict[str, DataFrame]) -> DataFrame:
    e = raw["events"]
    eid, uid = F.col("event_id"), F.col("user_id")
    status = _case(F.col("event_type"), LEAD_STATUS_BY_EVENT).cast("string")
    pk = F.when(eid % 3 == 0, eid).otherwise(uid)
    return e.select(
        eid.alias("id"), F.pmod(uid, F.lit(5)).cast("int").alias("box_id"), eid.alias("source_lead_id"),
        F.concat(F.lit("F"), uid.cast("string")).alias("first_name"),
        F.when(eid % 17 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("L"), eid.cast("string"))).alias("last_name"),
        F.concat(F.lit("l"), eid.cast("string"), F.lit("@example.test")).alias("email"),
        F.when(eid % 13 == 0, F.lit(None).cast("string")).otherwise(_phone("+972 5", pk)).alias("phone"),
        _by_mod(eid, LEAD_SOURCES).alias("source"),
        status.alias("status"),
        F.when(F.col("event_type") == "error", _by_mod(eid, LOST_REASONS)).alias("lost_reason"),
        F.when(F.col("event_type") == "purchase",
               F.date_add(F.lit(AS_OF_LEADS), (eid % 21 - 7).cast("int"))).alias("trial_date"),
        _ts(F.date_sub(F.col("ts").cast("date"), (eid % 400).cast("int"))).alias("created_at"))


def canonical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All canonical tables, lazily derived from the driver parquet in ``sf_dir``."""
    return canonical_from_raw(read_driver(spark, sf_dir))


def canonical_from_raw(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    bk = bookings(raw)
    cl = classes(bk)
    return {
        "boxes": boxes(raw),
        "members": members(raw),
        "memberships": memberships(raw),
        "payments": payments(raw),
        "bookings": bk,
        "classes": cl,
        "attendance": attendance(bk, cl),
        "freezes": freezes(raw),
        "leads": leads(raw),
    }
