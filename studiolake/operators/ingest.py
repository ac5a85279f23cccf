"""Cleaning landed report rows, resolving keys, keyed merges.

Everything is a column expression, an equi join on keys or an aggregate:
* per-row helpers (date sanitising, status mapping, phone keys) are native
  expressions from ``functions.exprs`` - no Python UDF;
* "last row wins" de-duplication is ``max_by(struct(row), feed_pos)`` - a
  partial aggregate, so a key repeated millions of times is combined before
  the shuffle (a sort aggregate, as the struct holds strings);
* the keyed upsert is one full outer join on the business key with a
  row-presence flag, so a *supplied* NULL overwrites while a column the feed
  does not carry keeps its stored value; as in a unique constraint, rows with
  a NULL key part match nothing and stay apart;
* the member map is a projection of the members table joined on
  (box_id, user_id) - a shuffle join on a composite key, not a driver dict.

Surrogate ids are a hash of the business key in a range of their own (60 bits
of MD5 above 2^60) instead of random UUIDs: a re-run after an executor loss
gives identical rows, ids of two boxes or of stored rows don't meet, and a
source id may be text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studiolake.functions import exprs as X

Tables = dict[str, DataFrame]

SEED_ID_LIMIT = 10000       # fixed: source ids below this are synthetic seed rows
NEW_IDS = 1 << 60            # ids made here start at this number
UPSERT_KEYS = {
    "members": ["box_id", "source_member_id"],
    "memberships": ["box_id", "source_membership_id"],
    "payments": ["box_id", "source_payment_id"],
    "classes": ["box_id", "source_class_id"],
    "bookings": ["box_id", "source_user_id", "booked_date", "booked_time", "class_name"],
    "leads": ["box_id", "source_lead_id"],
    "freezes": ["box_id", "source_hold_id"],
}


def surrogate(box_id, source_id) -> F.Column:
    digest = F.md5(F.concat(X.col(box_id).cast("string"), F.lit("|"), X.col(source_id).cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") + F.lit(NEW_IDS)


def has_id(column: str) -> F.Column:
    """A row without an id, or with id 0, is no row of the report."""
    return F.coalesce(F.col(column) != 0, F.lit(False))


def given(df: DataFrame, column: str, default) -> F.Column:
    """The field's value; the default where the report's row does not have the field.  An explicit null stays null.
    ``absent`` (see ``sources.pages``) names a row's missing fields; a feed without that column misses none."""
    if "absent" not in df.columns:
        return F.col(column)
    return F.when(F.array_contains("absent", column), F.lit(default)).otherwise(F.col(column))


def last_wins(df: DataFrame, keys: list[str], pos: str = "feed_pos") -> DataFrame:
    """One row per key: the one latest in feed order (max ``pos``).  Rows with a
    NULL key part are all kept."""
    others = [c for c in df.columns if c not in keys]
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return (df.groupBy(*keys, F.when(~whole, F.col(pos)).alias("_apart")).agg(F.max_by(F.struct(*others), F.col(pos)).alias("_r"))
              .select(*keys, "_r.*"))


# ---- A5-A10: table maintenance -------------------------------------------------

def upsert(target: DataFrame, rows: DataFrame, keys: list[str], pos: str | None = "feed_pos",
           defaults: dict[str, F.Column] | None = None) -> DataFrame:
    """A5: insert new keys; on a key match overwrite only the columns ``rows``
    supplies (NULL included); keep the others.  ``rows`` is first reduced to
    one row per key (last in feed order wins).  ``defaults`` fills columns of
    new rows that the feed does not supply (e.g. a surrogate id)."""
    if pos is not None and pos in rows.columns:
        rows = last_wins(rows, keys, pos).drop(pos)
    supplied = [c for c in rows.columns if c not in keys and c in target.columns]
    r = rows.select(*[F.col(k).alias(f"_key_{k}") for k in keys],
                    *[F.col(c).alias(f"_new_{c}") for c in supplied], F.lit(True).alias("_present"))
    tg = target.select("*", F.lit(True).alias("_old"))
    cond = None
    for k in keys:
        e = tg[k] == r[f"_key_{k}"]
        cond = e if cond is None else (cond & e)
    j = tg.join(r, cond, "full_outer")
    defaults = defaults or {}
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.when(F.col("_old").isNull(), F.col(f"_key_{c}")).otherwise(F.col(c)).alias(c))
        elif c in supplied:
            out.append(F.when(F.col("_present").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c))
        elif c in defaults:
            out.append(F.when(F.col("_old").isNull(), defaults[c]).otherwise(F.col(c)).cast(target.schema[c].dataType)
                       .alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Append rows whose key is not present yet (ON CONFLICT DO NOTHING);
    of several new rows with one key the first in feed order (``feed_pos``, or
    any where the feed has none) is taken."""
    others = [c for c in rows.columns if c not in keys]
    place = F.col("feed_pos") if "feed_pos" in rows.columns else F.monotonically_increasing_id()
    apart = F.lit(False)
    for k in keys:
        apart = apart | F.col(k).isNull()
    r = rows.withColumn("_place", place)
    first = r.groupBy(*keys, F.when(apart, F.col("_place")).alias("_apart")).agg(F.min_by(F.struct(*others), "_place").alias("_r")).select(*keys, "_r.*")
    new = first.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(new.select(*[c for c in new.columns if c in target.columns]),
                              allowMissingColumns=True)


def update_col(target: DataFrame, patch: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Set ``column`` from ``patch`` (one row per key) where the key matches."""
    p = patch.select(*keys, F.col(column).alias("_patch"), F.lit(True).alias("_hit"))
    j = target.join(p, keys, "left")
    return j.select(*[F.when(F.col("_hit").isNotNull(), F.col("_patch")).otherwise(F.col(c))
                      .cast(target.schema[c].dataType).alias(c) if c == column else F.col(c)
                      for c in target.columns])


def retention_window(df: DataFrame, ts_col: str, days: int, as_of: dt.date) -> DataFrame:
    """Drop rows with ``ts_col < as_of - days``; rows without a time stay.  A
    literal bound on the raw column, so it prunes row groups at the scan
    (``sources.tables.retire`` does it on a stored table)."""
    return df.filter(F.col(ts_col).isNull() | (F.col(ts_col) >= F.lit(as_of - dt.timedelta(days=days)).cast("timestamp_ntz")))


def purge_seed(df: DataFrame, id_col: str | None, box_id, limit: int = SEED_ID_LIMIT) -> DataFrame:
    """A10: drop one box's synthetic rows (source id below ``limit``); with
    ``id_col=None`` the box's rows are dropped wholesale (attendance)."""
    hit = F.col("box_id") == F.lit(box_id)
    if id_col is not None:
        hit = hit & (F.col(id_col) < limit)
    return df.filter(~F.coalesce(hit, F.lit(False)))


# ---- B1-B5 helpers exposed as frame operators ----------------------------------

def month_chunks(df: DataFrame, from_col: str, to_col: str) -> DataFrame:
    """B1: split each [from, to] range into calendar-month pieces, the first
    starting at ``from`` and the last clipped at ``to``."""
    months = F.sequence(X.month_start(from_col), F.col(to_col), F.expr("INTERVAL 1 MONTH"))
    e = df.filter(F.col(from_col) <= F.col(to_col)).withColumn("_m", F.explode(months))
    return e.withColumn("chunk_from", F.greatest(F.col("_m"), F.col(from_col))) \
            .withColumn("chunk_to", F.least(F.last_day("_m"), F.col(to_col))).drop("_m")


# ---- B6-B16 builders --------------------------------------------------------------

def build_members(props: DataFrame, active: DataFrame) -> DataFrame:
    """Member rows from the profile feed; active iff in the active feed."""
    act = active.filter(F.col("user_id").isNotNull()).select("box_id", "user_id").distinct() \
                .withColumn("_active", F.lit(True))
    p = props.filter(has_id("user_id"))
    j = p.join(act, ["box_id", "user_id"], "left")
    return j.select("box_id", F.col("user_id").alias("source_member_id"),
                    given(p, "name", "Unknown").alias("name"), "email", "phone",
                    F.when(F.col("_active").isNotNull(), "active").otherwise("inactive").alias("status"),
                    F.lit(None).cast("date").alias("join_date"), "feed_pos")


def member_map(members: DataFrame) -> DataFrame:
    """(box_id, source user id) -> member id."""
    return members.select("box_id", F.col("source_member_id").alias("user_id"), F.col("id").alias("member_id"))


def build_memberships(raw: DataFrame, mmap: DataFrame) -> DataFrame:
    """Inner join on the member map; status folding; price 0 where the row has none, null where it says null."""
    j = raw.join(mmap, ["box_id", "user_id"])
    st = F.lower(F.col("status"))
    status = (F.when(st.isin("cancelled", "cancel"), "cancelled").when(st == "expired", "expired")
              .otherwise("active"))
    return j.select("box_id", "member_id", F.col("membership_user_id").alias("source_membership_id"),
                    F.col("membership_type_name").alias("plan_type"),
                    given(raw, "price", 0.0).cast("decimal(10,2)").alias("price"),
                    X.clean_date("start_date").alias("start_date"), X.clean_date("end_date").alias("end_date"),
                    status.alias("status"), X.clean_ts("purchase_date").alias("created_at"), "feed_pos")


def join_date_patch(raw: DataFrame, mmap: DataFrame) -> DataFrame:
    """First non-NULL ``member_since`` per mapped user, in feed order."""
    j = raw.join(mmap, ["box_id", "user_id"]).withColumn("_since", X.clean_date("member_since")) \
           .filter(F.col("_since").isNotNull())
    return j.groupBy("box_id", "user_id").agg(F.min_by("_since", F.col("feed_pos")).alias("join_date")) \
            .select("box_id", F.col("user_id").alias("source_member_id"), "join_date")


def backfill_join_date(members: DataFrame, raw_memberships: DataFrame) -> DataFrame:
    """B9 + A7: members with join_date set from the memberships feed."""
    patch = join_date_patch(raw_memberships, member_map(members))
    return update_col(members, patch, ["box_id", "source_member_id"], "join_date")


def build_payments(raw: DataFrame, mmap: DataFrame) -> DataFrame:
    """Inner join on the member map; status from debt / paid / price."""
    j = raw.join(mmap, ["box_id", "user_id"])
    price = F.coalesce(F.col("price"), F.lit(0.0))
    paid = F.coalesce(F.col("paid"), F.lit(0.0))
    debt = F.coalesce(F.col("debt"), F.lit(0.0))
    status = F.when(debt > 0, "overdue").when((paid >= price) & (price > 0), "paid").otherwise("pending")
    return j.select("box_id", "member_id", F.col("sale_id").alias("source_payment_id"),
                    price.cast("decimal(10,2)").alias("amount"), status.alias("status"),
                    X.clean_date("date").alias("payment_date"), X.clean_ts("date").alias("created_at"), "feed_pos")


def build_classes(raw: DataFrame) -> DataFrame:
    """Sessions with a timestamp from date + start time, trimmed coach,
    name fallback class -> series -> 'WOD', capacity default 20."""
    r = raw.filter(has_id("schedule_id"))
    d = F.coalesce(F.col("date"), F.lit(""))
    sched = F.when(d == "", F.lit(None).cast("timestamp_ntz")).otherwise(
        F.try_to_timestamp(F.concat(d, F.lit("T"), F.coalesce(F.col("start_time"), F.lit("00:00")), F.lit(":00")),
                           F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"))
    name = F.coalesce(F.nullif(F.col("class_name"), F.lit("")), F.nullif(F.col("series_name"), F.lit("")),
                      F.lit("WOD"))
    cap = F.coalesce(F.nullif(F.col("max_participants"), F.lit(0)), F.lit(20))
    return r.select("box_id", F.col("schedule_id").alias("source_class_id"), name.alias("name"),
                    X.null_if_blank("staff_member").alias("coach"), sched.alias("scheduled_at"),
                    cap.cast("int").alias("max_capacity"), sched.alias("created_at"), "feed_pos")


def build_bookings(raw: DataFrame, mmap: DataFrame) -> DataFrame:
    """Client rows only (role client / empty / absent; a null role is none
    of them); left join on the member map; yes/no flags; sessions_left only
    when all digits."""
    r = raw.filter(has_id("user_id") & given(raw, "user_role", "client").isin("client", ""))
    j = r.join(mmap, ["box_id", "user_id"], "left")
    return j.select("box_id", "member_id", F.col("user_id").alias("source_user_id"), "class_name", "space_name",
                    X.null_if_blank("staff_member").alias("coach"), X.clean_date("date").alias("booked_date"),
                    F.col("time").alias("booked_time"), X.yes("check_in").alias("checked_in"),
                    X.yes("is_first_session").alias("is_first_session"),
                    F.col("membership_type_name").alias("membership_type"),
                    X.digits_only_int("sessions_left").alias("sessions_left"), "feed_pos")


def build_leads(raw: DataFrame) -> DataFrame:
    """Open pipeline leads; names default to ''; status normalised."""
    r = raw.filter(has_id("user_id"))
    return r.select("box_id", F.col("user_id").alias("source_lead_id"),
                    F.coalesce(F.col("first_name"), F.lit("")).alias("first_name"),
                    F.coalesce(F.col("last_name"), F.lit("")).alias("last_name"), "email", "phone",
                    X.lead_status("lead_status").alias("status"), F.col("lead_source").alias("source"),
                    X.clean_ts("created_time").alias("created_at"), "feed_pos")


def classify_vanished(leads: DataFrame, feed: DataFrame, members: DataFrame) -> DataFrame:
    """B14 + A8: open stored leads missing from the current feed become
    'converted' when their phone key matches a member's, else 'lost'.
    One pass over the leads; a lead without a usable phone probes with a value
    of its own that no key has, so such leads stay spread over all tasks."""
    in_feed = feed.filter(has_id("user_id")).select("box_id", F.col("user_id").alias("source_lead_id")).distinct() \
                  .withColumn("_seen", F.lit(True))
    keys = members.filter(F.col("phone").isNotNull()).select("box_id", X.phone_key("phone").alias("_pk")) \
                  .filter(F.col("_pk").isNotNull()).distinct().withColumn("_match", F.lit(True))
    probe = F.coalesce(X.phone_key("phone"), F.concat(F.lit("no phone "), F.col("id").cast("string")))
    j = leads.join(in_feed, ["box_id", "source_lead_id"], "left").withColumn("_pk", probe).join(keys, ["box_id", "_pk"], "left")
    gone = F.col("_seen").isNull() & ~F.coalesce(F.col("status").isin("converted", "lost"), F.lit(True))
    verdict = F.when(~gone, F.col("status")).when(F.col("_match").isNotNull(), "converted").otherwise("lost")
    return j.select(*[verdict.alias(c) if c == "status" else F.col(c) for c in leads.columns])


def dedupe_holds(raw: DataFrame) -> DataFrame:
    """One row per hold id (last occurrence wins); NULL / 0 ids dropped."""
    r = raw.filter(F.col("membership_hold_id").isNotNull() & (F.col("membership_hold_id") != 0))
    return last_wins(r, ["box_id", "membership_hold_id"])


def build_freezes(holds: DataFrame, mmap: DataFrame) -> DataFrame:
    """Hold rows; left join on the member map; price as in B8."""
    j = holds.join(mmap, ["box_id", "user_id"], "left")
    return j.select("box_id", "member_id", F.col("membership_hold_id").alias("source_hold_id"),
                    F.col("membership_user_id").alias("source_membership_id"),
                    F.col("membership_type_name").alias("plan_type"),
                    X.clean_date("start_suspend_time").alias("freeze_start"),
                    X.clean_date("end_suspend_time").alias("freeze_end"), "total_days",
                    F.col("suspend_reason").alias("reason"), "task_status",
                    given(holds, "price", 0.0).cast("decimal(10,2)").alias("price"), "feed_pos")
