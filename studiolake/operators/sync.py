"""Full and partial sync pipelines on a store.

Each step merges one report into its stored table (``sources.tables.merge``:
only the folders that hold a key of the report are rewritten) and commits
before the next step reads it: that cuts the lineage (an executor loss re-runs
one step, not the whole sync) and makes every step durable.  Reports that
meet in no table run at the same time once members are merged.  A failed sync
is run again from its start; steps that were done find nothing new.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.operators import ingest as I
from studiolake.session import together
from studiolake.sources import tables as S

SEED_IDS = {"attendance": None, "payments": "source_payment_id", "classes": "source_class_id",
            "memberships": "source_membership_id", "members": "source_member_id", "leads": "source_lead_id"}
#: Fixed: what the removal of a member does to its rows, and of a class to its attendance.
ON_DELETE = [("memberships", "member_id", "members", "delete"), ("payments", "member_id", "members", "delete"),
             ("attendance", "member_id", "members", "delete"), ("freezes", "member_id", "members", "null"),
             ("attendance", "class_id", "classes", "delete")]


def purge(spark: SparkSession, store: str, box) -> dict[str, S.Change]:
    """The first step of a full sync: one box's synthetic rows go, with what hangs on them.  (Bookings keep the number of a
    removed member: they have no reference to it.)"""
    before = {n: S.version(spark, f"{store}/{n}") for n in ("members", "classes")}
    done = {n: S.remove(spark, f"{store}/{n}", box, column, None if column is None else I.SEED_ID_LIMIT) for n, column in SEED_IDS.items()}
    for child, fk, parent, mode in ON_DELETE:
        path = f"{store}/{parent}"
        if not done[parent].gone:
            continue
        left = S.read_table(spark, path, boxes=[box]).select(F.col("id").alias("_gone"))
        removed = S.read_table(spark, path, boxes=[box], number=before[parent]).select(F.col("id").alias("_gone")).join(left, "_gone", "left_anti")
        removed = removed.distinct()

        def hit(rows: DataFrame, fk=fk, removed=removed) -> DataFrame:
            return rows.join(removed, rows[fk] == removed["_gone"], "left_semi")

        def cut(rows: DataFrame, fk=fk, mode=mode, removed=removed) -> DataFrame:
            if mode == "delete":
                return rows.join(removed, rows[fk] == removed["_gone"], "left_anti")
            j = rows.join(removed, rows[fk] == removed["_gone"], "left")
            return j.select(*(F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == fk else F.col(c) for c in rows.columns))
        done[f"{child}.{fk}"] = S.edit(spark, f"{store}/{child}", hit, cut, boxes=[box])
    return done


def sync(spark: SparkSession, feeds: dict[str, DataFrame], store: str, as_of: dt.date, partial: bool = False,
         purge_box=None, boxes: list | None = None) -> dict[str, S.Change]:
    """Run one sync of the store's tables; returns the change of each step.  A full sync first drops the synthetic rows of
    ``purge_box``.  The partial sync skips that, members and memberships, and reuses the stored map.  ``boxes``: the boxes
    whose reports these are (none given: all), whose open leads count as gone when their report lacks them."""
    done: dict[str, S.Change] = {}
    if not partial and purge_box is not None:
        done |= {f"purge {n}": c for n, c in purge(spark, store, purge_box).items()}
    ts = F.lit(as_of).cast("timestamp_ntz")

    def table(name: str) -> DataFrame:
        return S.read_table(spark, f"{store}/{name}", boxes)

    def take(name: str, rows: DataFrame, defaults: dict | None = None) -> None:
        done[name] = S.merge(f"{store}/{name}", rows, I.UPSERT_KEYS[name], defaults=defaults)

    def own_id(column: str) -> dict:
        return {"id": I.surrogate("_key_box_id", f"_key_{column}")}

    if not partial:
        take("members", I.build_members(feeds["member_props"], feeds["active_members"]), own_id("source_member_id") | {"created_at": ts})
        take("memberships", I.build_memberships(feeds["memberships"], I.member_map(table("members"))), own_id("source_membership_id"))
        members = table("members")
        was = members.select("box_id", "source_member_id", F.col("join_date").alias("_was"))
        patch = I.join_date_patch(feeds["memberships"], I.member_map(members)).join(was, ["box_id", "source_member_id"])
        patch = patch.filter(~F.col("join_date").eqNullSafe(F.col("_was"))).drop("_was")
        done["join dates"] = S.merge(f"{store}/members", patch, I.UPSERT_KEYS["members"], pos=None, insert=False)
    mmap = I.member_map(table("members"))

    def leads() -> None:
        take("leads", I.build_leads(feeds["leads"]), own_id("source_lead_id"))
        verdict = I.classify_vanished(table("leads").withColumn("_was", F.col("status")), feeds["leads"], table("members"))
        verdict = verdict.filter(~F.col("status").eqNullSafe(F.col("_was"))).select("box_id", "source_lead_id", "status")
        done["vanished leads"] = S.merge(f"{store}/leads", verdict, I.UPSERT_KEYS["leads"], pos=None, insert=False)

    booking_id = F.concat_ws("-", *(F.coalesce(F.col(f"_key_{k}").cast("string"), F.lit("?")) for k in I.UPSERT_KEYS["bookings"]))
    together(spark, [
        lambda: take("bookings", I.build_bookings(feeds["bookings"], mmap), {"id": booking_id}),
        lambda: take("payments", I.build_payments(feeds["sales"], mmap), own_id("source_payment_id")),
        lambda: take("freezes", I.build_freezes(I.dedupe_holds(feeds["holds"]), mmap), own_id("source_hold_id") | {"synced_at": ts}),
        leads,
        lambda: take("classes", I.build_classes(feeds["classes"]), own_id("source_class_id")),
    ])
    return done
