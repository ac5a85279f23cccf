"""Registered queries: data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from studiolake.operators import quality as Q
from studiolake.plans.oracle_feeds import FEED_CTES
from studiolake.plans.q_ingest import _raw
from studiolake.plans.registry import Entry

DQ_SPEC = "table_name:s, check:s, key:s, n:l"


# The constraints of the schema, written out for the SQL side.
_UNIQUE = """boxes access_token; members box_id source_member_id; memberships box_id source_membership_id;
payments box_id source_payment_id; classes box_id source_class_id; freezes box_id source_hold_id;
attendance box_id member_id class_id; leads box_id source_lead_id;
bookings box_id source_user_id booked_date booked_time class_name"""
_REQUIRED = """boxes name email access_token created_at; members box_id source_member_id name status created_at;
memberships box_id member_id source_membership_id status created_at;
payments box_id member_id source_payment_id amount status created_at; classes box_id source_class_id name created_at;
freezes box_id source_hold_id synced_at; attendance box_id member_id class_id checked_in created_at;
leads box_id source_lead_id status created_at"""
_STATUS = """members active inactive; memberships active expired cancelled; payments paid pending overdue;
leads new in_progress trial_booked converted lost"""
_REFERENCES = """members box_id boxes; memberships box_id boxes; memberships member_id members; payments box_id boxes;
payments member_id members; classes box_id boxes; freezes box_id boxes; freezes member_id members; attendance box_id boxes;
attendance member_id members; attendance class_id classes; leads box_id boxes"""


def _rules(text: str) -> list[list[str]]:
    return [rule.split() for rule in text.split(";")]


def _key(cols):
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


def _unique_sql():
    return "\nUNION ALL\n".join(
        f"SELECT '{tb}' AS table_name, 'unique' AS \"check\", {_key(cols)} AS key, count(*) AS n FROM {tb} "
        f"GROUP BY {', '.join(cols)} HAVING count(*) > 1" for tb, *cols in _rules(_UNIQUE))


def _not_null_sql():
    parts = []
    for tb, *cols in _rules(_REQUIRED):
        for c in cols:
            parts.append(f"SELECT '{tb}' AS table_name, 'not_null' AS \"check\", '{c}' AS key, "
                         f"count(*) FILTER (WHERE {c} IS NULL) AS n FROM {tb}")
    return "SELECT * FROM (" + "\nUNION ALL\n".join(parts) + ") WHERE n > 0"


def _outside(tb: str, source: str, c: str, values: list[str]) -> str:
    lst = ", ".join(f"'{v}'" for v in values)
    return (f"SELECT '{tb}' AS table_name, 'accepted_values:{c}' AS \"check\", CAST({c} AS VARCHAR) AS key, "
            f"count(*) AS n FROM {source} WHERE {c} IS NOT NULL AND {c} NOT IN ({lst}) GROUP BY {c}")


def _accepted_sql():
    return "\nUNION ALL\n".join(_outside(tb, tb, "status", values) for tb, *values in _rules(_STATUS))


def _orphans_sql(members: str = "members"):
    parts = []
    for child, c, parent in _rules(_REFERENCES):
        here, there = (members if x == "members" else x for x in (child, parent))
        parts.append(f"SELECT '{child}' AS table_name, 'references:{c}->{parent}' AS \"check\", "
                     f"CAST(x.{c} AS VARCHAR) AS key, count(*) AS n FROM {here} x "
                     f"WHERE x.{c} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {there} p WHERE p.id = x.{c}) "
                     f"GROUP BY x.{c}")
    return "\nUNION ALL\n".join(parts)


def _after_delete(t):
    """The tables after members were deleted without their rows."""
    return Q.dq_orphans(t | {"members": t["members"].filter("status = 'active'"), "classes": t["classes"].filter("max_capacity > 15")})


def _raw_values(t, f):
    """Status texts as the reports deliver them, held against the accepted ones."""
    return Q.dq_accepted_values({"memberships": f["memberships"], "leads": f["leads"].withColumnRenamed("lead_status", "status")},
                                {k: v for k, v in Q.ACCEPTED.items() if k[0] in ("memberships", "leads")})


def _raw_required(t, f):
    """Required fields that the reports leave empty."""
    return Q.dq_not_null({"memberships": f["memberships"], "bookings": f["bookings"], "classes": f["classes"]},
                         {"memberships": ["user_id", "status", "price"], "bookings": ["user_id", "user_role"], "classes": ["schedule_id", "class_name", "max_participants"]})


def _cascade(t):
    survivors = t["members"].filter(F.col("status") == "active")
    frz = Q.cascade_delete(t["freezes"], survivors, "member_id", mode="set_null")
    return frz.select(F.col("id").alias("freeze_id"), "box_id", "member_id")


def _cascade_ms(t):
    survivors = t["members"].filter(F.col("status") == "active")
    return Q.cascade_delete(t["memberships"], survivors, "member_id").select(
        F.col("id").alias("membership_id"), "box_id", "member_id")


ENTRIES = [
    Entry("dq_unique", Q.dq_unique, DQ_SPEC, _unique_sql()),
    Entry("dq_not_null", Q.dq_not_null, DQ_SPEC, _not_null_sql()),
    Entry("dq_accepted_values", Q.dq_accepted_values, DQ_SPEC, _accepted_sql()),
    Entry("dq_orphans", Q.dq_orphans, DQ_SPEC, _orphans_sql()),
    Entry("dq_orphans_after_delete", _after_delete, DQ_SPEC,
          _orphans_sql("(SELECT * FROM members WHERE status = 'active')").replace("FROM classes p WHERE", "FROM classes p WHERE p.max_capacity > 15 AND")
          .replace("FROM classes x WHERE", "FROM classes x WHERE x.max_capacity > 15 AND")),
    Entry("dq_accepted_values_raw", _raw(_raw_values), DQ_SPEC, "\nUNION ALL\n".join(
          _outside(tb, f"(SELECT {c} AS status FROM {feed})", "status", values) for tb, *values in _rules(_STATUS)
          for feed, c in [{"memberships": ("fd_memberships", "status"), "leads": ("fd_leads", "lead_status")}.get(tb, (None, None))] if feed), (FEED_CTES,), "raw"),
    Entry("dq_not_null_raw", _raw(_raw_required), DQ_SPEC, "SELECT * FROM (" + "\nUNION ALL\n".join(
          f"SELECT '{tb}' AS table_name, 'not_null' AS \"check\", '{c}' AS key, count(*) FILTER (WHERE {c} IS NULL) AS n FROM fd_{tb}"
          for tb, cols in [("memberships", ["user_id", "status", "price"]), ("bookings", ["user_id", "user_role"]), ("classes", ["schedule_id", "class_name", "max_participants"])]
          for c in cols) + ") WHERE n > 0", (FEED_CTES,), "raw"),
    Entry("dq_match_rate", Q.dq_match_rate, "box_id:l, bookings:l, matched:l, match_pct:d",
          """SELECT box_id, count(*) AS bookings, count(*) FILTER (WHERE hit) AS matched,
                    CAST(((count(*) FILTER (WHERE hit)) * 2000 + count(*)) // (count(*) * 2) AS DOUBLE) / 10.0
                      AS match_pct
             FROM (SELECT b.box_id, EXISTS (SELECT 1 FROM stg_classes c WHERE b.booked_date = c.class_date
                     AND b.booked_time = c.class_time AND b.class_name = c.class_name AND b.box_id = c.box_id) AS hit
                   FROM stg_bookings b) GROUP BY box_id"""),
    Entry("cascade_set_null_freezes", _cascade, "freeze_id:l, box_id:l, member_id:l",
          "SELECT f.id AS freeze_id, f.box_id, CASE WHEN m.id IS NULL THEN NULL ELSE f.member_id END AS member_id "
          "FROM freezes f LEFT JOIN (SELECT id FROM members WHERE status = 'active') m ON f.member_id = m.id"),
    Entry("cascade_delete_memberships", _cascade_ms, "membership_id:l, box_id:l, member_id:l",
          "SELECT id AS membership_id, box_id, member_id FROM memberships "
          "WHERE member_id IN (SELECT id FROM members WHERE status = 'active')"),
]
