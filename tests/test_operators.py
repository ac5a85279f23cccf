"""Operator behaviour on hand-made rows and properties on the fixture."""

import datetime as dt

from pyspark.sql import functions as F

from studiolake.operators import activity as A
from studiolake.operators import classes as C
from studiolake.operators import health as H
from studiolake.operators import ingest as I
from studiolake.operators import lifecycle as J
from studiolake.operators import money as M
from studiolake.operators import trends as T
from studiolake.sources.adapter import AS_OF

D = dt.date


def _ms(spark, rows):
    return spark.createDataFrame(rows, "id long, box_id int, member_id long, source_membership_id long, plan_type string, "
                                       "price int, start_date date, end_date date, status string, "
                                       "created_at timestamp_ntz")


def test_latest_membership_open_end_wins(spark):  # T4
    rows = [(1, 0, 7, 1, "A", 100, D(2025, 1, 1), D(2025, 6, 1), "expired", None),
            (2, 0, 7, 2, "B", 200, D(2025, 2, 1), None, "active", None),
            (3, 0, 7, 3, "C", 300, D(2025, 3, 1), D(2025, 9, 1), "active", None),
            (4, 0, 8, 4, "D", 100, D(2025, 1, 1), D(2025, 9, 1), "active", None),
            (5, 0, 8, 5, "E", 100, D(2025, 1, 1), D(2025, 9, 1), "active", None)]
    got = {r["member_id"]: r["plan_type"]
           for r in A.latest_membership({"memberships": _ms(spark, rows)}, D(2025, 7, 1)).collect()}
    assert got == {7: "B", 8: "E"}   # NULL end first; tie -> larger id


def test_health_score_bounds_and_tiers(spark, tables):
    a = A.member_activity(tables, AS_OF)
    r = a.agg(F.max("health_score").alias("mx"), F.count("*").alias("n"),
              F.count_if(F.col("health_tier").isin("healthy", "at_risk", "critical")).alias("tiered")).collect()[0]
    assert r["mx"] <= 100 and r["n"] == r["tiered"] == tables["members"].count()
    # tiers follow the score thresholds
    bad = a.filter(((F.col("health_score") >= 70) & (F.col("health_tier") != "healthy"))
                   | ((F.col("health_score") < 35) & (F.col("health_tier") != "critical"))).count()
    assert bad == 0


def test_alert_inactive_false_when_never_checked_in(spark, tables):  # T12
    h = H.health_scores(tables, AS_OF)
    assert h.filter(F.col("last_checkin_date").isNull() & F.col("alert_inactive")).count() == 0


def test_union_marts_row_counts(spark, tables):
    s = C.class_sessions(tables, keep_tenths=True)
    parts = [C.class_summary(tables, s), C.coach_leaderboard(tables, s), C.class_types(tables, s),
             C.class_weekly(tables, s), C.class_heatmap(tables, s)]
    assert C.classes_mart(tables).count() == sum(p.count() for p in parts)


def test_spines_have_twelve_periods(spark, tables):
    mt = T.member_trends(tables, AS_OF)
    counts = {(r["box_id"], r["period_type"]): r["n"]
              for r in mt.groupBy("box_id", "period_type").agg(F.count("*").alias("n")).collect()}
    assert counts and all(v == 12 for v in counts.values())


def test_retained_never_exceeds_cohort(spark, tables):
    cr = T.cohort_retention(tables, AS_OF)
    assert cr.filter(F.col("retained_members") > F.col("cohort_size")).count() == 0
    assert cr.filter((F.col("period_number") == 0) & (F.col("retention_pct") != 100.0)).count() == 0


def test_frozen_months_equal_brute_force_overlap(spark, tables):
    got = {(r["box_id"], r["period_start"]): (r["freeze_count"], r["period_revenue"])
           for r in M.frozen_mrr_monthly(tables, AS_OF).collect()}
    fr = tables["freezes"].collect()
    months = []
    y, m = AS_OF.year, AS_OF.month
    for _ in range(12):
        months.append(D(y, m, 1))
        y, m = (y, m - 1) if m > 1 else (y - 1, 12)
    want = {}
    for f in fr:
        if f["freeze_start"] is None or f["freeze_end"] is None:
            continue
        for ms in months:
            nxt = D(ms.year + (ms.month == 12), ms.month % 12 + 1, 1)
            if f["freeze_start"] < nxt and f["freeze_end"] >= ms:
                c, p = want.get((f["box_id"], ms), (0, 0))
                want[(f["box_id"], ms)] = (c + 1, p + (f["price"] or 0))
    assert {k: (v[0], float(v[1])) for k, v in got.items()} == {k: (v[0], float(v[1])) for k, v in want.items()}


def test_freeze_returned_matches_exists(spark, tables):
    fo = J.freeze_outcomes(tables, AS_OF).select("freeze_id", "member_id", "box_id", "freeze_end", "returned")
    b = tables["bookings"].filter("checked_in").select("member_id", "box_id", "booked_date")
    brute = fo.join(b, ["member_id", "box_id"], "left").groupBy("freeze_id").agg(
        F.coalesce(F.max(F.col("booked_date") > F.col("freeze_end")), F.lit(False)).alias("b"),
        F.first("returned").alias("r"))
    assert brute.filter(F.col("b") != F.col("r")).count() == 0


def test_upsert_supplied_null_overwrites_absent_persists(spark):  # A5
    target = spark.createDataFrame([(1, 0, 10, "Ann", "x@y", "lost_reason_kept")],
                                   "id long, box_id int, source_lead_id long, first_name string, email string, "
                                   "lost_reason string")
    rows = spark.createDataFrame([(0, 10, "Anna", None, 1), (0, 10, "Old", "o@o", 0), (0, 11, "Bob", "b@b", 2)],
                                 "box_id int, source_lead_id long, first_name string, email string, feed_pos long")
    out = I.upsert(target, rows, ["box_id", "source_lead_id"],
                   defaults={"id": I.surrogate("_key_box_id", "_key_source_lead_id")})
    got = {r["source_lead_id"]: r.asDict() for r in out.collect()}
    assert got[10] == {"id": 1, "box_id": 0, "source_lead_id": 10, "first_name": "Anna", "email": None,
                       "lost_reason": "lost_reason_kept"}
    assert got[11]["id"] >= I.NEW_IDS and got[11]["lost_reason"] is None
    again = I.upsert(out, rows, ["box_id", "source_lead_id"],
                     defaults={"id": I.surrogate("_key_box_id", "_key_source_lead_id")})
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, out.collect()))   # idempotent


def test_upsert_keeps_null_key_rows_apart(spark):
    """As a unique constraint: a NULL key part equals nothing, so no row is lost or merged."""
    target = spark.createDataFrame([(0, 1, None, "old")], "box_id int, k long, d date, v string")
    rows = spark.createDataFrame([(0, 1, None, "a", 1), (0, 1, None, "b", 2), (0, 2, D(2026, 1, 1), "c", 3), (0, 2, D(2026, 1, 1), "d", 4)],
                                 "box_id int, k long, d date, v string, feed_pos long")
    assert sorted(r["v"] for r in I.upsert(target, rows, ["box_id", "k", "d"]).collect()) == ["a", "b", "d", "old"]


def test_new_ids_do_not_meet(spark):
    rows = spark.createDataFrame([("0", "5"), ("1", "5"), ("10", "5"), ("1", "05"), ("1", "abc"), ("1", "99999999999999999999")], "b string, s string")
    ids = [r[0] for r in rows.select(I.surrogate("b", "s")).collect()]
    assert len(set(ids)) == 6 and min(ids) >= I.NEW_IDS


def test_id_zero_is_no_row(spark):
    raw = spark.createDataFrame([(0, 0, "A"), (0, None, "B"), (0, 7, "C")], "box_id int, user_id long, name string") \
               .withColumn("email", F.lit("e")).withColumn("phone", F.lit("p")).withColumn("feed_pos", F.lit(1))
    assert [r["source_member_id"] for r in I.build_members(raw, raw.select("box_id", "user_id")).collect()] == [7]


def test_insert_ignore_keeps_existing(spark):  # A6
    target = spark.createDataFrame([(0, 1, "old")], "box_id int, k long, v string")
    rows = spark.createDataFrame([(0, 1, "new", 1), (0, 2, "later", 3), (0, 2, "new", 2)], "box_id int, k long, v string, feed_pos long")
    got = sorted(map(tuple, I.insert_ignore(target, rows, ["box_id", "k"]).collect()))
    assert got == [(0, 1, "old"), (0, 2, "new")]


def test_month_chunks(spark):  # B1
    df = spark.createDataFrame([(D(2026, 1, 15), D(2026, 3, 10))], "f date, t date")
    got = [(r["chunk_from"], r["chunk_to"]) for r in I.month_chunks(df, "f", "t").orderBy("chunk_from").collect()]
    assert got == [(D(2026, 1, 15), D(2026, 1, 31)), (D(2026, 2, 1), D(2026, 2, 28)), (D(2026, 3, 1), D(2026, 3, 10))]


def test_retention_rate_half_up(spark):  # E4
    acts = spark.createDataFrame(
        [(0, "active", False, None, "active", None, "healthy", 80, None)] * 2
        + [(0, "active", False, None, "cancelled", None, "critical", 10, None)],
        "box_id int, member_status string, is_frozen boolean, join_date date, membership_status string, "
        "last_payment_date date, health_tier string, health_score long, x int")
    r = H.retention({}, D(2026, 1, 1), activity=acts).collect()[0]
    # cancelled member is also active & not frozen: 3 active, 1 cancelled -> 3/4 = 75.0 %
    assert r["total_active"] == 3 and r["cancelled_count"] == 1 and r["retention_rate_pct"] == 75.0
    assert r["avg_health_score"] == 57   # (80+80+10)/3 = 56.67 -> 57


def test_unique_keys_are_dealt_before_they_are_counted(spark, tmp_path, monkeypatch):
    """No task counts keys of its whole input before the shuffle, and tasks follow the input."""
    from studiolake.operators import quality as Q
    rows = [(1, k) for k in range(3000)] + [(1, 7), (None, 5), (None, 5), (2, None), (2, None), (2, 7)]
    spark.createDataFrame(rows, "box_id int, source_lead_id long").coalesce(1).write.parquet(str(tmp_path / "a leads"))
    leads = spark.read.parquet(str(tmp_path / "a leads"))
    size = sum(f.stat().st_size for f in (tmp_path / "a leads").glob("*.parquet"))
    monkeypatch.setattr(Q, "KEY_BYTES", -(-size // 5))
    out = Q.dq_unique({"leads": leads}, {"leads": ["box_id", "source_lead_id"]})
    assert sorted(tuple(r) for r in out.collect()) == [("leads", "unique", "1|7", 2), ("leads", "unique", "2", 2), ("leads", "unique", "5", 2)]
    executed = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(box_id" in executed and ", 5), REPARTITION_BY_NUM" in executed
    assert "partial_count" not in executed[executed.index("REPARTITION_BY_NUM"):].split("== Initial Plan ==")[0]
    other = Q.dq_unique({"leads": spark.createDataFrame(rows, leads.schema)}, {"leads": ["box_id", "source_lead_id"]})
    assert sorted(r.n for r in other.collect()) == [2, 2, 2]
