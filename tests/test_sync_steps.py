"""Steps of the sync and the store: what runs at the same time, what is worked out once, and date texts."""

import datetime as dt
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import ingest as I
from studiolake.operators import sync as Y
from studiolake.sources import tables as S

KEYS = ["box_id", "source_payment_id"]
MONTHS = S.Layout(month="created_at", key="source_payment_id")


def day(month: int, d: int = 5) -> dt.datetime:
    return dt.datetime(2001, month, d, 10)


def test_reports_of_different_tables_are_merged_at_the_same_time(spark, monkeypatch):
    """The fake merge of payments ends only while that of classes runs, and the other way round."""
    meet, seen = threading.Barrier(2, timeout=30), []
    rows = spark.createDataFrame([(1, 1)], "box_id int, user_id long")

    def merge(path, feed, keys, **more):
        name = path.rsplit("/", 1)[1]
        seen.append(name)
        if name in ("payments", "classes"):
            meet.wait()
        return S.Change(1)
    leads = spark.createDataFrame([(1, 1, "new", "1")], "box_id int, source_lead_id long, status string, phone string").withColumn("id", F.lit(1))
    members = spark.createDataFrame([(1, 1, 1, "1")], "id long, box_id int, source_member_id long, phone string")
    monkeypatch.setattr(S, "merge", merge)
    monkeypatch.setattr(S, "read_table", lambda spark, path, *a, **k: leads if path.endswith("leads") else members)
    for name in ("build_payments", "build_classes", "build_bookings", "build_leads", "build_freezes", "dedupe_holds"):
        monkeypatch.setattr(I, name, lambda *a: rows)
    done = Y.sync(spark, dict.fromkeys(["sales", "classes", "bookings", "leads", "holds"], rows), "store", dt.date(2001, 8, 1), partial=True)
    assert sorted(seen) == ["bookings", "classes", "freezes", "leads", "leads", "payments"]
    assert set(done) == {"bookings", "classes", "freezes", "leads", "payments", "vanished leads"}


def test_a_failed_step_fails_the_sync_when_the_others_have_ended(spark):
    from studiolake.session import together
    ended = []

    def bad():
        raise ValueError("broken report")
    with pytest.raises(ValueError, match="broken report"):
        together(spark, [bad, lambda: ended.append(1), lambda: ended.append(2)])
    assert sorted(ended) == [1, 2] and together(spark, [lambda i=i: i for i in range(9)]) == list(range(9))


def test_rows_without_a_whole_key_are_looked_up_once(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/payments"
    stored = "box_id int, source_payment_id long, amount double, created_at timestamp_ntz"
    S.write_table(spark.createDataFrame([(1, k, 1.0, day(1 + k % 3)) for k in range(9)] + [(1, None, 2.0, day(1)), (None, 3, 2.0, day(2))], stored), path, MONTHS)
    plans, upsert = [], I.upsert

    def watched(target, rows, *a, **k):
        plans.append(rows._jdf.queryExecution().optimizedPlan().toString())
        return upsert(target, rows, *a, **k)
    monkeypatch.setattr(I, "upsert", watched)
    feed = [(1, 2, 9.0, day(2), 1), (1, None, 2.0, day(1), 2), (1, None, 3.0, day(1), 3), (None, 3, 2.0, day(2), 4)]
    S.merge(path, spark.createDataFrame(feed, f"{stored}, feed_pos long"), KEYS)
    assert len(plans) == 1 and "Join" not in plans[0]  # it was joined once, and what was left is read back
    rows = S.read_table(spark, path)
    assert rows.count() == 12 and rows.filter("amount = 3").count() == 1 and rows.filter("amount = 9").count() == 1


def test_a_folders_rows_are_counted_over_its_files(spark):
    path = tempfile.mkdtemp(prefix="files-") + "/payments"
    rows = spark.range(6000).select((F.col("id") % 2).cast("int").alias("box_id"), F.when(F.col("id") > 0, F.col("id")).alias("source_payment_id"), F.lit("x").alias("v"),
                                    F.when(F.col("id") % 100 > 0, F.lit(day(3))).alias("created_at"))
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1000")  # three files or so a folder
    try:
        S.write_table(rows, path, MONTHS)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    got = sorted((r.box, r.part, r.n, str(r.lo), r.undated, r.key_lo, r.key_hi, r.unkeyed) for r in S.manifest(spark, path).collect())
    assert got == [("0", "2001-03", 2940, "2001-03-05", 0, 2, 5998, 0), ("0", "none", 60, "None", 60, 100, 5900, 1), ("1", "2001-03", 3000, "2001-03-05", 0, 1, 5999, 0)]


def test_date_texts_have_one_form_each(spark):
    texts = [None, "", "0000-00-00", "-0001-11-30", "2001-07-03", "2001-07-03 10:30:00", "2001-07-03T10:30:00", "2001-07-03t10:30:00", "2001-07-03 10:30", "2001-07-03T",
             " 2001-07-03", "2001-07-03 ", "2001-07-03T10:30:00 ", "2001-02-30", "2001-02-30 10:00:00", "2001-7-3", "+12001-07-03", "20010703", "Tuesday", "two days", "2001-07-03T10:30:00Z"]
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]
    every = F.coalesce(*(F.try_to_timestamp("t", F.lit(f)) for f in forms)).cast("timestamp_ntz")
    want = F.when(F.col("t").isNull() | (F.col("t") == "") | F.col("t").startswith("0000") | F.col("t").startswith("-"), F.lit(None)).otherwise(every)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3).select("t", X.clean_ts("t").cast("string").alias("got"), want.cast("string").alias("want"))
    found = rows.collect()
    assert [(r.t, r.got) for r in found] == [(r.t, r.want) for r in found] and sum(r.got is not None for r in found) >= 4
    plan = rows.select("got")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "coalesce" not in plan  # a form that can't fit is not tried
