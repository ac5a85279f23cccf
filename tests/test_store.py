"""The table store: which folders a change reads and writes, and what readers see."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from studiolake.operators.ingest import upsert
from studiolake.sources import tables as S

PAYMENT = "id long, box_id int, source_payment_id long, amount double, status string, created_at timestamp_ntz"
KEYS = ["box_id", "source_payment_id"]
MONTHS = S.Layout(month="created_at", key="source_payment_id")


def day(month: int, d: int = 5) -> dt.datetime:
    return dt.datetime(2001, month, d, 10)


def payments(spark, boxes=(1, 2, 3), months=(1, 2, 3, 4)):
    rows = [(b * 1000 + m * 10 + k, b, m * 100 + k, 10.0 * k, "paid", day(m, 1 + k)) for b in boxes for m in months for k in range(5)]
    return spark.createDataFrame(rows, PAYMENT)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def path(spark, tmp_path):
    p = f"{tmp_path}/payments"
    S.write_table(payments(spark), p, MONTHS)
    return p


def feed(spark, rows):
    return spark.createDataFrame(rows, "box_id int, source_payment_id long, amount double, created_at timestamp_ntz, feed_pos long")


def test_merge_rewrites_only_folders_with_a_key_of_the_feed(spark, path):
    before = set(S._names(S.manifest(spark, path)))
    rows = feed(spark, [(1, 201, 7.0, day(2, 2), 1), (1, 201, 8.0, day(2, 2), 2), (1, 999, 1.0, day(2, 3), 3)])
    want = upsert(S.read_table(spark, path), rows, KEYS, defaults={"id": F.col("_key_source_payment_id")})
    want = rows_of(want.select(*S.read_table(spark, path).columns))
    change = S.merge(path, rows, KEYS, defaults={"id": F.col("_key_source_payment_id")})
    after = set(S._names(S.manifest(spark, path)))
    # Box 1, ids 201 to 999: months 2, 3 and 4 can hold them, only month 2 does.
    assert [re.sub(r"^w=\w+/", "", f) for f in change.looked_up] == [f"box_id=1/part=2001-0{m}" for m in (2, 3, 4)]
    assert [re.sub(r"^w=\w+/", "", f) for f in change.gone] == ["box_id=1/part=2001-02"]
    assert before - after == set(change.gone) and after - before == set(change.new) and len(change.new) == 1
    assert rows_of(S.read_table(spark, path)) == want


def test_merge_moves_a_row_to_another_month_and_keeps_other_boxes(spark, path):
    rows = feed(spark, [(2, 101, 5.5, day(4, 9), 1), (7, 101, 1.0, None, 1), (None, 5, 2.0, day(1), 1), (None, 5, 2.0, day(1), 2), (2, None, 3.0, day(1), 1)])
    want = rows_of(upsert(S.read_table(spark, path), rows, KEYS).select(*S.read_table(spark, path).columns))
    change = S.merge(path, rows, KEYS)
    assert len(change.gone) == 1 and rows_of(S.read_table(spark, path)) == want
    got = {r.source_payment_id: r for r in S.read_table(spark, path, boxes=[2]).collect()}
    assert got[101].amount == 5.5 and got[101].status == "paid" and got[101].created_at.month == 4
    assert {r.box_id for r in S.read_table(spark, path, boxes=[None, 7]).collect()} == {None, 7}


def test_new_keys_only_rewrite_nothing(spark, path):
    change = S.merge(path, feed(spark, [(3, 5000 + k, 1.0, day(4), k) for k in range(10)]), KEYS)
    assert change.gone == [] and len(change.new) == 1
    gone = [len(S.merge(path, feed(spark, [(3, 6000 + k, 1.0, day(4), k)]), KEYS).gone) for k in range(S.MANY_FOLDERS + 1)]
    assert max(gone) > S.MANY_FOLDERS and gone.count(0) == len(gone) - 1  # too many folders of one month: rewritten as one
    assert S.manifest(spark, path).filter("box = '3' AND part = '2001-04'").count() <= 2
    assert S.read_table(spark, path, boxes=[3]).filter("source_payment_id >= 5000").count() == 10 + S.MANY_FOLDERS + 1


def test_rows_without_a_whole_key_come_once(spark, path):
    rows = feed(spark, [(1, None, 2.0, day(1), 1), (1, None, 2.0, day(1), 2), (1, None, None, None, 3), (None, None, 4.0, day(2), 4), (2, None, 2.0, day(1), 5)])
    S.merge(path, rows, KEYS)
    assert S.read_table(spark, path).count() == 60 + 5
    assert S.merge(path, rows, KEYS).gone == [] and S.read_table(spark, path).count() == 60 + 5
    S.merge(path, feed(spark, [(1, None, 3.0, day(1), 1), (1, None, 2.0, day(1), 2)]), KEYS)
    assert S.read_table(spark, path).count() == 60 + 6


def test_update_only(spark, path):
    patch = spark.createDataFrame([(1, 102, "overdue"), (1, 98765, "overdue")], "box_id int, source_payment_id long, status string")
    S.merge(path, patch, KEYS, pos=None, insert=False)
    got = S.read_table(spark, path)
    assert got.count() == 60 and [tuple(r) for r in got.filter("status = 'overdue'").select("box_id", "source_payment_id", "amount").collect()] == [(1, 102, 20.0)]


def test_merge_by_bucket(spark, tmp_path):
    path, layout = f"{tmp_path}/members", S.Layout(bucket="source_member_id", buckets=8, key="source_member_id")
    members = spark.range(200).select((F.col("id") % 2).cast("int").alias("box_id"), F.col("id").alias("source_member_id"), F.lit("old").alias("name"))
    S.write_table(members, path, layout)
    change = S.merge(path, spark.createDataFrame([(1, 31, "new"), (1, 5001, "new")], "box_id int, source_member_id long, name string"), ["box_id", "source_member_id"], pos=None)
    assert len(change.gone) == 1 and len(change.looked_up) <= 2 and S.read_table(spark, path).count() == 201
    assert S.read_table(spark, path).filter("name = 'new'").count() == 2


def test_text_keys_and_odd_box_names(spark, tmp_path):
    path, schema = f"{tmp_path}/odd", "box_id string, source_payment_id string, v int"
    names = ["007", "a b", "a%b", "a=b/c", "x+y", "é", None, "[q]"]
    S.write_table(spark.createDataFrame([(b, f"k{i}", i) for i, b in enumerate(names)], schema), path, S.Layout(key="source_payment_id"))
    change = S.merge(path, spark.createDataFrame([(b, f"k{i}", 100 + i) for i, b in enumerate(names)], schema), KEYS, pos=None)
    got = sorted((r.box_id or "", r.v) for r in S.read_table(spark, path).collect())
    assert got == sorted([*((b, 100 + i) for i, b in enumerate(names) if b), ("", 6), ("", 106)]) and len(change.gone) == len(names) - 1
    assert [r.v for r in S.read_table(spark, path, boxes=["a%b"]).collect()] == [102]


def test_an_epoch_is_committed_once(spark, path):
    rows = feed(spark, [(1, 101, 77.0, day(1, 2), 1), (9, 1, 1.0, day(1), 2)])
    first = S.merge(path, rows, KEYS, stream="sales", epoch=4)
    again = S.merge(path, rows, KEYS, stream="sales", epoch=4)
    assert not first.repeated and again.repeated and again.number == first.number == S.version(spark, path)
    assert not S.merge(path, rows, KEYS, stream="other", epoch=4).repeated
    assert not S.merge(path, rows, KEYS, stream="sales", epoch=5).repeated
    assert S.read_table(spark, path).filter("amount = 77").count() == 1


def test_retire_drops_old_months_unread(spark, path):
    change = S.retire(spark, path, "created_at", 90, dt.date(2001, 5, 4))  # bound: 3 February
    ends = [f.rsplit("/", 1)[1] for f in change.gone]
    assert sorted(ends) == ["part=2001-01"] * 3 + ["part=2001-02"] * 3
    assert [f.rsplit("/", 1)[1] for f in change.looked_up] == ["part=2001-02"] * 3  # the only month that is read
    assert len(_files(spark, path, change.looked_up)) == 3
    left = S.read_table(spark, path)
    assert left.count() == 3 * (3 + 10) and left.agg(F.min("created_at")).first()[0] == day(2, 3)
    assert S.retire(spark, path, "created_at", 90, dt.date(2001, 5, 4)).gone == []


def _files(spark, path, folders):
    return S._read(spark, path, S._must(spark, path).schema, folders).inputFiles()


def test_retire_keeps_rows_without_a_date(spark, path):
    S.merge(path, feed(spark, [(1, 9000, 1.0, None, 1)]), KEYS)
    S.retire(spark, path, "created_at", 90, dt.date(2010, 1, 1))
    assert [r.source_payment_id for r in S.read_table(spark, path).collect()] == [9000]


def test_since_is_read_by_folders(spark, path):
    part = S.read_table(spark, path, boxes=[1], since=dt.date(2001, 4, 3))
    assert part.count() == 3 and len(part.inputFiles()) == 1


def test_remove_rows_of_a_box(spark, path):
    change = S.remove(spark, path, 2, "source_payment_id", 103)
    assert [f.rsplit("/", 1)[1] for f in change.looked_up] == ["part=2001-01"]
    assert S.read_table(spark, path, boxes=[2]).agg(F.min("source_payment_id")).first()[0] == 103
    change = S.remove(spark, path, 2)
    assert change.looked_up == [] and change.new == [] and S.read_table(spark, path).select("box_id").distinct().count() == 2
    assert S.remove(spark, path, 55).gone == []


def test_changed_boxes_and_replacing_them(spark, path):
    first = S.version(spark, path)
    S.merge(path, feed(spark, [(1, 101, 3.0, day(1, 2), 1)]), KEYS)
    S.merge(path, feed(spark, [(8, 1, 3.0, day(1), 1)]), KEYS)
    assert S.changed_boxes(spark, path, first) == ["1", "8"] and S.changed_boxes(spark, path, S.version(spark, path)) == []
    change = S.replace_boxes(payments(spark, boxes=(1,), months=(6,)), path, [1, 8])
    assert S.read_table(spark, path).count() == 5 + 40 and all("box_id=1/part=2001-06" in f for f in change.new)
    assert S.read_table(spark, path, number=first).count() == 60


def test_vacuum_leaves_what_the_last_commits_name(spark, path):
    for k in range(3):
        S.merge(path, feed(spark, [(1, 101, 3.0 + k, day(1, 2), 1)]), KEYS)
    now, before = rows_of(S.read_table(spark, path)), rows_of(S.read_table(spark, path, number=3))
    gone = S.vacuum(spark, path, keep=2)
    assert len(gone) == 2 and rows_of(S.read_table(spark, path)) == now and rows_of(S.read_table(spark, path, number=3)) == before
    assert len(S.vacuum(spark, path, keep=1)) == 1 and S.vacuum(spark, path, keep=1) == []
    assert rows_of(S.read_table(spark, path)) == now


def test_a_failed_merge_changes_nothing(spark, path):
    was = rows_of(S.read_table(spark, path))
    bad = feed(spark, [(1, 101, 3.0, day(1, 2), 1)]).withColumn("amount", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        S.merge(path, bad, KEYS)
    assert rows_of(S.read_table(spark, path)) == was


def test_empty_table_and_empty_feed(spark, tmp_path):
    path = f"{tmp_path}/payments"
    S.write_table(payments(spark).limit(0), path)
    assert S.merge(path, feed(spark, []), KEYS).gone == [] and S.read_table(spark, path).collect() == []
    S.merge(path, feed(spark, [(1, 1, 1.0, day(1), 1)]), KEYS)
    assert S.read_table(spark, path).count() == 1
    with pytest.raises(FileNotFoundError):
        S.merge(f"{tmp_path}/none", feed(spark, []), KEYS)
