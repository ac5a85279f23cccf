"""Sources, sinks, the sync pipeline and the streaming upsert."""

import os
import re
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studiolake.operators import build
from studiolake.operators import ingest as I
from studiolake.operators.build import refresh_models, run_models
from studiolake.operators.datagen import sequential_ids
from studiolake.operators.sync import sync
from studiolake.sources import adapter as AD
from studiolake.sources import feeds as FD
from studiolake.sources import tables as S
from studiolake.sources.pages import AMBIGUOUS, IncompleteReport, land_pages, page_completeness, read_pages
from studiolake.sources.tables import load, read_table, save_all, write_table
from studiolake.streaming.page_stream import run_upsert_stream

SF = "/root/testdata/sf0.001"


def test_sequential_ids_dense_and_ordered(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k"))
    out = sequential_ids(df, [F.col("k")])
    r = out.agg(F.min("seq_id"), F.max("seq_id"), F.count_distinct("seq_id"),
                F.sum((F.col("seq_id") != F.col("k") + 1).cast("int"))).collect()[0]
    assert tuple(r) == (1, 5000, 5000, 0)


def test_pages_round_trip_and_completeness(spark):
    raw = AD.read_driver(spark, SF)
    sales = FD.sales_feed(raw)
    path = tempfile.mkdtemp(prefix="pages-") + "/sales"
    land_pages(sales, path, page_size=100, order_cols=["feed_pos"])
    back = read_pages(spark, path, sales.schema)
    assert back.count() == sales.count()
    assert back.exceptAll(sales).count() == 0
    assert page_completeness(spark, path, sales.schema).collect()[0]["complete"]


def test_store_round_trip_partitioned(spark, tables):
    store = tempfile.mkdtemp(prefix="store-")
    save_all({"members": tables["members"]}, store)
    back = load(spark, store, ["members"])["members"]
    assert back.count() == tables["members"].count()
    one = back.filter(F.col("box_id") == 1)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*box_id#\d+ = 1\)", plan)
    assert {f.split("box_id=")[1].split("/")[0] for f in one.inputFiles()} >= {"1"}
    assert {f.name: f.dataType for f in back.schema} == {f.name: f.dataType for f in tables["members"].schema}


def test_store_keeps_types_versions_and_failures(spark):
    path = tempfile.mkdtemp(prefix="store-") + "/t"
    write_table(spark.createDataFrame([("007", 1)], "box_id string, v int"), path)
    assert [tuple(r) for r in read_table(spark, path).select("box_id", "v").collect()] == [("007", 1)]
    bad = spark.createDataFrame([("8", 1)], "box_id string, v int").withColumn("v", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        write_table(bad, path)
    assert [tuple(r) for r in read_table(spark, path).select("box_id", "v").collect()] == [("007", 1)]
    write_table(read_table(spark, path).withColumn("v", F.col("v") + 1), path)
    assert [tuple(r) for r in read_table(spark, path).select("box_id", "v").collect()] == [("007", 2)]
    write_table(read_table(spark, path).limit(0), path)
    assert read_table(spark, path).collect() == []
    with pytest.raises(FileNotFoundError):
        read_table(spark, path + "x")


def test_every_source_row_reaches_the_tables(spark):
    raw = AD.read_driver(spark, SF)
    t, feeds = AD.canonical_from_raw(raw), FD.all_feeds(raw)
    lines, orders, events = (raw[n].count() for n in ("lineitem", "orders", "events"))
    assert t["bookings"].count() == lines == feeds["bookings"].count() == feeds["holds"].count() == feeds["sales"].count()
    assert t["freezes"].count() == orders == t["payments"].count() and t["leads"].count() == events == feeds["leads"].count()


def test_broken_and_missing_pages_are_errors(spark):
    base = tempfile.mkdtemp(prefix="pages-")
    schema = T.StructType([T.StructField("v", T.LongType())])
    page = '{"page": %d, "data": [{"v": %d}], "extra": {"pagination": {"total_pages": 3}}}'
    for name, lines in {"whole": [1, 2, 3], "missing": [1, 3], "broken": [1, 2, 3]}.items():
        text = [page % (k, k) for k in lines]
        if name == "broken":
            text[1] = text[1][:30]
        spark.createDataFrame([(x,) for x in text], "value string").coalesce(1).write.text(f"{base}/{name}")
    assert sorted(r.v for r in read_pages(spark, f"{base}/whole", schema).collect()) == [1, 2, 3]
    with pytest.raises(IncompleteReport):
        read_pages(spark, f"{base}/missing", schema)
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST"):
        read_pages(spark, f"{base}/broken", schema).collect()


SYNCED = ["members", "memberships", "payments", "classes", "bookings", "leads", "freezes"]


@pytest.fixture(scope="module")
def synced(spark):
    """A store after a full sync with a purge: feeds, tables before, store, changes."""
    raw = AD.read_driver(spark, SF)
    feeds, current, store = FD.all_feeds(raw), AD.canonical_from_raw(raw), tempfile.mkdtemp(prefix="sync-")
    save_all(current, store)
    return feeds, current, store, sync(spark, feeds, store, AD.AS_OF, purge_box=2)


def test_full_sync_purges_what_hangs_on_seed_members(spark, synced):
    feeds, current, store, done = synced
    after = load(spark, store)
    assert after["attendance"].filter("box_id = 2").count() == 0 < current["attendance"].filter("box_id = 2").count()
    assert after["attendance"].filter("box_id <> 2").count() == current["attendance"].filter("box_id <> 2").count()
    seeds = current["members"].filter("box_id = 2 AND source_member_id < 10000").select(F.col("id").alias("member_id"))
    assert seeds.count() > 0 and after["members"].join(seeds.withColumnRenamed("member_id", "id"), "id").count() == 0
    for child in ["memberships", "payments", "freezes"]:
        assert after[child].join(seeds, "member_id").count() == 0, child
    assert after["freezes"].count() >= current["freezes"].count()
    assert done["purge attendance"].looked_up == [] and all("box_id=2/" in f for f in done["purge members"].gone)


def test_a_second_sync_changes_no_row(spark, synced):
    feeds, _, store, _ = synced
    before = {n: S.version(spark, f"{store}/{n}") for n in SYNCED}
    sync(spark, feeds, store, AD.AS_OF)
    for name in SYNCED:  # rows with a NULL key part too
        a, b = (sorted(map(repr, read_table(spark, f"{store}/{name}", number=n).collect())) for n in (before[name], None))
        assert a == b, name


def test_models_follow_the_boxes_that_changed(spark, tables, monkeypatch):
    store, out, whole = (tempfile.mkdtemp(prefix=p) for p in ("store-", "models-", "whole-"))
    save_all(tables, store)
    assert refresh_models(spark, store, out, AD.AS_OF, AD.AS_OF_LEADS) is None
    assert refresh_models(spark, store, out, AD.AS_OF, AD.AS_OF_LEADS) == []
    names = [n for n in os.listdir(out) if n != "refreshed"]
    assert len(names) == 19
    before = {n: set(S._names(S.manifest(spark, f"{out}/{n}"))) for n in names}
    some = tables["payments"].filter("box_id = 3").orderBy("id").limit(3).select("box_id", "source_payment_id", F.lit("overdue").alias("status"))
    S.merge(f"{store}/payments", some, I.UPSERT_KEYS["payments"], pos=None, insert=False)
    assert refresh_models(spark, store, out, AD.AS_OF, AD.AS_OF_LEADS) == ["3"]
    run_models(spark, load(spark, store), whole, AD.AS_OF, AD.AS_OF_LEADS)
    for n in names:
        differ = before[n] ^ set(S._names(S.manifest(spark, f"{out}/{n}")))
        assert all("/box_id=3/" in f for f in differ), n
        got, want = read_table(spark, f"{out}/{n}").collect(), read_table(spark, f"{whole}/{n}").collect()
        assert sorted(map(repr, got)) == sorted(map(repr, want)), n
    built = []
    monkeypatch.setattr(build, "run_models", lambda *a: built.append(a[3]))
    assert refresh_models(spark, store, out, AD.AS_OF_LEADS, AD.AS_OF_LEADS) is None and built == [AD.AS_OF_LEADS]  # another date: all


def _payment_stream(spark, base, rows, schema, table, mmap, **more):
    return run_upsert_stream(spark, f"{base}/landing", schema, table, f"{base}/ckpt", I.UPSERT_KEYS["payments"], "sales",
                             prepare=lambda b: I.build_payments(b, mmap), defaults={"id": I.surrogate("_key_box_id", "_key_source_payment_id")}, **more)


def test_streaming_merge_matches_batch_and_replays_once(spark):
    raw = AD.read_driver(spark, SF)
    sales, t = FD.sales_feed(raw), AD.canonical_from_raw(raw)
    base = tempfile.mkdtemp(prefix="stream-")
    land_pages(sales, f"{base}/landing", page_size=500, order_cols=["feed_pos"])
    table, mmap = f"{base}/payments", I.member_map(t["members"])
    write_table(t["payments"], table)
    changes = _payment_stream(spark, base, sales, sales.schema, table, mmap)
    batch = I.upsert(t["payments"], I.build_payments(sales, mmap), I.UPSERT_KEYS["payments"], defaults={"id": I.surrogate("_key_box_id", "_key_source_payment_id")})
    streamed = read_table(spark, table).select(batch.columns)
    assert changes and streamed.exceptAll(batch).count() == 0 and streamed.count() == batch.count()
    # The stream fails after its commit: the last epoch's own record is lost, the batch comes again and does nothing.
    number = S.version(spark, table)
    for n in sorted(os.listdir(f"{base}/ckpt/commits")):
        if n.strip(".").split(".")[0] == str(len(changes) - 1):
            os.remove(f"{base}/ckpt/commits/{n}")
    again = _payment_stream(spark, base, sales, sales.schema, table, mmap)
    assert [c.repeated for c in again] == [True] and S.version(spark, table) == number
    assert read_table(spark, table).count() == batch.count()


@pytest.mark.parametrize(("lines", "error"), [([1, 3], "pages landed"), ([1, 2, -3], "MALFORMED|Malformed|FAILED_READ_FILE")])
def test_a_broken_or_missing_page_fails_the_stream(spark, lines, error):
    base, schema = tempfile.mkdtemp(prefix="stream-"), T.StructType([T.StructField("box_id", T.IntegerType()), T.StructField("v", T.LongType())])
    text = ['{"page": %d, "data": [{"box_id": 1, "v": %d}], "extra": {"pagination": {"total_pages": 3}}}' % (abs(k), k) for k in lines]
    spark.createDataFrame([(x if k > 0 else x[:40],) for x, k in zip(text, lines, strict=True)], "value string").coalesce(1).write.text(f"{base}/landing")
    write_table(spark.createDataFrame([], schema), f"{base}/t")
    with pytest.raises(Exception, match=error):
        run_upsert_stream(spark, f"{base}/landing", schema, f"{base}/t", f"{base}/ckpt", ["box_id", "v"], "s", pos=None)


def test_absent_fields_and_explicit_nulls(spark):
    path = tempfile.mkdtemp(prefix="pages-") + "/p"
    rows = ['{"user_id": 1, "price": null}', '{"user_id": 2}', '{"user_id": 3, "price": 4.5, "user_role": null}', '{"user_id": 4, "price": 0, "user_role": "client"}']
    spark.createDataFrame([('{"page": 1, "data": [%s]}' % ",".join(rows),)], "value string").write.text(path)
    schema = T.StructType.fromDDL("user_id bigint, price double, user_role string")
    got = read_pages(spark, path, schema, absent=AMBIGUOUS)  # no number of pages: one
    seen = {r.user_id: (r.price, r.user_role, r.absent) for r in got.collect()}
    assert seen == {1: (None, None, ["user_role"]), 2: (None, None, ["price", "user_role"]), 3: (4.5, None, None), 4: (0.0, "client", None)}
    price = {r.user_id: r.p for r in got.select("user_id", I.given(got, "price", 0.0).alias("p")).collect()}
    assert price == {1: None, 2: 0.0, 3: 4.5, 4: 0.0}
    kept = [r.user_id for r in got.filter(I.given(got, "user_role", "client").isin("client", "")).collect()]
    assert sorted(kept) == [1, 2, 4]
    assert "absent" not in read_pages(spark, path, schema).columns
    spark.createDataFrame([('{"page": 2, "data": []}',)], "value string").write.mode("append").text(path)
    with pytest.raises(IncompleteReport):  # two pages, none of which says so
        read_pages(spark, path, schema)


def test_run_models_writes_every_mart(spark, tables):
    out = tempfile.mkdtemp(prefix="models-")
    paths = run_models(spark, tables, out, AD.AS_OF, AD.AS_OF_LEADS)
    assert len(paths) == 19
    hs = read_table(spark, paths["mart_health_scores"])
    assert hs.count() == tables["members"].count()
    assert read_table(spark, paths["mart_monetization"]).filter("record_type = 'summary'").count() > 0


def test_landed_pages_take_little_space(spark, tmp_path):
    """Field names repeat in every row of a page; the files are compressed, and read as before."""
    import glob
    import os
    rows = spark.range(5000).selectExpr("id AS a_field_with_a_long_name", "id % 7 AS another_field_with_a_long_name", "id AS feed_pos")
    path = str(tmp_path / "pages")
    land_pages(rows, path, order_cols=["feed_pos"])
    files = glob.glob(f"{path}/part-*")
    text = sum(len(r.value) for r in spark.read.text(path).collect())
    assert files and sum(os.path.getsize(f) for f in files) * 5 < text
    assert sorted(read_pages(spark, path, rows.schema).collect()) == sorted(rows.collect())


def test_store_derives_bookings_once(spark, tables):
    """Classes and attendance are made of the stored bookings; the tables are those of the adapter."""
    from studiolake.plans.q_ingest import _store
    from studiolake.sources.tables import load
    for names in (["attendance", "payments", "classes"], ["bookings", "classes", "attendance"]):
        store = _store({n: tables[n] for n in ("members", "bookings", "payments")}, names)  # nothing else is derived
        for n, df in load(spark, store, names).items():
            assert df.exceptAll(tables[n]).isEmpty() and tables[n].exceptAll(df).isEmpty() and df.columns == tables[n].columns, n
            assert df.count() == tables[n].count()
