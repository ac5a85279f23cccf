"""Hand-checked expectations for the semantic traps."""

import datetime as dt

from pyspark.sql import functions as F

from studiolake.functions import exprs as X


def one(spark, expr, schema="x int", row=(1,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).collect()[0]["v"]


def test_dow0_sunday_is_zero(spark):  # T2
    assert one(spark, X.dow0(F.lit(dt.date(2026, 1, 4)))) == 0
    assert one(spark, X.dow0(F.lit(dt.date(2026, 1, 10)))) == 6


def test_week_starts_monday(spark):  # T3
    assert one(spark, X.week_start(F.lit(dt.date(2026, 1, 4)))) == dt.date(2025, 12, 29)


def test_half_up_ratio_exact_halves(spark):  # T7
    assert one(spark, X.half_up_ratio(F.lit(1), F.lit(2))) == 1          # 0.5 -> 1
    assert one(spark, X.half_up_ratio(F.lit(-1), F.lit(2))) == -1        # -0.5 -> -1 (away from zero)
    assert one(spark, X.pct_half_up(F.lit(1), F.lit(8), 1)) == 12.5      # 12.5 exactly
    assert one(spark, X.pct_half_up(F.lit(1), F.lit(3), 1)) == 33.3
    assert one(spark, X.pct_half_up(F.lit(2), F.lit(3), 1)) == 66.7
    assert one(spark, X.pct_half_up(F.lit(1), F.lit(0), 1)) is None      # T9 nullif


def test_js_round_halves_up(spark):  # T17
    assert one(spark, X.js_round(F.lit(2.5))) == 3
    assert one(spark, X.js_round(F.lit(-2.5))) == -2


def test_age_quarter_days(spark):  # T6
    q = one(spark, X.age_quarter_days(F.lit(dt.date(2026, 3, 1)), F.lit(dt.date(2025, 1, 31))))
    assert q * 21600 == 34_236_000            # 1 y 1 m 1 d
    assert one(spark, X.age_quarter_days(F.lit(dt.date(2025, 3, 15)), F.lit(dt.date(2025, 1, 15)))) == 240


def test_plan_capacity_rules(spark):  # D5
    cases = {"ללא הגבלה": 28, "Monthly UNLIMITED": 28, "3 כניסות בשבוע": 12, "8 כניסות חודשיות": 8,
             "10 כניסות בחודש": 10, "Annual Plan": 12, None: 12}
    rows = [(k,) for k in cases]
    got = spark.createDataFrame(rows, "p string").select("p", X.plan_capacity("p").alias("c")).collect()
    assert {r["p"]: r["c"] for r in got} == cases


def test_least_ignores_null(spark):  # T10
    assert one(spark, F.least(F.lit(40), X.half_up_ratio(F.lit(5), F.lit(0)))) == 40


def test_clean_date(spark):  # B2
    rows = [("2025-03-04",), ("2025-03-04T10:00:00",), ("0000-00-00",), ("-0001-11-30",), ("",), (None,),
            ("garbage",)]
    got = [r["d"] for r in spark.createDataFrame(rows, "s string").select(X.clean_date("s").alias("d")).collect()]
    assert got == [dt.date(2025, 3, 4), dt.date(2025, 3, 4), None, None, None, None, None]


def test_phone_key(spark):  # B5
    rows = [("+972 52-123-4567",), ("052-1234567",), ("12-34",), ("",), (None,), ("abc",)]
    got = [r["k"] for r in spark.createDataFrame(rows, "s string").select(X.phone_key("s").alias("k")).collect()]
    assert got == ["521234567", "521234567", "1234", None, None, None]


def test_lead_status_first_match_wins(spark):  # B4
    rows = [("Converted",), ("lost - trial",), ("Trial booked",), ("in process",), ("follow up",),
            ("הפך ללקוח",), ("לא רלוונטי",), ("ניסיון",), (None,), ("whatever",)]
    got = [r["s"] for r in spark.createDataFrame(rows, "s string").select(X.lead_status("s").alias("s")).collect()]
    assert got == ["converted", "lost", "trial_booked", "in_progress", "in_progress", "converted", "lost",
                   "trial_booked", "new", "new"]


def test_concat_null_propagates(spark):  # T13
    v = one(spark, F.concat(F.lit("a"), F.lit(" "), F.lit(None).cast("string")))
    assert v is None


def test_intl_phone(spark):  # K9
    assert one(spark, X.intl_phone(F.lit("052-123 4567"))) == "972521234567"


def test_digits_only_int(spark):  # B12
    rows = [("12",), ("",), ("n/a",), (None,), ("3a",)]
    got = [r["v"] for r in spark.createDataFrame(rows, "s string").select(X.digits_only_int("s").alias("v")).collect()]
    assert got == [12, None, None, None, None]


def test_mode_ties_first_in_order(spark):  # T19
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",)], "c string")
    assert df.agg(F.mode("c", True).alias("m")).collect()[0]["m"] == "a"
