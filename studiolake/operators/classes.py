"""H1-H8: class sessions and usage (five record types).

Plan notes
* Bookings join classes on the four session keys (date, time text, name,
  box); the composite key spreads evenly even when one box dominates.
* The session rollup (H2) feeds five aggregates.  The union mart (H8) builds
  them in one pass (grouping sets), so the rollup is computed once; the single-type functions
  (H3-H7) remain for callers that need one record type.
* Per-session rates are kept as integer tenths of a percent so that the
  averages of already-rounded rates (double rounding) are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]

SESSION_KEYS = ["box_id", "class_name", "coach", "booked_date", "booked_time", "booked_week",
                "day_of_week", "hour_of_day", "max_capacity"]


def enriched_bookings(t: Tables) -> DataFrame:
    """H1: bookings matched to their class (inner: unmatched bookings drop)."""
    b = S.stg_bookings(t)
    c = S.stg_classes(t).select(F.col("box_id").alias("c_box"), F.col("class_name").alias("c_name"),
                                "class_date", "class_time", "max_capacity")
    j = b.join(c, (b.booked_date == c.class_date) & (b.booked_time == c.class_time)
               & (b.class_name == c.c_name) & (b.box_id == c.c_box))
    return j.select("box_id", "member_id", "class_name", "coach", "booked_date", "booked_time", "booked_week",
                    "day_of_week", "hour_of_day", "checked_in", "is_first_session", "max_capacity")


def _tenths(num, den) -> F.Column:
    """round(num / nullif(den,0) * 100, 1) expressed in integer tenths."""
    return X.half_up_ratio(X.col(num).cast("decimal(38,0)") * 1000, den, 0)


def class_sessions(t: Tables, keep_tenths: bool = False) -> DataFrame:
    """H2: one row per session with registrations, check-ins, first-timers and rates."""
    e = enriched_bookings(t)
    s = e.groupBy(*SESSION_KEYS).agg(
        F.count(F.lit(1)).alias("registrations"),
        F.count_if("checked_in").alias("checkins"),
        F.count_if("is_first_session").alias("first_timers"))
    s = s.select("*", _tenths("checkins", "max_capacity").alias("fill_t"),
                 _tenths("registrations", "max_capacity").alias("reg_t"),
                 _tenths("checkins", "registrations").alias("show_t"))
    s = s.select("*", (F.col("fill_t") / 10.0).alias("fill_rate"),
                 (F.col("reg_t") / 10.0).alias("registration_rate"),
                 (F.col("show_t") / 10.0).alias("showup_rate"))
    return s if keep_tenths else s.drop("fill_t", "reg_t", "show_t")


def _avg_tenths(c: str) -> F.Column:
    # round(avg(rate), 1) where rate = tenths / 10  ->  round(sum / count) tenths
    return X.half_up_ratio(F.sum(c), F.count(c)) / 10.0


def _showup(ch: str = "checkins", reg: str = "registrations") -> F.Column:
    return X.pct_half_up(F.sum(ch), F.sum(reg), 1)


def class_summary(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """H3: per box."""
    s = sessions if sessions is not None else class_sessions(t, keep_tenths=True)
    return s.groupBy("box_id").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("registrations").alias("total_registrations"),
        F.sum("checkins").alias("total_checkins"), F.sum("first_timers").alias("total_first_timers"),
        _avg_tenths("fill_t").alias("avg_fill_rate"), _avg_tenths("reg_t").alias("avg_registration_rate"),
        _showup().alias("avg_showup_rate"))


def coach_leaderboard(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """H4: per coach (non-empty), with the most frequent class (ties: first by name)."""
    s = sessions if sessions is not None else class_sessions(t, keep_tenths=True)
    return (s.filter(F.col("coach").isNotNull() & (F.col("coach") != ""))
             .groupBy("box_id", F.col("coach").alias("label")).agg(
                 F.count(F.lit(1)).alias("total_sessions"), F.sum("registrations").alias("total_registrations"),
                 F.sum("checkins").alias("total_checkins"), _avg_tenths("fill_t").alias("avg_fill_rate"),
                 _showup().alias("avg_showup_rate"), F.mode("class_name", True).alias("top_class")))


def class_types(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """H5: per class name."""
    s = sessions if sessions is not None else class_sessions(t, keep_tenths=True)
    return s.groupBy("box_id", F.col("class_name").alias("label")).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("registrations").alias("total_registrations"),
        F.sum("checkins").alias("total_checkins"), _avg_tenths("fill_t").alias("avg_fill_rate"),
        _showup().alias("avg_showup_rate"))


def class_weekly(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """H6: per booking week."""
    s = sessions if sessions is not None else class_sessions(t, keep_tenths=True)
    return s.groupBy("box_id", F.col("booked_week").alias("period_start")).agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("registrations").alias("total_registrations"),
        F.sum("checkins").alias("total_checkins"), _avg_tenths("fill_t").alias("avg_fill_rate"))


def class_heatmap(t: Tables, sessions: DataFrame | None = None) -> DataFrame:
    """H7: per day of week x hour."""
    s = sessions if sessions is not None else class_sessions(t, keep_tenths=True)
    return s.groupBy("box_id", "day_of_week", "hour_of_day").agg(
        F.count(F.lit(1)).alias("total_sessions"), F.sum("checkins").alias("total_checkins"),
        _avg_tenths("fill_t").alias("avg_fill_rate"))


CLASSES_COLUMNS = [
    ("record_type", "string"), ("box_id", "bigint"), ("label", "string"), ("total_sessions", "bigint"),
    ("total_registrations", "bigint"), ("total_checkins", "bigint"), ("total_first_timers", "bigint"),
    ("avg_fill_rate", "double"), ("avg_showup_rate", "double"), ("period_start", "date"),
    ("day_of_week", "int"), ("hour_of_day", "int"), ("top_class", "string"),
]


def _shape(df: DataFrame, record_type: str | None) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.lit(record_type) if n == "record_type" and record_type else (F.col(n) if n in have else F.lit(None)))
        .cast(ty).alias(n) for n, ty in CLASSES_COLUMNS])


#: Grouping columns of the mart and, by grouping_id over them, its record types; the last set counts a coach's classes.
_GROUPS = ["coach", "class_name", "booked_week", "day_of_week", "hour_of_day"]
_SETS = {"summary": [], "by_coach": ["coach"], "by_class_type": ["class_name"], "weekly_trend": ["booked_week"],
         "heatmap": ["day_of_week", "hour_of_day"], "coach_class": ["coach", "class_name"]}


def _grouping_id(columns: list[str]) -> int:
    return sum(1 << (len(_GROUPS) - 1 - i) for i, c in enumerate(_GROUPS) if c not in columns)


def classes_mart(t: Tables) -> DataFrame:
    """H8: the five record types in ONE pass over the session rollup.

    ``GROUPING SETS`` over the session rows (an Expand, then one hash aggregate
    with partial sums before the shuffle, so the per-box summary key of a
    dominant box is combined first).  A sixth set counts each coach's classes;
    the coach's most frequent class (ties: first by name) is the head of those
    few rows, taken by a window over the aggregated rows.
    """
    s = class_sessions(t, keep_tenths=True)
    sets = [[F.col(c) for c in ["box_id", *columns]] for columns in _SETS.values()]
    g = s.groupingSets(sets, "box_id", *_GROUPS).agg(
        F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("total_sessions"), F.sum("registrations").alias("total_registrations"),
        F.sum("checkins").alias("total_checkins"), F.sum("first_timers").alias("total_first_timers"),
        _avg_tenths("fill_t").alias("avg_fill_rate"), _showup().alias("avg_showup_rate"))
    kind = F.lit(None).cast("string")
    for name, columns in _SETS.items():
        kind = F.when(F.col("gid") == _grouping_id(columns), F.lit(name)).otherwise(kind)
    g = g.withColumn("record_type", kind).filter(~F.col("record_type").isin("by_coach", "coach_class") | (F.coalesce(F.col("coach"), F.lit("")) != ""))
    rt = F.col("record_type")
    # A coach's own row comes after its class rows, the most frequent first.
    about = F.when(rt.isin("by_coach", "coach_class"), F.lit("coach")).otherwise(rt)
    order = Window.partitionBy("box_id", about, "coach").orderBy(rt == "by_coach", F.desc("total_sessions"), "class_name").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    g = g.withColumn("top_class", F.first("class_name").over(order)).filter(rt != "coach_class")

    def only(c, *types):
        return F.when(rt.isin(*types), F.col(c))

    return _shape(g.select(
        "record_type", "box_id", F.when(rt == "by_coach", F.col("coach")).when(rt == "by_class_type", F.col("class_name")).alias("label"), "total_sessions",
        only("total_registrations", "summary", "by_coach", "by_class_type", "weekly_trend")
        .alias("total_registrations"),
        "total_checkins", only("total_first_timers", "summary").alias("total_first_timers"), "avg_fill_rate",
        only("avg_showup_rate", "summary", "by_coach", "by_class_type").alias("avg_showup_rate"),
        F.col("booked_week").alias("period_start"), "day_of_week", "hour_of_day", only("top_class", "by_coach").alias("top_class")),
        None)
