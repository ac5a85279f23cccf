"""Table constraints re-aimed as data-quality checks.

Spark does not enforce keys, NOT NULL, CHECK or foreign keys on parquet, so
each constraint becomes a query returning its violations.  Every check is one
aggregate per table (references: one join for all); results are tiny and unioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = dict[str, DataFrame]

# The constraints of the canonical schema.
UNIQUE_KEYS = {
    "boxes": ["access_token"],
    "members": ["box_id", "source_member_id"],
    "memberships": ["box_id", "source_membership_id"],
    "payments": ["box_id", "source_payment_id"],
    "classes": ["box_id", "source_class_id"],
    "freezes": ["box_id", "source_hold_id"],
    "attendance": ["box_id", "member_id", "class_id"],
    "leads": ["box_id", "source_lead_id"],
    "bookings": ["box_id", "source_user_id", "booked_date", "booked_time", "class_name"],
}
NOT_NULL = {
    "boxes": ["name", "email", "access_token", "created_at"],
    "members": ["box_id", "source_member_id", "name", "status", "created_at"],
    "memberships": ["box_id", "member_id", "source_membership_id", "status", "created_at"],
    "payments": ["box_id", "member_id", "source_payment_id", "amount", "status", "created_at"],
    "classes": ["box_id", "source_class_id", "name", "created_at"],
    "freezes": ["box_id", "source_hold_id", "synced_at"],
    "attendance": ["box_id", "member_id", "class_id", "checked_in", "created_at"],
    "leads": ["box_id", "source_lead_id", "status", "created_at"],
}
ACCEPTED = {
    ("members", "status"): ["active", "inactive"],
    ("memberships", "status"): ["active", "expired", "cancelled"],
    ("payments", "status"): ["paid", "pending", "overdue"],
    ("leads", "status"): ["new", "in_progress", "trial_booked", "converted", "lost"],
}
KEY_BYTES = 4 << 20  # input bytes for each task that counts keys: some 100,000s of rows
FOREIGN_KEYS = [  # (child, column, parent, parent key)
    ("members", "box_id", "boxes", "id"),
    ("memberships", "box_id", "boxes", "id"),
    ("memberships", "member_id", "members", "id"),
    ("payments", "box_id", "boxes", "id"),
    ("payments", "member_id", "members", "id"),
    ("classes", "box_id", "boxes", "id"),
    ("freezes", "box_id", "boxes", "id"),
    ("freezes", "member_id", "members", "id"),
    ("attendance", "box_id", "boxes", "id"),
    ("attendance", "member_id", "members", "id"),
    ("attendance", "class_id", "classes", "id"),
    ("leads", "box_id", "boxes", "id"),
]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _key_text(cols: list[str]) -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _tasks(df: DataFrame, sizes: dict[str, int]) -> int:
    """Tasks for the rows of a table by the bytes of the files it is read from; 0 where it isn't read from files.
    ``sizes``: of the files known already."""
    spark, files = df.sparkSession, df.inputFiles()
    for f in files:
        if f not in sizes:
            place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
            sizes[f] = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getLen()
    return -(-sum(sizes[f] for f in files) // KEY_BYTES)


def dq_unique(t: Tables, keys: dict[str, list[str]] = UNIQUE_KEYS) -> DataFrame:
    """Business keys that occur more than once: (table, key, n).

    Nearly every row is a key of its own, so a count before the shuffle would hold a task's whole input: the rows are dealt by
    key first, into tasks whose number follows the input."""
    parts, sizes = [], {}
    for table, cols in keys.items():
        rows, tasks = t[table].select(*cols), _tasks(t[table], sizes)
        dealt = rows.repartition(tasks, *cols) if tasks else rows.repartition(*cols)
        g = dealt.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        parts.append(g.select(F.lit(table).alias("table_name"), F.lit("unique").alias("check"),
                              _key_text(cols).alias("key"), "n"))
    return _union(parts)


def dq_not_null(t: Tables, spec: dict[str, list[str]] = NOT_NULL) -> DataFrame:
    """R2: NULL counts of required columns, one aggregate pass per table."""
    parts = []
    for table, cols in spec.items():
        agg = t[table].agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
        long = agg.unpivot([], cols, "key", "n")
        parts.append(long.select(F.lit(table).alias("table_name"), F.lit("not_null").alias("check"), "key", "n")
                         .filter(F.col("n") > 0))
    return _union(parts)


def dq_accepted_values(t: Tables, spec=ACCEPTED) -> DataFrame:
    """Values outside the accepted set (NULL is a not-null matter): (table, value, n)."""
    parts = []
    for (table, c), values in spec.items():
        df = t[table].filter(F.col(c).isNotNull() & ~F.col(c).isin(values))
        parts.append(df.groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
                       .select(F.lit(table).alias("table_name"), F.lit(f"accepted_values:{c}").alias("check"),
                               "key", "n"))
    return _union(parts)


def dq_orphans(t: Tables, fks=FOREIGN_KEYS) -> DataFrame:
    """Child rows whose (non-NULL) reference has no parent: (table, value, n).

    Each child is read once: its references are unpivoted to (reference, parent,
    value) and counted, so a hot parent is one row per task before the shuffle.
    Each parent is read once as (parent, key), and one join finds the rest."""
    refs, keys = [], []
    for child in dict.fromkeys(c for c, *_ in fks):
        own = [F.struct(F.lit(f"references:{c}->{parent}").alias("check"), F.lit(parent).alias("parent"), F.col(c).cast("string").alias("key"))
               for table, c, parent, _ in fks if table == child]
        refs.append(t[child].select(F.lit(child).alias("table_name"), F.inline(F.array(*own))).filter(F.col("key").isNotNull()))
    for parent, pk in dict.fromkeys((p, k) for _, _, p, k in fks):
        keys.append(t[parent].select(F.lit(parent).alias("parent"), F.col(pk).cast("string").alias("key")))
    counted = _union(refs).groupBy("table_name", "check", "parent", "key").agg(F.count(F.lit(1)).alias("n"))
    # An outer join: an anti join would be pushed below the union, one for each child.
    known = _union(keys).withColumn("_known", F.lit(True))
    return counted.join(known, ["parent", "key"], "left").filter(F.col("_known").isNull()).select("table_name", "check", "key", "n")


def dq_match_rate(t: Tables) -> DataFrame:
    """Share of bookings that find their class session, per box."""
    from studiolake.operators import staging as S
    from studiolake.functions import exprs as X
    b = S.stg_bookings(t)
    c = S.stg_classes(t).select(F.col("box_id").alias("c_box"), F.col("class_name").alias("c_name"),
                                "class_date", "class_time").distinct().withColumn("_hit", F.lit(True))
    j = b.join(c, (b.booked_date == c.class_date) & (b.booked_time == c.class_time)
               & (b.class_name == c.c_name) & (b.box_id == c.c_box), "left")
    agg = j.groupBy("box_id").agg(F.count(F.lit(1)).alias("bookings"),
                                  F.count_if(F.col("_hit").isNotNull()).alias("matched"))
    return agg.select("box_id", "bookings", "matched", X.pct_half_up("matched", "bookings", 1).alias("match_pct"))


def cascade_delete(child: DataFrame, parents: DataFrame, fk: str, pk: str = "id",
                   mode: str = "delete") -> DataFrame:
    """Apply ON DELETE CASCADE (drop children of removed parents) or
    ON DELETE SET NULL (null the reference) against the surviving parents."""
    keys = parents.select(F.col(pk).alias("_pk")).distinct()
    if mode == "delete":
        return child.join(keys, child[fk] == keys["_pk"], "left_semi")
    j = child.join(keys, child[fk] == keys["_pk"], "left")
    return j.select(*[(F.when(F.col("_pk").isNull(), F.lit(None)).otherwise(F.col(fk)).cast(child.schema[fk].dataType)
                       .alias(fk) if c == fk else F.col(c)) for c in child.columns])
