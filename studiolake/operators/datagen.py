"""Fixture-style generators, re-aimed to scale with the data.

* ``gen_classes`` (S1) lays the Sun-Fri daily class template over each box's
  observed booking-date span (so the output grows with the bookings).
* ``sequential_ids`` (S2) numbers rows 1..n in an explicit total order
  without a single-partition window: a range-partitioned sort, per-partition
  counts (one row per partition), prefix offsets, and the in-partition index.
* The seed's member x class cross join with hash sampling (S3) is not built:
  it emits all pairs within a box; see README.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from studiolake.functions import exprs as X
from studiolake.operators import staging as S

Tables = dict[str, DataFrame]

# The daily class template (name, coach, hour), days Sun..Fri.
CLASS_TEMPLATE = [
    ("Dawn lift", "Coach one", 6),
    ("Early row", "Coach one", 7),
    ("Noon mobility", "Coach two", 12),
    ("Evening lift", "Coach one", 18),
    ("Late row", "Coach two", 19),
]
TEMPLATE_CAPACITY = 20


def gen_classes(t: Tables) -> DataFrame:
    """Template classes on every Sun-Fri day of each box's booking span."""
    b = S.stg_bookings(t)
    span = b.groupBy("box_id").agg(F.min("booked_date").alias("d0"), F.max("booked_date").alias("d1"))
    days = span.select("box_id", F.explode(F.sequence("d0", "d1")).alias("class_date")) \
               .filter(X.dow0("class_date").between(0, 5))
    tmpl = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(c).alias("coach"), F.lit(h).alias("hour"))
                     for n, c, h in CLASS_TEMPLATE])
    g = days.select("box_id", "class_date", F.explode(tmpl).alias("c"))
    sched = (F.col("class_date").cast("timestamp_ntz") + F.make_interval(hours=F.col("c.hour"))).cast("timestamp_ntz")
    return g.select("box_id", F.col("c.name").alias("name"), F.col("c.coach").alias("coach"),
                    sched.alias("scheduled_at"), F.lit(TEMPLATE_CAPACITY).alias("max_capacity"))


def sequential_ids(df: DataFrame, order: list, id_col: str = "seq_id") -> DataFrame:
    """1..n in the given total order (order must be unique for determinism)."""
    from studiolake.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    # Materialise the sorted, partition-tagged rows once (reliable checkpoint in
    # the shared checkpoint folder): the counts and the numbering must see the
    # same partitioning, and a re-run after an executor loss must not re-sort.
    s = df.orderBy(*order).select("*", F.spark_partition_id().alias("_pid"),
                                  F.monotonically_increasing_id().alias("_mid")).checkpoint(eager=True)
    # monotonically_increasing_id = (partition id << 33) + row index within the partition
    s = s.withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: bounded by the partition count, safe to broadcast
    out = s.join(F.broadcast(offsets), "_pid").withColumn(id_col, F.col("_off") + F.col("_idx") + 1)
    return out.drop("_pid", "_mid", "_idx", "_off")
