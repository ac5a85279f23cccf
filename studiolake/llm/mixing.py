"""Operator 2: mix sources to target weights by hash thresholds. DataFrame functions only.

Each document has a 60-bit hash of its id and text.  Sizes are summed by (source, hash bucket); running sums over the
buckets of a source show in which bucket its budget ends, and only that bucket is dealt into finer buckets, level by
level, until it holds one hash.  A document is taken when its hash is at most its source's threshold, so nothing is
sorted by document.  All budgets use one hash, so a smaller mix is contained in a larger one.

Shares: sources by code point (null last) weigh 1, 2, 3, repeating.  A target stops at ``most`` times its source's size;
what it leaves is shared again by weight among the others.  A source of size s and target t takes each document
floor(t / s) times, and once more those under the threshold; the document at the threshold counts when that brings the
sum nearer.  Where the threshold falls on rows of equal id and text, these have one hash: they alone are dealt again, by
a hash of their place in a stored table, and the same refinement says how many of them count.

Cases: null text has size 0; null source is a source; of equal rows (same id and text) as many are taken as bring the sum
nearest (which of them: not defined); a source of size 0 has target 0; empty table: no rows.  Further columns are carried
by ``mix`` and ignored otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studiolake.llm import common as C

WEIGHTS = (1, 2, 3)
MOST = 3
HASH_BITS, LEVEL_BITS = 60, 12


def hash_of(key: Column, text: Column) -> Column:
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> with target.  One row per source passes one task."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    s = (s.withColumn("before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
         .withColumn("w_left", F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("total", F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    share = (F.col("total") - F.col("before")) / F.col("w_left")
    s = s.withColumn("share", F.when(F.col("cap") / F.col("w") >= share, share))
    s = s.withColumn("share", F.first("share", ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    full = F.col("cap").cast("double")
    return s.select("source", "source_size", F.coalesce(F.least(full, F.col("share") * F.col("w")), full).alias("target"))


def cut(measured: DataFrame, ask: DataFrame, folder: str) -> DataFrame:
    """Where the rest of each (source, budget) ends: source, budget, rest, sum_before, and of the hash there its sum and rows.

    measured: source, size, h (stored).  ask: source, budget, rest (stored; rests above 0)."""
    # open: the bucket in which the rest ends; level 0's is the whole source
    open_ = ask.select("source", "budget", "rest", F.lit(0).cast("long").alias("open"), F.lit(0).cast("long").alias("sum_before"))
    done = None
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        rows = measured.select("source", "size", "h", F.shiftrightunsigned("h", shift).alias("bucket"))
        if level > 1:
            one = open_.select(F.col("source").alias("s"), F.col("open").alias("o")).distinct()
            rows = rows.join(one, F.col("source").eqNullSafe(F.col("s")) & (F.shiftrightunsigned("h", shift + LEVEL_BITS) == F.col("o")), "left_semi")
        hist = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
        hist = C.stored(hist.withColumn("parent", F.shiftrightunsigned("bucket", LEVEL_BITS)), f"{folder}/hist{level}")
        # at most 2**LEVEL_BITS buckets in a window
        w = Window.partitionBy("source", "parent").orderBy("bucket")
        hist = hist.withColumn("upto", F.sum("sum").over(w)).select(F.col("source").alias("s"), "bucket", "parent", "sum", "rows", "low", "high", (F.col("upto") - F.col("sum")).alias("prior"))
        step = open_.join(hist, F.col("source").eqNullSafe(F.col("s")) & (F.col("open") == F.col("parent")))
        before = F.col("sum_before") + F.col("prior")
        step = step.filter((before < F.col("rest")) & (before + F.col("sum") >= F.col("rest")))
        step = step.select("source", "budget", "rest", F.col("bucket").alias("open"), before.alias("sum_before"), "sum", "rows", "low", "high")
        step = C.stored(step, f"{folder}/open{level}")
        single = F.col("low") == F.col("high")
        ends = step.filter(single).select("source", "budget", "rest", "sum_before", "sum", "rows", F.col("low").alias("at"))
        done = ends if done is None else done.unionByName(ends)
        open_ = step.filter(~single).select("source", "budget", "rest", "open", "sum_before")
        if open_.isEmpty():
            break
    return done


def _nearest() -> Column:
    """The last hash taken, so that the sum comes nearest."""
    return F.when(2 * (F.col("rest") - F.col("sum_before")) > F.col("sum"), F.col("at")).otherwise(F.col("at") - 1)


def thresholds(measured: DataFrame, shares: DataFrame, folder: str, budgets: tuple[float, ...] = (1.0,), most: int = MOST) -> DataFrame:
    """Per source and budget: repeats, and the threshold up to which documents are taken once more; where it falls on
    several rows of one hash, tie is that hash and tie_rest what they share.

    measured: source, size, h (stored).  shares: source, source_size, target (stored)."""
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("goal") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long")
    ask = (shares.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).withColumn("goal", F.col("target") * F.col("budget"))
           .withColumn("repeats", times)
           .withColumn("rest", F.when(F.col("repeats") >= most, F.lit(0.0)).otherwise(F.col("goal") - F.col("repeats") * F.col("source_size")))
           .select("source", "source_size", "target", "budget", "repeats", "rest"))
    ask = C.stored(ask, f"{folder}/ask")
    tied = F.col("rows") > 1
    done = cut(measured, ask.filter("rest > 0"), folder).select(
        F.col("source").alias("s"), F.col("budget").alias("b"), F.when(tied, F.col("at") - 1).otherwise(_nearest()).alias("threshold"),
        F.when(tied, F.col("at")).alias("tie"), F.when(tied, F.col("rest") - F.col("sum_before")).alias("tie_rest"))
    # a rest that rounding left above the sum of all: everything
    found = ask.join(done, F.col("source").eqNullSafe(F.col("s")) & (F.col("budget") == F.col("b")), "left")
    reach = F.when(F.col("rest") > 0, F.coalesce(F.col("threshold"), F.lit((1 << HASH_BITS) - 1))).otherwise(F.lit(-1))
    return C.stored(found.select("source", "source_size", "target", "budget", "repeats", reach.alias("threshold"), "tie", "tie_rest"), f"{folder}/thresholds")


def placed(table: DataFrame) -> DataFrame:
    """A stored table with copy: a hash of each row's file and place in it."""
    return table.withColumn("copy", F.shiftrightunsigned(F.xxhash64("_metadata.file_path", "_metadata.row_index"), 64 - HASH_BITS))


def tie_cuts(rows: DataFrame, cuts: DataFrame, folder: str) -> DataFrame:
    """Per source with a tie: last, the highest copy that is taken once more.  rows: source, size, h, copy of placed rows."""
    ties = cuts.filter("tie IS NOT NULL")
    on = F.col("source").eqNullSafe(F.col("s")) & (F.col("h") == F.col("tie"))
    own = rows.join(F.broadcast(ties.select(F.col("source").alias("s"), "tie")) if ties.count() <= C.BROADCAST_ROWS else ties.select(F.col("source").alias("s"), "tie"), on)
    own = C.stored(own.select("source", "size", F.col("copy").alias("h")), f"{folder}/tied")
    ends = cut(own, ties.select("source", "budget", F.col("tie_rest").alias("rest")), f"{folder}/ties")
    return C.stored(ends.select("source", _nearest().alias("last")), f"{folder}/last")


def measure(docs: DataFrame, folder: str) -> DataFrame:
    return C.stored(docs.select("doc_id", "source", C.n_words(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text")).alias("h")), f"{folder}/measured")


def plan(measured: DataFrame, folder: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budgets: tuple[float, ...] = (1.0,)) -> DataFrame:
    sizes = measured.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = C.stored(targets(sizes, weights, most), f"{folder}/shares")
    return thresholds(measured, shares, folder, budgets, most)


def copies() -> Column:
    return F.col("repeats") + F.when(F.col("h") <= F.col("threshold"), 1).otherwise(0)


def tied_copies() -> Column:
    return copies() + F.when((F.col("h") == F.col("tie")) & (F.col("copy") <= F.col("last")), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, budget: float = 1.0) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    folder = C.scratch(docs.sparkSession, "mixing")
    cuts = plan(measure(docs, folder), folder, weights, most, (budget,)).select("source", "budget", "repeats", "threshold", "tie", "tie_rest")
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("source"), hash_of(F.col("doc_id"), F.col("text")).alias("h"))
    own = C.join_small(own, cuts, ["source"])
    repeated = lambda rows, n: rows.withColumn("copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select("row.*")
    if cuts.filter("tie IS NOT NULL").isEmpty():
        return repeated(own, copies())
    at_tie = F.coalesce(F.col("h") == F.col("tie"), F.lit(False))
    ties = placed(C.stored(own.filter(at_tie).withColumn("size", C.n_words(F.col("row.text"))), f"{folder}/tied-rows"))
    ties = C.join_small(ties, tie_cuts(ties.select("source", "size", "h", "copy"), cuts, folder), ["source"])
    return repeated(own.filter(~at_tie), copies()).unionByName(repeated(ties, tied_copies()))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "mixing")
    measured = measure(C.read(spark, sf_dir, "documents"), folder)
    cuts = plan(measured, folder)
    rows, times = C.join_small(measured, cuts, ["source"]), copies()
    if not cuts.filter("tie IS NOT NULL").isEmpty():
        own = placed(measured)
        rows, times = C.join_small(C.join_small(own, cuts, ["source"]), tie_cuts(own, cuts, folder), ["source"]), tied_copies()
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


# One pass that sorts each source by hash; the operator never does.
MIX_CTES = r"""
mx_docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
mx_sources AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM mx_docs GROUP BY source),
mx_weighed AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM mx_sources),
mx_level AS (
  SELECT c.cap / c.w AS cutoff,
         ((SELECT sum(source_size) FROM mx_sources) - coalesce(sum(o.cap) FILTER (o.cap / o.w < c.cap / c.w), 0))::BIGINT
           / (sum(o.w) FILTER (o.cap / o.w >= c.cap / c.w))::BIGINT AS share
  FROM mx_weighed c CROSS JOIN mx_weighed o GROUP BY c.source, c.cap, c.w),
mx_share AS (SELECT max(share) AS share FROM mx_level WHERE cutoff >= share),
mx_targets AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, share * w), cap::DOUBLE) AS target FROM mx_weighed, mx_share),
mx_goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS repeats FROM mx_targets),
mx_rest AS (SELECT *, CASE WHEN repeats >= 3 THEN 0.0 ELSE target - repeats * source_size END AS rest FROM mx_goal),
mx_numbered AS (SELECT *, row_number() OVER (PARTITION BY source, h) AS copy FROM mx_docs),
mx_run AS (SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY h, copy))::BIGINT - size AS before FROM mx_numbered)
"""

ORACLES = {"op2_mixing": "WITH " + MIX_CTES + """
SELECT r.doc_id, r.size, t.source_size, t.target,
       r.size * (t.repeats + CASE WHEN 2 * (t.rest - r.before) > r.size THEN 1 ELSE 0 END) AS taken
FROM mx_run r JOIN mx_rest t ON r.source IS NOT DISTINCT FROM t.source"""}
QUERIES = {"op2_mixing": op2_mixing}
