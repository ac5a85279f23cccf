"""Canonical table storage as partition folders under a commit log.

A table is a folder with

* ``data/w=<write>/box_id=<box>/part=<part>`` - Parquet; ``part`` is a month of a date column or a hash bucket of the key,
* ``manifests/<write>`` - Parquet; one row per folder that belongs to the table, with its rows and the least and greatest
  date and source id in it,
* ``commits`` - an append-only Parquet log, one row per finished change: number, manifest, schema, layout, and the stream
  and epoch that it stands for, if any.

A change writes new folders first, then a manifest that carries every other folder over as it is, then its commit.  Readers
take the manifest of the latest commit, so a job that fails leaves the table as it was, a folder is never changed, and a
job can read the table it replaces.  One job changes a table at a time.

* ``write_table`` replaces a table; ``replace_boxes`` the folders of some boxes.
* ``merge`` is the keyed upsert: the folders that can hold a key of the feed follow from the manifest (box, bucket, range
  of source ids); of these only the key columns are read to find the folders that do; only those are rewritten.  New keys
  become folders of their own beside the old ones; a partition of more than ``MANY_FOLDERS`` is rewritten as one.
* ``retire`` drops folders that are older than a bound by the commit alone and rewrites the one month the bound cuts.
* ``remove`` deletes rows of a box, whole folders by the commit alone.
* ``changed_boxes`` compares two commits; ``vacuum`` removes what the last commits no longer name.

A manifest has one row per folder (boxes x months), which is what Spark's own file listing holds on the driver for such a
table; box-scoped reads and merges collect the rows of their boxes only.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CANONICAL_TABLES = ["boxes", "members", "memberships", "payments", "classes", "freezes", "attendance",
                    "leads", "bookings"]
BOX = "box_id"
MANY_FOLDERS = 8
_COMMIT = "number long, manifest string, schema string, layout string, stream string, epoch long"
_MANIFEST = "folder string, write string, box string, part string, n long, lo date, hi date, undated long, key_lo long, key_hi long, unkeyed long"


@dataclass(frozen=True)
class Layout:
    """How a table is cut below its box: by month of ``month``, else by a hash of ``bucket`` into ``buckets``, else not at
    all.  ``key``: the id column whose range each folder states (where it is a number)."""
    month: str | None = None
    bucket: str | None = None
    buckets: int = 8
    key: str | None = None

    def part(self) -> Column:
        if self.month:
            return F.coalesce(F.date_format(self.month, "yyyy-MM"), F.lit("none"))
        if self.bucket:
            return F.concat(F.lit("b"), F.pmod(F.xxhash64(F.col(self.bucket).cast("string")), F.lit(self.buckets)).cast("string"))
        return F.lit("all")


#: Layouts of the canonical tables: dated tables by month (retention by date), the others by a hash bucket of their id.
LAYOUTS = {
    "members": Layout(bucket="source_member_id", key="source_member_id"),
    "memberships": Layout(month="created_at", key="source_membership_id"),
    "payments": Layout(month="created_at", key="source_payment_id"),
    "classes": Layout(month="created_at", key="source_class_id"),
    "attendance": Layout(month="created_at", key="member_id"),
    "bookings": Layout(month="booked_date", key="source_user_id"),
    "freezes": Layout(bucket="source_hold_id", key="source_hold_id"),
    "leads": Layout(bucket="source_lead_id", key="source_lead_id"),
}


@dataclass
class Change:
    """What a change did: its commit's number, the folders whose keys were looked up, those that went and those that came.
    ``repeated``: the stream's epoch was there already, and nothing was done."""
    number: int
    looked_up: list[str] = field(default_factory=list)
    gone: list[str] = field(default_factory=list)
    new: list[str] = field(default_factory=list)
    repeated: bool = False


@dataclass(frozen=True)
class _State:
    number: int
    manifest: str
    schema: T.StructType
    layout: Layout


# ---- the log ---------------------------------------------------------------------------

def _log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def _state(spark: SparkSession, path: str, number: int | None = None) -> _State | None:
    """The latest commit, or the one of a number (one row)."""
    log = _log(spark, path)
    if log is None:
        return None
    row = (log if number is None else log.filter(F.col("number") == number)).orderBy(F.desc("number"), "manifest").first()
    return _State(row["number"], row["manifest"], T.StructType.fromJson(json.loads(row["schema"])), Layout(**json.loads(row["layout"]))) if row else None


def _must(spark: SparkSession, path: str, number: int | None = None) -> _State:
    state = _state(spark, path, number)
    if state is None:
        raise FileNotFoundError(f"{path} has no finished version")
    return state


def version(spark: SparkSession, path: str) -> int:
    """Number of the latest commit; 0 before the first."""
    state = _state(spark, path)
    return state.number if state else 0


def manifest(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The folders of the table, as of its latest commit or that of a number."""
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{_must(spark, path, number).manifest}")


def _commit(spark: SparkSession, path: str, before: _State | None, folders: DataFrame, schema: T.StructType, layout: Layout,
            stream: str | None = None, epoch: int | None = None) -> int:
    name, number = uuid.uuid4().hex, (before.number if before else 0) + 1
    folders.coalesce(1).write.parquet(f"{path}/manifests/{name}")
    row = [(number, name, schema.json(), json.dumps(asdict(layout)), stream, epoch)]
    spark.createDataFrame(row, _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number


# ---- folders ---------------------------------------------------------------------------

def _boxed(schema: T.StructType) -> bool:
    return BOX in schema.names


def _read(spark: SparkSession, path: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    """The rows of some folders, with their ``w`` and ``part``."""
    whole = T.StructType([*schema.fields, T.StructField("w", T.StringType()), T.StructField("part", T.StringType())])
    if not folders:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*(f"{path}/data/{f}" for f in folders))


def _write(df: DataFrame, path: str, layout: Layout) -> tuple[str, DataFrame]:
    """Write rows as new folders; returns the write's name and their manifest rows.  ``rebalance`` deals the rows so that a folder has few
    files and a large one is split by bytes, whatever box it belongs to."""
    spark, write = df.sparkSession, uuid.uuid4().hex
    by = [BOX, "part"] if _boxed(df.schema) else ["part"]
    dealt = df.withColumn("part", layout.part()).hint("rebalance", *(F.col(c) for c in by))
    dealt.write.partitionBy(*by).parquet(f"{path}/data/w={write}")
    kept = [df.schema[c] for c in sorted({layout.month, layout.key, BOX} - {None} & set(df.columns))] + [T.StructField("part", T.StringType())]
    try:
        back = spark.read.schema(T.StructType(kept)).parquet(f"{path}/data/w={write}")
    except AnalysisException:
        return write, spark.createDataFrame([], _MANIFEST)
    numeric = layout.key in df.columns and isinstance(df.schema[layout.key].dataType, T.IntegralType)
    date = F.col(layout.month).cast("date") if layout.month in df.columns else F.lit(None).cast("date")
    key = F.col(layout.key).cast("long") if numeric else F.lit(None).cast("long")
    no_key = F.col(layout.key).isNull() if layout.key in df.columns else F.lit(False)
    box = F.col(BOX).cast("string") if _boxed(df.schema) else F.lit(None).cast("string")
    # Rows are counted by file; the folder's name is made of the few paths, not of each row's.
    files = back.select(F.col("_metadata.file_path").alias("file"), box.alias("box"), "part", date.alias("d"), key.alias("k"), no_key.alias("u")) \
                .groupBy("file", "box", "part").agg(
                    F.count("*").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_if(F.col("d").isNull()).alias("undated"),
                    F.min("k").alias("key_lo"), F.max("k").alias("key_hi"), F.count_if("u").alias("unkeyed"))
    name = F.expr("url_decode(replace(regexp_extract(file, '/data/(w=.*)/[^/]*$', 1), '+', '%2B'))")
    return write, files.groupBy(name.alias("folder"), F.lit(write).alias("write"), "box", "part").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("undated").alias("undated"),
        F.min("key_lo").alias("key_lo"), F.max("key_hi").alias("key_hi"), F.sum("unkeyed").alias("unkeyed"))


def _names(folders: DataFrame) -> list[str]:
    return sorted(r.folder for r in folders.select("folder").collect())


def _new(spark: SparkSession, path: str, number: int, write: str) -> list[str]:
    return _names(manifest(spark, path, number).filter(F.col("write") == write))


def _in(column: Column, values: list) -> Column:
    """One of the values, null being one like others."""
    known = [v for v in values if v is not None]
    if values and len(known) == len(values):
        return column.isin(known)
    return F.coalesce(column.isin(known), F.lit(False)) | (column.isNull() & F.lit(len(known) < len(values)))


# ---- reading and replacing -----------------------------------------------------------------

def read_table(spark: SparkSession, path: str, boxes: list | None = None, since: dt.date | None = None, number: int | None = None) -> DataFrame:
    """The table as of its latest commit (or of a number).  ``boxes`` and ``since`` (a bound on the layout's date) leave out
    folders by the manifest; rows before ``since`` in the month it cuts are left out by the scan, rows without a date stay."""
    state = _must(spark, path, number)
    folders = manifest(spark, path, state.number)
    if boxes is not None:
        folders = folders.filter(_in(F.col("box"), [None if b is None else str(b) for b in boxes]))
    if since is not None and state.layout.month:
        folders = folders.filter((F.col("hi") >= since) | (F.col("undated") > 0))
    rows = _read(spark, path, state.schema, _names(folders))
    if boxes is not None:
        rows = rows.filter(_in(F.col(BOX), boxes))  # a literal filter on the partition column
    if since is not None and state.layout.month:
        rows = rows.filter(~F.coalesce(F.col(state.layout.month) < F.lit(since).cast(state.schema[state.layout.month].dataType), F.lit(False)))
    return rows.select(*state.schema.names)


def load(spark: SparkSession, store: str, names: list[str] | None = None, boxes: list | None = None) -> dict[str, DataFrame]:
    """A2: the canonical tables of a store directory, or their rows of some boxes (tables without a box are whole)."""
    return {n: read_table(spark, f"{store}/{n}", boxes if n != "boxes" else None) for n in (names or CANONICAL_TABLES)}


def write_table(df: DataFrame, path: str, layout: Layout | None = None) -> DataFrame:
    """A4: replace a table; returns the new version as read back.  The layout is the given one, the stored one or the
    canonical one of the folder's name."""
    spark, before = df.sparkSession, _state(df.sparkSession, path)
    layout = layout or (before.layout if before else LAYOUTS.get(path.rstrip("/").rsplit("/", 1)[-1], Layout()))
    columns = set(df.columns)
    layout = Layout(month=layout.month if layout.month in columns else None, bucket=layout.bucket if layout.bucket in columns else None,
                    buckets=layout.buckets, key=layout.key if layout.key in columns else None)
    _commit(spark, path, before, _write(df, path, layout)[1], df.schema, layout)
    return read_table(spark, path)


def replace_boxes(df: DataFrame, path: str, boxes: list) -> Change:
    """Replace the rows of some boxes; all other folders are carried over.  ``df`` holds rows of these boxes only."""
    spark = df.sparkSession
    state, named = _must(spark, path), [None if b is None else str(b) for b in boxes]
    folders = manifest(spark, path, state.number)
    hit = _in(F.col("box"), named)
    hit = F.coalesce(hit, F.lit(False))
    write, new = _write(df.select(*state.schema.names), path, state.layout)
    number = _commit(spark, path, state, folders.filter(~hit).unionByName(new), state.schema, state.layout)
    return Change(number, gone=_names(folders.filter(hit)), new=_new(spark, path, number, write))


def save_all(tables: dict[str, DataFrame], store: str) -> None:
    for n, df in tables.items():
        write_table(df, f"{store}/{n}")


# ---- keyed merge -------------------------------------------------------------------------

def merge(path: str, rows: DataFrame, keys: list[str], pos: str | None = "feed_pos", defaults: dict[str, Column] | None = None,
          insert: bool = True, stream: str | None = None, epoch: int | None = None) -> Change:
    """A5 on a stored table (semantics of ``operators.ingest.upsert``): only folders that hold a key of ``rows`` are
    rewritten.  A row with a NULL key part matches nothing, but is added only where the table has no such row with the same
    values, so that a feed that comes again adds nothing.  With ``insert=False`` rows of unknown keys are left out (A7, A8).
    With a stream and an epoch the change is
    made once: a batch that comes again after a failure finds its commit and does nothing."""
    from studiolake.operators.ingest import last_wins, upsert

    spark = rows.sparkSession
    state = _must(spark, path)
    if stream is not None and _log(spark, path).filter((F.col("stream") == stream) & (F.col("epoch") >= epoch)).limit(1).count():
        return Change(state.number, repeated=True)
    # The feed, one row per key, written once, and again where rows left it: the steps below read it three times.
    feed = last_wins(rows, keys, pos).drop(pos) if pos is not None and pos in rows.columns else rows
    feed = feed.select(*(F.col(c).cast(state.schema[c].dataType).alias(c) for c in feed.columns if c in state.schema.names))
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    feed = _staged(feed, f"{staged}/feed")
    folders = manifest(spark, path, state.number)
    if insert and (unknown := _unknown(spark, path, state, folders, feed, keys)) is not feed:
        feed = _staged(unknown, f"{staged}/unknown")
    # Folders that can hold a key: by box, by bucket, by range of ids.
    parts = [F.col(BOX).cast("string").alias("_box")] if _boxed(state.schema) else [F.lit(None).cast("string").alias("_box")]
    bucket = state.layout.bucket if state.layout.bucket in keys else None
    parts.append((state.layout.part() if bucket else F.lit(None).cast("string")).alias("_part"))
    ranged = state.layout.key in keys and isinstance(state.schema[state.layout.key].dataType, T.IntegralType)
    key = F.col(state.layout.key).cast("long") if ranged else F.lit(None).cast("long")
    reach = feed.select(*parts, key.alias("_k")).groupBy("_box", "_part").agg(F.min("_k").alias("_lo"), F.max("_k").alias("_hi"))
    reach = _staged(reach, f"{staged}/reach")
    on = F.col("box").eqNullSafe(F.col("_box"))
    if bucket:
        on = on & (F.col("part") == F.col("_part"))
    if ranged:
        on = on & (F.col("key_lo") <= F.col("_hi")) & (F.col("key_hi") >= F.col("_lo"))
    possible = folders.join(reach, on, "left_semi")
    looked_up = _names(possible)
    # Of these, the ones that do.  A NULL key part matches nothing, as in a unique constraint.
    stored = _read(spark, path, state.schema, looked_up).select(*keys, "w", "part").alias("s")
    hits = stored.join(feed.select(*(F.col(k).alias(f"_{k}") for k in keys)), [F.col(f"s.{k}") == F.col(f"_{k}") for k in keys], "left_semi")
    boxed = F.col(BOX).cast("string") if _boxed(state.schema) else F.lit(None).cast("string")
    hit = hits.select(F.col("w").alias("_w"), boxed.alias("_box"), F.col("part").alias("_part")).distinct()
    same = (F.col("write") == F.col("_w")) & F.col("box").eqNullSafe(F.col("_box")) & (F.col("part") == F.col("_part"))
    gone = set(_names(folders.join(hit, same, "left_semi")))
    if insert:  # partitions that have become many folders, among those the feed reaches
        many = folders.groupBy("box", "part").agg(F.count("*").alias("c")).filter(F.col("c") > MANY_FOLDERS)
        many = many.join(reach.select("_box").distinct(), F.col("box").eqNullSafe(F.col("_box")), "left_semi").select(F.col("box").alias("_b"), F.col("part").alias("_p"))
        gone |= set(_names(folders.join(many, F.col("box").eqNullSafe(F.col("_b")) & (F.col("part") == F.col("_p")), "left_semi")))
    target = _read(spark, path, state.schema, sorted(gone)).select(*state.schema.names)
    if not insert:
        feed = feed.join(target.select(*keys).distinct(), keys, "left_semi")
    merged = upsert(target, feed, keys, pos=None, defaults=defaults)
    write, new = _write(merged.select(*(F.col(c).cast(state.schema[c].dataType).alias(c) for c in state.schema.names)), path, state.layout)
    rest = folders.filter(~F.col("folder").isin(sorted(gone))) if gone else folders
    number = _commit(spark, path, state, rest.unionByName(new), state.schema, state.layout, stream, epoch)
    _remove(spark, staged)
    return Change(number, looked_up, sorted(gone), _new(spark, path, number, write))


def _staged(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def _unknown(spark: SparkSession, path: str, state: _State, folders: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The feed without the rows with a NULL key part that the table holds already, value for value."""
    loose = F.lit(False)
    for k in keys:
        loose = loose | F.col(k).isNull()
    if not feed.filter(loose).limit(1).count():
        return feed
    box = F.col(BOX).cast("string") if _boxed(state.schema) else F.lit(None).cast("string")
    near = folders.join(feed.filter(loose).select(box.alias("_box")).distinct(), F.col("box").eqNullSafe(F.col("_box")), "left_semi")
    if set(keys) <= {BOX, state.layout.key, state.layout.month}:
        near = near.filter((F.col("unkeyed") > 0) | (F.col("undated") > 0) | F.col("box").isNull())
    held = _read(spark, path, state.schema, _names(near)).filter(loose).select(*(F.col(c).alias(f"_{c}") for c in feed.columns)).distinct()
    same = F.lit(True)
    for c in feed.columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return feed.filter(~loose).unionByName(feed.filter(loose).join(held, same, "left_anti"))


# ---- deletes ------------------------------------------------------------------------------

def _cut(spark: SparkSession, path: str, whole: Column, partly: Column, keep: Column) -> Change:
    """Drop the folders of ``whole``, rewrite those of ``partly`` with the rows of ``keep``."""
    state = _must(spark, path)
    folders = manifest(spark, path, state.number).withColumn("_whole", F.coalesce(whole, F.lit(False))) \
        .withColumn("_partly", ~F.col("_whole") & F.coalesce(partly, F.lit(False)))
    drop, rewrite = _names(folders.filter("_whole")), _names(folders.filter("_partly"))
    if not drop and not rewrite:
        return Change(state.number)
    rest = folders.filter("NOT _whole AND NOT _partly").drop("_whole", "_partly")
    write = ""
    if rewrite:
        left = _read(spark, path, state.schema, rewrite).filter(F.coalesce(keep, F.lit(True)))
        write, new = _write(left.select(*state.schema.names), path, state.layout)
        rest = rest.unionByName(new)
    number = _commit(spark, path, state, rest, state.schema, state.layout)
    return Change(number, looked_up=rewrite, gone=sorted(drop + rewrite), new=_new(spark, path, number, write))


def retire(spark: SparkSession, path: str, column: str, days: int, as_of: dt.date) -> Change:
    """Delete rows whose ``column`` lies before ``as_of - days``; rows without a date stay.  With a layout by that
    column's month, whole old months go by the commit alone and only the month that the bound cuts is read."""
    state, bound = _must(spark, path), as_of - dt.timedelta(days=days)
    keep = ~(F.col(column) < F.lit(bound).cast(state.schema[column].dataType))
    if state.layout.month != column:
        return _cut(spark, path, F.lit(False), F.lit(True), keep)
    return _cut(spark, path, (F.col("hi") < bound) & (F.col("undated") == 0), F.col("lo") < bound, keep)


def remove(spark: SparkSession, path: str, box, column: str | None = None, below: int | None = None) -> Change:
    """A10: delete a box's rows, or those whose id ``column`` is under ``below``.  Whole folders go by the commit alone,
    folders with no such id are left alone, the others are rewritten."""
    state = _must(spark, path)
    own = F.col("box").eqNullSafe(F.lit(None if box is None else str(box)))
    if column is None:
        return _cut(spark, path, own, F.lit(False), F.lit(True))
    keep = ~(F.col(column) < below)
    if state.layout.key != column or not isinstance(state.schema[column].dataType, T.IntegralType):
        return _cut(spark, path, F.lit(False), own, keep)
    return _cut(spark, path, F.lit(False), own & (F.col("key_lo") < below), keep)


def edit(spark: SparkSession, path: str, hit: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], boxes: list | None = None) -> Change:
    """Change the folders in which ``hit`` finds rows: they are written anew as ``change`` gives them."""
    state = _must(spark, path)
    folders = manifest(spark, path, state.number)
    if boxes is not None:
        folders = folders.filter(_in(F.col("box"), [None if b is None else str(b) for b in boxes]))
    looked_up = _names(folders)
    boxed = F.col(BOX).cast("string") if _boxed(state.schema) else F.lit(None).cast("string")
    found = hit(_read(spark, path, state.schema, looked_up)).select(F.col("w").alias("_w"), boxed.alias("_box"), F.col("part").alias("_part")).distinct()
    same = (F.col("write") == F.col("_w")) & F.col("box").eqNullSafe(F.col("_box")) & (F.col("part") == F.col("_part"))
    gone = _names(folders.join(found, same, "left_semi"))
    if not gone:
        return Change(state.number, looked_up)
    write, new = _write(change(_read(spark, path, state.schema, gone).select(*state.schema.names)), path, state.layout)
    rest = manifest(spark, path, state.number).filter(~F.col("folder").isin(gone))
    number = _commit(spark, path, state, rest.unionByName(new), state.schema, state.layout)
    return Change(number, looked_up, gone, _new(spark, path, number, write))


# ---- history ------------------------------------------------------------------------------

def changed_boxes(spark: SparkSession, path: str, since: int) -> list[str | None]:
    """Boxes (as text) whose folders differ between the commit of a number and the latest; a box whose folders were only
    rewritten counts as well."""
    now, then = manifest(spark, path), manifest(spark, path, since)
    differ = now.join(then, "folder", "left_anti").select("box").unionByName(then.join(now, "folder", "left_anti").select("box"))
    return sorted((r.box for r in differ.distinct().collect()), key=lambda b: (b is not None, b))


def _remove(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _entries(spark: SparkSession, folder: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove what none of the last ``keep`` commits names: data folders, manifests, staged feeds.  Returns the folders of
    ``data`` that went.  Not while a job reads an older version or writes a new one."""
    last: list[Row] = _log(spark, path).orderBy(F.desc("number"), "manifest").limit(keep).collect()
    held = [spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/{r.manifest}").select("folder") for r in last]
    named = held[0]
    for h in held[1:]:
        named = named.unionByName(h)
    live = set(_names(named.distinct()))
    writes, gone = {f.split("/", 1)[0] for f in live}, []
    for w in _entries(spark, f"{path}/data"):
        if w not in writes:
            _remove(spark, f"{path}/data/{w}")
            gone.append(w)
            continue
        if any(f.startswith(f"{w}/") for f in live):
            for box in [b for b in _entries(spark, f"{path}/data/{w}") if "=" in b]:
                leaves = [f"{w}/{box}"] if box.startswith("part=") else [f"{w}/{box}/{p}" for p in _entries(spark, f"{path}/data/{w}/{box}") if "=" in p]
                for leaf in set(leaves) - live:
                    _remove(spark, f"{path}/data/{leaf}")
                    gone.append(leaf)
    for m in set(_entries(spark, f"{path}/manifests")) - {r.manifest for r in last}:
        _remove(spark, f"{path}/manifests/{m}")
    _remove(spark, f"{path}/staged")
    return sorted(gone)
