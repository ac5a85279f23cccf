"""A1: landed report pages.

A report is fetched page by page; each page lands as one JSON object
``{"page": n, "data": [...rows...], "extra": {"pagination": {"total_pages": N}}}``.
Reading is ``spark.read.schema(envelope).json(dir)`` (never schema inference)
plus ``explode(data)``; a page without ``data`` contributes no rows, a broken
page or a missing one is an error.  A report that names no number of pages has
one.

Absent and null: a typed read gives null for both.  The fields named in
``absent`` are read as VARIANT instead, where a missing field is null and an
explicit null a value; the rows then get a column ``absent`` with the names of
the fields that they do not have (null: none).

``land_pages`` is the inverse used by tests and the streaming example: page
numbers come from a scalable sequential numbering (no single-task window),
and each page groups at most ``page_size`` rows, so no group is unbounded.
It writes nulls as explicit nulls and leaves out the fields of ``absent``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studiolake.operators.datagen import sequential_ids

#: Fixed: fields for which a missing value and an explicit null differ.
AMBIGUOUS = ["name", "price", "user_role"]


class IncompleteReport(ValueError):
    """Fewer pages landed than the report announces."""


def row_fields(row_schema: T.StructType, absent: list[str]) -> T.StructType:
    """The schema as landed: without ``absent``, its fields as VARIANT."""
    return T.StructType([T.StructField(f.name, T.VariantType() if f.name in absent else f.dataType) for f in row_schema if f.name != "absent"])


def envelope_schema(row_schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField("page", T.IntegerType()),
        T.StructField("data", T.ArrayType(row_schema)),
        T.StructField("extra", T.StructType([
            T.StructField("pagination", T.StructType([T.StructField("total_pages", T.IntegerType())]))])),
    ])


def typed(rows: DataFrame, row_schema: T.StructType, absent: list[str]) -> DataFrame:
    """Rows as landed -> columns of ``row_schema``, with ``absent`` filled where some field is watched."""
    out = []
    for f in row_schema:
        if f.name in absent:
            out.append(F.variant_get(f.name, "$", f.dataType.simpleString()).alias(f.name))
        elif f.name != "absent":
            out.append(F.col(f.name))
    watched = [f for f in row_schema.names if f in absent]
    if watched:
        missing = F.array_compact(F.array(*(F.when(F.col(f).isNull(), F.lit(f)) for f in watched)))
        out.append(F.when(F.size(missing) > 0, missing).alias("absent"))
    return rows.select(*[c for c in rows.columns if c == "page" and c not in row_schema.names], *out)


def pages_frame(rows: DataFrame, page_size: int, order_cols: list[str]) -> DataFrame:
    """Page envelopes of ``page_size`` rows in ``order_cols`` order, as JSON text."""
    numbered = sequential_ids(rows, [F.col(c) for c in order_cols], "_seq")
    paged = numbered.withColumn("page", (F.floor((F.col("_seq") - 1) / page_size) + 1).cast("int"))
    fields = [c for c in rows.columns if c != "absent"]
    item = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    if "absent" in rows.columns:  # a row that lacks fields is written without its nulls
        item = F.when(F.size("absent") > 0, F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})).otherwise(item)
    env = paged.withColumn("_item", item).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("_seq", "_item"))).alias("_items"))
    total = paged.agg(F.max("page").alias("total_pages"))        # one row
    data = F.array_join(F.transform("_items", lambda x: x["_item"]), ",")
    return env.crossJoin(F.broadcast(total)).select(F.format_string('{"page":%d,"data":[%s],"extra":{"pagination":{"total_pages":%d}}}', "page", data, "total_pages").alias("value"))


def land_pages(rows: DataFrame, path: str, page_size: int = 200, order_cols: list[str] | None = None) -> None:
    """Write ``rows`` as landed report pages (JSON lines, one page per line; gzip, as field names repeat in every row)."""
    pages_frame(rows, page_size, order_cols or rows.columns[:1]).write.mode("overwrite").option("compression", "gzip").text(path)


def read_pages(spark: SparkSession, path: str, row_schema: T.StructType, with_page: bool = False,
               absent: list[str] | None = None) -> DataFrame:
    """Concatenate ``data`` over all landed pages with a fixed row schema.

    A page that cannot be parsed whole is an error, and so is a report with
    fewer pages than it announces (``IncompleteReport`` names how many)."""
    check_whole(spark, path, row_schema)
    absent = absent or []
    env = spark.read.schema(envelope_schema(row_fields(row_schema, absent))).option("mode", "FAILFAST").json(path)
    out = typed(env.select("page", F.explode("data").alias("r")).select("page", "r.*"), row_schema, absent)
    return out if with_page else out.drop("page")


def page_completeness(spark: SparkSession, path: str, row_schema: T.StructType) -> DataFrame:
    """One row: pages landed vs pages announced, and whether the report is whole."""
    env = spark.read.schema(envelope_schema(row_fields(row_schema, []))).option("mode", "FAILFAST").json(path)
    return env.agg(F.count_distinct("page").alias("pages_landed"), F.max("extra.pagination.total_pages").alias("total_pages")) \
              .withColumn("complete", F.col("pages_landed") == F.coalesce("total_pages", F.least("pages_landed", F.lit(1))))


def check_whole(spark: SparkSession, path: str, row_schema: T.StructType) -> None:
    state = page_completeness(spark, path, row_schema).first()
    if not state["complete"]:
        raise IncompleteReport(f"{path}: {state['pages_landed']} of {state['total_pages'] or 1} pages landed")
