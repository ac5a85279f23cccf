"""Incremental ingest with Structured Streaming.

Landed report pages (see ``sources.pages``) arrive in a folder; a file stream
with a fixed envelope schema explodes each page into rows, and
``foreachBatch`` merges every micro-batch into a stored table with the keyed
merge of ``sources.tables`` (last row wins within the batch; only folders with
a key of the batch are rewritten).

Exactly-once: the merge commits (stream, epoch) with its rows, so a batch that
is run again after a failure finds its epoch in the commit log and does
nothing.  The stream's name belongs to one checkpoint folder: a new checkpoint
counts its epochs from 0 and needs a new name.

A page that cannot be parsed fails the stream; when the folder is drained, a
report with fewer pages than it announces is an error (its rows so far are
in the table, and the next run takes up the pages that land later).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studiolake.sources import tables as S
from studiolake.sources.pages import check_whole, envelope_schema, row_fields, typed


def page_rows_stream(spark: SparkSession, landing_dir: str, row_schema: T.StructType,
                     max_files_per_trigger: int | None = None, absent: list[str] | None = None) -> DataFrame:
    """Streaming DataFrame of report rows from landed page files."""
    r = spark.readStream.schema(envelope_schema(row_fields(row_schema, absent or []))).option("mode", "FAILFAST")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    env = r.json(landing_dir)
    return typed(env.select(F.explode("data").alias("r")).select("r.*"), row_schema, absent or [])


def run_upsert_stream(spark: SparkSession, landing_dir: str, row_schema: T.StructType, table: str, checkpoint: str,
                      keys: list[str], stream: str, prepare=None, defaults=None, pos: str = "feed_pos",
                      max_files_per_trigger: int | None = None, absent: list[str] | None = None) -> list[S.Change]:
    """Drain the landing folder (``availableNow``) into the stored table; returns the change of each batch."""
    changes: list[S.Change] = []

    def take(batch: DataFrame, epoch: int) -> None:
        rows = prepare(batch) if prepare else batch
        changes.append(S.merge(table, rows, keys, pos=pos, defaults=defaults, stream=stream, epoch=epoch))

    q = (page_rows_stream(spark, landing_dir, row_schema, max_files_per_trigger, absent).writeStream
         .foreachBatch(take).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    check_whole(spark, landing_dir, row_schema)
    return changes
