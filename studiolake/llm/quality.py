"""Operator 3: quality rules with cross-document line frequency.

Base rules per text: word characters, symbols, repeated lines and words in repeated 8-word windows.  Method: each line
is normalised (A-Z lower-cased, digits as 0, white space as one space) and hashed; per host (``source``) the distinct
documents that hold a line are counted, where copies of one text are one document.  Lines in more than ``max_documents``
documents of their host are removed.  A document that loses over half of its words is depleted and rejected.

Hot lines: distinct (host, line, text) are counted with partial sums, and the frequent lines are joined by broadcast
while they are few, else salted.  Line tables are stored in the shared folder.

Cases: null or empty text has no words and fails the base rule; null host is a host; equal rows each get a row; empty
table: no rows.  Further columns are ignored by the query and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.llm import common as C

MAX_DOCUMENTS = 10
LEAST_LEFT = 0.5
_SYMBOLS = b"#*$%&|<>"
_DIGITS = bytes.maketrans(b"123456789", b"000000000")
_SPACES = b" \t\n\r\x0b\x0c"
_KEEP_CONTINUATION = bytes(b for b in range(256) if b & 0xC0 == 0x80)


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(line.lower().translate(_DIGITS).split())) - (1 << 63)


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words inside windows of ``size`` words that the text has twice or more."""
    h = C.windows(C.word_hashes(words), size)
    if len(h) < 2:
        return 0
    _, which, n = np.unique(h, return_inverse=True, return_counts=True)
    at = n[which] > 1
    if not at.any():
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(at)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(),
             "line_hash": pa.list_(pa.int64()), "line_words": pa.list_(pa.int64()), "line_no": pa.list_(pa.int64())}
    for b in batches:
        out: dict[str, list] = {k: [] for k in kinds}
        for t in C.texts(b["text"]):
            words = t.split()
            body = t.translate(None, _SPACES)
            seen, repeats, hashes, sizes, numbers = set(), 0, [], [], []
            for i, line in enumerate(t.split(b"\n")):
                n = len(line.split())
                if n:
                    repeats += line in seen
                    seen.add(line)
                    hashes.append(line_hash(line))
                    sizes.append(n)
                    numbers.append(i)
            row = (len(words), len(body.translate(None, _KEEP_CONTINUATION)), len(body) - len(body.translate(None, _SYMBOLS)), repeats,
                   repeated_words(words), hashes, sizes, numbers)
            for k, v in zip(kinds, row, strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({**{c: b[c] for c in b.schema.names if c != "text"}, **{k: pa.array(out[k], kind) for k, kind in kinds.items()}})


def measure(docs: DataFrame, folder: str) -> DataFrame:
    """Base columns and the lines (hash, words, number) of every document, stored."""
    C.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    out = rows.mapInArrow(_measure, f"doc_id {kind}, source string, text_hash long, row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                    "n_repeat_words long, line_hash array<long>, line_words array<long>, line_no array<long>")
    return C.stored(out, f"{folder}/measured")


def frequent_lines(measured: DataFrame, folder: str, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(source, line_hash) of the lines that more than ``max_documents`` distinct texts of their host hold."""
    lines = measured.select("source", "text_hash", F.explode(F.array_distinct("line_hash")).alias("line_hash")).distinct()
    return C.stored(lines.groupBy("source", "line_hash").count().filter(F.col("count") > max_documents).drop("count"), f"{folder}/frequent")


def removed_lines(measured: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, line_no, line_words) of every line to remove."""
    lines = measured.select("row", "source", F.explode(F.arrays_zip("line_hash", "line_words", "line_no")).alias("line")).select("row", "source", "line.*")
    return C.join_small(lines, frequent, ["source", "line_hash"], "inner").select("row", "line_no", "line_words")


def judge(measured: DataFrame, removed: DataFrame, least_left: float = LEAST_LEFT) -> DataFrame:
    lost = removed.groupBy("row").agg(F.sum("line_words").alias("words_removed"), F.collect_list("line_no").alias("lines_removed"))
    rows = measured.drop("line_hash", "line_words", "line_no").join(lost, "row", "left").fillna(0, ["words_removed"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    left = F.col("n_words") - F.col("words_removed") >= F.lit(least_left) * F.col("n_words")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & left)


def verdicts(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT) -> DataFrame:
    folder = C.scratch(docs.sparkSession, "quality")
    measured = measure(docs, folder)
    return judge(measured, removed_lines(measured, frequent_lines(measured, folder, max_documents)), least_left)


def clean(docs: DataFrame, max_documents: int = MAX_DOCUMENTS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The kept documents with the frequent lines taken out of their texts; all columns are carried, whatever they are called."""
    v = verdicts(docs, max_documents, least_left).filter("kept").groupBy("doc_id", "source", "text_hash").agg(F.first("lines_removed").alias("gone"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.col("source").alias("own_source"), F.xxhash64("text").alias("own_hash"))
    on = rows["own_id"].eqNullSafe(v["doc_id"]) & rows["own_source"].eqNullSafe(v["source"]) & (rows["own_hash"] == v["text_hash"])
    whole = F.col("row").getField("text")
    lines = F.filter(F.split(whole, "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("gone", i.cast("long")), F.lit(False)))
    text = F.when(F.col("gone").isNull(), whole).otherwise(F.array_join(lines, "\n"))
    return rows.join(v, on).select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(C.read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "words_removed")


ORACLES = {"op3_quality": r"""
WITH q_docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
q_words AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM q_docs),
q_grams AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM q_words WHERE len(w) >= 8)),
q_twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM q_grams) WHERE n > 1),
q_covered AS (SELECT r, count(DISTINCT i + k)::BIGINT AS n FROM q_twice, range(0, 8) x(k) GROUP BY r),
q_split AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM q_docs),
q_lines AS (
  SELECT r, source, t, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
         translate(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS norm
  FROM q_split),
q_full AS (SELECT * FROM q_lines WHERE len(lw) > 0),
q_dups AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM q_full GROUP BY r),
q_often AS (SELECT source, norm FROM q_full GROUP BY source, norm HAVING count(DISTINCT t) > 10),
q_lost AS (
  SELECT f.r, sum(len(f.lw))::BIGINT AS n FROM q_full f JOIN q_often o ON f.norm = o.norm AND f.source IS NOT DISTINCT FROM o.source GROUP BY f.r),
q_all AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(p.n, 0) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS words_removed
  FROM q_docs d JOIN q_words w USING (r) LEFT JOIN q_dups p USING (r) LEFT JOIN q_covered c USING (r) LEFT JOIN q_lost l USING (r))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - words_removed >= 0.5 * n_words AS kept
FROM q_all"""}
QUERIES = {"op3_quality": op3_quality}
