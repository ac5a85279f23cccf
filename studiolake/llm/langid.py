"""Operator 5: language ID by compression.

Per language a zstandard raw-content dictionary of ``DICTIONARY_BYTES`` is filled with sample texts; a text goes to the
language whose dictionary makes it smallest.  Texts are folded first (lower case, runs of other characters than letters
as one space) and encoded whole, in blocks of ``BLOCK`` bytes; short texts at a higher level.  Score is the margin
(second smallest - smallest) / second smallest, between 0 and 1; below ``LEAST_MARGIN`` the document is rejected.  Equal
sizes go to the language with more training documents, then by name.

Learning takes a bounded sample: per language at most ``SAMPLE_DOCUMENTS`` documents, those with the lowest hash of id
and text, at most ``SAMPLE_CHARS`` characters of each, and at most ``MAX_LANGUAGES`` languages, the most frequent
first.  Prediction reads only the text.

Cases: null text or text without a letter is ``und`` with score 0, rejected; null language or null text teaches nothing;
a null id is not held out; without training documents all is ``und``; equal rows get equal results; empty table: no
rows.  Further columns are carried by ``classify``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studiolake.llm import common as C

DICTIONARY_BYTES = 64 << 10
SAMPLE_DOCUMENTS, SAMPLE_CHARS, MAX_LANGUAGES = 200, 4096, 200
BLOCK, SHORT = 16 << 10, 2000
LEVEL, SHORT_LEVEL = 6, 12
LEAST_MARGIN = 0.01
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def fold(text: str) -> bytes:
    """Letters in lower case with single spaces around words; empty if there is no letter."""
    words = _OTHER.sub(" ", text.lower()).strip()
    return f" {words} ".encode() if words else b""


def sample(labelled: DataFrame) -> list[tuple[str, int, list[str]]]:
    """(language, training documents, sample texts), most frequent first; bounded by the constants above."""
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not counts:
        return []
    # A hash limit that lets about twice the wanted number through, then exactly the lowest ones.
    limits = {r["lang"]: min(1.0, 2 * SAMPLE_DOCUMENTS / r["count"]) for r in counts}
    share = F.create_map(*(x for k, v in limits.items() for x in (F.lit(k), F.lit(v))))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    low = (labelled.withColumn("place", place).filter(F.col("place") < share[F.col("lang")] * float(1 << 30))
           .select("lang", "place", F.substring("text", 1, SAMPLE_CHARS).alias("part")).distinct())
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "part"))
    parts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in low.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_DOCUMENTS).orderBy("lang", "rank").collect():
        parts[r["lang"]].append(r["part"])
    return [(r["lang"], r["count"], parts[r["lang"]]) for r in counts]


def dictionaries(samples: list[tuple[str, int, list[str]]]) -> list[tuple[str, bytes]]:
    """The end of a raw-content dictionary is the cheapest to refer to; all are filled to one size if the samples reach."""
    return [(lang, b"".join(map(fold, parts))[:DICTIONARY_BYTES]) for lang, _, parts in samples]


class Judge:
    def __init__(self, known: list[tuple[str, bytes]]):
        self.langs = [lang for lang, _ in known]
        self.coders = {level: [self._coder(raw, level) for _, raw in known] for level in (LEVEL, SHORT_LEVEL)}

    @staticmethod
    def _coder(raw: bytes, level: int) -> zstandard.ZstdCompressor:
        if len(raw) < 8:
            return zstandard.ZstdCompressor(level=level, write_content_size=False)
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False)

    def __call__(self, text: str) -> tuple[str, float]:
        body = fold(text)
        if not body or not self.langs:
            return UNKNOWN, 0.0
        blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]
        sizes = [sum(len(c.compress(x)) for x in blocks) for c in self.coders[SHORT_LEVEL if len(body) < SHORT else LEVEL]]
        best = min(sizes)
        at = sizes.index(best)
        rest = min(sizes[:at] + sizes[at + 1:], default=0)
        return self.langs[at], max(0.0, (rest - best) / rest) if rest else 1.0


def classify(docs: DataFrame, known: list[tuple[str, bytes]], least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score and accepted.  ``known`` is bounded by MAX_LANGUAGES * DICTIONARY_BYTES."""
    spark = docs.sparkSession
    C.small_batches(spark)
    shared = spark.sparkContext.broadcast(known)
    carried = [c for c in docs.columns if c not in ("lang_pred", "score", "accepted")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(shared.value)
        for b in batches:
            got = [one(t.as_py() or "") for t in b["text"]]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in carried), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64()),
                                              pa.array([x != UNKNOWN and s >= least_margin for x, s in got], pa.bool_())], [*carried, "lang_pred", "score", "accepted"])

    schema = T.StructType([*(docs.schema[c] for c in carried), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return docs.select(carried).mapInArrow(judge, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> list[tuple[str, bytes]]:
    return dictionaries(sample(docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    known = learn(docs)
    return classify(docs.select("doc_id", held_out().alias("held_out"), "text"), known).drop("text")


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
