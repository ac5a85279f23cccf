"""Operator 11: periodic runs of words, found by an online sparse diagonal search.

A run of period q is a stretch whose words equal the words q places before; on the diagonal of lag q it is a chain of
matches.  A search that lets every earlier occurrence of a word feed its lag costs the square of a frequent word's count.
Here a word is looked up with its context: at level k the window of L = 2^k words that ends at it, for the lags in
(L/2, L].  Of its earlier occurrences only the nearest can matter:

* a run holds its period at least four times, so a window of L >= q words has its copy q places before inside the run;
* inside a run of smallest period q no window of q or more words recurs at a smaller distance (it would be a proper
  rotation equal to itself), so the nearest earlier occurrence lies at lag q exactly, word after word.

So each level has one active lag.  A word whose nearest lag is the active one lengthens its match; another lag ends the
diagonal, which is given out at once if its stretch (match length + window + lag) is long enough.  Windows are named by
exact ranks: a level's name is the pair of names of its two halves, and only windows that occur twice in their text are
carried to the next level, so ordinary prose is done after a few levels.  All work is linear in words per level, for texts
of one repeated word as well; no row leaves its task and nothing is shuffled.

Cases: null or empty text has no words and no runs; a null doc_id (in the query) leaves the text as it is; repeated rows
each give a row; an empty table gives no rows; further columns are carried whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.llm import common as C

LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are searched together: texts of a batch are put one after another up to this number (a longer text alone).
WORDS_AT_ONCE = 100_000
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class _Names(dict):
    """word -> number in order of first use."""

    def __init__(self):
        super().__init__()
        self._next = count()

    def __missing__(self, word: bytes) -> int:
        n = self[word] = next(self._next)
        return n


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of keys in order of place: rank of each, place in keys of the nearest earlier equal one (-1: none), and whether
    the key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    ordered = keys[order]
    same[1:] = ordered[1:] == ordered[:-1]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(~same)
    before = np.full(len(keys), -1)
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    twice = np.zeros(len(keys), bool)
    twice[order] = same | np.append(same[1:], False)
    return rank, before, twice


def runs(words: np.ndarray, longest: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence of word numbers; texts that follow one another must not
    share numbers.  ``longest``: words of the longest text."""
    at = np.arange(len(words))
    keys, size, found = words, 1, []
    while len(at) > 1:
        rank, before, twice = _ranks(keys)
        # The diagonals of this level: chains of words with one and the same lag.
        seen = before >= 0
        place, lag = at[seen], at[seen] - at[before[seen]]
        use = (lag <= size) & (lag > size // 2)
        place, lag = place[use], lag[use]
        if len(place):
            first = np.flatnonzero(np.append(True, (np.diff(place) != 1) | (np.diff(lag) != 0)))
            last = np.append(first[1:], len(place)) - 1
            q = lag[first]
            length = place[last] - place[first] + size + q
            enough = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
            found.append(np.stack([place[first] - size + 1 - q, length, q], 1)[enough])
        if LEAST_PERIODS * (size + 1) > longest:  # the next level's least lag is size + 1
            break
        # Next level: windows of twice the size, of two halves that both occur again.
        at, rank = at[twice], rank[twice]
        half = np.searchsorted(at, at - size)
        both = at[np.minimum(half, len(at) - 1)] == at - size if len(at) else np.zeros(0, bool)
        keys = rank[half[both]] * (len(words) + 1) + rank[both]
        at, size = at[both], 2 * size
    out = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _several(texts: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its runs and which words stay, for texts searched together."""
    sizes = [len(t) for t in texts]
    begin = np.cumsum([0, *sizes])
    codes = np.empty(int(begin[-1]), np.int64)
    used = 0
    for t, a, z in zip(texts, begin, begin[1:], strict=False):
        names = _Names()
        codes[a:z] = np.fromiter(map(names.__getitem__, t), np.int64, len(t))
        codes[a:z] += used  # each text has numbers of its own
        used += len(names)
    found = runs(codes, max(sizes, default=0))
    edge = np.zeros(len(codes) + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    stays = np.cumsum(edge)[:-1] == 0
    cut = np.searchsorted(found[:, 0], begin)
    for k, (a, z) in enumerate(zip(begin, begin[1:], strict=False)):
        own = found[cut[k]:cut[k + 1]].copy()
        own[:, 0] -= a
        yield own, stays[a:z]


def _rows(row: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
    found, collapsed = [], []
    for words, (own, stays) in zip(texts, _several(texts), strict=True):
        found.append(own)
        collapsed.append(b" ".join(words if stays.all() else [w for w, s in zip(words, stays.tolist(), strict=True) if s]))
    flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_RUN))
    offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    return pa.RecordBatch.from_arrays([
        row, pa.array([len(t) for t in texts], pa.int64()), pa.ListArray.from_arrays(offsets, values),
        pa.array(collapsed, pa.binary()).cast(pa.string())], ["row", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None,
              edit: Callable[[dict, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """All rows with ``row`` (a struct of their columns, or those of ``keep``), ``n_words``, ``runs`` (array of start, length, period by start,
    then period, in words) and ``collapsed`` (the text's words without those that a run repeats, one space between).
    ``edit`` gets each row and its words and returns the words to search."""
    C.small_batches(docs.sparkSession)
    held = docs.select(F.struct(*(keep or docs.columns)).alias("row"), F.col(text).cast("string").alias("text"))
    kind = held.schema["row"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, begin, words = [], 0, 0
            for i, t in enumerate(map(bytes.split, C.texts(b["text"]))):
                t = edit(b["row"][i].as_py(), t) if edit else t
                if held and words + len(t) > WORDS_AT_ONCE:
                    yield _rows(b["row"].slice(begin, len(held)), held)
                    held, begin, words = [], begin + len(held), 0
                held.append(t)
                words += len(t)
            if held:
                yield _rows(b["row"].slice(begin), held)

    return held.mapInArrow(search, f"row {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(found: Column) -> Column:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    def better(a: Column, b: Column) -> Column:
        x, y = (a["length"].cast("decimal(19,0)") * b["period"].cast("decimal(19,0)"), b["length"].cast("decimal(19,0)") * a["period"].cast("decimal(19,0)"))
        return F.when(a.isNull() | (y > x), b).otherwise(a)  # runs come by start and period, so the earlier of equal ones stays
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(found, none, better)


def planted(row: dict, words: list[bytes]) -> list[bytes]:
    """The contract's texts: with h = crc32 of the decimal id, every tenth text repeats from some word on."""
    n = len(words)
    g, tenth = divmod(zlib.crc32(str(row["doc_id"]).encode()), 10)
    if row["doc_id"] is None or tenth or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * ((n - a) // p + 1))[:n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_runs(C.read(spark, sf_dir, "documents"), keep=["doc_id"], edit=planted).withColumn("best", strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


# The plain form: every pair of equal words of a text is a match on its diagonal.  A stretch that several periods give
# belongs to the smallest one.
CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: ord(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))), 4294967295::BIGINT))"
ORACLES = {"op11_periodic_runs": f"""
WITH texts AS (
  SELECT row_number() OVER () AS t, doc_id, {CRC.format("doc_id")} AS h,
         regexp_extract_all(coalesce(text, ''), '{C.WORD}') AS w
  FROM documents),
params AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM texts),
planted AS (SELECT t, doc_id, n, a, 1 + (n - a) // parts AS p, w FROM params),
places AS (SELECT t, unnest(range(n)) AS i, w, a, p FROM planted),
words AS (SELECT t, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM places),
matches AS (
  SELECT x.t, x.i, x.i - y.i AS q FROM words x JOIN words y ON x.t = y.t AND x.word = y.word AND y.i < x.i
  JOIN planted p ON p.t = x.t WHERE 4 * (x.i - y.i) <= p.n),
chains AS (SELECT t, q, i, i - row_number() OVER (PARTITION BY t, q ORDER BY i) AS chain FROM matches),
stretches AS (SELECT t, q, min(i) - q AS start, count(*) + q AS length FROM chains GROUP BY t, q, chain),
found AS (SELECT t, start, length, min(q) AS q FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY t, start, length),
per_text AS (
  SELECT t, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines
  FROM found GROUP BY t),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY t ORDER BY length::DOUBLE / q DESC, start, q) = 1),
kept AS (
  SELECT t, string_agg(word, ' ' ORDER BY i) AS left_over FROM words w
  WHERE NOT EXISTS (SELECT 1 FROM found f WHERE f.t = w.t AND w.i >= f.start + f.q AND w.i < f.start + f.length) GROUP BY t)
SELECT p.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, b.start::BIGINT AS start, b.length::BIGINT AS length, b.q::BIGINT AS period,
       (1000 * b.length // b.q)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
       sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM planted p LEFT JOIN per_text USING (t) LEFT JOIN best b USING (t) LEFT JOIN kept USING (t)"""}
QUERIES = {"op11_periodic_runs": op11_periodic_runs}
