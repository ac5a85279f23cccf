"""Operator 4: benchmark decontamination with a BM25 index of the test items.

Items are indexed by term (words without outer punctuation, lower case).  Each item's weights are divided by its
threshold, ``THRESHOLD`` of the score that the item itself would get, so an item is retrieved when a passage's weights
reach 1.  Every training text is cut into passages of two blocks of words; blocks are as long as the longest item, and
each pair of neighbouring blocks is a passage, so any item's copy lies whole in one.  Every passage is a query.  The sum
of its terms' highest weights bounds all scores, and the sum of their highest weights in a block of ``ITEM_BLOCK`` items
bounds the scores there (both in numpy, for many passages at once); in the blocks whose bound reaches 1 WAND walks the
postings by pivots.  Retrieved pairs are verified: of the
item's question (up to its last line or sentence) ``QUESTION`` of the ``GRAM``-word runs, of its answer (the rest)
``ANSWER`` of the words must stand in the passage.

The index goes to the tasks in parts of at most ``PART_WORDS`` item words, each broadcast; term statistics are of all
items.  Passages never leave their task: no shuffle of texts.

Cases: null or empty text has no passages; null or empty items match nothing; items equal to each other all match;
an item shorter than a run needs all of it; equal rows each get their matches; null ids stay; empty tables: no rows.
Further columns are carried by ``decontaminate``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from studiolake.llm import common as C

K1, B = 1.2, 0.75
THRESHOLD = 0.6
GRAM, QUESTION, ANSWER = 5, 0.6, 0.5
ITEM_BLOCK = 8
CELLS = 1 << 20
SLACK = 1e-9
PART_WORDS = 2_000_000
LEAST_BLOCK = 32
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_ASCII_EDGE = bytes(b for b in range(128) if not chr(b).isalnum())
_LAST = re.compile(r"(?s)(.*)(?:\n|[.?!]\s)(.*\S.*)$")


def term(word: bytes) -> bytes:
    if word.isascii():
        return word.strip(_ASCII_EDGE).lower()
    return _EDGE.sub("", word.decode("utf-8", "replace").lower()).encode()


def terms(text: str) -> list[bytes]:
    return [t for t in map(term, text.encode().split()) if t]


def question_answer(text: str) -> tuple[str, str]:
    m = _LAST.match(text.strip())
    return (m[1], m[2]) if m and m[1].strip() else (text, "")


class Index:
    """Postings of some items with the statistics of all.  items: (item_id, text); df: term -> items; n, mean: of all items."""

    def __init__(self, items: list[tuple[object, str]], df: dict[bytes, int], n: int, mean: float, block: int):
        self.ids, self.block = [i for i, _ in items], block
        self.names: dict[bytes, int] = {}
        rows: list[list[tuple[int, float]]] = []
        self.questions, self.answers = [], []
        for k, (_, text) in enumerate(items):
            tf = Counter(terms(text))
            size = sum(tf.values())
            own = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for t, f in tf.items()}
            goal = THRESHOLD * sum(own.values())
            for t, w in own.items():
                at = self.names.setdefault(t, len(self.names))
                if at == len(rows):
                    rows.append([])
                rows[at].append((k, w / goal))
            q, a = (terms(x) for x in question_answer(text))
            self.questions.append({tuple(q[i:i + GRAM]) for i in range(max(1, len(q) - GRAM + 1))} if q else set())
            self.answers.append(set(a))
        # postings term by term, and the highest weight of each (term, block of items)
        self.start = np.cumsum([0, *map(len, rows)])
        self.item = np.array([k for r in rows for k, _ in r], np.int64)
        self.weight = np.array([w for r in rows for _, w in r])
        self.top = np.array([max(w for _, w in r) for r in rows] or [0.0])
        self.n_blocks = -(-len(items) // ITEM_BLOCK)
        key = np.repeat(np.arange(len(rows)), np.diff(self.start)) * self.n_blocks + self.item // ITEM_BLOCK
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.block_key, self.block_begin, self.block_end = key[at], at, np.r_[at[1:], len(key)] if len(at) else at
        self.block_of = key[at] % self.n_blocks if len(at) else at
        self.block_top = np.maximum.reduceat(self.weight, at) if len(at) else np.empty(0)
        self.block_start = np.searchsorted(key[at] // self.n_blocks, np.arange(len(rows) + 1)) if len(at) else np.zeros(1, np.int64)

    def bounds(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """For terms in rows: per row and block of items the sum of the highest weights."""
        n = self.block_start[term + 1] - self.block_start[term]
        at = np.repeat(self.block_start[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(np.repeat(row, n) * self.n_blocks + self.block_of[at], self.block_top[at], rows * self.n_blocks).reshape(rows, -1)


def wand(index: Index, query: np.ndarray, block: int) -> list[tuple[int, float]]:
    """(item, score) of every item of a block of items whose weights for the distinct terms reach 1.

    Cursors stand on the terms' postings, sorted by item; the pivot is the first item at which the terms' highest
    weights in this block reach 1; items before it are skipped unscored."""
    wanted = query * index.n_blocks + block
    at = np.minimum(np.searchsorted(index.block_key, wanted), len(index.block_key) - 1)
    cursors = [[index.item[a:z].tolist(), index.weight[a:z].tolist(), 0, top] for a, z, top in
               zip(*(x[at[index.block_key[at] == wanted]].tolist() for x in (index.block_begin, index.block_end, index.block_top)), strict=True)]
    out = []
    while True:
        live = sorted((c for c in cursors if c[2] < len(c[0])), key=lambda c: c[0][c[2]])
        bound, pivot = 0.0, None
        for c in live:
            bound += c[3]
            if bound >= 1 - SLACK:
                pivot = c[0][c[2]]
                break
        if pivot is None:
            return out
        score = 0.0
        for c in live:
            while c[2] < len(c[0]) and c[0][c[2]] < pivot:
                c[2] += 1
            if c[2] < len(c[0]) and c[0][c[2]] == pivot:
                score += c[1][c[2]]
                c[2] += 1
        if score >= 1 - SLACK:
            out.append((pivot, score))


class Matcher:
    """Finds the verified items in texts."""

    def __init__(self, index: Index, limit: int = 400_000):
        self.index, self.limit, self.known = index, limit, {}

    def _ids(self, words: list[bytes]) -> np.ndarray:
        """Term numbers: -2 for a word without letters or figures, -1 for a term of no item."""
        if len(self.known) > self.limit:
            self.known.clear()
        known, names = self.known, self.index.names
        for w in words:
            if w not in known:
                t = term(w)
                known[w] = names.get(t, -1) if t else -2
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def find(self, texts: list[bytes]) -> list[tuple[int, int, int, float, float, float]]:
        """(text number, item, passage, score, question share, answer share) of every verified item, its best passage."""
        index, kept, sizes = self.index, [], []
        if not index.names:
            return []
        for t in texts:
            ids = self._ids(t.split())
            ids = ids[ids > -2]
            kept.append(ids)
            sizes.append(-(-len(ids) // index.block))
        first = np.cumsum([0, *sizes])
        if not first[-1]:
            return []
        block = np.concatenate([first[k] + np.arange(len(x)) // index.block for k, x in enumerate(kept)])
        flat = np.concatenate(kept)
        pair = np.unique((block * len(index.names) + flat)[flat >= 0])
        b, t = pair // len(index.names), pair % len(index.names)
        bound = np.bincount(b, index.top[t], first[-1])
        owner = np.repeat(np.arange(len(texts)), sizes)
        follows = np.r_[owner[1:] == owner[:-1], False]
        total = bound + np.where(follows, np.r_[bound[1:], 0], 0)
        begin = np.searchsorted(b, np.arange(first[-1] + 1))
        best: dict[tuple[int, int], tuple] = {}
        for p, block in self._survivors(np.flatnonzero(total >= 1 - SLACK), follows, begin, t):
            last = p + 1 if follows[p] else p
            query = np.unique(t[begin[p]:begin[last + 1]])
            for item, score in wand(index, query, block):
                own = kept[owner[p]][(p - first[owner[p]]) * index.block:(last + 1 - first[owner[p]]) * index.block]
                q, a = self._overlap(item, own)
                if q >= QUESTION and a >= ANSWER:
                    key, row = (int(owner[p]), item), (score, q, a, int(p - first[owner[p]]))
                    if key not in best or (row[1] + row[2], row[0], -row[3]) > (best[key][1] + best[key][2], best[key][0], -best[key][3]):
                        best[key] = row
        return [(k, item, r[3], r[0] * THRESHOLD, r[1], r[2]) for (k, item), r in sorted(best.items())]

    def _survivors(self, passages: np.ndarray, follows: np.ndarray, begin: np.ndarray, t: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, block of items) whose bound reaches 1; a limited number of bounds is held at a time."""
        step = max(1, CELLS // max(1, self.index.n_blocks))
        for a in range(0, len(passages), step):
            some = passages[a:a + step]
            stop = begin[some + np.where(follows[some], 2, 1)]
            n = stop - begin[some]
            at = np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pair = np.unique(np.repeat(np.arange(len(some)), n) * len(self.index.names) + t[at])
            high = self.index.bounds(pair // len(self.index.names), pair % len(self.index.names), len(some))
            for p, block in np.argwhere(high >= 1 - SLACK):
                yield int(some[p]), int(block)

    def _overlap(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        names = self.index.names
        runs, ids = self.index.questions[item], passage.tolist()
        sizes = {len(r) for r in runs}
        there = {tuple(ids[i:i + n]) for n in sizes for i in range(len(ids) - n + 1)}
        q = sum(tuple(names[x] for x in r) in there for r in runs) / len(runs) if runs else 1.0
        own = self.index.answers[item]
        held = set(ids)
        return q, (sum(names[x] in held for x in own) / len(own) if own else 1.0)


def indexes(benchmark: DataFrame) -> list[Index]:
    """The index in parts of a bounded number of item words."""
    spark = benchmark.sparkSession
    items = benchmark.filter(F.col("text").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("no"))
    items = C.stored(items, f"{C.scratch(spark, 'benchmark')}/items")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(n, t, f, sum(tf.values())) for n, x in zip(b["no"].to_pylist(), b["text"].to_pylist(), strict=True) for tf in [Counter(terms(x))] for t, f in tf.items()]
            yield pa.RecordBatch.from_pydict({"no": pa.array([r[0] for r in rows], pa.int64()), "term": pa.array([r[1] for r in rows], pa.binary()), "size": pa.array([r[3] for r in rows], pa.int64())})

    postings = C.stored(items.mapInArrow(split, "no long, term binary, size long"), f"{C.scratch(spark, 'benchmark')}/postings")
    sizes = postings.groupBy("no").agg(F.first("size").alias("size"))
    s = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("longest")).first()
    if not s["n"]:
        return []
    parts = -(-s["words"] // PART_WORDS)
    df = postings.groupBy("term").agg(F.countDistinct("no").alias("df"))
    block = max(LEAST_BLOCK, s["longest"])
    out = []
    for p in range(parts):
        mine = items.filter(F.pmod(F.xxhash64("no"), F.lit(parts)) == p)
        own = {bytes(r["term"]): r["df"] for r in df.join(postings.filter(F.pmod(F.xxhash64("no"), F.lit(parts)) == p).select("term").distinct(), "term").collect()}
        rows = [(r["item_id"], r["text"]) for r in mine.orderBy("no").collect() if terms(r["text"])]
        out.append(Index(rows, own, s["n"], s["words"] / s["n"], block))
    return out


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and verified item: doc_id, item_id, passage, score, question_share, answer_share."""
    spark = docs.sparkSession
    C.small_batches(spark)
    kinds = [dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, passage long, score double, question_share double, answer_share double"
    item_type = pa.int64() if kinds[1] == "bigint" else None
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value)
            for b in batches:
                hits = m.find(list(C.texts(b["text"])))
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array([h[0] for h in hits], pa.int64())), pa.array([m.index.ids[h[1]] for h in hits], item_type),
                                                  *(pa.array([h[i] for h in hits], kind) for i, kind in ((2, pa.int64()), (3, pa.float64()), (4, pa.float64()), (5, pa.float64())))],
                                                 ["doc_id", "item_id", "passage", "score", "question_share", "answer_share"])

        one = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(find, schema)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a verified item."""
    spark = docs.sparkSession
    C.small_batches(spark)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m = Matcher(shared.value)
            for b in batches:
                bad = {h[0] for h in m.find(list(C.texts(b["text"])))}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, T.StructType(docs.schema.fields))
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {}
