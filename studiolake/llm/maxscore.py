"""Operator 13: exact top-k by inner product with MaxScore.

Components become integers, floor(scale * x).  A term is a dimension; its postings are the components of a shard's
vectors.  A query's term scores w * v and so at most the larger of w * high and w * low, where high and low are the
dimension's extremes in the shard's block (0 at least).  Against the query's k-th score so far, the terms of the lowest
bounds whose sum stays below that score are non-essential: no vector gets in by them alone.  Per block and query

1. the essential terms' postings are traversed and summed,
2. vectors whose sum and all non-essential bounds together stay below the k-th score are left,
3. the others are probed term by term, highest bound first, while they can still compete,
4. what remains has its exact score and enters the query's list (higher score, then smaller id).

Each task keeps the lists of its shard; lists of all shards are merged by query.  The k-th score starts from the k-th best
in a sample of the vectors (1 of ``SAMPLE``, by hash), which is a lower bound and leaves the result as it is, so shards
give out little that does not compete.

Queries are taken in blocks of about ``ASKED`` distinct (id, vector) pairs; only one block is broadcast at a time, and
every block meets all vectors.  Lists run to k + 1 places; the query's own row, which is one place of its id and its own
product, is then taken out, wherever rows of the same id or vector stand.

Cases: a vector that is null or holds a null or non-finite component takes no part; an empty vector scores 0 with all;
of vectors of different lengths the shorter is filled with 0; a null id is no query and comes after all ids in ties;
repeated rows are candidates, and queries, of their own; an empty table gives no rows; further columns are ignored.
Sums that could leave 53 bits are made with unbounded integers; a score must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studiolake.llm import common as C

SCALE, TOP, QUERY_STEP = 1024, 10, 100
ASKED = 16_384
SAMPLE = 64
BLOCK = 8_192
_LAST = (1 << 63) - 1
_EXACT = 1 << 53


def scaled(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id and v, the integer components, of the rows that take part."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    sound = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull() & sound) \
               .select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """Dimensions x vectors; shorter vectors are filled with 0, components beyond ``dims`` are left out."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0)) if dims is None else dims
    if len(flat) == len(sizes) * width and (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(len(sizes), width).T)
    out = np.zeros((width, len(sizes)), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    inside = at < width
    out[at[inside], np.repeat(np.arange(len(sizes)), sizes)[inside]] = flat[inside]
    return out


class Lists:
    """The best ``places`` of each query of a block over the vectors seen: score (descending), then id."""

    def __init__(self, queries: np.ndarray, places: int, floors: np.ndarray | None):
        self.queries, self.places = queries, places
        self.floors = floors if floors is not None else np.full(len(queries), -_LAST, np.int64)
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64),) * 2 + (np.empty(0, bool),)] * len(queries)
        self.largest = int(np.abs(queries).max(initial=0))

    def add(self, ids: np.ndarray, no_id: np.ndarray, lists: np.ndarray) -> None:
        """A block of vectors (its postings lists: dimensions x vectors)."""
        if not lists.shape[1]:
            return
        exact = max(self.largest, 1) * max(int(np.abs(lists).max(initial=0)), 1) * max(len(lists), 1) < _EXACT
        kind = np.float64 if exact else object
        lists = lists.astype(kind)
        high, low = np.maximum(lists.max(1, initial=0), 0), np.minimum(lists.min(1, initial=0), 0)
        for number, query in enumerate(self.queries):
            floor = int(self.floors[number])
            w = query.astype(kind)
            bound = np.maximum(w * high, w * low)
            order = np.argsort(bound, kind="stable")
            reach = np.cumsum(bound[order])
            split = int(np.searchsorted(reach, floor, "left")) if floor > 0 else 0  # the sum of all before stays below floor
            essential = order[split:]
            score = w[essential] @ lists[essential] if len(essential) else np.zeros(lists.shape[1], kind)
            at = np.flatnonzero(score + (reach[split - 1] if split else 0) >= floor)
            score = score[at]
            for term in range(split - 1, -1, -1):
                if not len(at):
                    break
                score = score + w[order[term]] * lists[order[term]][at]
                still = score + (reach[term - 1] if term else 0) >= floor
                at, score = at[still], score[still]
            if len(at):
                self._enter(number, score.astype(np.int64), ids[at], no_id[at])

    def _enter(self, number: int, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        score, ids, no_id = (np.concatenate(x) for x in zip(self.best[number], (score, ids, no_id), strict=True))
        keep = np.lexsort((ids, no_id, -score))[:self.places]
        self.best[number] = score[keep], ids[keep], no_id[keep]
        if len(keep) == self.places:
            self.floors[number] = max(int(self.floors[number]), int(score[keep[-1]]))

    def rows(self) -> pa.RecordBatch:
        score, ids, no_id = (np.concatenate([b[i] for b in self.best]) if self.best else np.empty(0, np.int64) for i in range(3))
        query = np.repeat(np.arange(len(self.best)), [len(b[0]) for b in self.best])
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(ids, pa.int64(), mask=no_id.astype(bool)), pa.array(score, pa.int64())], ["query", "vec_id", "score"])


def _search(vectors: DataFrame, queries: np.ndarray, places: int, floors: np.ndarray | None) -> DataFrame:
    """query (number in the block), vec_id, score: the best of each query, per shard."""
    held = vectors.sparkSession.sparkContext.broadcast((queries, floors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = held.value
        lists = Lists(queries, places, None if floors is None else floors.copy())
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                b = batch.slice(a, BLOCK)
                no_id = b["vec_id"].is_null().to_numpy(zero_copy_only=False)
                lists.add(b["vec_id"].fill_null(0).to_numpy(), no_id, matrix(b["v"], queries.shape[1]))
        yield lists.rows()

    return vectors.mapInArrow(search, "query long, vec_id long, score long")


def _first(rows: DataFrame, places: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= places)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, folder: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of ``vectors`` (vec_id, v) for each row of ``queries`` (the same
    columns; each is one of the vectors and not its own candidate)."""
    spark, places = vectors.sparkSession, k + 1
    asked = C.stored(queries.groupBy("vec_id", "v").agg(F.count("*").alias("copies")), f"{folder}/queries")
    parts = max(1, -(-asked.count() // ASKED))
    sample = vectors.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(SAMPLE)) == 0)
    out = None
    for part in range(parts):
        mine = asked.filter(F.pmod(F.xxhash64("v", "vec_id"), F.lit(parts)) == part).toArrow().combine_chunks()  # about ASKED rows
        block = np.ascontiguousarray(matrix(pa.concat_arrays(mine["v"].chunks or [pa.array([], pa.list_(pa.int64()))])).T)
        seen = _first(_search(sample, block, places, None), places).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("floor")).toArrow()  # a row per query
        floors, full = np.full(len(block), -_LAST, np.int64), seen["n"].to_numpy() == places
        floors[seen["query"].to_numpy()[full]] = seen["floor"].to_numpy()[full]
        own = [int(x) for x in (block.astype(object) ** 2).sum(1)] if block.shape[1] else [0] * len(block)
        asker = pa.table({"query": pa.array(range(len(block)), pa.int64()), "query_id": mine["vec_id"], "copies": mine["copies"], "own": pa.array(own, pa.int64())})
        best = C.stored(_first(_search(vectors, block, places, floors), places), f"{folder}/best{part}").join(F.broadcast(spark.createDataFrame(asker)), "query")  # at most a block
        best = best.withColumn("part", F.lit(part))
        out = best if out is None else out.unionByName(best)
    # The first place of the query's own id and product goes; without such a place the last one goes.
    mine = F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))
    gone = F.coalesce(F.min(mine).over(W.partitionBy("part", "query")), F.lit(places))
    rest = out.withColumn("gone", gone).filter("place != gone").withColumn("rank", (F.col("place") - (F.col("place") > F.col("gone")).cast("int")).cast("int"))
    return rest.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "maxscore")
    vectors = C.stored(scaled(C.read(spark, sf_dir, "embeddings"), "vec_id", "embedding", SCALE), f"{folder}/vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0), TOP, folder)


ORACLES = {"op13_exact_top_k": f"""
WITH vectors AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % {QUERY_STEP} = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}"""}
QUERIES = {"op13_exact_top_k": op13_exact_top_k}
