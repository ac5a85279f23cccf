"""Operator 11 against the plain definition: every lag tried at every word, in SQL and here."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from studiolake.llm import periodic

from .conftest import words


def plain(w: list) -> list[tuple[int, int, int]]:
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted((*k, q) for k, q in found.items())


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_texts_searched_together(seed):
    rng = random.Random(seed)
    for _ in range(300):
        texts = []
        for _ in range(3):
            n, alphabet, p = rng.randint(0, 60), rng.choice([1, 2, 3, 5]), rng.randint(1, 12)
            w = [rng.randrange(alphabet) for _ in range(n)]
            x = rng.randrange(n) if n and rng.random() < 0.6 else n
            texts.append([b"%d" % c for c in w[:x] + [w[x + (i - x) % min(p, n - x)] for i in range(x, n)]])
        for t, (own, stays) in zip(texts, periodic._several(texts), strict=True):
            want = plain(t)
            assert [tuple(r) for r in own.tolist()] == want
            gone = {i for s, n, q in want for i in range(s + q, s + n)}
            assert np.flatnonzero(~stays).tolist() == sorted(gone)


def test_long_texts_are_linear():
    ((own, stays),) = periodic._several([[b"same"] * 300_000])
    assert own.tolist() == [[0, 300_000, 1]] and stays.sum() == 1
    ((own, _),) = periodic._several([[b"%d" % (i % 30_011) for i in range(200_000)]])
    assert own.tolist() == [[0, 200_000, 30_011]]


def test_query(against_sql, edge):
    got = against_sql("op11_periodic_runs", documents=edge)
    assert (got.n_runs > 0).any()


def test_query_planted(against_sql, spark):
    rows = [(i, " ".join(words(i % 97 * 3, i, 2 + i % 40))) for i in range(400)]
    got = against_sql("op11_periodic_runs", documents=spark.createDataFrame(rows + rows[:40], "doc_id long, text string"))
    assert (got.n_runs > 3).any() and (got.n_runs == 0).any()


def test_query_empty(against_sql, empty):
    assert not len(against_sql("op11_periodic_runs", documents=empty))


def test_carries_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b " * 4, "r", "c", "x"), (2, None, None, "c", None)], "doc_id long, text string, runs string, collapsed string, row string")
    got = {r["row"].doc_id: r for r in periodic.find_runs(docs).collect()}
    assert got[1]["row"].runs == "r" and got[1]["row"].row == "x" and got[1].collapsed == "a b"
    assert [tuple(r) for r in got[1].runs] == [(0, 8, 2)] and got[2].runs == [] and got[2].collapsed == ""


def test_strongest_run_and_its_ties(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j " + "x y x y x y x y " + "k " * 6 + "m " * 6 + "p q r")], "doc_id long, text string")
    r = periodic.find_runs(docs).withColumn("best", periodic.strongest(F.col("runs"))).first()
    assert tuple(r.best) == (18, 6, 1)
