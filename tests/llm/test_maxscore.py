"""Operator 13 against all products, in SQL and here."""

import random

import numpy as np
import pytest

from studiolake.llm import maxscore

ROWS = "vec_id long, embedding array<float>, label int, score long, query long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], ROWS)


def some(n: int, dims: int, seed: int) -> list:
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 0.3) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize(("asked", "sample", "block"), [(16_384, 64, 8_192), (2, 2, 7)])
def test_all_products(against_sql, spark, monkeypatch, asked, sample, block):
    monkeypatch.setattr(maxscore, "ASKED", asked)
    monkeypatch.setattr(maxscore, "SAMPLE", sample)
    monkeypatch.setattr(maxscore, "BLOCK", block)
    got = against_sql("op13_exact_top_k", embeddings=vectors(spark, some(700, 12, 3)))
    assert len(got) == 70


def test_edge_rows(against_sql, spark):
    rows = [(0, [1.0, -1.0]), (0, [1.0, -1.0]), (0, [1.0, 1.0]), (100, [-0.5]), (200, []), (300, None), (400, [None, 1.0]), (500, [float("nan")]), (600, [float("inf"), 0.0])]
    rows += [(None, [1.0, -1.0]), (None, None), (-100, [0.0001, -0.0001, 5.0])] + [(i, [1.0, -1.0]) for i in range(1, 14)] + [(7, [1.0, -1.0, 0.0])]
    got = against_sql("op13_exact_top_k", embeddings=vectors(spark, rows))
    assert set(got.query_id) == {0, 100, 200, -100} and (got.groupby("query_id")["rank"].max() == 10).all()


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(100, [1.0]), (100, [1.0])], [(1, [2.0]), (None, [1.0])]])
def test_few_rows(against_sql, spark, rows):
    assert len(against_sql("op13_exact_top_k", embeddings=vectors(spark, rows))) == (2 if len(rows) == 2 and rows[0][0] == 100 else 0)


def test_ties_everywhere(against_sql, spark):
    got = against_sql("op13_exact_top_k", embeddings=vectors(spark, [(i, [1.0, 0.0] if i % 2 else [0.0, 0.0]) for i in range(250)]))
    assert got[got.query_id == 100].vec_id.tolist() == [i for i in range(10)]


def test_wide_sums_and_no_term_is_essential():
    rng = np.random.default_rng(1)
    for scale in (40, 1 << 28):
        all_ = rng.integers(-scale, scale, (500, 9))
        lists = maxscore.Lists(all_[:20], 5, None)
        for a in range(0, 500, 60):
            lists.add(np.arange(a, min(a + 60, 500)), np.zeros(min(60, 500 - a), bool), np.ascontiguousarray(all_[a:a + 60].T))
        for q, (score, ids, _) in zip(all_[:20], lists.best, strict=True):
            want = sorted((-sum(int(x) * int(y) for x, y in zip(q, v, strict=True)), i) for i, v in enumerate(all_))[:5]
            assert [(-int(s), int(i)) for s, i in zip(score, ids, strict=True)] == want
