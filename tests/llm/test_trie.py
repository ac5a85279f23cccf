"""Operator 12 against its SQL, which forms every prefix as a list."""

import hashlib

import pytest

from studiolake.llm import trie

CHATS = "conv_id long, turn long, role string, text string, k1 string, block long"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], CHATS)


def edge_rows():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {c % 3 if t > 1 else 0}") for c in range(60) for t in range(c % 7)]
    rows += [(0, None, None, None), (0, None, "a", None), (None, 1, "user", "no id"), (None, None, None, None)]
    rows += [(3, 0, "user", "twice"), (3, 0, "user", "twice"), (5, 0, "ab", "c"), (6, 0, "a", "bc")]
    rows += [(300 + c, 0, "user", "x" * 3000) for c in range(4)] + [(-100, 0, "user", "below zero"), (-130, 1, "user", "below zero"), (1 << 62, 1, "a", "far")]
    return rows


def test_edge_rows(against_sql, spark):
    got = against_sql("op12_prefix_trie", conversations=chats(spark, edge_rows()))
    root = got[got.depth == 0].iloc[0]
    assert root.n_convs == len({r[0] for r in edge_rows()} - {None}) and root.conv_id == -130


def test_long_conversations_in_many_blocks(against_sql, spark, monkeypatch):
    monkeypatch.setattr(trie, "SPAN", 2)
    rows = [(c, t, "user", f"{t if t < 20 + c % 4 * 9 else (t, c % 5)}") for c in range(1, 30) for t in range(15 + c * 3)]
    got = against_sql("op12_prefix_trie", conversations=chats(spark, rows))
    assert got.depth.max() > 80 and (got.n_children > 2).any()


def test_one_conversation_holds_a_third_and_copies_another(against_sql, spark):
    rows = [(1, t, "user", f"t{t}") for t in range(120)] + [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(2)] + [(c, 0, "user", f"own {c}") for c in range(400, 520)]
    got = against_sql("op12_prefix_trie", conversations=chats(spark, rows))
    assert got.n_convs.max() == 181


def test_ids_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "IDS_PER_TEXT", 3)
    ends = spark.createDataFrame([(c, c % 2, 7) for c in range(101)], "conv_id long, k1 long, k2 long")
    got = {r.k1: r.ends_sha256 for r in trie.digests(ends, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(",".join(str(c) for c in range(k, 101, 2)).encode()).hexdigest() for k in (0, 1)}


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "no id")]])
def test_empty(against_sql, spark, rows):
    assert not len(against_sql("op12_prefix_trie", conversations=chats(spark, rows)))


def test_turnless_conversations_are_members_of_the_root(against_sql, spark):
    got = against_sql("op12_prefix_trie", conversations=chats(spark, [(c, 0, "user", "only") for c in range(101, 120)]))
    assert got[got.depth == 0].n_convs.iloc[0] == 19 > got[got.depth == 1].n_convs.sum()
