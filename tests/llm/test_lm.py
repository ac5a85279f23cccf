import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard

from pyspark.sql import functions as F

from studiolake.llm import lm as L


def base(rows):
    """Token counts and base scores by hand; rows: id, text, held out."""
    tokens = [[*(t or "").encode().lower().split(), b""] for _, t, _ in rows]
    c = Counter(w for (_, _, held), ws in zip(rows, tokens, strict=True) if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for (i, _, held), ws in zip(rows, tokens, strict=True)]


def hold(got, rows):
    key = lambda r: repr(r[:5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want = sorted(base(rows), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)


def test_edge_cases(spark, edge, empty, monkeypatch):
    held = F.coalesce(F.col("doc_id") % 5 == 2, F.lit(False))
    docs = edge.withColumn("held_out", held)
    rows = [(r.doc_id, r.text, r.held_out) for r in docs.collect()]
    got = L.score(docs).collect()
    hold(got, rows)
    assert all(r.score < 0 for r in got)
    monkeypatch.setattr(L, "BATCH_TOKENS", 50)
    monkeypatch.setattr(L, "FAN", 2)  # many batches: folded and answered in groups
    hold(L.score(docs).collect(), rows)
    hold(L.score(docs, least=1).collect(), rows)
    assert L.score(empty.withColumn("held_out", F.lit(False))).collect() == []
    hold(L.score(docs.withColumn("held_out", F.lit(True))).collect(), [(i, t, True) for i, t, _ in rows])


def test_tables(spark):
    got = L.op9_lm_score(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    hold(got, [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs])
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.85 * sum(r.base_score for r in held)


def test_seating_follows_the_stated_distribution():
    rng = np.random.default_rng(0)
    d, b, c = 0.5, 1.7, 6
    s = L.stirling(d)[c, 1:c + 1] + np.log(b) * np.arange(1, c + 1)
    p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
    drawn = np.bincount(L.seat(np.full(40_000, c), np.full(40_000, b), d, rng), minlength=c + 1)[1:] / 40_000
    assert np.abs(drawn - p).max() < 0.01
    many = L.seat(np.array([0, 1, 2, 300, 5000, 10**7]), np.array([1.0, 1, 1, 5, 1e-9, 50]), d, rng)
    assert many[0] == 0 and many[1] == 1 and (many <= [0, 1, 2, 300, 5000, 10**7]).all() and many[4] >= 1


def test_spelling_is_a_distribution():
    words = [b"ab", b"", b"ba", b"abab", "é".encode()]
    data, lens = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    keys, n = L.spell_counts(data, lens, np.array([5, 2, 1, 3, 1]))
    assert n.sum() == (lens + 1) @ [5, 2, 1, 3, 1]
    rng, model = np.random.default_rng(1), None
    for _ in range(2):
        model = L.spelling_model(keys, n, model, rng)
        assert np.allclose(model["p"][0].reshape(-1, L.SYMBOLS).sum(1), 1)
    assert L.spelled(data, lens, model["log"])[0] > L.spelled(np.frombuffer(b"zq", np.uint8), np.array([2]), model["log"])[0]


def test_the_word_before_tells_letters_apart(spark):
    """Each of 20 first words has its own second one; a model that throws their last letters together can't tell which."""
    letters = "abcdefghijklmnopqrst"
    pairs = [f"x{c} y{i}" for i, c in enumerate(letters)]
    wrong = [f"x{c} y{(i + 1) % len(letters)}" for i, c in enumerate(letters)]
    rows = [(k, t, False) for k, t in enumerate(pairs * 40)] + [(5000 + i, t, True) for i, t in enumerate(pairs)] + [(6000 + i, t, True) for i, t in enumerate(wrong)]
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    better = [got[5000 + i] - got[6000 + i] for i in range(len(letters))]
    assert len(set(L.word_class(np.frombuffer(letters.encode(), np.uint8)).tolist())) >= 16
    assert sum(b > 0.5 for b in better) >= 16


def test_a_word_before_has_its_own_restaurant(spark):
    """First words of one class (equal last letters), each with its own second word."""
    pairs, wrong = [f"{c}x y{i}" for i, c in enumerate("abcdefgh")], [f"{c}x y{(i + 1) % 8}" for i, c in enumerate("abcdefgh")]
    rows = [(k, t, False) for k, t in enumerate(pairs * 40)] + [(5000 + i, t, True) for i, t in enumerate(pairs)] + [(6000 + i, t, True) for i, t in enumerate(wrong)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r.doc_id: r.score for r in L.score(docs).collect()}
    assert all(got[5000 + i] - got[6000 + i] > 1 for i in range(8))
    shared = {r.doc_id: r.score for r in L.score(docs, least=10**6).collect()}
    assert abs(sum(shared[5000 + i] - shared[6000 + i] for i in range(8))) < 1e-6  # the class alone can't tell which follows which


def test_rare_words_have_restaurants_of_their_own(spark):
    """Previous words learnt twice beside one learnt thousands of times, all of one class: none falls to the class."""
    pairs, wrong = [f"{c}x y{i}" for i, c in enumerate("abcdefgh")], [f"{c}x y{(i + 1) % 8}" for i, c in enumerate("abcdefgh")]
    rows = [(k, t, False) for k, t in enumerate(pairs * 2)] + [(100 + k, "zx " * 2000, False) for k in range(20)] \
        + [(5000 + i, t, True) for i, t in enumerate(pairs)] + [(6000 + i, t, True) for i, t in enumerate(wrong)]
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert all(got[5000 + i] - got[6000 + i] > 0.3 for i in range(8))


def test_probabilities_by_hand(spark, monkeypatch):
    """Dishes of one customer have one table, so nothing is random; the spelling is fixed to 1 / 257 a symbol."""
    flat = np.full(L.SLOTS3 * L.SYMBOLS, np.log(1 / 257), np.float32)
    monkeypatch.setattr(L, "spelling", lambda *_: {"log": flat})
    rows = [(1, "a b", False), (2, "A b b", True), (3, "z a", True)]
    got = {r.doc_id: r.score for r in L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), least=1).collect()}
    base = {"a": 257.0**-2, "b": 257.0**-2, "": 257.0**-1}
    base["?"] = 1 - sum(base.values())
    (d2, s2), (d1, s1), (d0, s0) = L.CONTEXT_PARAMETERS, L.CLASS_PARAMETERS, L.WORD_PARAMETERS
    p0 = {w: ((w != "?") * (1 - d0) + (s0 + 3 * d0) * b) / (s0 + 3) for w, b in base.items()}
    p1 = lambda w, there: (there * (1 - d1) + (s1 + d1) * p0[w]) / (s1 + 1)
    p2 = lambda w, there: (there * (1 - d2) + (s2 + d2) * p1(w, there)) / (s2 + 1)
    want = {1: [p1("a", 1), p2("b", 1), p2("", 1)], 2: [p1("a", 1), p2("b", 1), p2("b", 0), p2("", 1)],
            3: [p1("?", 0), p0["a"], p2("", 0)]}  # z is no context and its class saw nothing: the unigram
    assert len({L.word_class(np.frombuffer(c, np.uint8))[0] for c in (b"a", b"b", b"z")}) == 3
    for i, ps in want.items():
        assert math.isclose(got[i], sum(map(math.log10, ps)), rel_tol=1e-5)


def test_counts_beyond_32_bits_are_kept():
    batch = {"part": 0, "words": zstandard.compress(b"the"), "lens": L._pack(np.array([3], np.uint32)), "type_word": L._pack(np.array([0], np.uint32)),
             "type_context": L._pack(np.array([0], np.uint32)), "counts": L._pack(np.array([4_000_000_000], np.int64))}
    cls = np.arange(L.CLASSES)
    state = dict(zip((x.split()[0] for x in L._STATE.split(", ")), L.first_state(0, pa.Table.from_pylist([batch, batch]), cls), strict=True))
    assert L.Part(state, cls).counts.tolist() == [8_000_000_000]


def test_only_the_scores_stay_on_disk(spark, tmp_path, monkeypatch):
    """Whatever past sweeps and rounds stored goes, rounds score every batch once, and the session's setting comes back."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    monkeypatch.setattr(L.C, "scratch", lambda *_: str(tmp_path / "lm"))
    monkeypatch.setattr(L, "BATCH_TOKENS", 50)
    monkeypatch.setattr(L, "FAN", 2)
    spark.conf.set(setting, "false")
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on mat {i}", i % 5 == 0) for i in range(40)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    assert sorted(p.name for p in (tmp_path / "lm").iterdir() if not p.name.startswith(".")) == [f"scores{k}" for k in range(L.ROUNDS)]
    assert spark.conf.get(setting) == "false"
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_few_batches_are_answered_in_two_rounds(spark, tmp_path, monkeypatch):
    """Half of what is asked and answered is on disk at a time, also while one group could answer all."""
    monkeypatch.setattr(L.C, "scratch", lambda *_: str(tmp_path / "lm"))
    monkeypatch.setattr(L, "BATCH_TOKENS", 20)
    rows = [(i, f"the cat {'sat' if i % 2 else 'ran'} on mat {i}", i % 5 == 0) for i in range(40)]
    got = L.score(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"))
    assert sorted(p.name for p in (tmp_path / "lm").iterdir() if p.name.startswith("scores")) == ["scores0", "scores1"]
    assert sorted(r.doc_id for r in got.collect()) == list(range(40))


def test_words_of_a_column_are_those_of_the_bytes(edge):
    texts = [r.text for r in edge.collect()] + [" ", "\x0ba\x1cB\x85 C ", "a" * 3]
    words, sizes = L.split_words(pa.array(texts))
    want = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(w) + 1 for w in want]
    assert words.cast(pa.binary()).to_pylist() == sum(want, [])
    batch = L.batch_of(7, [(pa.array(range(len(texts))), pa.array([i % 3 == 0 for i in range(len(texts))]), words, sizes)], [x.split()[0] for x in L._BATCH.split(", ")]).to_pylist()[0]
    data, lens, h = L._words_of(batch)
    listed = [data[e - n:e].tobytes() for e, n in zip(np.cumsum(lens), lens, strict=True)]
    assert (np.diff(h.astype(object)) > 0).all() and [listed[k] for k in L._unpack(batch["stream"], np.uint32)] == sum(([*w, b""] for w in want), [])
    learnt = Counter(w for i, ws in enumerate(want) if i % 3 for w in [*ws, b""])
    assert L._unpack(batch["seen"], np.int64).tolist() == [learnt[w] for w in listed] and batch["learnt"] == sum(learnt.values())


def test_memory_goes_back_when_a_worker_turns_to_another_step(monkeypatch):
    calls = []
    monkeypatch.setattr(L.C, "_step", None)
    monkeypatch.setattr(L.C.ctypes, "CDLL", lambda _: type("Libc", (), {"malloc_trim": staticmethod(calls.append)}))
    for step in ("counts", "counts", "sweeps", "sweeps", "counts"):
        L.C.begin_step(step)
    assert calls == [0, 0, 0]


def _peak_mb(f):
    tracemalloc.start()
    try:
        out = f()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_spelling_holds_few_words_at_a_time():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 12, 100_000)
    data, model = rng.integers(97, 123, int(lens.sum())).astype(np.uint8), rng.random(L.SLOTS3 * L.SYMBOLS).astype(np.float32)
    got, peak = _peak_mb(lambda: L.spelled(data, lens, model))
    assert peak < 30  # 52 with the symbols of all words at once
    ends = np.r_[0, np.cumsum(lens)]
    one = [L.spelled(data[ends[i]:ends[i + 1]], lens[i:i + 1], model)[0] for i in (0, 16_383, 16_384, 99_999)]
    assert got[[0, 16_383, 16_384, 99_999]].tolist() == one


def test_types_are_numbered_in_little_memory():
    rng = np.random.default_rng(4)
    sizes = np.full(1000, 500)
    stream = rng.integers(0, 5000, int(sizes.sum())).astype(np.uint32)
    r = {"stream": L._pack(stream), "sizes": L._pack(sizes.astype(np.uint32))}
    (kinds, which, _), peak = _peak_mb(lambda: L.types_of_batch(r))
    tokens, _ = L._tokens_of(r)
    known, number = np.unique(tokens, return_inverse=True)
    assert (kinds == known).all() and (which == number).all()
    assert peak < 36 * len(stream) / 1e6  # 57 bytes a token with np.unique


def test_numbered_dishes():
    word, cls = np.array([0, 0, 1, 3, 3], np.uint32), np.array([5, 2, 31, 0, 0], np.int8)
    dishes, dish = L._dishes(word, cls, 4)
    assert dishes.tolist() == [2, 5, 63, 96] and dish.tolist() == [1, 0, 2, 3, 3]
    assert [x.tolist() for x in L._dishes(word[:0], cls[:0], 0)] == [[], []]


def test_packed_rows_travel_few_at_a_time(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    with L.C.blob_batches(spark):
        seen = spark.range(10, numPartitions=1).mapInArrow(lambda rows: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())}) for b in rows), "n long").collect()
    assert max(r.n for r in seen) == 4 and sum(r.n for r in seen) == 10
    assert spark.conf.get(setting) == before
