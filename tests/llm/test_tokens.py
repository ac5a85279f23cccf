import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from studiolake.llm import common as C
from studiolake.llm import tokens as T


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(T.vocabulary_path())


def expected(rows, whole):
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_encoder_is_the_whole_pipeline(whole, edge):
    enc = T.encoder(T.vocabulary_path())
    assert enc.check
    for r in edge.collect():
        t = r.text or ""
        assert enc.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_encoder_forgets(whole):
    enc = T.Encoder(T.vocabulary_path(), limit=3)
    for t in ("a b c d", "e f g a", "Été, a b", "d d d d"):
        assert enc.encode(t.encode()).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_word_is_looked_up_once_for_many_texts(whole, edge):
    asked = []

    class Counting(T.Encoder):
        def listed(self, words):
            asked.extend(words)
            return super().listed(words)

    texts = [r.text for r in edge.collect()]
    columns = [pa.array(texts), pa.array([None, ""], pa.string()), pa.array(texts * 2).slice(3, len(texts))]
    enc = Counting(T.vocabulary_path(), limit=1000)
    got = list(enc.encode_columns(columns, 2))
    assert len(asked) == len(set(asked))
    for column, (ids, lens) in zip(columns, got, strict=True):
        want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in column.to_pylist()]
        assert lens.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])


def test_texts_are_grouped_up_to_their_bytes(monkeypatch):
    monkeypatch.setattr(T, "GROUP_BYTES", 100)
    batches = [pa.RecordBatch.from_pydict({"text": ["x" * n] * (n > 0)}, pa.schema([("text", pa.string())])) for n in (60, 0, 60, 200, 0, 5, 0)]
    assert [[len(b["text"][0].as_py()) for b in some] for some in T._grouped(batches)] == [[60, 60], [200], [5]]
    assert list(T._grouped(batches[1:2])) == []


def test_output(spark, edge, whole):
    got = [tuple(r) for r in T.token_output(spark, edge).collect()]
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    key = lambda r: (r[1], r[2])
    assert sorted(got, key=key) == sorted(expected(rows, whole), key=key)


def test_whole_table(spark, whole):
    docs = C.read(spark, "/root/testdata/sf0.001", "documents")
    got = sorted(tuple(r) for r in T.op1_token_output(spark, "/root/testdata/sf0.001").collect())
    assert got == expected([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], whole)


def test_empty(spark, empty):
    assert T.token_output(spark, empty).collect() == []


def test_lookup_of_ids_and_foreign_keys(spark, edge, whole):
    folder = C.scratch(spark, "test")
    n = T.write_dataset(edge, folder, T.vocabulary_path(), keys_per_bucket=5)
    assert n > 2
    keys = spark.createDataFrame([(9,), (4,), (999,), (None,)], "doc_id long")
    got = T.read_documents(keys, folder, n, 2, with_ids=True).collect()
    text = {r.doc_id: r.text for r in edge.filter("doc_id IN (4, 9)").collect()}
    for r in got:
        if r.doc_id in text:
            assert r.ids == [*whole.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
    assert sorted(str(r.doc_id) for r in got) == ["4", "9", "None", "None"]


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        h1, h2 = (rng.integers(0, 1 << 64, n, np.uint64) for _ in range(2))
        p = T.PerfectHash.build(h1, h2)
        assert sorted(p.slots(h1, h2)) == list(range(n))
    with pytest.raises(ValueError):
        T.PerfectHash.build(np.array([1, 1], np.uint64), np.array([2, 2], np.uint64))
