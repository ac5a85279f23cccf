"""Operators that return documents carry further columns, whatever they are called."""

import zstandard

from studiolake.llm import langid, pii, quality

from .conftest import words

KIND = "doc_id long, text string, source string, gone string, _text_hash long, d long, t string, _th string, own_id long, row string, _spans long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "h", "g", 7, 8, "t", "th", 9, "r", 10) for i, t in rows], KIND)


def carried(r):
    return (r.source, r.gone, r._text_hash, r.d, r.t, r._th, r.own_id, r.row, r._spans)


def test_clean_and_sanitise_carry_all(spark):
    line = " ".join(words(12, 77))
    rows = [(i, " ".join(words(40, i, 4000)) + "\n" + line + f"\nask jo{i}@ex.org") for i in range(12)]
    for out, gone in ((quality.clean(docs(spark, rows)), line), (pii.sanitise(docs(spark, rows)), "@ex.org")):
        got = out.collect()
        assert out.columns == docs(spark, rows).columns and len(got) == 12
        assert all(carried(r) == ("h", "g", 7, 8, "t", "th", 9, "r", 10) and gone not in r.text for r in got)


def test_clean_and_sanitise_of_edge_rows(spark, edge, empty):
    for f in (quality.clean, pii.sanitise):
        assert f(edge).columns == edge.columns and f(empty).collect() == []
    assert pii.sanitise(edge).count() == edge.count()


def test_language_is_the_smallest_code_by_zstandard_itself(spark):
    """The classifier against plain calls of the library: one dictionary a language, the shortest code wins."""
    alphabet = {"aa": "abcdefghij", "bb": "jihgklmnop", "cc": "qrstuvwxyz"}

    def text(lang: str, seed: int, n: int) -> str:
        return " ".join("".join(alphabet[lang][int(c)] for c in w[1:]) for w in words(n, seed, 300))
    rows = [(100 * k + i, text(lang, 50 * k + i, 3 + i * i), lang) for k, lang in enumerate(alphabet) for i in range(40)]
    rows += [(900 + i, text("aa", i, 6) + " " + text("bb", i, 6), None) for i in range(10)] + [(990, None, "aa"), (991, "12 -", "bb"), (992, "ab", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    known = langid.learn(table)
    assert [k for k, _ in known] == sorted(alphabet) and all(0 < len(d) <= langid.DICTIONARY_BYTES for _, d in known)

    def size(raw: bytes, body: bytes) -> int:
        level = langid.SHORT_LEVEL if len(body) < langid.SHORT else langid.LEVEL
        coder = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        return sum(len(coder.compress(body[a:a + langid.BLOCK])) for a in range(0, len(body), langid.BLOCK))
    got = {r.doc_id: r for r in langid.classify(table, known).collect()}
    right = 0
    for i, t, lang in rows:
        body = langid.fold(t or "")
        if not body:
            assert (got[i].lang_pred, got[i].score, got[i].accepted) == ("und", 0.0, False)
            continue
        sizes = [size(raw, body) for _, raw in known]
        best = min(range(len(sizes)), key=lambda k: (sizes[k], k))  # ties: the language with more labelled rows, then by name
        rest = min(s for k, s in enumerate(sizes) if k != best)
        assert (got[i].lang_pred, got[i].score) == (known[best][0], (rest - sizes[best]) / rest)
        assert got[i].accepted == (got[i].score >= langid.LEAST_MARGIN)
        right += got[i].lang_pred == lang
    assert right >= 115
