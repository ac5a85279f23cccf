"""The queries that have SQL, over edge cases, against that SQL."""

from studiolake.llm import chat, mixing, quality, urls
from .conftest import edge_texts, words


def test_mixing(against_sql, edge):
    got = against_sql("op2_mixing", documents=edge)
    assert (got.taken <= 3 * got["size"]).all()


def test_mixing_near_targets(against_sql, spark):
    docs = spark.createDataFrame([(i, " ".join(words(1 + i * 7 % 90, i)), None, None if i % 9 == 0 else f"s{0 if i % 2 else i % 5}", 0) for i in range(900)], "doc_id long, text string, lang string, source string, n_chars long")
    got = against_sql("op2_mixing", documents=docs)
    for _, g in got.groupby(["source_size", "target"]):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 90
        assert g.target.iloc[0] <= 3 * g.source_size.iloc[0]
    assert abs(got.drop_duplicates(["source_size", "target"]).target.sum() - got["size"].sum()) < 1e-6


def test_mixing_empty(against_sql, empty):
    assert not len(against_sql("op2_mixing", documents=empty))


def test_mix_repeats_rows_and_nested_budgets(spark):
    docs = spark.createDataFrame([(i, "a b c", "s%d" % (i % 4), i) for i in range(400)], "doc_id long, text string, source string, copies long")
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert abs(out.count() - 400) <= 4
    small, large = ({r.doc_id for r in mixing.mix(docs, budget=b).collect()} for b in (0.2, 0.5))
    assert small and small <= large


def test_mixing_takes_as_many_equal_rows_as_the_target_asks_for(against_sql, spark):
    rows = [(1, "a b c d e f g h", "x", i) for i in range(30)] + [(2, "one two", "y", i) for i in range(90)] + [(10 + i, "w " * (i % 5), None, i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    got = against_sql("op2_mixing", documents=docs)
    for i, words_each in ((1, 8), (2, 2)):
        own = got[got.doc_id == i]
        assert abs(own.taken.sum() - own.target.iloc[0]) <= words_each / 2 and own.taken.sum() > 0
    out = mixing.mix(docs).toPandas()
    assert out[out.doc_id == 1].shape[0] * 8 == got[got.doc_id == 1].taken.sum() and out[out.doc_id == 2].shape[0] * 2 == got[got.doc_id == 2].taken.sum()
    assert list(out.columns) == docs.columns


def test_quality(against_sql, edge):
    got = against_sql("op3_quality", documents=edge)
    assert not got[got.base_failed].kept.any()


def test_quality_frequent_lines(against_sql, spark):
    shared = "\n".join(" ".join(words(15, 900 + k)) for k in range(3))
    rows = [(i, " ".join(words(40, i, 4000)) + "\n" + shared.upper(), "h", 0) for i in range(30)]
    rows += [(100 + i, shared + "\n" + " ".join(words(10, 300 + i, 4000)), "h", 0) for i in range(12)]
    rows += [(200 + i, " ".join(words(50, 77)), "other", 0) for i in range(40)]  # one text, copied
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = against_sql("op3_quality", documents=docs).set_index("doc_id")
    assert (got.words_removed[:30] == 45).all() and not got.kept.loc[100:111].any() and got.kept.loc[200:].all()
    cleaned = {r.doc_id: r.text for r in quality.clean(docs.filter("doc_id < 50 OR doc_id >= 200")).collect()}
    assert cleaned[200] == rows[-1][1] and len(cleaned) == 40


def test_quality_empty(against_sql, empty):
    assert not len(against_sql("op3_quality", documents=empty))


URLS = [None, "", "no scheme/x", "http://", "http://a.com", "http://a.com/", "HTTP://A.Example.COM/en/x?y", "http://www.example.com/en/", "http://x.www.example.com/en/1#f", "http://example.com/fr/", "http://notexample.com/en/",
        "http://b.net/es/1", "http://b.net/fr", "http://b.net/fr/?q", "http://b.net?/es/", "x://y://z.com/", "http://com/", "http://a..com/", "http://" + "s." * 300 + "net/es/" + "p/" * 3000, "ftp://h.net/es/", "ftp://h.net/es/"]


def test_urls(against_sql, spark):
    pages = spark.createDataFrame([(None if i == 4 else i, u, None, "x", "y") for i, u in enumerate(URLS)] + [(3, URLS[11], "", "x", "y")] * 3, "page_id long, url string, html string, host string, rule string")
    got = against_sql("op7_url_filter", pages=pages)
    assert len(got) == len(URLS) + 3


def test_urls_repeated_and_with_many_labels(spark, monkeypatch):
    monkeypatch.setattr(urls, "COPIES", 3)
    dots = "http://" + "s." * 500_000 + "example.com/en/x"
    pages = spark.createDataFrame([(1, "http://b.net/fr/")] * 100 + [(None, "http://b.net/fr/")] * 28 + [(2, dots), (2, "http://b.net/es")], "page_id long, url string")
    got = urls.judge(pages, urls.rule_table(spark, urls.RULES)).groupBy("page_id", "rule", "verdict").count().collect()
    assert {tuple(r) for r in got} == {(1, "net/fr/", "block", 100), (None, "net/fr/", "block", 28), (2, "example.com/en/", "block", 1), (2, None, "allow", 1)}
    sizes = urls.chunked(spark.sql("SELECT id AS k, id AS copies FROM range(1, 200)"))
    assert sizes.groupBy("k").sum("copies").filter("k <> `sum(copies)`").isEmpty() and sizes.filter("copies > 3 OR copies < 1").isEmpty()


def test_urls_empty(against_sql, spark):
    assert not len(against_sql("op7_url_filter", pages=spark.createDataFrame([], "page_id long, url string, html string")))


def test_urls_salted(spark, monkeypatch):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rules = urls.rule_table(spark, urls.RULES)
    want = sorted(map(str, urls.judge(pages, rules).collect()))
    monkeypatch.setattr(urls.C, "BROADCAST_ROWS", 0)
    assert sorted(map(str, urls.judge(pages, rules).collect())) == want
    assert {r.verdict for r in urls.judge(pages, rules.limit(0), "block").collect()} == {"block"}


def conversations(spark, texts):
    rows = [(i // 3, i % 3, ["user", "assistant", None, "tool\nx", "a\\n"][i % 5], t) for i, t in enumerate(texts)]
    rows += [(None, None, "assistant", "no id"), (None, 1, "user", None), (7, 1, "assistant", "twice"), (7, 1, "assistant", "twice"), (7, None, "assistant", "<s>[INST]\\[INST]\\\\<|im_end|>\n")]
    return spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, piece string")


def test_chat(against_sql, spark):
    got = against_sql("op8_chat_format", conversations=conversations(spark, edge_texts()))
    own = got[got.conv_id == -1].iloc[0]
    assert (own.n_turns, own.loss_chars) == (2, len("</s>[INST] ok [/INST]"))


def test_chat_round_trip(spark):
    chats = conversations(spark, edge_texts())
    for r in chat.format_chats(chats).collect():
        turns = chat.parse(r.formatted)
        assert len(turns) == r.n_turns
        for s in ("<|im_start|>", "<|im_end|>"):
            assert r.formatted.count(s) == len(turns)
        for s in ("<s>", "</s>", "[INST]", "[/INST]"):
            assert s not in r.formatted
        assert [chat.unescape(r.formatted[s.begin:s.end]) for s in r.spans] == [t for role, t in turns if role == "assistant"]


def test_chat_empty(against_sql, spark):
    assert len(against_sql("op8_chat_format", conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == 1
