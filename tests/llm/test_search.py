"""Decontamination, language ID, near-duplicates and personal data against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np

from studiolake.llm import common as C
from studiolake.llm import decontaminate as D
from studiolake.llm import langid as L
from studiolake.llm import minhash as M
from studiolake.llm import pii as P

from .conftest import words

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- 4

def items(n=40):
    return [(k, " ".join(words(14 + k % 20, 700 + k, 900)).capitalize() + ".\nThe answer " + " ".join(words(3, 60 + k)) + ".") for k in range(n)]


def brute_matches(texts, bench):
    """Every passage scored against every item, then verified."""
    kept = [(i, t) for i, t in bench if t and D.terms(t)]
    df = Counter(x for _, t in kept for x in set(D.terms(t)))
    sizes = [len(D.terms(t)) for _, t in kept]
    index = D.Index(kept, df, len(kept), sum(sizes) / len(sizes), max(D.LEAST_BLOCK, max(sizes)))
    table = np.zeros((len(index.names), len(kept)))
    for t in range(len(index.names)):
        table[t, index.item[index.start[t]:index.start[t + 1]]] = index.weight[index.start[t]:index.start[t + 1]]
    out, m = set(), D.Matcher(index)
    for d, t in texts:
        ids = m._ids((t or "").encode().split())
        ids = ids[ids > -2]
        for a in range(0, len(ids), index.block):
            if a and a + index.block >= len(ids) + index.block:
                break
            own = ids[a:a + 2 * index.block]
            score = table[np.unique(own[own >= 0])].sum(0)
            for k in np.flatnonzero(score >= 1 - D.SLACK):
                q, x = m._overlap(int(k), own)
                if q >= D.QUESTION and x >= D.ANSWER:
                    out.add((d, kept[k][0]))
    return out


def test_decontamination(spark, edge, monkeypatch):
    bench = [*items(), (90, None), (91, ""), (92, "a"), (93, items()[3][1])]
    rows = [(r.doc_id, r.text) for r in edge.collect() if r.doc_id is not None]
    for k, t in items()[:25]:
        rows.append((1000 + k, " ".join(words(k * 9, k)) + " " + t.upper() + " " + " ".join(words(70, k + 1))))
        rows.append((2000 + k, " ".join(t.split()[: len(t.split()) // 3]) + " " + " ".join(words(200, k + 5, 900))))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    b = spark.createDataFrame(bench, "item_id long, text string")
    want = brute_matches(rows, bench)
    assert {(1000 + k, k) for k in range(25)} <= want and not any(d >= 2000 for d, _ in want)
    assert {(r.doc_id, r.item_id) for r in D.search(docs, b).collect()} == want
    clean = D.decontaminate(docs, b)
    assert clean.columns == docs.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, _ in rows if d not in {x for x, _ in want})
    monkeypatch.setattr(D, "PART_WORDS", 200)
    assert {(r.doc_id, r.item_id) for r in D.search(docs, b).collect()} == want


def test_wand_is_exhaustive():
    rng = np.random.default_rng(0)
    bench = items(60)
    df = Counter(x for _, t in bench for x in set(D.terms(t)))
    index = D.Index(bench, df, len(bench), 25.0, 64)
    for _ in range(60):
        query = np.unique(rng.integers(0, len(index.names), rng.integers(5, 900)))
        score = np.zeros(len(bench))
        for t in query:
            np.add.at(score, index.item[index.start[t]:index.start[t + 1]], index.weight[index.start[t]:index.start[t + 1]])
        bound = index.bounds(np.zeros(len(query), np.int64), query, 1)[0]
        got = {k for block in np.flatnonzero(bound >= 1 - D.SLACK) for k, _ in D.wand(index, query, int(block))}
        assert got == set(np.flatnonzero(score >= 1 - D.SLACK))


def test_decontamination_empty(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.search(edge, none).collect() == [] and D.search(empty, spark.createDataFrame(items(), "item_id long, text string")).collect() == []
    assert D.decontaminate(edge, none).count() == edge.count()


# ---------------------------------------------------------------- 5

def test_language_accuracy(spark):
    docs = C.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    got = L.op5_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(got) == 1000
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and sum(r.accepted for r in got) >= 0.98 * len(got)


def test_language_edge_cases(spark, edge, empty):
    known = [("a", L.fold("alpha beta gamma delta " * 9)), ("b", L.fold("eins zwei drei vier " * 9))]
    got = L.classify(edge, known).collect()
    assert [r.lang_pred == "und" for r in got] == [not re.search(r"[^\W\d_]", r.text or "") for r in got]
    assert all(not r.accepted and r.score == 0 for r in got if r.lang_pred == "und")
    assert L.classify(edge, []).filter("lang_pred <> 'und'").count() == 0
    assert L.classify(empty, known).collect() == [] and L.learn(empty) == []
    assert {lang for lang, _ in L.learn(edge)} <= {"en", "de"}


# ---------------------------------------------------------------- 6

def brute_groups(rows):
    """Row number -> (set size, least id of its component), all pairs of distinct sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    up = {s: s for s in sets}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s
    for a, b in itertools.combinations([s for s in up if s], 2):
        if min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)):
            n = len(a & b)
            if 100 * n >= 85 * (len(a) + len(b) - n):
                up[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets, strict=True):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return [(len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets, strict=True)]


def hold(spark, rows):
    docs = spark.createDataFrame([(i, t, 5, 6, 7) for i, t in rows], "doc_id long, text string, node long, n long, th long")
    want = Counter((i, n, c, i == c) for (i, _), (n, c) in zip(rows, brute_groups(rows), strict=True))
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(docs).collect())
    assert got == want
    return docs


def test_near_duplicates_edge_cases(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    docs = hold(spark, rows)
    kept = M.dedupe(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t), (_, c) in zip(rows, brute_groups(rows), strict=True) if i == c}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)
    assert M.near_duplicates(empty).collect() == []


def test_near_duplicates_in_large_groups(spark):
    """Copies of one text with few and many edits, so lists outgrow their leaders and hold several components."""
    rng = np.random.default_rng(3)
    rows, base, passage = [], words(150, 1, 5000), words(60, 2, 5000)
    for i in range(260):
        w = list(base)
        for at in rng.integers(0, len(w), rng.integers(0, 8)):
            w[at] = f"e{i}" if i % 2 else f"e{i % 7}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(passage + words(40, 100 + i, 5000))) for i in range(120)]  # a common passage, else unlike
    rows += [(2000 + i, " ".join(words(20 + i % 30, 7, 5000))) for i in range(60)]  # prefixes of one text
    rows += [(3000 + i, " ".join(base)) for i in range(40)]
    hold(spark, rows)


def test_near_duplicates_of_the_tables(spark):
    docs = C.read(spark, "/root/testdata/sf0.01", "documents")
    hold(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_prefixes_and_estimates():
    rng = np.random.default_rng(5)
    for n in (1, 5, 20, 54, 55, 64, 100, 700):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            same = rng.random(len(a)) < 0.95
            b = np.unique(np.r_[a[same], rng.integers(0, 1 << 64, int(n * rng.random() * 0.1), np.uint64)])
            if not M.alike(len(np.intersect1d(a, b)), len(a), len(b)):
                continue
            x, y = a[:M.K], b[:M.K]
            order = lambda v: sorted(v.tolist(), key=lambda z: (z % 97, z))
            assert set(order(x)[:M.prefix_length(len(x))]) & set(order(y)[:M.prefix_length(len(y))])
            assert M.estimated(x.tobytes(), y.tobytes()) >= M.ESTIMATE


def test_contained_sets_share_a_listed_value():
    """The larger set holds the smaller one, so the values they don't share are the rarest and come first in the order."""
    rng = np.random.default_rng(9)
    for share in (0.85, 0.86, 0.87):
        for _ in range(25_000):
            inside = rng.permutation(1000) < round(1000 * share)
            b = int(inside[:M.K].sum())  # of the larger set's sketch, those in the smaller one
            assert M.K - b < M.prefix_length(M.K) and b / M.K >= M.ESTIMATE


# ---------------------------------------------------------------- 10

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        if kind == "card":
            return 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return all(int(x) <= 255 for x in v.split(".")) if kind == "ip" else 8 <= len(d) <= 15 if kind == "phone" else True
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if valid(k, m.group())]


PRIVATE = ["a@b.c_d@e.f, 1.2.3.4.5 +1 (456) 555-2186 x 4111 1111 1111 1111 00.0001.255.256 9.9.9.0009", "é🙂 x@y.zz. 日本 a.b+c%d@h-i.j-k..l 4111-1111-1111-1111 5500 0000 0000 0004 1", "+1 2 +49 (0) 30 123456 7 +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6-7",
           "a" * 3000 + " " + "1" * 3000 + "@" + ".x" * 300, "1.2.3.4" * 50, "@@ a@ @b a@b a@b. a@b.c@d.e", "255.255.255.255 256.1.1.1 1.2.3", "4111111111111111 41111111111111111111 " * 20]


def test_private_spans(spark, edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()] + [(500 + i, t) for i, t in enumerate(PRIVATE)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, th long, kind long")
    want = Counter((i, hashlib.sha256(",".join(plain_spans(t)).encode()).hexdigest(), *(sum(s.startswith(k) for s in plain_spans(t)) for k in PLAIN)) for i, t in rows)
    got = P.report(docs).collect()
    assert Counter((r.doc_id, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    assert P.report(empty).collect() == [] and P.sanitise(docs).columns == docs.columns


def test_terms_that_disclose(spark):
    """A word that stands only near one person's address gives it away; words that stand everywhere don't."""
    rows = [(i, " ".join(words(30, i, 50)) + f" mail quillon7 zebulon at jo@ex.org {' '.join(words(30, i + 99, 50))} number {i}") for i in range(5)]
    rows += [(100 + i, " ".join(words(60, i + 7, 50)) + " mail at number quillon") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.report(docs).collect()}
    for i, t in rows:
        terms = sorted(f"term:{m.start()}:{m.end()}" for m in re.finditer("quillon7|zebulon", t)) if i < 100 else []
        assert got[i].spans == ",".join([*plain_spans(t), *terms]) and got[i].n_term == len(terms)
    clean = {r.doc_id: r.text for r in P.sanitise(docs).collect()}
    assert "mail   at [EMAIL]" in clean[0] and clean[150] == rows[55][1]


def test_terms_far_off_and_at_the_ends_disclose(spark):
    """Where a term stands in its entity's text doesn't matter: first, last, beside the address or far from it."""
    far = " ".join(words(60, 3, 50))
    texts = ["Zebulon jo@ex.org", "jo@ex.org Zebulon", "Mr Zebulon jo@ex.org rings Quillon", f"Mr rings jo@ex.org {far} Quillon Zebulon", f"Quillon {far} rings jo@ex.org Mr jo"]
    rows = [*enumerate(texts), *((100 + i, " ".join(words(60, i + 7, 50)) + " Mr rings") for i in range(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in P.report(docs).collect()}
    for i, t in enumerate(texts):
        terms = [f"term:{m.start()}:{m.end()}" for m in re.finditer("Zebulon|Quillon", t)]
        assert got[i].split(",") == [*plain_spans(t), *terms]
    assert all(got[i] == "" for i, _ in rows[len(texts):])
