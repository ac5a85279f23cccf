"""Operator 10: personal data, by patterns and by what the corpus discloses. DataFrame functions only.

Base spans: e-mail, IP, card and phone by pattern, leftmost and non-overlapping per kind; matches that fail their check
are dropped.  Method: an entity is the value of a base span.  Over distinct texts the corpus tells how often a term
(run of letters and digits, folded) stands in an entity's texts, outside base spans, and how often it stands anywhere.
PMI(t; e) = log2(n(t, e) * N / (n(t) * n(e))) is the information that t gives about e; IC(e) = log2(N / n(e)) is all there
is.  A term with n(t, e) >= ``SUPPORT`` and PMI >= ``GENERALISE`` * IC is generalised in the texts that hold e (to
``[NUMBER]`` or ``[WORD]``), and with PMI >= ``REMOVE`` * IC removed.

Only texts with a digit or ``@`` can hold base spans; those alone run through the patterns.  Positions are running sums
over a text's pieces, one row each, so long texts cost linear time.  Counts have partial sums and distinct steps, so
frequent terms and entities stay spread.  Patterns use possessive repeats and look-behind: linear in the text's length,
with the same matches as the plain ones.

Cases: null text is empty and has no spans; null ids stay; equal rows (id and text) get equal results; empty table: no
rows.  Positions are code points, end exclusive.  Further columns are carried by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studiolake.llm import common as C

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*PATTERNS, "term"]
SUPPORT = 3
GENERALISE, REMOVE = 0.9, 0.97
_TERM = r"[\p{L}\p{N}]+"


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    figure = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")  # noqa: E731  from the right
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    luhn = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, doubled(figure(i))).otherwise(figure(i))), F.lit(0), lambda a, x: a + x) % 10 == 0
    parts = F.split(value, r"\.")
    ip = F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.substring(F.concat(F.lit("00"), F.regexp_replace(p, "^0+(?=[0-9])", "")), -3, 3) <= "255")
    return F.when(kind == "ip", ip).when(kind == "card", n.between(16, 19) & F.when(n.between(16, 19), luhn)).when(kind == "phone", n.between(8, 15)).otherwise(True)


def _positions(texts: DataFrame, pattern: str, lead: Column) -> DataFrame:
    """texts: key columns and text.  One row per match: kind, value, start, end."""
    matches, gaps = F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), F.split("text", pattern, -1)
    rows = texts.select("doc_id", "th", lead.alias("kind"), F.posexplode(F.arrays_zip(matches.alias("value"), gaps.alias("gap"))).alias("at", "m"))
    rows = rows.select("doc_id", "th", "kind", "at", "m.value", F.length("m.gap").alias("gap")).filter("value IS NOT NULL")
    w = Window.partitionBy("doc_id", "th", "kind").orderBy("at")
    end = F.sum(F.col("gap") + F.length("value")).over(w)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def base_spans(candidates: DataFrame) -> DataFrame:
    """candidates: distinct (doc_id, th, text).  doc_id, th, kind, value, start, end of the valid base spans."""
    needs = {"email": F.col("text").contains("@"), "phone": F.col("text").contains("+")}
    found = None
    for kind, pattern in PATTERNS.items():
        one = _positions(candidates.filter(needs.get(kind, F.col("text").rlike("[0-9]"))), pattern, F.lit(kind))
        found = one if found is None else found.unionByName(one)
    return found.filter(_valid(F.col("kind"), F.col("value"))).select("doc_id", "th", "kind", "value", "start", "end")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _entity() -> Column:
    value = F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    return F.concat_ws(":", "kind", value)


def disclosing(docs: DataFrame, candidates: DataFrame, base: DataFrame, folder: str) -> DataFrame:
    """(entity, term, pmi, ic): terms that disclose an entity by the corpus' counts."""
    total = docs.select(F.xxhash64("text").alias("th")).filter("th IS NOT NULL").distinct().count()
    spans = base.select("th", _entity().alias("entity")).distinct()
    n = F.count("*").alias("n_entity")
    entities = C.stored(spans.groupBy("entity").agg(n).filter(f"n_entity >= {SUPPORT} AND n_entity < {total}"), f"{folder}/entities")
    spans = C.stored(C.join_small(spans, entities, ["entity"], "inner").select("th", "entity", "n_entity"), f"{folder}/entity_texts")
    # the terms of each distinct text that holds an entity, outside its base spans
    w = Window.partitionBy("th").orderBy("start", "end")
    far = F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = base.select("th", "start", "end").distinct().withColumn("far", far).withColumn("last", F.max("end").over(Window.partitionBy("th")))
    cuts = cuts.groupBy("th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "far"))).alias("cuts"), F.first("last").alias("last"))
    cuts = cuts.join(spans.select("th").distinct(), "th", "left_semi")
    own = candidates.select("th", "text").dropDuplicates(["th"]).join(cuts, "th")
    pieces = F.transform("cuts", lambda x: F.substring(F.col("text"), x["far"] + 1, F.greatest(x["start"] - x["far"], F.lit(0))))
    rest = F.concat_ws(" ", pieces, F.substring(F.col("text"), F.col("last") + 1, F.length("text")))
    held = C.stored(own.select("th", F.explode(F.array_distinct(_terms(rest))).alias("term")), f"{folder}/held")
    wanted = C.stored(held.groupBy("term").count().filter(f"count >= {SUPPORT}").select("term"), f"{folder}/terms")
    # copies of one text count once: each row weighs one part of its text's copies, and the sums are whole numbers again
    copies = C.stored(docs.select(F.xxhash64("text").alias("th")).groupBy("th").count().filter("count > 1"), f"{folder}/copies")
    weight = (1 / F.coalesce(F.col("count"), F.lit(1))).alias("weight")
    rows = C.join_small(docs.select(F.xxhash64("text").alias("th"), "text"), copies, ["th"]).select(weight, F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    terms = C.join_small(rows, wanted, ["term"], "inner").groupBy("term").agg(F.round(F.sum("weight")).alias("n_term"))
    terms = C.stored(terms, f"{folder}/n_terms")
    # n(t, e) <= n(e), so a term in more texts than this can't reach the share: such pairs needn't be counted
    most = F.lit(float(total)) * F.pow(F.col("n_entity") / F.lit(float(total)), F.lit(GENERALISE)) * (1 + 1e-9)
    pairs = spans.join(C.join_small(held, terms, ["term"], "inner").select("th", "term", "n_term"), "th").filter(F.col("n_term") <= most)
    known = pairs.groupBy("entity", "term").agg(F.count("*").alias("n_joint"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity"))
    known = known.filter(F.col("n_joint") >= SUPPORT)
    pmi = F.log2(F.col("n_joint") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    known = known.withColumn("pmi", pmi).withColumn("ic", F.log2(F.lit(float(total)) / F.col("n_entity")))
    return C.stored(known.filter((F.col("ic") > 0) & (F.col("pmi") >= GENERALISE * F.col("ic"))).select("entity", "term", "pmi", "ic"), f"{folder}/disclosing")


def term_spans(candidates: DataFrame, base: DataFrame, known: DataFrame) -> DataFrame:
    """Spans of disclosing terms in the texts that hold their entity, outside the base spans."""
    entity = _entity()
    risky = base.select("doc_id", "th", entity.alias("entity")).join(known, "entity")
    risky = risky.groupBy("doc_id", "th", "term").agg(F.max(F.col("pmi") / F.col("ic")).alias("share"))
    own = risky.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()
    texts = candidates.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).drop("d", "t")
    words = _positions(texts, _TERM, F.lit("term")).withColumn("term", F.lower("value"))
    r = risky.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("term").alias("own_term"), "share")
    hits = words.join(r, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("term") == F.col("own_term"))).drop("d", "t", "own_term")
    b = base.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("start").alias("s"), F.col("end").alias("e"))
    inside = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))
    hits = hits.join(b, inside, "left_anti")
    return hits.select("doc_id", "th", "kind", "value", "start", "end", "share")


def spans(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, all spans): doc_id, th, kind, value, start, end, replacement; both stored."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))
    candidates = C.stored(rows.filter(F.col("text").rlike("[0-9@]")).dropDuplicates(["doc_id", "th"]), f"{folder}/candidates")
    base = C.stored(base_spans(candidates), f"{folder}/base")
    known = disclosing(docs.select(F.col("text").cast("string").alias("text")), candidates, base, folder)
    more = term_spans(candidates, base, known)
    label = F.when(F.col("share") >= REMOVE, "").when(F.col("value").rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]")
    every = base.withColumn("replacement", F.concat(F.lit("["), F.upper("kind"), F.lit("]"))).unionByName(more.withColumn("replacement", label).drop("share"))
    return candidates, C.stored(every, f"{folder}/spans")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span generalised or removed; overlapping spans go as one, by the first's label.  All columns
    are carried, whatever they are called."""
    folder = C.scratch(docs.sparkSession, "pii")
    _, every = spans(docs, folder)
    w = Window.partitionBy("doc_id", "th").orderBy("start", F.desc("end"), "kind")
    far = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = every.withColumn("group", F.sum(F.when(far.isNull() | (F.col("start") >= far), 1).otherwise(0)).over(w))
    merged = run.groupBy("doc_id", "th", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("replacement", F.struct("start", -F.col("end"), "kind")).alias("label"))
    lists = merged.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("t")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("_spans"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_th"))
    joined = rows.join(lists, rows["own_id"].eqNullSafe(F.col("d")) & (rows["own_th"] == F.col("t")), "left")
    s, whole = F.col("_spans"), F.col("row").getField("text")
    begin = lambda i: F.when(i == 0, 0).otherwise(F.element_at(s, i).getField("end"))
    piece = F.transform(s, lambda x, i: F.concat(F.substring(whole, begin(i) + 1, x["start"] - begin(i)), x["label"]))
    text = F.when(s.isNull(), whole).otherwise(F.concat(F.array_join(piece, ""), F.substring(whole, F.element_at(s, -1)["end"] + 1, F.length(whole))))
    return joined.select(*((text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts and texts of its spans."""
    _, every = spans(docs, C.scratch(docs.sparkSession, "pii"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    name = F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string"))
    per = every.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", name.alias("name")))).alias("all"))
    per = per.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), "all")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"))
    out = own.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left").withColumn("all", F.coalesce("all", F.array().cast("array<struct<rank: long, start: long, name: string>>")))

    def count(place: int) -> Column:
        return F.size(F.filter("all", lambda x: x["rank"] == place)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS, 1)]
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["name"]), ",")
    return out.select("doc_id", *counts, F.sha2(joined(F.filter("all", lambda x: x["rank"] <= len(PATTERNS))), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(C.read(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
