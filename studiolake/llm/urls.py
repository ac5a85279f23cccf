"""Operator 7: URL filters by hashed host-suffix and path-prefix expressions. DataFrame functions only.

A rule is (host, path, verdict); it fits its host and all subdomains where the URL's path starts with the rule's path.
Every URL is expanded into expressions: each suffix of its host with as many labels as some rule's host has, with each
prefix of its path of a length that some rule's path has.  Expressions and rules are digested (SHA-256); they are joined on the first ``PREFIX_BYTES`` of the
digest, hits are confirmed by the whole digest, and the longest rule wins (equal length: longer host, then block).

The rules are broadcast while they are few (counted), else expressions are salted and rules repeated, as one expression
(``com/``) can stand in a third of all URLs.  Equal URLs of one page id are counted, judged once for every ``COPIES`` of
them and given back as rows, so no row holds more than ``COPIES`` copies and their chunks spread over tasks.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or
the end.  Cases: null URL or one without ``://`` has empty host and path and fits no rule; URLs that no rule fits get the
``default`` verdict; an empty path starts with no rule's ``/``; null page ids stay; repeated rows stay; empty tables
(of pages or rules) give no rows or the default.  Rules with a null part are ignored.  Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.llm import common as C

PREFIX_BYTES = 4
COPIES = 4096
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    end = lambda c, marks: F.element_at(F.split(c, marks, 2), 1)
    rest = _rest(F.col(url))
    bare = end(rest, "[?#]")
    host = end(bare, "/")
    return pages.withColumn("host", C.ascii_lower(host)).withColumn("path", F.substring(bare, F.length(host) + 1, F.length(bare)))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def digested(rules: DataFrame) -> DataFrame:
    """One row per rule text; of two verdicts for one text block wins."""
    r = rules.select(C.ascii_lower(F.col("host")).alias("host"), "path", "verdict").filter("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("rule_verdict"))
    d = _digest(F.col("host"), F.col("path"))
    return r.select(F.substring(d, 1, 2 * PREFIX_BYTES).alias("short"), d.alias("rule_digest"), F.concat("host", "path").alias("rule_text"), F.length("host").alias("host_length"), "rule_verdict",
                    F.length("path").alias("path_length"), _labels(F.col("host")).alias("labels"))


def chunked(counted: DataFrame) -> DataFrame:
    """copies -> rows of at most ``COPIES`` copies, numbered by high and low; an array here holds at most ``COPIES`` numbers
    for each ``COPIES ** 3`` copies."""
    first = counted.withColumn("high", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES ** 2}"))))
    first = first.withColumn("copies", F.least(F.lit(COPIES ** 2), F.col("copies") - F.col("high") * COPIES ** 2))
    both = first.withColumn("low", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    return both.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("low") * COPIES))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    spark = pages.sparkSession
    table = C.stored(digested(rules), f"{C.scratch(spark, 'url-rules')}/rules")
    # lengths of rule paths and hosts' labels: distinct numbers, at most as many as the longest has characters
    lengths, labels = (sorted(r[0] for r in table.select(c).distinct().collect()) for c in ("path_length", "labels"))
    own = chunked(parts(pages.select(key, url).groupBy(key, url).agg(F.count("*").alias("copies")), url))
    suffixes = F.array_compact(F.array(*(F.when(_labels(F.col("host")) >= n, F.substring_index("host", ".", -n)) for n in labels or [1])))
    prefixes = F.filter(F.transform(F.array(*map(F.lit, lengths or [0])), lambda n: F.when(n <= F.length("path"), F.substring(F.col("path"), F.lit(1), n))), lambda p: p.isNotNull())
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("h"), p.alias("p")))))
    e = own.withColumn("e", F.explode_outer(F.when(F.col("host") != "", expressions)))
    digest = _digest(F.col("e.h"), F.col("e.p"))
    e = e.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, 2 * PREFIX_BYTES)).drop("e")
    hits = C.join_small(e, table, ["short"])
    sure = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule_text").alias("length"), "host_length", F.col("rule_verdict").alias("verdict"), F.col("rule_text").alias("rule")))
    best = hits.groupBy(key, url, "host", "path", "high", "low", "copies").agg(F.max(sure).alias("best"))
    out = best.select(key, url, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "copies")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("copies", "copy")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.read(spark, sf_dir, "pages"), rule_table(spark, RULES)).drop("url")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLES = {"op7_url_filter": f"""
WITH u_rules(h, p, v) AS (VALUES {_VALUES}),
u_rest AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS t FROM pages),
u_pages AS (
  SELECT r, page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u_rest),
u_fit AS (
  SELECT u.*, h || p AS rule, v, row_number() OVER (PARTITION BY r ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS place
  FROM u_pages u LEFT JOIN u_rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u_fit WHERE place = 1"""}
QUERIES = {"op7_url_filter": op7_url_filter}
