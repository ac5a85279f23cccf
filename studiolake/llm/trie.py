"""Operator 12: the prefix trie of conversations, by ROLLUP over positional turn-id columns.

A turn's id is a 64-bit hash of role and text, kept with the text's length.  Turns are numbered within their conversation
and laid out in blocks of ``BLOCK`` columns; a row is one block of one conversation, keyed by the node at which the block
before it ended (its key is the exclusive-or of two 64-bit hashes of (turn, position) over all turns up to there, so a
conversation of any length has all its block keys after one running sum, and all blocks go into one aggregate):

1. ``GROUP BY block, key, ROLLUP (t1, ..., t8)`` with ``grouping_id`` gives every prefix's members in one pass.
2. Blocks form a tree of their own.  Its subtree sums come from pointer doubling: after round r a block holds the sum of
   the blocks below it at distances under 2^r, so there are log2(longest conversation / 8) rounds, none for short ones.
3. The same ROLLUP over the nodes, where a block's last node carries what hangs below it, gives each node's subtree sums
   and children.

Hot keys: a long conversation is numbered over ranges of (conversation, turn) and their counts, and its running keys over
spans of 1,024 blocks; a common first turn, or one conversation copied to a third of all rows, is combined before each
shuffle; members that end at one node are joined to texts of 8,192 ids by ranges, and only those texts are hashed in
sequence.  Joins of children to a parent with very many are left to Spark's splitting of skewed joins.

Order in a conversation: turn (nulls first), role, text.  Cases: null role or text is empty; rows without a conv_id belong
to no conversation and are left out; repeated rows are turns of their own; an empty table has no nodes, not even a root;
further columns are ignored.  Ids: two turns of one parent with equal length would meet at 2^-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from studiolake.llm import common as C
from studiolake.llm.periodic import CRC

BLOCK = 8
SPAN = 1024
IDS_PER_TEXT = 8192
LEVELS = range(1, BLOCK + 1)
_T = [f"t{j}" for j in LEVELS]
_PATH = ["block", "p1", "p2"]


# ---- numbering ---------------------------------------------------------------------

def number_turns(chats: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order of their conversations, stored: conv_id, part, place (grows within a part), turn_id, chars; and the
    pieces: conv_id, part, first (least place), n, before (turns of the conversation in earlier parts)."""
    rows = chats.filter("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, 32)).sortWithinPartitions("conv_id", "turn", "role", "text")
    held = C.stored(dealt.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
                                 F.xxhash64("role", "text").alias("turn_id"), F.length("text").cast("long").alias("chars")), f"{folder}/turns")
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    pieces = held.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return held, C.stored(pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))), f"{folder}/pieces")


def positions(held: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, chars and the further columns of ``pieces``."""
    return held.join(pieces, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("place") - F.col("first") + 1) \
               .drop("part", "place", "first", "n", "before")


def rebuilt(held: DataFrame, pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of conversation c - c % 100, then c's own after its first h."""
    ids = pieces.groupBy("conv_id").agg(F.sum("n").alias("n"))
    base, h = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    bases = ids.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), "n")
    heads = positions(held.filter("conv_id % 100 = 0"), pieces.filter("before < 5")).filter("pos <= 5")
    lists = heads.groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "turn_id", "chars")).alias("head"))  # five at most
    taken = F.when(F.col("bn").isNull(), 0).otherwise(F.least("h", "bn"))
    own = pieces.withColumn("base", base).withColumn("h", h).join(bases.withColumnRenamed("n", "bn"), "base", "left").withColumn("taken", taken).drop("base", "bn")
    rest = positions(held, own).filter(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    lent = ids.select("conv_id", base.alias("base"), h.alias("h")).filter("h > 0").join(lists, "base").select("conv_id", "h", F.inline("head")).filter("pos <= h")
    columns = ["conv_id", "pos", "turn_id", "chars"]
    return ids.select("conv_id"), rest.select(columns).unionByName(lent.select(columns))


# ---- blocks ------------------------------------------------------------------------

def _hash(turn_id: Column, chars: Column, pos: Column, lane: int) -> Column:
    return F.xxhash64(turn_id, chars, pos.cast("long"), F.lit(lane))


def blocks_of(turns: DataFrame, folder: str) -> DataFrame:
    """One row per conversation and block of turns: its turns t1 .. t8 (null after the last), n, x1 and x2 (exclusive-or of
    its turns' hashes), p1 and p2 (the same of all earlier blocks)."""
    at, col = F.expr(f"CAST((pos - 1) DIV {BLOCK} AS INT)"), (F.col("pos") - 1) % BLOCK + 1
    lanes = [F.bit_xor(_hash(F.col("turn_id"), F.col("chars"), F.col("pos"), k)).alias(f"x{k}") for k in (1, 2)]
    cells = [F.max(F.when(col == j, F.col(c))).alias(f"{c}{j}") for j in LEVELS for c in ("turn_id", "chars")]
    laid = turns.groupBy("conv_id", at.alias("block")).agg(F.count("*").alias("n"), *lanes, *cells)
    laid = laid.select("conv_id", "block", "n", "x1", "x2", *(F.when(F.col(f"turn_id{j}").isNotNull(), F.struct(F.col(f"turn_id{j}").alias("id"), F.col(f"chars{j}").alias("chars"))).alias(f"t{j}") for j in LEVELS))
    laid = C.stored(laid.withColumn("span", F.expr(f"block DIV {SPAN}")), f"{folder}/laid")
    spans = laid.groupBy("conv_id", "span").agg(*(F.bit_xor(f"x{k}").alias(f"s{k}") for k in (1, 2)))
    before = W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", *(F.coalesce(F.bit_xor(f"s{k}").over(before), F.lit(0)).alias(f"s{k}") for k in (1, 2)))
    inside = W.partitionBy("conv_id", "span").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    keyed = laid.select("*", *(F.coalesce(F.bit_xor(f"x{k}").over(inside), F.lit(0)).alias(f"b{k}") for k in (1, 2))).join(spans, ["conv_id", "span"])
    return C.stored(keyed.select("conv_id", "block", "n", "x1", "x2", *(F.col(f"b{k}").bitwiseXOR(F.col(f"s{k}")).alias(f"p{k}") for k in (1, 2)), *_T), f"{folder}/blocks")


def _rollup(rows: DataFrame, values: str) -> DataFrame:
    """All prefixes of all blocks: level (columns in the prefix, 0 for the whole block), key k1 and k2 of the prefix's node,
    q1 and q2 of its parent, chars of its last turn."""
    held = ", ".join(_T)
    grouped = rows.sparkSession.sql(
        f"SELECT {', '.join(_PATH)}, {held}, CAST({BLOCK} - bit_count(grouping_id()) AS INT) AS level, {values} "
        f"FROM {{rows}} GROUP BY {', '.join(_PATH)}, ROLLUP ({held})", rows=rows)
    filled = sum((F.col(t).isNotNull().cast("int") for t in _T), F.lit(0))
    grouped = grouped.filter(filled == F.col("level"))  # else the last turn is missing: the prefix ended before
    last = F.coalesce(*(F.col(t) for t in reversed(_T)))
    for k in (1, 2):
        key = F.col(f"p{k}")
        for j in LEVELS:
            turn = F.col(f"t{j}")
            key = key.bitwiseXOR(F.when(turn.isNull(), F.lit(0)).otherwise(_hash(turn["id"], turn["chars"], F.col("block") * BLOCK + j, k)))
        parent = key.bitwiseXOR(F.when(last.isNull(), F.lit(0)).otherwise(_hash(last["id"], last["chars"], F.col("block") * BLOCK + F.col("level"), k)))
        grouped = grouped.withColumn(f"k{k}", key).withColumn(f"q{k}", parent)
    return grouped.withColumn("chars", last["chars"])


def _below(nodes: DataFrame, folder: str) -> DataFrame:
    """Per block root after the first block (k1, k2): sums of saved and leaves over all nodes below it."""
    own = nodes.filter("block > 0").groupBy("p1", "p2").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    above = nodes.filter(f"block > 0 AND level = {BLOCK}").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("p1").alias("a1"), F.col("p2").alias("a2"))
    sums, n = C.stored(own.join(above, ["p1", "p2"], "left"), f"{folder}/below0"), 0
    while sums.filter("a1 IS NOT NULL").limit(1).count():
        n += 1
        up = sums.filter("a1 IS NOT NULL").groupBy(F.col("a1").alias("p1"), F.col("a2").alias("p2")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
        jump = sums.filter("a1 IS NOT NULL").select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("n1"), F.col("a2").alias("n2"))
        step = sums.join(up, ["p1", "p2"], "left").join(jump, ["a1", "a2"], "left")
        sums = C.stored(step.select("p1", "p2", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
                                    F.col("n1").alias("a1"), F.col("n2").alias("a2")), f"{folder}/below{n}")
    return sums.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("saved").alias("saved_below"), F.col("leaves").alias("leaves_below"))


def build(ids: DataFrame, blocks: DataFrame, folder: str) -> DataFrame:
    """All nodes: key (k1, k2; the root's is 0, 0), depth, conv_id (smallest member), parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens.  ``ids``: all conversations, also those without turns."""
    first = _rollup(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id, max(n) AS longest")
    first = C.stored(first, f"{folder}/prefixes")
    goes_on = first.filter("level = 0 AND block > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.lit(True).alias("goes_on"))
    nodes = first.filter("level > 0").join(goes_on, ["k1", "k2"], "left")
    leaf = (F.col("goes_on").isNull() & (F.col("longest") == F.col("level"))).cast("long")
    nodes = C.stored(nodes.select(*_PATH, *_T, "level", "k1", "k2", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), leaf.alias("leaves"), "goes_on"), f"{folder}/nodes")
    below = _below(nodes, folder)
    total = nodes.join(below, ["k1", "k2"], "left")
    total = total.select(*_PATH, *_T, F.col("level").alias("at"), "conv_id", "n_convs", (F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved"),
                         (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("leaves"))
    children = ", ".join(f"count_if(at = {j}) AS c{j}" for j in LEVELS)
    second = C.stored(_rollup(total, f"min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(saved) AS saved_tokens, sum(leaves) AS n_leaves, {children}"), f"{folder}/sums")
    roots = second.filter("level = 0")
    inner = F.coalesce(*(F.when(F.col("level") == j, F.col(f"c{j + 1}")) for j in range(1, BLOCK)), F.lit(0))
    found = second.filter("level > 0").withColumn("inner", inner).join(roots.filter("block > 0").select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("c1").alias("further")), ["k1", "k2"], "left")
    found = C.stored(found.select("k1", "k2", "q1", "q2", (F.col("block") * BLOCK + F.col("level")).cast("long").alias("depth"), "conv_id", "n_convs",
                                  (F.col("inner") + F.coalesce("further", F.lit(0))).alias("n_children"), "n_leaves", "saved_tokens"), f"{folder}/found")
    # The root: every conversation, also those without turns; parent of all nodes of depth 1.
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).first()  # one row
    if not top["n_convs"]:
        return found.select("k1", "k2", "depth", "conv_id", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    whole = roots.filter("block = 0").agg(F.coalesce(F.sum("c1"), F.lit(0)).alias("n_children"), F.coalesce(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"))
    kind = dict(ids.dtypes)["conv_id"]
    root = whole.select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(0).cast("long").alias("depth"), F.lit(top["conv_id"]).cast(kind).alias("conv_id"),
                        F.lit(None).cast(kind).alias("parent_conv_id"), F.lit(top["n_convs"]).cast("long").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    parents = found.filter("n_children > 0").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("of_parent"))
    deeper = found.filter("depth > 1").join(parents, ["q1", "q2"], "left").withColumnRenamed("of_parent", "parent_conv_id")
    shallow = found.filter("depth = 1").withColumn("parent_conv_id", F.lit(top["conv_id"]).cast(kind))
    return root.unionByName(deeper.select(root.columns)).unionByName(shallow.select(root.columns))


# ---- members that end at a node ------------------------------------------------------

def ending(ids: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per conversation the key of the node at which it ends: conv_id, k1, k2."""
    zero = F.lit(0).cast("long")
    rows = blocks.select("conv_id", "x1", "x2").unionByName(ids.select("conv_id", zero.alias("x1"), zero.alias("x2")))
    return rows.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2"))


def digests(ends: DataFrame, folder: str) -> DataFrame:
    """Per node SHA-256 of the decimal conv_ids that end there, ascending, comma-joined: k1, k2, ends_sha256.  Ranges of the
    ids become texts first; a node's texts then pass through one hash in order."""
    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = (b[c].to_pylist() for c in ("k1", "k2", "conv_id"))
            cut = [0, *(i for i in range(1, len(ids)) if k1[i] != k1[i - 1] or k2[i] != k2[i - 1]), len(ids)]
            steps = [(a, min(a + IDS_PER_TEXT, z)) for s, z in zip(cut, cut[1:], strict=False) for a in range(s, z, IDS_PER_TEXT)]
            yield pa.RecordBatch.from_pydict({
                "k1": pa.array([k1[a] for a, _ in steps], pa.int64()), "k2": pa.array([k2[a] for a, _ in steps], pa.int64()),
                "first": pa.array([ids[a] for a, _ in steps], pa.int64()), "ids": pa.array([",".join(map(str, ids[a:z])) for a, z in steps], pa.string())})

    def hash_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"k1": pa.array([k[0] for k, _ in done], pa.int64()), "k2": pa.array([k[1] for k, _ in done], pa.int64()), "ends_sha256": pa.array([s.hexdigest() for _, s in done], pa.string())})
        for b in batches:
            done = []
            for key, ids in zip(zip(b["k1"].to_pylist(), b["k2"].to_pylist(), strict=True), b["ids"].to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, state))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield out(done)
        if now is not None:
            yield out([(now, state)])

    ranged = ends.select("k1", "k2", F.col("conv_id").cast("long").alias("conv_id")).repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    texts = C.stored(ranged.mapInArrow(join_ids, "k1 long, k2 long, first long, ids string"), f"{folder}/ends")
    return texts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(hash_texts, "k1 long, k2 long, ends_sha256 string")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.scratch(spark, "trie")
    ids, turns = rebuilt(*number_turns(C.read(spark, sf_dir, "conversations"), folder))
    blocks = blocks_of(turns, folder)
    nodes = build(ids, blocks, folder).join(digests(ending(ids, blocks), folder), ["k1", "k2"], "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


# The plain form: every prefix of every conversation as a list, and every node handed to each of its ancestors.
ORACLES = {"op12_prefix_trie": f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
ids AS (SELECT conv_id, {CRC.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
all_turns AS (
  SELECT i.conv_id, 0 AS own, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.pos <= i.h
  UNION ALL SELECT i.conv_id, 1, t.pos, t.role, t.text FROM ids i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
paths AS (
  SELECT i.conv_id, coalesce(p.path, []) AS path, coalesce(p.sizes, []) AS sizes
  FROM ids i LEFT JOIN (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY own, pos) AS path, list(length(text) ORDER BY own, pos) AS sizes
                        FROM all_turns GROUP BY conv_id) p USING (conv_id)),
prefixes AS (SELECT conv_id, path, sizes, unnest(range(len(path) + 1)) AS depth FROM paths),
nodes AS (
  SELECT depth, path[1:depth] AS prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END) AS size,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends
  FROM prefixes GROUP BY depth, prefix),
childless AS (SELECT n.*, NOT EXISTS (SELECT 1 FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS leaf FROM nodes n),
handed AS (SELECT n.*, unnest(range(depth + 1)) AS above FROM childless n),
sums AS (
  SELECT above AS depth, prefix[1:above] AS prefix, sum(leaf::BIGINT) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens, count(*) FILTER (depth = above + 1) AS n_children
  FROM handed GROUP BY above, prefix[1:above])
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, s.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN sums s USING (depth, prefix) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]"""}
QUERIES = {"op12_prefix_trie": op12_prefix_trie}
