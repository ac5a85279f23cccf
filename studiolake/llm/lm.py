"""Operator 9: language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one per previous word that was learnt; their parents, shared, are the restaurants of the previous word's class
(31 classes by its last byte, and the text's start), where the tokens after the text's start sit as well; all classes share
the unigram restaurant as parent; its base spells a word byte by byte, by restaurants for contexts of 3, 2, 1 and 0 bytes,
each with the next shorter as parent, over a uniform base of 257 symbols.  A restaurant that never saw a word asks its
parent.  All words that weren't learnt are one event, unknown, with the probability that the model gives to all of them
together.

Seating is sampled by Gibbs: given all else, the number of tables of a dish with c customers has probability
proportional to b^t S(c, t), where b is the new table's weight and S the generalised Stirling numbers; it is drawn
exactly up to ``EXACT`` customers, and above by seating in sequence, skipping from one new table to the next.  Each table
is a customer of the parent.  A sweep re-seats all restaurants; the predictive probabilities of the last ``SAMPLES`` of
``SWEEPS`` sweeps are averaged.  Restaurants' totals are those of the sweep before.

Work is dealt twice.  Tasks turn documents into stored batches of about ``BATCH_TOKENS`` tokens: their words and the stream
of word numbers.  The words' counts give N and the vocabulary's size.  A batch then asks for its distinct (word, context)
types, dealt by ranges of the word's hash into parts, whose number follows the vocabulary.  Counts are folded ``FAN`` batches
at a time; a part seats its words and answers ``FAN`` batches at a time, so that what a task holds does not grow with the
number of batches.  A word's tables as a context lie with the words that follow it, in many parts: after each sweep the part
of the context's own word adds them up and sends them to the parts that hold types of it.  Its customers are its own count.
A batch is told both with its words' counts, and adds its answers up per document.  A word in a third of all texts is a few
types per batch.  Batches ask, and are scored, in two to ``ROUNDS`` rounds; what a round, or a sweep, leaves on disk goes when
the next has read it.  Through the driver go totals of the classes and the spelling model, which has a fixed number of context
slots (at most ``SLOTS3`` * 258 numbers).  Words are told apart by 64-bit hashes, contexts by 59 bits and the class.

Cases: null text is empty and has only its end; null ids learn (they aren't held out) and are scored; equal rows each
count; with nothing to learn from, the base alone scores; empty table: no rows.  Further columns are ignored.
"""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.llm import common as C

BATCH_TOKENS = 2_500_000
CLASSES = 32
EXACT = 256
PART_WORDS, LEAST_PARTS, FAN, ROUNDS = 100_000, 16, 64, 4
SWEEPS, SAMPLES = 3, 2
CONTEXT_PARAMETERS, CLASS_PARAMETERS, WORD_PARAMETERS, SPELL_PARAMETERS = (0.8, 5.0), (0.7, 20.0), (0.6, 100.0), (0.4, 2.0)  # discount, strength
SYMBOLS, STOP, BEGIN = 258, 256, 257  # bytes, the word's end, and what stands before its first byte
SLOTS2, SLOTS3 = 1 << 12, 1 << 14
SPELL_WORDS, SCORE_TYPES = 16_384, 1 << 17  # worked on at a time
SEED = 11
CONTEXT_BITS = 32  # a type is word << CONTEXT_BITS | context, both numbered within a batch or a part
CONTEXT_MASK = (1 << CONTEXT_BITS) - 1
CLASS_NUMBERS = np.arange(CLASSES)


# ---------------------------------------------------------------- seating

@functools.cache
def stirling(discount: float) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= EXACT: S(c + 1, t) = S(c, t - 1) + (c - discount * t) S(c, t)."""
    s = np.full((EXACT + 1, EXACT + 1), -np.inf)
    s[1, 1] = 0
    t = np.arange(1, EXACT + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, EXACT):
            s[c + 1, 1:] = np.logaddexp(s[c, :-1], np.log(np.maximum(c - discount * t, 0)) + s[c, 1:])
    return s


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """A draw of the number of tables for each dish, given its customers and a new table's weight."""
    tables = np.minimum(customers, 1)
    log_s, log_w = stirling(discount), np.log(np.maximum(weight, 1e-300))
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    bounds = np.flatnonzero(np.r_[True, np.diff(customers[few]) != 0, True]) if len(few) else np.empty(0, int)
    for a, z in zip(bounds, bounds[1:], strict=False):
        c = int(customers[few[a]])
        for i in range(a, z, max(1, 400_000 // c)):
            at = few[i:min(z, i + max(1, 400_000 // c))]
            logits = log_s[c, 1:c + 1] + log_w[at][:, None] * np.arange(1, c + 1)
            p = np.cumsum(np.exp(logits - logits.max(1, keepdims=True)), 1)
            tables[at] = 1 + (p < rng.random(len(at))[:, None] * p[:, -1:]).sum(1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        seated, t, b = np.ones(len(many)), np.ones(len(many)), np.maximum(weight[many], 1e-12)
        live = np.arange(len(many))
        while len(live):
            room = seated[live] - discount * t[live]
            with np.errstate(over="ignore"):
                after = discount * t[live] + room * rng.random(len(live)) ** (-1 / b[live])  # customers until the next new table
            after = np.maximum(np.floor(after), seated[live]) + 1
            ok = after <= customers[many[live]]
            live = live[ok]
            seated[live], t[live] = after[ok], t[live] + 1
        tables[many] = np.minimum(t, customers[many]).astype(tables.dtype)
    return tables


# ---------------------------------------------------------------- spelling

def _symbols(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For words one after the other: symbols with the ends, the begin of each word, and the context slots 1, 2, 3."""
    n = len(lens)
    begin = np.concatenate([[0], np.cumsum(lens + 1)])[:-1].astype(np.int64)
    total = int(lens.sum()) + n
    s = np.full(total, STOP, np.int64)
    inside = np.ones(total, bool)
    inside[begin + lens] = False
    s[inside] = words
    place = np.arange(total) - np.repeat(begin, lens + 1)
    before = [np.where(place >= k, np.r_[np.full(k, BEGIN), s[:-k]][:total], BEGIN) if total else s for k in (1, 2, 3)]
    two = before[0] * SYMBOLS + before[1]
    slot2 = (C.mix(two.astype(np.uint64)) % np.uint64(SLOTS2)).astype(np.int64)
    slot3 = (C.mix((two * SYMBOLS + before[2]).astype(np.uint64) + np.uint64(1 << 40)) % np.uint64(SLOTS3)).astype(np.int64)
    return s, begin, before[0], slot2, slot3


def _some_words(words: np.ndarray, lens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and lengths of ``SPELL_WORDS`` words at a time, as a word's symbols take many times its bytes."""
    ends = np.r_[0, np.cumsum(lens)]
    for a in range(0, len(lens), SPELL_WORDS):
        z = min(a + SPELL_WORDS, len(lens))
        yield words[ends[a]:ends[z]], lens[a:z]


def spelled(words: np.ndarray, lens: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Probability of each word under the spelling model (natural log)."""
    if not len(lens):
        return np.empty(0)
    out = []
    for some in _some_words(words, lens):
        s, begin, _, _, slot3 = _symbols(*some)
        out.append(np.add.reduceat(model[slot3 * SYMBOLS + s].astype(np.float64), begin))
    return np.concatenate(out)


def spell_counts(words: np.ndarray, lens: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Customers of the longest contexts: keys (slot 3, slot 2, slot 1, symbol) packed, and counts."""
    if not len(lens):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys = []
    for some in _some_words(words, lens):
        s, _, slot1, slot2, slot3 = _symbols(*some)
        keys.append(((slot3 * SLOTS2 + slot2) * SYMBOLS + slot1) * SYMBOLS + s)
    values, which = np.unique(_joined(keys), return_inverse=True)
    return values, np.bincount(which, np.repeat(times, lens + 1)).astype(np.int64)


def _parents(child: np.ndarray, parent: np.ndarray, n: np.ndarray, slots: int) -> np.ndarray:
    """Of each slot the parent that most of its customers have."""
    pair, which = np.unique(child * (1 << 20) + parent, return_inverse=True)
    total = np.bincount(which, n)
    out = np.zeros(slots, np.int64)
    order = np.lexsort((-pair, total))
    out[(pair >> 20)[order]] = (pair & (1 << 20) - 1)[order]
    return out


def spelling_model(keys: np.ndarray, counts: np.ndarray, old: dict | None, rng: np.random.Generator) -> dict:
    """Seat the spelling restaurants; returns log probabilities by (slot 3, symbol), with totals for the next sweep."""
    d, strength = SPELL_PARAMETERS
    symbol, rest = keys % SYMBOLS, keys // SYMBOLS
    slot1, rest = rest % SYMBOLS, rest // SYMBOLS
    slot2, slot3 = rest % SLOTS2, rest // SLOTS2
    up = [_parents(slot3, slot2, counts, SLOTS3), _parents(slot2, slot1, counts, SLOTS2), np.zeros(SYMBOLS, np.int64)]
    sizes = [SLOTS3, SLOTS2, SYMBOLS, 1]
    c = [np.bincount(slot3 * SYMBOLS + symbol, counts, SLOTS3 * SYMBOLS)]
    t = []
    uniform = np.where(np.arange(SYMBOLS) == BEGIN, 0, 1 / (SYMBOLS - 1))
    for level, slots in enumerate(sizes):
        known = np.flatnonzero(c[level])
        parent = up[level][known // SYMBOLS] * SYMBOLS + known % SYMBOLS if level < 3 else None
        above = (old["p"][level + 1][parent] if level < 3 else uniform[known]) if old else np.full(len(known), 1 / (SYMBOLS - 1))
        total = old["tables"][level][known // SYMBOLS] if old else 0
        mine = np.zeros(slots * SYMBOLS)
        mine[known] = seat(c[level][known].astype(np.int64), (strength + d * total) * above, d, rng)
        t.append(mine)
        if level < 3:
            c.append(np.bincount(parent, mine[known], sizes[level + 1] * SYMBOLS))
    p, tables = [np.empty(0)] * 4, [x.reshape(-1, SYMBOLS).sum(1) for x in t]
    for level in (3, 2, 1, 0):
        above = (p[level + 1].reshape(-1, SYMBOLS)[up[level]] if level < 3 else uniform[None, :])
        own, seats = c[level].reshape(-1, SYMBOLS), t[level].reshape(-1, SYMBOLS)
        p[level] = ((own - d * seats + (strength + d * tables[level])[:, None] * above) / (strength + own.sum(1))[:, None]).ravel()
    with np.errstate(divide="ignore"):
        return {"p": p, "tables": tables, "log": np.log(p[0]).astype(np.float32)}


# ---------------------------------------------------------------- documents to batches

def word_class(last: np.ndarray) -> np.ndarray:
    """Class of the word before, by its last byte; 0 is the text's start."""
    return 1 + (last.astype(np.int64) * 37 + 11) % 251 % (CLASSES - 1)


def _pack(a: np.ndarray) -> bytes:
    """Bytes of the same weight side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T), 3)


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    b = np.frombuffer(zstandard.decompress(raw), np.uint8) if len(raw) else np.empty(0, np.uint8)
    return np.ascontiguousarray(b.reshape(size, -1).T).view(kind).ravel()


_BATCH = "batch long, learnt long, words binary, lens binary, seen binary, ids array<{kind}>, held array<boolean>, sizes binary, stream binary"


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, A-Z lower-cased, and how many tokens each text has: its words and its end."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))  # the same white space as bytes.split
    words, n = split.flatten(), pc.list_value_length(split).to_numpy()
    some = pc.not_equal(pc.binary_length(words), 0)  # white space before the first word or after the last splits off an empty one
    upto = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))][np.r_[0, np.cumsum(n)]]
    return words.filter(some), np.diff(upto) + 1


def batch_of(number: int, held: list[tuple], names: list[str]) -> pa.RecordBatch:
    """One batch of documents: parts of columns (ids, held out, words, sizes)."""
    ids, out, words, sizes = zip(*held, strict=True)
    sizes = np.concatenate(sizes)
    coded = pa.chunked_array([pa.array([""], pa.large_binary()), *(w.cast(pa.large_binary()) for w in words)]).dictionary_encode()  # number 0 is the end
    listed = coded.chunk(0).dictionary  # that of all chunks
    ends = np.frombuffer(listed.buffers()[1], np.int64)[listed.offset:listed.offset + len(listed) + 1]
    data, lens = np.frombuffer(listed.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]], np.diff(ends)
    order = np.argsort(_hashes(data, lens), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    stream = np.full(int(sizes.sum()), rank[0])
    inside = np.ones(len(stream), bool)
    inside[np.cumsum(sizes) - 1] = False
    stream[inside] = np.concatenate([rank[c.indices.to_numpy()] for c in coded.chunks])[1:]
    ids, out = pa.chunked_array(ids).combine_chunks(), pa.chunked_array(out).combine_chunks()
    learn = np.repeat(~out.to_numpy(zero_copy_only=False), sizes)
    data, lens = _gather(data, lens, order)
    row = {"batch": number, "learnt": int(learn.sum()), "words": zstandard.compress(data.tobytes(), 3), "lens": _pack(lens.astype(np.uint32)),
           "seen": _pack(np.bincount(stream[learn], minlength=len(order)).astype(np.int64)), "sizes": _pack(sizes.astype(np.uint32)), "stream": _pack(stream)}
    types = dict.fromkeys(names, pa.binary()) | {"batch": pa.int64(), "learnt": pa.int64()}
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for c, x in (("ids", ids), ("held", out))}
    return pa.RecordBatch.from_arrays([lists[c] if c in lists else pa.array([row[c]], types[c]) for c in names], names)


def batches_of(docs: DataFrame, folder: str) -> DataFrame:
    """Stored batches: the words in the order of their hashes, how often each is learnt, and the documents as word numbers."""
    C.small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    names = [x.split()[0] for x in _BATCH.split(", ")]

    def make(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin_step("batches")
        number, tokens, held = TaskContext.get().partitionId() << 24, 0, []
        for b in rows:
            words, sizes = split_words(b["text"])
            upto, at, first = np.r_[0, np.cumsum(sizes)], 0, 0  # tokens up to each text; texts and tokens given out before
            while at < len(sizes):
                end = min(len(sizes), int(np.searchsorted(upto, first + BATCH_TOKENS - tokens, "left")))
                last = int(upto[end])
                held.append((b["doc_id"][at:end], b["held_out"][at:end], words[first - at:last - end], sizes[at:end]))
                tokens += last - first
                at, first = end, last
                if tokens >= BATCH_TOKENS:
                    yield batch_of(number, held, names)
                    tokens, held = 0, []
                    number += 1
        if held:
            yield batch_of(number, held, names)

    return C.stored(docs.select("doc_id", "held_out", F.col("text").cast("string").alias("text")).mapInArrow(make, _BATCH.format(kind=kind)), f"{folder}/batches")


# ---------------------------------------------------------------- contexts

def _context_keys(data: np.ndarray, lens: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """59 bits of each word's hash and its class."""
    last = np.zeros(len(lens), np.int64)
    some = lens > 0
    last[some] = data[np.cumsum(lens)[some] - 1]
    return (hashes & ~np.uint64(CLASSES - 1)) | word_class(last).astype(np.uint64)


def vocabulary(batches: DataFrame) -> int:
    """How many words are learnt."""
    def learnt(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                keys = _context_keys(*_words_of(r))[_unpack(r["seen"], np.int64) > 0]
                yield pa.RecordBatch.from_pydict({"k": pa.array(keys.view(np.int64))})

    return batches.select("words", "lens", "seen").mapInArrow(learnt, "k long").distinct().count()


def _tokens_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each token's type (word << CONTEXT_BITS | context: 0 for the text's start, else 1 + the word before), sizes."""
    stream, sizes = _unpack(r["stream"], np.uint32).astype(np.int64), _unpack(r["sizes"], np.uint32).astype(np.int64)
    before = np.empty(len(stream), np.int64)
    before[1:] = 1 + stream[:-1]
    before[np.cumsum(sizes) - sizes] = 0
    return before | stream << CONTEXT_BITS, sizes


def types_of_batch(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted types, each token's type, sizes."""
    tokens, sizes = _tokens_of(r)
    order = np.argsort(tokens)
    tokens = tokens[order]
    new = np.diff(tokens, prepend=-1) != 0
    kinds, which = tokens[new], np.empty(len(tokens), np.int32)  # less memory than np.unique takes
    del tokens
    which[order] = np.cumsum(new, dtype=np.int32) - 1
    return kinds, which, sizes


def learnt_types(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """The sorted types and how often each is learnt."""
    tokens, sizes = _tokens_of(r)
    tokens = np.sort(tokens << 1 | np.repeat(~np.array(r["held"], bool), sizes))  # words and contexts have 31 bits at most
    first = np.flatnonzero(np.diff(tokens >> 1, prepend=-1))
    return tokens[first] >> 1, np.add.reduceat(tokens & 1, first)


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes; a context's key lies where its word does."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


# contexts: keys of the previous words; a type's context is CLASSES + its place there, or 0: the text's start
_ASK = "batch long, part long, words binary, lens binary, type_word binary, type_context binary, contexts binary, counts binary"


def _rows(t: pa.Table) -> Iterator[dict]:
    """A table's rows, one at a time."""
    for i in range(t.num_rows):
        yield t.slice(i, 1).to_pylist()[0]


def _table(values: list[tuple], schema: str) -> dict:
    fields = [x.split() for x in schema.split(", ")]
    return {name: pa.array([v[i] for v in values], pa.int64() if kind == "long" else pa.binary()) for i, (name, kind) in enumerate(fields)}


def asked_by(batches: DataFrame, parts: int, counted: bool = True) -> DataFrame:
    """What each batch asks of each part: its types there, and, counted, how often each is learnt."""
    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.begin_step("asks")
        for b in rows:
            for r in b.to_pylist():
                (data, lens, h), (kinds, n) = _words_of(r), learnt_types(r)
                word, ends, keys = kinds >> CONTEXT_BITS, np.r_[0, np.cumsum(lens)], _context_keys(data, lens, h)
                there, number = np.zeros(len(lens), bool), np.zeros(len(lens), np.int64)
                word_at = np.searchsorted(_part_of(h, parts), np.arange(parts + 1, dtype=np.uint64))
                kind_at = np.searchsorted(word, word_at)
                for p in np.flatnonzero(np.diff(word_at)):
                    a, z, k, m = word_at[p], word_at[p + 1], kind_at[p], kind_at[p + 1]
                    context = (kinds[k:m] & CONTEXT_MASK) - 1
                    own = context >= 0
                    there[context[own]] = True
                    used = np.flatnonzero(there)
                    there[used], number[used] = False, np.arange(len(used))
                    context[own], context[~own] = number[context[own]] + CLASSES, 0
                    row = (r["batch"], int(p), zstandard.compress(data[ends[a]:ends[z]].tobytes(), 3), _pack(lens[a:z].astype(np.uint32)), *_pack_types(word[k:m] - a, context), _pack_keys(keys[used]), _pack(n[k:m]) if counted else b"")
                    yield pa.RecordBatch.from_pydict(_table([row], _ASK))

    return batches.select("batch", "words", "lens", "held", "sizes", "stream").mapInArrow(ask, _ASK)


# ---------------------------------------------------------------- parts

def _bytes_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of a row's words."""
    return np.frombuffer(zstandard.decompress(r["words"]) if r["words"] else b"", np.uint8), _unpack(r["lens"], np.uint32).astype(np.int64)


def _hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    spaced = np.full(len(data) + len(lens), ord(" "), np.uint8)  # no word has a space
    inside = np.ones(len(spaced), bool)
    inside[np.cumsum(lens + 1) - 1] = False
    spaced[inside] = data
    return np.fromiter(map(xxhash.xxh3_64_intdigest, spaced.tobytes().split(b" ")[:-1]), np.uint64, len(lens))


def _words_of(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, lengths and 64-bit hashes of a row's words."""
    data, lens = _bytes_of(r)
    return data, lens, _hashes(data, lens)


def _pack_types(word: np.ndarray, context: np.ndarray) -> tuple[bytes, bytes]:
    return _pack(np.diff(word, prepend=0).astype(np.uint32)), _pack(context.astype(np.uint32))


def _types_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word number (ascending) and context of each of a row's types."""
    return np.cumsum(_unpack(r["type_word"], np.uint32), dtype=np.uint32), _unpack(r["type_context"], np.uint32)


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes | None) -> np.ndarray:
    return np.cumsum(_unpack(raw or b"", np.uint64), dtype=np.uint64)


def _contexts_of(r: dict) -> np.ndarray:
    """Keys of a row's previous words."""
    return _unpack_keys(r.get("contexts"))


def _gather(data: np.ndarray, lens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words at some positions."""
    start, n = (np.cumsum(lens) - lens)[at], lens[at]
    return data[np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], n


_STATE = ("part long, words binary, lens binary, type_word binary, type_context binary, contexts binary, own binary, counts binary, "
          "tables binary, class_tables binary, word_tables binary, sums binary, context_tables binary")


_COLUMNS = [x.split()[0] for x in _STATE.split(", ")]


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    """One array of a list's arrays, which the list gives up."""
    x = np.concatenate(arrays)
    arrays.clear()
    return x


def _narrow(n: np.ndarray) -> np.ndarray:
    """Numbers in 32 bits where they fit."""
    return n.astype(np.uint32) if not len(n) or n.max() < 1 << 32 else n


def _numbered(x: np.ndarray, below: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ones of the numbers under ``below``, ascending, and each one's place among these, counted from ``first``."""
    there = np.zeros(below, bool)
    there[x] = True
    place = np.cumsum(there, dtype=np.uint32)
    place += np.uint32(first)
    place -= np.uint32(1)  # first + 1 stands at the first one there
    return np.flatnonzero(there), place[x]


def _summed(t: pa.Table) -> tuple[bytes, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The learnt types of several rows of one part: packed words by hash and lengths, then words, contexts and counts of the
    types, and the contexts' keys, ascending."""
    datas, lens, hashes, words, contexts, keys, counts, n, m = [], [], [], [], [], [], [], 0, 0
    for r in _rows(t):
        data, size, h = _words_of(r)
        word, context = _types_of(r)
        datas.append(data)
        lens.append(size)
        hashes.append(h)
        words.append(word + np.uint32(n))
        contexts.append(np.where(context >= CLASSES, context + np.uint32(m), context))
        keys.append(_contexts_of(r))
        counts.append(_narrow(_unpack(r["counts"], np.int64)))
        n, m = n + len(size), m + len(keys[-1])
    _, first, which = np.unique(_joined(hashes), return_index=True, return_inverse=True)
    known, number = np.unique(_joined(keys), return_inverse=True)
    kinds = which[_joined(words)] << CONTEXT_BITS
    kinds |= np.r_[CLASS_NUMBERS, number + CLASSES][_joined(contexts)]
    del which, number
    order = np.argsort(kinds)
    kinds = kinds[order]
    new = np.flatnonzero(np.diff(kinds, prepend=-1))
    kinds, c = kinds[new], _joined(counts)[order]
    del order
    c = np.add.reduceat(c, new, dtype=np.int64) if len(new) else np.zeros(0, np.int64)
    if not c.all():
        learnt = np.flatnonzero(c)
        kinds, c = kinds[learnt], c[learnt]
    del new
    word = (kinds >> CONTEXT_BITS).astype(np.uint32)
    context = (kinds & CONTEXT_MASK).astype(np.uint32)
    del kinds
    used, word = _numbered(word, len(first))
    data, size = _gather(np.concatenate(datas), np.concatenate(lens), first[used])
    own = context >= CLASSES
    some, context[own] = _numbered(context[own] - np.uint32(CLASSES), len(known), CLASSES)
    return zstandard.compress(data.tobytes(), 3), _pack(size.astype(np.uint32)), word, context, c, known[some]


def states_of(asked: DataFrame, batches: int) -> DataFrame:
    """One row per part with the counts of all batches, and one table per dish to begin with."""
    def fold(key: tuple, t: pa.Table) -> pa.Table:
        C.begin_step("counts")
        words, lens, word, context, c, keys = _summed(t)
        return pa.table(_table([(key[1].as_py(), key[0].as_py(), words, lens, *_pack_types(word, context), _pack_keys(keys), _pack(c))], _ASK))

    def merged(key: tuple, t: pa.Table) -> pa.Table:
        C.begin_step("counts")
        return pa.table(_table([first_state(key[0].as_py(), t, CLASS_NUMBERS)], _STATE))

    while batches > FAN:
        batches = -(-batches // FAN)
        asked = asked.withColumn("batch", F.pmod(F.xxhash64("batch"), F.lit(batches))).groupBy("part", "batch").applyInArrow(fold, _ASK)
    return asked.groupBy("part").applyInArrow(merged, _STATE)


def first_state(part: int, t: pa.Table, cls: np.ndarray) -> tuple:
    words, lens, word, context, c, keys = _summed(t)
    words_ = int(word[-1]) + 1 if len(word) else 0
    dishes = len(_dishes(word, classes_of(cls, keys)[context], words_)[0])
    ones = lambda n: _pack(np.ones(n, np.int64))
    row = dict(zip(_COLUMNS, (part, words, lens, *_pack_types(word, context), _pack_keys(keys), _pack(np.ones(len(keys), bool)), _pack(c), ones(len(c)), ones(dishes),
                              ones(words_)), strict=False))
    return tuple((row | Part(row, cls).summary()).values())


def classes_of(cls: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Classes of a row's contexts: the classes themselves, then the previous words."""
    return np.concatenate([cls, (keys & np.uint64(CLASSES - 1)).astype(np.int64)]).astype(np.int8)


def _dishes(word: np.ndarray, cls: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The types' dishes (word * CLASSES + class), ascending, and each type's place among them."""
    key = word * np.uint32(CLASSES)  # a part has some PART_WORDS words
    key += cls.astype(np.uint32)
    return _numbered(key, words * CLASSES)


class Part:
    """One stored row of a part: types (word, context), dishes (word, class) and words, each by number.  ``own``: types whose
    context has a restaurant of its own."""

    def __init__(self, r: dict, cls: np.ndarray):
        self.part = r["part"]
        self.words, self.lens = _bytes_of(r)
        self.word, self.context = _types_of(r)
        self.counts, self.tables, self.class_tables, self.word_tables = (_unpack(r[c], np.int64) for c in ("counts", "tables", "class_tables", "word_tables"))  # 64 bits: "the" passes 2^32
        self.keys = _contexts_of(r)
        self.own = np.r_[np.zeros(CLASSES, bool), _unpack(r["own"], np.bool_)][self.context]
        self.dishes, self.dish = _dishes(self.word, classes_of(cls, self.keys)[self.context], len(self.lens))
        self.dish_word, self.dish_class = self.dishes // CLASSES, self.dishes % CLASSES
        self.seated()

    def with_seats(self, r: dict) -> Part:
        """The same types, seated as the row says."""
        p = copy.copy(self)
        p.tables, p.class_tables, p.word_tables = (_unpack(r[c], np.int64) for c in ("tables", "class_tables", "word_tables"))
        p.seated()
        return p

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return _hashes(self.words, self.lens)

    @functools.cached_property
    def kinds(self) -> np.ndarray:
        kinds = self.word.astype(np.int64)
        kinds <<= CONTEXT_BITS
        kinds |= self.context
        return kinds

    @functools.cached_property
    def seen(self) -> np.ndarray:
        """Training counts of the words."""
        seen = np.zeros(len(self.lens), np.int64)
        np.add.at(seen, self.word, self.counts)
        return seen

    def summary(self) -> dict:
        """What the totals of all parts are added up from: customers and tables of the classes, words, tables of the unigram;
        and the tables of the contexts."""
        n = [np.bincount(self.dish_class, x, CLASSES).astype(np.int64) for x in (self.class_customers, self.class_tables)]
        return {"sums": _pack(np.r_[n[0], len(self.lens), n[1], self.word_tables.sum()]), "context_tables": _pack(self.by_context(self.tables))}

    def by_context(self, n: np.ndarray) -> np.ndarray:
        """Sums of a number of the types over each of the contexts' keys."""
        own = self.context >= CLASSES
        return np.bincount(self.context[own] - CLASSES, n[own], len(self.keys)).astype(np.int64)

    def seated(self) -> None:
        """Customers of the classes and of the unigram: the tables below, and tokens after words without a restaurant."""
        self.class_customers = np.bincount(self.dish, np.where(self.own, self.tables, self.counts), len(self.dishes)).astype(np.int64)
        self.customers = np.bincount(self.dish_word, self.class_tables, len(self.lens)).astype(np.int64)


_CONTEXTS = "part long, place long, keys binary, n binary"


def context_sums(state: DataFrame, parts: int, what: str, path: str) -> DataFrame:
    """Sums of the types' ``what`` (counts, tables) over all parts, by context.  Each part adds up its own; the part of the
    context's word adds these up (``place``: the part that asked) and sends to each, in the order of its keys, what it asked
    for, and keeps all of its own words' (``place`` -1)."""
    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                keys, n = _contexts_of(r), _unpack(r["context_tables"], np.int64) if what == "tables" else Part(r, CLASS_NUMBERS).by_context(_unpack(r[what], np.int64))
                at = np.searchsorted(_part_of(keys, parts), np.arange(parts + 1, dtype=np.uint64))
                rows_ = [(int(q), r["part"], _pack_keys(keys[at[q]:at[q + 1]]), _pack(n[at[q]:at[q + 1]])) for q in np.flatnonzero(np.diff(at))]
                yield pa.RecordBatch.from_pydict(_table(rows_, _CONTEXTS))

    def add(key: tuple, t: pa.Table) -> pa.Table:
        asked = [(r["place"], _unpack_keys(r["keys"]), _unpack(r["n"], np.int64)) for r in _rows(t)]
        keys, which = np.unique(np.concatenate([k for _, k, _ in asked]), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, which, np.concatenate([x for _, _, x in asked]))
        ends = np.cumsum([len(k) for _, k, _ in asked])
        out = [(place, key[0].as_py(), b"", _pack(n[which[e - len(k):e]])) for (place, k, _), e in zip(asked, ends, strict=True)]
        return pa.table(_table([*out, (key[0].as_py(), -1, _pack_keys(keys), _pack(n))], _CONTEXTS))

    state = state.select("part", "contexts", "context_tables") if what == "tables" else state
    return C.stored(state.mapInArrow(own, _CONTEXTS).groupBy("part").applyInArrow(add, _CONTEXTS), path)


def told(t: pa.Table) -> np.ndarray:
    """For each of a part's contexts the sum that came back."""
    rows = sorted(((r["place"], r) for r in t.to_pylist() if r["place"] >= 0), key=lambda x: x[0])  # ranges of keys, ascending
    return np.concatenate([_unpack(r["n"], np.int64) for _, r in rows]) if rows else np.zeros(0, np.int64)


def with_own(state: DataFrame, parts: int, least: int, folder: str) -> DataFrame:
    """Only previous words that were learnt ``least`` times have a restaurant of their own."""
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [r | {"own": _pack(told(right) >= least)} for r in left.to_pylist()]
        return pa.table(_table([tuple((r | Part(r, CLASS_NUMBERS).summary()).values()) for r in rows], _STATE))

    sums = context_sums(state, parts, "counts", f"{folder}/often").filter("place >= 0")
    return C.stored(state.groupBy("part").cogroup(sums.groupBy("part")).applyInArrow(cut, _STATE), f"{folder}/owning")


def totals(state: DataFrame, learnt: int) -> dict:
    """Sums over all restaurants of the classes: customers and tables; tables of the unigram; N and V."""
    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                customers, tables = _unpack(r["sums"], np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"at": pa.array(np.r_[CLASS_NUMBERS, -1]), "customers": pa.array(customers), "tables": pa.array(tables)})

    got = state.select("sums").mapInArrow(add, "at long, customers long, tables long").groupBy("at").agg(F.sum("customers").alias("customers"), F.sum("tables").alias("tables")).toArrow()
    at = got["at"].to_numpy()
    out = {"N": learnt, "V": 0, "parent_tables": 0}
    for c in ("customers", "tables"):
        n = np.zeros(CLASSES + 1, np.int64)
        n[at] = got[c].to_numpy()  # -1 is the last place
        out[c], out[{"customers": "V", "tables": "parent_tables"}[c]] = n[:-1], int(n[-1])
    return out


def known_mass(state: DataFrame, models: list[Broadcast]) -> list[float]:
    """How much of the spelling models' probability lies on learnt words."""
    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                words, lens = _bytes_of(r)
                yield pa.RecordBatch.from_pydict({f"p{k}": pa.array([float(np.exp(spelled(words, lens, model.value)).sum())], pa.float64()) for k, model in enumerate(models)})

    names = [f"p{k}" for k in range(len(models))]
    return [min(1.0, p or 0.0) for p in state.select("words", "lens").mapInArrow(add, ", ".join(f"{n} double" for n in names)).agg(*(F.sum(n) for n in names)).first()]


def unigram(customers: np.ndarray, tables: np.ndarray, base: np.ndarray, sums: dict) -> np.ndarray:
    d, strength = WORD_PARAMETERS
    return (customers - d * tables + (strength + d * sums["parent_tables"]) * base) / (strength + sums["tables"].sum())


def predictive(customers: np.ndarray, tables: np.ndarray, at: np.ndarray, up: np.ndarray, sums: dict, parameters: tuple[float, float]) -> np.ndarray:
    """Probability of dishes in the restaurants ``at``, given their parents' probabilities."""
    d, strength = parameters
    return (customers - d * tables + (strength + d * sums["tables"][at]) * up) / (strength + sums["customers"][at])


def sweep(state: DataFrame, contexts: DataFrame, known: dict, model: Broadcast | None, number: int, folder: str) -> DataFrame:
    """Re-seat the restaurants of words, classes and the unigram.  contexts: the tables of the words' restaurants."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        C.begin_step("sweeps")
        (d2, s2), (d1, s1), (d0, s0) = CONTEXT_PARAMETERS, CLASS_PARAMETERS, WORD_PARAMETERS
        done = []
        for r in left.to_pylist():
            p, rng = Part(r, CLASS_NUMBERS), np.random.default_rng([SEED, number, r["part"]])
            base = np.exp(spelled(p.words, p.lens, model.value)) if model else np.full(len(p.lens), 1 / (known["V"] + 1))
            up0 = unigram(p.customers, p.word_tables, base, known)[p.dish_word]
            up1 = predictive(p.class_customers, p.class_tables, p.dish_class, up0, known, CLASS_PARAMETERS)
            own = np.flatnonzero(p.own & (p.counts > 1))  # one customer sits at one table
            p.tables = p.tables.copy()
            p.tables[own] = seat(p.counts[own], (s2 + d2 * told(right)[p.context[own] - CLASSES]) * up1[p.dish[own]], d2, rng)
            p.seated()
            p.class_tables = seat(p.class_customers, (s1 + d1 * known["tables"][p.dish_class]) * up0, d1, rng)
            p.seated()
            p.word_tables = seat(p.customers, (s0 + d0 * known["parent_tables"]) * base, d0, rng)
            done.append(tuple((r | {"tables": _pack(p.tables), "class_tables": _pack(p.class_tables), "word_tables": _pack(p.word_tables)} | p.summary()).values()))
        return pa.table(_table(done, _STATE))

    run_on = state.groupBy("part").cogroup(contexts.filter("place >= 0").groupBy("part"))
    return C.stored(run_on.applyInArrow(run, _STATE), f"{folder}/state{number}")


def spelling(state: DataFrame, old: dict | None, number: int) -> dict:
    """Seat the spelling restaurants by the words' tables.  At most SLOTS3 * 258 rows come back."""
    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for r in b.to_pylist():
                words, lens = _bytes_of(r)
                keys, n = spell_counts(words, lens, _unpack(r["word_tables"], np.int64))
                yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64())})

    # a slot and symbol keep only their most frequent shorter contexts; their counts stay whole
    rows = state.select("words", "lens", "word_tables").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    slot = F.expr(f"k div {SLOTS2 * SYMBOLS * SYMBOLS}")
    rows = rows.groupBy(slot.alias("slot"), (F.col("k") % SYMBOLS).alias("symbol")).agg(F.max_by("k", F.struct("n", "k")).alias("k"), F.sum("n").alias("n"))
    got = rows.select("k", "n").orderBy("k").toArrow()
    return spelling_model(got["k"].to_numpy(), got["n"].to_numpy(), old, np.random.default_rng([SEED, number, 1 << 40]))


# ---------------------------------------------------------------- scores


# of each type its customers in its own restaurant, and, one sample after the other, its tables there and its parent's
# probability; of each word its training count, and, one sample after the other, its tables as a context
_REPLY = "batch long, part long, held binary, seats binary, above binary, counts binary, tables binary"


def _found(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted number, and whether it is there."""
    if not len(sorted_):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return at, sorted_[at] == wanted


def _at(values: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    return np.where(there, values[at], 0) if len(values) else np.zeros(len(at), np.int64)


class Asked:
    """What a batch asks of a part, and where the part has it (all samples seat the same types)."""

    def __init__(self, p: Part, r: dict):
        self.words, self.lens, h = _words_of(r)
        self.word, context = _types_of(r)
        self.mine = _context_keys(self.words, self.lens, h)
        self.at, self.hit = _found(p.hashes, h)
        keys = _contexts_of(r)
        self.cls = classes_of(CLASS_NUMBERS, keys)[context]
        self.dish, self.dish_hit = _found(p.dishes, self.at[self.word] * CLASSES + self.cls)
        self.dish_hit &= self.hit[self.word]
        place, known = _found(p.keys, keys)
        number = np.r_[CLASS_NUMBERS, np.where(known, place + CLASSES, CONTEXT_MASK)][context]
        self.kind, self.kind_hit = _found(p.kinds, self.at[self.word] << CONTEXT_BITS | number)
        self.kind_hit &= self.hit[self.word]

    def counts(self, p: Part) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the types in their own restaurant; training counts of the words."""
        return _at(p.counts, self.kind, self.kind_hit), _at(p.seen, self.at, self.hit)

    def probabilities(self, p: Part, sums: dict, words: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
        """Of the types their tables in their own restaurant, and their probability in its parent.  words: the unigram
        probabilities of the part's words; unknown: that of all words that weren't learnt."""
        up0 = np.where(self.hit, words[self.at] if len(words) else 0, unknown)[self.word]
        up1 = predictive(_at(p.class_customers, self.dish, self.dish_hit), _at(p.class_tables, self.dish, self.dish_hit), self.cls, up0, sums, CLASS_PARAMETERS)
        return _at(p.tables, self.kind, self.kind_hit), up1


def answers(asked: DataFrame, batches: int, samples: list[tuple[DataFrame, DataFrame, dict, Broadcast]], masses: list[float]) -> DataFrame:
    """For every batch and part what it needs to score each type it asked for, and the words' training counts.  masses: how much
    of each sample's spelling lies on learnt words."""
    shared = [(sums, model, max(1 - mass, 1e-12)) for (_, _, sums, model), mass in zip(samples, masses, strict=True)]
    # All samples seat the same types: these travel once, the tables once for each sample, and so do the contexts' tables.
    seats = ["part", "tables", "class_tables", "word_tables"]
    states = samples[0][0].drop("sums", "context_tables").withColumn("sample", F.lit(0))
    for k, (s, contexts, _, _) in enumerate(samples):
        own = contexts.filter("place = -1").select("part", F.col("keys").alias("after"), F.col("n").alias("after_tables")).withColumn("sample", F.lit(k))
        states = states.unionByName(own, allowMissingColumns=True)
        states = states.unionByName(s.select(*seats).withColumn("sample", F.lit(k)), allowMissingColumns=True) if k else states
    groups = -(-batches // FAN)
    states = states.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        C.begin_step("answers")
        rows: list[dict] = [{} for _ in shared]
        for r in _rows(right):
            rows[r["sample"]] |= {c: v for c, v in r.items() if v is not None}
        own = []
        if "words" in rows[0]:
            first = Part(rows[0], CLASS_NUMBERS)
            for r, (sums, model, unknown) in zip(rows, shared, strict=True):
                p = first.with_seats(r) if own else first
                words = unigram(p.customers, p.word_tables, np.exp(spelled(p.words, p.lens, model.value)), sums)  # once, not by every batch
                own.append((p, words, float(unigram(0, 0, unknown, sums)), sums, _unpack_keys(r.get("after")), _unpack(r.get("after_tables", b""), np.int64)))
        rows.clear()
        out: list[tuple] = []
        for r in _rows(left) if own else []:
            asks, seats, above, tables = Asked(own[0][0], r), [], [], []
            held, count = asks.counts(own[0][0])
            for p, words, unknown, sums, after, after_tables in own:
                one, up = asks.probabilities(p, sums, words, unknown)
                seats.append(one)
                above.append(np.log(np.maximum(up, 1e-300)).astype(np.float32))
                tables.append(_at(after_tables, *_found(after, asks.mine)))
            out.append((r["batch"], r["part"], _pack(held), _pack(np.concatenate(seats)), _pack(np.concatenate(above)), _pack(count), _pack(np.concatenate(tables))))
        return pa.table(_table(out, _REPLY))

    asked = asked.drop("counts").withColumn("some", F.pmod(F.xxhash64("batch", F.lit(1)), F.lit(groups)))
    return asked.groupBy("part", "some").cogroup(states.groupBy("part", "some")).applyInArrow(answer, _REPLY)


def scored(batches: DataFrame, replies: DataFrame, samples: int, least: int, sums: dict) -> DataFrame:
    n, v = sums["N"], sums["V"]
    kind = dict(batches.dtypes)["ids"][6:-1]
    d, strength = CONTEXT_PARAMETERS

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        C.begin_step("scores")
        order = [int(i) for i in np.argsort(right["part"].to_numpy())]
        kinds, stream, sizes = types_of_batch(left.select(["sizes", "stream"]).to_pylist()[0])

        def replied(column: str, kind: type, of: int = samples) -> np.ndarray:
            found = [_unpack(right[column][i].as_py(), kind) for i in order]
            found = [(x if kind is np.float32 else _narrow(x)).reshape(of, len(x) // of) for x in found]
            return np.concatenate(found, 1)

        seen, tables = replied("counts", np.int64, 1)[0], replied("tables", np.int64)
        context = (kinds & CONTEXT_MASK) - 1  # customers of a word's restaurant: what follows it, as often as itself
        own = (context >= 0) & (seen[context] >= least)
        held, seats, above = replied("held", np.int64, 1)[0], replied("seats", np.int64), replied("above", np.float32)
        log10 = np.zeros(len(kinds))
        for a in range(0, len(kinds), SCORE_TYPES):
            at = slice(a, a + SCORE_TYPES)
            after = context[at]
            for k in range(samples):
                p = np.exp(above[k, at].astype(np.float64))
                log10[at] += np.where(own[at], (held[at] - d * seats[k, at] + (strength + d * tables[k][after]) * p) / (strength + seen[after]), p)
            log10[at] = np.log10(np.maximum(log10[at] / samples, 1e-300))
        del held, seats, above, context, own
        count = seen[kinds >> CONTEXT_BITS].astype(np.int64)
        del kinds
        first = np.cumsum(sizes) - sizes
        sums_ = [np.add.reduceat(x()[stream], first) for x in (lambda: (count > 0).astype(np.int64), lambda: np.log10((count + 1) / (n + (v + 1))), lambda: log10)]
        return pa.table({"doc_id": left["ids"].combine_chunks().values, "held_out": left["held"].combine_chunks().values, "n_tokens": pa.array(sizes), "n_known": pa.array(sums_[0]),
                         "train_tokens": pa.array(np.full(len(sizes), n)), "base_score": pa.array(sums_[1]), "score": pa.array(sums_[2])})

    return batches.select("batch", "ids", "held", "sizes", "stream").groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(
        add, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, sweeps: int = SWEEPS, samples: int = SAMPLES, least: int | None = None) -> DataFrame:
    """docs: doc_id, text, held_out (its words aren't learnt).  least: training tokens that give a previous word its own
    restaurant; 1 where unset, so that every learnt word has one."""
    spark, least = docs.sparkSession, least or 1
    folder = C.scratch(spark, "lm")
    stored = batches_of(docs, folder)
    size = stored.agg(F.count("*").alias("batches"), F.sum("learnt").alias("learnt")).first()
    n = size["learnt"] or 0
    parts = max(LEAST_PARTS, -(-vocabulary(stored) // PART_WORDS))
    with C.shuffles_removed(spark), C.blob_batches(spark):  # all steps are stored
        state = C.stored(states_of(asked_by(stored, parts), size["batches"]), f"{folder}/state0")
        state = state if least == 1 else with_own(state, parts, least, folder)
        model, log, kept = None, None, []
        sums, contexts = totals(state, n), context_sums(state, parts, "tables", f"{folder}/contexts0")
        for k in range(1, sweeps + 1):
            state = sweep(state, contexts, sums, log, k, folder)
            sums, contexts = totals(state, n), context_sums(state, parts, "tables", f"{folder}/contexts{k}")
            model = spelling(state, model, k)
            log = spark.sparkContext.broadcast(model["log"])  # one for the next sweep and the answers
            kept.append((state, contexts, sums, log))
            if len(kept) > samples:
                kept.pop(0)[3].unpersist()
            if k == 1 or k <= sweeps - samples + 1:  # the sweep before is read no more
                C.removed(spark, f"{folder}/state{k - 1}", f"{folder}/contexts{k - 1}", *[f"{folder}/{x}" for x in ("often", "owning") if k == 1])
        done = []
        masses = known_mass(kept[0][0], [model for *_, model in kept])
        # what is asked and answered is kept for one round's batches
        rounds = max(1, min(2, size["batches"]), min(ROUNDS, -(-size["batches"] // FAN)))
        for k in range(rounds):
            some = stored.filter(F.pmod(F.xxhash64("batch"), F.lit(rounds)) == k)
            replies = C.stored(answers(asked_by(some, parts, counted=False), max(1, -(-size["batches"] // rounds)), kept, masses), f"{folder}/replies{k}")
            if k == rounds - 1:  # the last answers are given
                C.removed(spark, *(f"{folder}/{x}{i}" for i in range(sweeps - len(kept) + 1, sweeps + 1) for x in ("state", "contexts")))
            done.append(C.stored(scored(some, replies, len(kept), least, sums), f"{folder}/scores{k}"))
            C.removed(spark, f"{folder}/replies{k}")
        C.removed(spark, f"{folder}/batches")
    return functools.reduce(DataFrame.unionByName, done)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(C.read(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out")))


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
