"""Operator 1: token-ID shards with a minimal-perfect-hash index.

``write_shards`` range-partitions documents by key, sorts them, and each task encodes its documents and writes one raw
payload file of little-endian ids (2 bytes while the vocabulary has at most 65,536 ids, else 4).  The index maps a
document key to (shard, first id, ids, documents): keys are dealt into buckets by hash, and each bucket is one file
with a minimal perfect hash (levels of bit arrays with rank counts), a 32-bit fingerprint per slot that rejects foreign
keys, and the slots' entries.  A lookup costs a constant number of probes.  ``read_documents`` looks keys up in the
index and reads the ids from the payload files.

Files are written under a temporary name and renamed, so a repeated task leaves one whole file.  A task holds the Arrow
batches of about ``GROUP_BYTES`` of texts, whose distinct words it looks up once, and one bucket of about
``KEYS_PER_BUCKET`` keys, at a time.

Cases: null text encodes to no ids (only the end id); null key is a key of its own; documents that share a key lie one
after the other, and the key's entry names how many there are (their lengths stand before the ids); empty table: no
shards, no rows.  Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from studiolake.llm import common as C

KEYS_PER_BUCKET = 200_000
GROUP_BYTES = 16 << 20  # texts whose words are looked up together
SOME_WORDS = 50_000
END_ID = 2
_REGULAR = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?]*)")


# ---------------------------------------------------------------- encoding

class Encoder(dict):
    """Ids of a text, word by word.

    The tokenizer's pre-tokens never cross white space, so a text's ids are its words' ids in order.  Words of plain
    letters with trailing punctuation go to the library's model directly, all others through its whole pipeline.
    The tables of words and of pieces seen are bounded: each is emptied when it has ``limit`` entries.  Ids are kept as
    bytes, 4 an id.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer
        super().__init__()
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.model, self.limit = self.whole.model, limit
        self.bytes_as = _byte_letters()
        self.pieces: dict[str, bytes] = {}
        self.check = self._direct_agrees()
        self.clear()

    def _direct_agrees(self) -> bool:
        """Does this tokenizer's pipeline treat regular words as the direct way does?"""
        return all(self._direct(*_REGULAR.fullmatch(w).groups()) == self._whole(w) for w in ("Abc", "don,", "Été.", "straße!?", "...", "Ñandú;:"))

    def _whole(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def _direct(self, letters: str, marks: str) -> bytes:
        ids = self._piece(letters.lower())
        return ids + self._piece(marks) if marks else ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= self.limit:
                self.pieces.clear()
            shown = piece if piece.isascii() else "".join([self.bytes_as[b] for b in piece.encode()])
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(shown)]).tobytes() if piece else b""
        return ids

    def __missing__(self, word: bytes) -> bytes:
        w = word.decode("utf-8", "replace")
        regular = self.check and _REGULAR.fullmatch(w)
        ids = self[word] = self._direct(*regular.groups()) if regular else self._whole(w)
        return ids

    def listed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words, one after the other, and how many each has."""
        ids, lens = [], [np.empty(0, np.int64)]
        for i in range(0, len(words), SOME_WORDS):
            if len(self) >= self.limit:
                self.clear()
            some = list(map(self.__getitem__, words[i:i + SOME_WORDS]))
            ids.append(b"".join(some))
            lens.append(np.fromiter(map(len, some), np.int64, len(some)) >> 2)
        return np.frombuffer(b"".join(ids), np.uint32), np.concatenate(lens)

    def encode(self, text: bytes) -> np.ndarray:
        return self.listed(text.split())[0]

    def encode_columns(self, columns: list[pa.Array], end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of some columns of texts (null is empty) all ids, with ``end_id`` after each text, and how many each text
        has.  A word is looked up once for all columns."""
        split = [pc.ascii_split_whitespace(c.fill_null("")) for c in columns]  # the same white space as bytes.split
        coded = pa.chunked_array([s.flatten() for s in split]).dictionary_encode()
        if not coded.num_chunks:
            return
        flat, lens = self.listed(coded.chunk(0).dictionary.cast(pa.binary()).to_pylist())  # all chunks share one dictionary
        first = np.cumsum(lens) - lens
        for s, c in zip(split, coded.chunks, strict=True):
            at = c.indices.to_numpy()
            n, words = lens[at], pc.list_value_length(s).to_numpy()
            upto = np.r_[0, np.cumsum(n)][np.cumsum(words)]  # ids up to the end of each text
            ends = upto + np.arange(len(s))
            ids = np.full(int(n.sum()) + len(s), end_id, np.uint32)
            inside = np.ones(len(ids), bool)
            inside[ends] = False
            ids[inside] = flat[_spread(first[at], n)]
            yield ids, np.diff(ends, prepend=-1)


def _byte_letters() -> list[str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable ones stand for themselves, others follow U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], extra = chr(extra), extra + 1
    return out


def _spread(first: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + lens[i] - 1, one run after the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(first - before, lens) + np.arange(total)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


# ---------------------------------------------------------------- files

def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _put(folder: str, name: str, chunks: Iterable[bytes]) -> None:
    """Whole file or none: written beside its place, then renamed."""
    store, top = _store(folder)
    store.create_dir(top, recursive=True)
    part = f"{top}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
    with store.open_output_stream(part) as out:
        for c in chunks:
            out.write(c)
    store.move(part, f"{top}/{name}")


def _get(folder: str, name: str) -> pa.Buffer:
    store, top = _store(folder)
    with store.open_input_file(f"{top}/{name}") as f:
        return f.read_buffer()


# ---------------------------------------------------------------- payload shards

def write_shards(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> DataFrame:
    """Write the payload; returns the stored entries: h1, h2 (hashes of the key), shard, position, lengths of its documents."""
    spark = docs.sparkSession
    C.small_batches(spark)
    wide = _id_bytes(vocabulary)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(key).alias("sort_key"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange("sort_key").sortWithinPartitions("sort_key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, held = encoder(vocabulary), []
        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is None:
            return
        shard = "s" + xxhash.xxh3_128_hexdigest(repr([head["sort_key"][0].as_py(), head["text"][0].as_py()]))

        def chunks() -> Iterator[bytes]:
            for some in _grouped(_chain(head, batches)):
                for b, (ids, lens) in zip(some, enc.encode_columns([b["text"] for b in some], end_id), strict=True):
                    h1, h2 = _key_hashes(b["key"].to_pylist())
                    held.append((h1, h2, lens))
                    yield ids.astype(f"<u{wide}").tobytes()

        _put(f"{folder}/ids", shard, chunks())
        h1, h2, lens = (np.concatenate(x) for x in zip(*held, strict=True))
        first = np.cumsum(lens) - lens
        new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        at = np.flatnonzero(new)
        runs = np.diff(np.r_[at, len(h1)])
        n = len(at)
        for a in range(0, n, 50_000):
            z = min(n, a + 50_000)
            yield pa.RecordBatch.from_pydict({
                "h1": pa.array(h1[at[a:z]].view(np.int64)), "h2": pa.array(h2[at[a:z]].view(np.int64)), "shard": pa.array([shard] * (z - a)),
                "begin": pa.array(first[at[a:z]]),
                "lens": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(runs[a:z])].astype(np.int32)), pa.array(lens[at[a]:at[a] + int(runs[a:z].sum())])),
                "rank": pa.array(np.full(z - a, -1 if a else n, np.int64)), "total": pa.array(np.full(z - a, int(lens.sum()), np.int64)),
                "head": pa.array([head["sort_key"][0].as_py()] * (z - a), head["sort_key"].type)})

    kind = dict(docs.dtypes)[key]
    entries = rows.mapInArrow(write, f"h1 long, h2 long, shard string, begin long, lens array<long>, rank long, total long, head {kind}")
    entries = C.stored(entries, f"{folder}/entries")
    # ids of all shards before: one row per shard
    shards = entries.groupBy("shard").agg(F.max("total").alias("ids"), F.min("head").alias("head"))
    order = Window.orderBy(F.col("head").asc_nulls_first(), "shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", "ids", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("base"))
    C.stored(shards, f"{folder}/shards")
    return entries.select("h1", "h2", "shard", "begin", "lens")


def _chain(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, until they have ``GROUP_BYTES`` of text."""
    some, size = [], 0
    for b in batches:
        if b.num_rows:
            some.append(b)
            size += b["text"].nbytes
        if size >= GROUP_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _id_bytes(vocabulary: str) -> int:
    from tokenizers import Tokenizer
    return 2 if Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def _key_hashes(keys: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    h = [xxhash.xxh3_128_intdigest(b"0" if k is None else b"1" + k.encode()) for k in keys]
    return np.array([x & (1 << 64) - 1 for x in h], np.uint64), np.array([x >> 64 for x in h], np.uint64)


# ---------------------------------------------------------------- minimal perfect hash

class PerfectHash:
    """Levels of bit arrays: a key takes its bit on the first level where no other key left wants it; its slot is the
    number of set bits before.  Keys are pairs of 64-bit hashes; equal pairs are one key."""

    LEVELS = 40

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.flat = np.concatenate(bits) if bits else np.empty(0, np.uint64)
        counts = np.bitwise_count(self.flat).astype(np.int64)
        self.rank = np.cumsum(counts) - counts
        self.begin = np.cumsum([0, *map(len, bits)])

    @staticmethod
    def _place(h1: np.ndarray, h2: np.ndarray, level: int, words: int) -> np.ndarray:
        return C.mix(h1 + h2 * np.uint64(2 * level + 1)) % np.uint64(words * 64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        bits, left = [], np.arange(len(h1))
        for level in range(cls.LEVELS):
            if not len(left):
                break
            words = max(1, -(-len(left) * 3 // 128))
            at = cls._place(h1[left], h2[left], level, words)
            wanted = np.bincount(at.astype(np.int64), minlength=words * 64)
            alone = wanted[at.astype(np.int64)] == 1
            bits.append(np.packbits((wanted == 1).astype(np.uint8), bitorder="little").view("<u8"))
            left = left[~alone]
        if len(left):
            raise ValueError(f"{len(left)} keys share both 64-bit hashes")
        return cls(bits)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where no level has its bit (surely foreign)."""
        out, left = np.full(len(h1), -1, np.int64), np.arange(len(h1))
        for level, level_bits in enumerate(self.bits):
            if not len(left):
                break
            at = self._place(h1[left], h2[left], level, len(level_bits))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            row = self.flat[self.begin[level] + word]
            hit = (row >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(row & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.rank[self.begin[level] + word] + below)[hit]
            left = left[~hit]
        return out


def _fingerprint(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    return (C.mix(h1 ^ C.mix(h2)) >> np.uint64(32)).astype(np.uint32)


def write_index(entries: DataFrame, folder: str, keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Deal keys into buckets by hash and write one index file each; returns the number of buckets."""
    buckets = max(1, -(-entries.count() // keys_per_bucket))

    def build(key: tuple, t: pa.Table) -> pa.Table:
        h1, h2 = (t[c].to_numpy().view(np.uint64) for c in ("h1", "h2"))
        mph = PerfectHash.build(h1, h2)
        slot = mph.slots(h1, h2)
        order = np.argsort(slot)
        lens = t["lens"].combine_chunks()
        docs = np.diff(lens.offsets.to_numpy())[order]
        shards, codes = np.unique(np.array(t["shard"].to_pylist(), object).astype(str), return_inverse=True)
        parts = [np.array([len(mph.bits), len(h1), len(shards)], "<i8"), np.array([len(b) for b in mph.bits], "<i8"), mph.flat,
                 _fingerprint(h1, h2)[order], codes.astype("<i4")[order], t["begin"].to_numpy()[order].astype("<i8"),
                 (np.cumsum(docs) - docs).astype("<i8"), docs.astype("<i4"),
                 lens.values.to_numpy()[_spread(lens.offsets.to_numpy()[:-1][order], docs)].astype("<i8")]
        _put(f"{folder}/index", f"{key[0].as_py():08d}", [x.tobytes() for x in parts] + ["".join(shards).encode()])
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "keys": pa.array([len(h1)], pa.int64())})

    b = entries.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    built = b.groupBy("bucket").applyInArrow(build, "bucket long, keys long")
    C.stored(built, f"{folder}/buckets")
    return buckets


class Bucket:
    """One index file, opened for lookups."""

    def __init__(self, folder: str, bucket: int):
        raw = _get(f"{folder}/index", f"{bucket:08d}")
        at = 0

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(raw, kind, n, at)
            at += x.nbytes
            return x

        levels, n, shards = take(3, "<i8").tolist()
        words = take(levels, "<i8")
        flat = take(int(words.sum()), "<u8")
        self.mph = PerfectHash(np.split(flat, np.cumsum(words)[:-1]) if levels else [])
        self.fingers, self.codes, self.begin, self.first, self.docs = take(n, "<u4"), take(n, "<i4"), take(n, "<i8"), take(n, "<i8"), take(n, "<i4")
        self.lens = take(int(self.docs.sum()), "<i8")
        names = bytes(raw[at:]).decode()
        width = len(names) // max(shards, 1)
        self.shards = np.array([names[i * width:(i + 1) * width] for i in range(shards)], object)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't stored (but for one foreign key in 2**32)."""
        slot = self.mph.slots(h1, h2)
        if len(self.fingers):
            slot[(slot >= 0) & (self.fingers[np.maximum(slot, 0)] != _fingerprint(h1, h2))] = -1
        return slot


# ---------------------------------------------------------------- reading

def locate(keys: DataFrame, folder: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """(key, shard, begin, lens) of each distinct key that the index holds."""
    kind = dict(keys.dtypes)[key]

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = _key_hashes(b["text_key"].to_pylist())
            yield pa.RecordBatch.from_pydict({key: b[key], "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64))})

    def look(at: tuple, t: pa.Table) -> pa.Table:
        index = Bucket(folder, at[0].as_py())
        slot = index.find(*(t[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
        t, slot = t.filter(pa.array(slot >= 0)), slot[slot >= 0]
        docs = index.docs[slot].astype(np.int64)
        lens = index.lens[_spread(index.first[slot], docs)]
        return pa.table({key: t[key], "shard": pa.array(index.shards[index.codes[slot]].tolist(), pa.string()), "begin": pa.array(index.begin[slot]),
                         "lens": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(docs)].astype(np.int32)), pa.array(lens))})

    hashed = keys.select(key).distinct().select(key, F.col(key).cast("string").alias("text_key")).mapInArrow(hashes, f"{key} {kind}, h1 long, h2 long")
    dealt = hashed.withColumn("bucket", F.pmod("h1", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(look, f"{key} {kind}, shard string, begin long, lens array<long>")


def read_documents(keys: DataFrame, folder: str, buckets: int, wide: int, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per stored document of the wanted keys: key, start, n_tokens, ids_crc32, with_ids: the ids, from the files."""
    kind = dict(keys.dtypes)[key]
    spark = keys.sparkSession
    found = locate(keys, folder, buckets, key)
    shards = spark.read.parquet(f"{folder}/shards").select("shard", "base")
    found = found.join(shards, "shard").repartition("shard").sortWithinPartitions("shard", "begin")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for b in batches:
            out = {key: [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
            for r in b.to_pylist():
                if r["shard"] != name:
                    store, top = _store(f"{folder}/ids")
                    name, file = r["shard"], store.open_input_file(f"{top}/{r['shard']}")
                at = r["begin"]
                file.seek(at * wide)
                raw, used = file.read(sum(r["lens"]) * wide), 0
                for n in r["lens"]:
                    ids = np.frombuffer(raw, f"<u{wide}", n, used * wide).astype("<u4")
                    for k, v in ((key, r[key]), ("start", r["base"] + at + used), ("n_tokens", n), ("ids_crc32", zlib.crc32(ids.tobytes())), ("ids", ids.tolist() if with_ids else [])):
                        out[k].append(v)
                    used += n
            yield pa.RecordBatch.from_pydict({key: pa.array(out[key], b[key].type), **{c: pa.array(out[c], pa.int64()) for c in ("start", "n_tokens", "ids_crc32")}, "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    read = found.mapInArrow(fetch, f"{key} {kind}, start long, n_tokens long, ids_crc32 long, ids array<long>")
    return read if with_ids else read.drop("ids")


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def write_dataset(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID,
                  keys_per_bucket: int = KEYS_PER_BUCKET) -> int:
    """Payload and index under ``folder``; returns the number of index buckets."""
    return write_index(write_shards(docs, folder, vocabulary, key, text, end_id), folder, keys_per_bucket)


def token_output(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder, vocabulary = C.scratch(spark, "token-ids"), vocabulary_path()
    buckets = write_dataset(docs.select("doc_id", "text"), folder, vocabulary)
    return read_documents(docs.select("doc_id"), folder, buckets, _id_bytes(vocabulary))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark, C.read(spark, sf_dir, "documents"))


QUERIES = {"op1_token_output": op1_token_output}
ORACLES: dict[str, str] = {}
