"""Operator 8: chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings (those marks, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]``) inside roles and texts get a backslash after their first character, and a backslash is doubled, so taking
one backslash away before each character gives the text back; in a role a line end is written ``\\n`` with letter n.

Rows are dealt by conversation and sorted by turn; a task goes through Arrow batches.  For a batch all segment lengths,
their running sums and the scatter indices are computed in numpy, and headers and contents are copied into one
preallocated buffer, which becomes the Arrow string column without further copies.  One output row is a piece: the
formatted turns of a conversation within a batch, with the spans (code points in the piece) that the loss counts.  So a
conversation of any length is held a batch at a time; ``read_back`` digests pieces in order, also one by one.

Order in a conversation: turn (nulls first), role, text.  Cases: null text is empty; null role is an empty role; null
conv_id is one conversation; repeated rows are turns of their own; empty table: no rows.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from studiolake.llm import common as C

START, MIDDLE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
LOSS_ROLE = "assistant"


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    out = pc.replace_substring(column, "\\", "\\\\")
    for s in CONTROL:
        out = pc.replace_substring(out, s, s[0] + "\\" + s[1:])
    return pc.replace_substring(out, "\n", "\\n") if role else out


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data, start and length of each value of a string column without nulls."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), at[:-1], np.diff(at)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; begin of each turn (with the end), begin and length of each text, in bytes."""
    (rd, ra, rn), (td, ta, tn) = _bytes(roles), _bytes(texts)
    n, marks = len(roles), np.frombuffer(START + MIDDLE + END, np.uint8)
    source = np.concatenate([marks, rd, td])
    begin = np.empty((n, 5), np.int64)
    size = np.empty((n, 5), np.int64)
    m1, m2 = len(START), len(START) + len(MIDDLE)
    for k, (a, z) in enumerate(((0, len(START)), (ra + len(marks), rn), (m1, len(MIDDLE)), (ta + len(marks) + len(rd), tn), (m2, len(END)))):
        begin[:, k], size[:, k] = a, z
    lens = size.ravel()
    to = np.cumsum(lens) - lens
    total = int(lens.sum())
    index = np.repeat(begin.ravel() - to, lens) + np.arange(total)
    out = np.empty(total, np.uint8)
    np.take(source, index, out=out)
    return out, np.append(to[::5], total), to[3::5], size[:, 3]


def _characters(buffer: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte position (one more than bytes)."""
    return np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])


def format_chats(chats: DataFrame) -> DataFrame:
    """Pieces: conv_id, piece (ascending), n_turns, formatted, spans (begin and end of loss characters in the piece)."""
    C.small_batches(chats.sparkSession)
    kind = dict(chats.dtypes)["conv_id"]
    rows = chats.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", F.coalesce("role", F.lit("")).alias("role"), "text")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for b in batches:
            if not b.num_rows:
                continue
            data, turns, text_at, text_n = assemble(escape(b["role"], True), escape(b["text"]))
            chars = _characters(data)
            ids = b["conv_id"].to_pylist()
            cut = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            loss = pc.equal(b["role"], LOSS_ROLE).to_numpy(zero_copy_only=False)
            spans = []
            for a, z in zip(cut, cut[1:], strict=False):
                zero = chars[turns[a]]
                spans.append([{"begin": int(chars[text_at[i]] - zero), "end": int(chars[text_at[i] + text_n[i]] - zero)} for i in range(a, z) if loss[i]])
            offsets = pa.py_buffer(turns[np.array(cut)].astype(np.int32).tobytes())
            text = pa.StringArray.from_buffers(len(cut) - 1, offsets, pa.py_buffer(data))
            yield pa.RecordBatch.from_pydict({
                "conv_id": b["conv_id"].take(pa.array(cut[:-1])), "piece": pa.array(range(number, number + len(cut) - 1), pa.int64()), "n_turns": pa.array(np.diff(cut), pa.int64()),
                "formatted": text, "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))})
            number += len(cut) - 1

    return rows.mapInArrow(pieces, f"conv_id {kind}, piece long, n_turns long, formatted string, spans array<struct<begin: long, end: long>>")


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation the digests of what the formatted pieces hold."""
    kind = dict(formatted.dtypes)["conv_id"]
    rows = formatted.select("conv_id", "piece", "formatted", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, type_ = None, None, None

        def row() -> pa.RecordBatch:
            n, turns, loss_n, loss, chars = state
            values = [now[0], n, turns.hexdigest(), loss_n, loss.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [type_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], ["conv_id", *names])

        for b in batches:
            type_ = b["conv_id"].type
            for r in b.to_pylist():
                if now != (r["conv_id"],):
                    if now:
                        yield row()
                    now, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(r["formatted"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in r["spans"]:
                    text = unescape(r["formatted"][s["begin"]:s["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(r["formatted"])
        if now:
            yield row()

    return rows.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    chats = C.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(C.stored(format_chats(chats), f"{C.scratch(spark, 'chats')}/formatted"))


_ESCAPE = "replace({}, '\\', '\\\\')"
for _s in CONTROL:
    _ESCAPE = f"replace({_ESCAPE}, '{_s}', '{_s[0]}\\{_s[1:]}')"
ORACLES = {"op8_chat_format": f"""
WITH c_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPE.format("text")}) + length(replace({_ESCAPE.format("role")}, chr(10), '\\n')) + {len(START + MIDDLE + END)})::BIGINT AS formatted_chars
FROM c_rows GROUP BY conv_id"""}
QUERIES = {"op8_chat_format": op8_chat_format}
