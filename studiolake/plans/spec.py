"""Output specs shared by a Spark query and its SQL oracle.

A spec is ``"name:type, name:type, ..."`` with the plain types
``l`` bigint, ``i`` int, ``d`` double, ``s`` string, ``b`` boolean,
``t`` date, ``ts`` timestamp (no zone).  Both sides project to exactly these
columns and types, so the comparison never trips on ``decimal`` vs ``double``
or ``int`` vs ``bigint``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPARK = {"l": "bigint", "i": "bigint", "d": "double", "s": "string", "b": "boolean",
          "t": "date", "ts": "timestamp_ntz"}
_SQL = {"l": "BIGINT", "i": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN",
        "t": "DATE", "ts": "TIMESTAMP"}


def parse(spec: str) -> list[tuple[str, str]]:
    out = []
    for part in spec.split(","):
        part = part.strip()
        if part:
            n, t = part.split(":")
            out.append((n.strip(), t.strip()))
    return out


def to_spec(df: DataFrame, spec: str) -> DataFrame:
    return df.select(*[F.col(n).cast(_SPARK[t]).alias(n) for n, t in parse(spec)])


def sql_select(spec: str, src: str = "result") -> str:
    cols = ", ".join(f'CAST("{n}" AS {_SQL[t]}) AS "{n}"' for n, t in parse(spec))
    return f"SELECT {cols} FROM {src}"
