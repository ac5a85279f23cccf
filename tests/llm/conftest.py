import duckdb
import pandas as pd
import pytest

from studiolake.llm import catalog

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, value string, h long, score string"


def words(n: int, seed: int, vocabulary: int = 400) -> list[str]:
    """Words of a fixed linear congruential sequence."""
    out, x = [], seed * 2654435761 % (1 << 32)
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(f"w{x // 65536 % vocabulary}")
    return out


def edge_texts() -> list:
    long = " ".join(words(60_000, 5, 5000))
    page = "\n".join(" ".join(words(12, 40 + k)) + "." for k in range(30))
    return [None, "", " \t\n\x0b\x0c\r", "one", "one two three four", "one two three four five", "One TWO three four five", page, page, page.upper(), long, "\n\n a \n a \n A \n", "é́ 日本語\u00a0x\x1cy <|endoftext|> it's 3.5 don't",
            "x" * 40_000, "same same " * 50, "***|| ## $$", "<|startoftext|>a b", "ÀÉ ñandú!? straße,", "0 1 2 3 4 5 6 7 8 9"]


def edge_documents(spark):
    rows = [(i, t, "en" if i % 3 else None, None if i % 4 == 0 else f"s{i % 3}") for i, t in enumerate(edge_texts())]
    rows += [(None, "a text without an id", "de", "s1"), (None, None, None, None), (3, "one", "en", "s0"), (3, "one", "en", "s0"), (3, "another text of document three", "en", "s0")]
    return spark.createDataFrame([(i, t, g, s, None, 1, 2, "v", 3, "q") for i, t, g, s in rows], DOCUMENTS)


@pytest.fixture(scope="session")
def edge(spark):
    return edge_documents(spark)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture
def against_sql(spark, tmp_path):
    """Runs a registered query and its SQL over given tables and holds their rows against each other."""
    def run(name: str, **tables):
        for t, df in tables.items():
            df.coalesce(2).write.parquet(f"{tmp_path}/{t}.parquet")
        got = catalog.queries()[name](spark, str(tmp_path))
        db = duckdb.connect()
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        found = db.execute(catalog.oracles()[name])
        columns = [d[0] for d in found.description]
        assert sorted(got.columns) == sorted(columns)
        rows = [tuple(r) for r in got.select(columns).collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, found.fetchall()))
        return pd.DataFrame(rows, columns=columns)
    return run
