import duckdb
import pandas as pd
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, size string, score string, __extra array<int>"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows, ties, columns with clashing names."""
    line = "the same line that many texts hold"
    rows = [
        (1, f"{line}\nown words of one text here", "en", "a", 1),
        (2, f"  {line.upper()}\t\nother words of a text there", "en", "a", 1),
        (3, f"{line}\n{line}\nthird", None, None, None),
        (4, None, "en", "b", 0),
        (5, "", None, "b", 0),
        (6, " \t\n ", "en", "b", 3),
        (7, "x", "en", None, 1),
        (8, "x", "en", None, 1),
        (8, "x", "en", None, 1),
        (None, f"{line}\nno id", "en", "c", 1),
        (9, "é中  . ,\r\n" * 3, "fr", "c", 1),
        (10, "word " * 30_000, "en", "d", 1),
        (11, "x" * 200_000, "en", "d", 1),
        (12, "12345 ... !!!", "en", "e", 1),
    ]
    return spark.createDataFrame([(*r, "l", "s", "c", [1]) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def rows():
    return lambda df: df.toPandas().astype(object).where(lambda x: pd.notna(x), None)
