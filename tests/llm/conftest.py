"""Small document tables with the awkward cases in them."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name string, rid long, block string, fp long, size long"


def table(spark, tmp_path, rows):
    """Write (doc_id, text, lang, source) rows with extra columns of clashing names; read them back."""
    path = str(tmp_path / f"documents{len(rows)}.parquet")
    full = [(*r, len(r[1] or ""), None, "x", 7, None, 1, 3) for r in rows]
    spark.createDataFrame(full, SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


LONG = " ".join(f"word{i % 977} and{i}" for i in range(30_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog", "en", "a"),
    (None, "the quick brown fox jumps over the lazy dog", None, None),
    (None, None, None, None),
    (3, None, "en", "b"),
    (4, "", "en", "b"),
    (5, " \t\n\r ", "fr", None),
    (6, LONG, "en", "c"),
    (7, LONG, "en", "c"),
    (8, LONG + " end", "en", "c"),
    (9, "one", "en", "a"),
    (10, "two words", "en", "a"),
    (11, "été \U0001f600 naïve <|endoftext|> x", "fr", "b"),
    (12, "y" * 25_000, "de", "d"),
]


@pytest.fixture
def odd(spark, tmp_path):
    return table(spark, tmp_path, ODD)


@pytest.fixture
def empty(spark, tmp_path):
    return table(spark, tmp_path, [])
