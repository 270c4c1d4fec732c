from __future__ import annotations

import pytest
from conftest_words import words

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """doc_id, text, lang, source, n_chars, host: nulls, ties, empty and very long texts, repeated rows and ids, near copies; host clashes with a name of the URL filter."""
    base = words(1, 200)
    near = [*base[:100], "changed", *base[101:]]
    far = [*base[:100], *words(2, 100)]
    texts = [" ".join(base), " ".join(near), " ".join(far), None, "", " \t\n ", "a b c", "A b  C", LONG, "one two three four five", "one two three four five six"]
    out = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], 7, "h") for i, t in enumerate(texts)]
    out += [(0, " ".join(base), "en", "s1", 7, "h"), (3, None, None, None, None, None), (None, " ".join(near), "en", "s2", 7, None), (None, None, None, None, None, None), (12, " ".join(base).upper(), "en", "s2", 7, "h")]
    return out


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string"


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
