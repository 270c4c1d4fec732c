"""The registered training-data queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from quillon.llm import queries as llm

AT = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(AT), reason="needs the test tables")


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(llm.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    rel = con.execute(llm.ORACLE_SQL[name])
    names = sorted(d[0] for d in rel.description)
    want = Counter(tuple(plain(dict(zip([d[0] for d in rel.description], r))[c]) for c in names) for r in rel.fetchall())
    got = llm.QUERIES[name](spark, AT)
    assert set(names) <= set(got.columns)
    assert Counter(tuple(plain(r[c]) for c in names) for r in got.collect()) == want


CLASHING = "doc_id bigint, text string, lang string, source string, n_chars bigint, size bigint, target string, copies int, Source_Size string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, f"some words of document {i} that are all its own " * 3 + str(i * 7919), "en", ["s", "t", None][i % 3], 9, -7, "mine", None, "kept") for i in range(30)]
    rows += [(30, None, None, None, None, 1, None, None, None), (31, "", "en", "s", 0, 2, "x", 3, ""), (None, "one more text without an id", "en", "t", 5, 3, "y", 1, "z"), rows[0]]
    return spark.createDataFrame(rows, CLASHING)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_rows(spark, clashing, name):
    """Clean documents stay with all their own columns, null and empty ones too; a mix gives whole copies."""
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, AT)
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    came, left = Counter(map(tuple, clashing.collect())), Counter(map(tuple, out.collect()))
    assert left.keys() <= came.keys()
    if name in ("toxicity", "decontamination"):
        assert left == came
    if name == "ngram_jaccard_join":
        assert left.keys() == came.keys()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_an_empty_table(spark, clashing, name):
    assert dict(corpus_pipeline.STAGES)[name](spark, clashing.limit(0), AT).count() == 0


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, AT).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert rows and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
