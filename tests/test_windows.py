"""Windows, samples, sessions and counters on hand-made rows."""

from __future__ import annotations

import os
import random

import pytest

from quillon.operators import joins, windows
from quillon.plans import QUERIES


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_saturating_counter_in_blocks(spark, block):
    r = random.Random(4)
    rows = [(k, i, r.random() < 0.55) for k in range(3) for i in range(20)]
    want = {}
    for k in range(3):
        v = 1
        for _, i, h in [x for x in rows if x[0] == k]:
            v = max(-2, min(5, v + (1 if h else -1)))
            want[k, i] = v
    got = windows.saturating_counter(spark.createDataFrame(rows, "k int, i bigint, hit boolean"), ["k"], "i", "hit", -2, 5, 1, block=block)
    assert {(x.k, x.i): x.keep_alive for x in got.collect()} == want


def test_sessions_split_only_above_the_threshold(spark):
    frames = [0, 2, 4, 9, 11, 20]  # median gap 2, threshold 5: a gap of 5 doesn't part, one of 9 does
    df = spark.createDataFrame([("c", f) for f in frames] + [("one", 5)], "cam string, frame bigint")
    got = {(r.cam, r.frame): r.run_index for r in windows.sessions(df, ["cam"], "frame", 2.5).collect()}
    assert [got["c", f] for f in frames] == [0, 0, 0, 0, 0, 1] and got["one", 5] == 0


@pytest.mark.parametrize(("n", "want"), [(2, []), (3, [0]), (4, [0, 1]), (7, [0, 2, 4]), (8, [0, 2, 4, 5])])
def test_fixed_windows_have_a_tail(spark, n, want):
    df = spark.createDataFrame([("k", i) for i in range(n)], "k string, i int")
    got = windows.fixed_windows(df, ["k"], ["i"], 3, 2).groupBy("window_start").count().collect()
    assert sorted(r.window_start for r in got) == want and all(r["count"] == 3 for r in got)


@pytest.mark.parametrize(("n", "k"), [(5, 1), (4, 4), (10, 4), (11, 5), (23, 20), (6, 4)])
def test_even_sample_rounds_half_to_even(spark, n, k):
    df = spark.createDataFrame([("k", i) for i in range(n)], "k string, i int")
    got = sorted(r.i for r in windows.even_sample(df, ["k"], ["i"], k).collect())
    assert got == (list(range(n)) if n <= k else [n // 2] if k == 1 else sorted({round(j * (n - 1) / (k - 1)) for j in range(k)}))


def test_global_rank_over_partitions(spark):
    df = spark.range(1000).selectExpr("id", "id % 17 AS s").repartition(5)
    got = [r["n"] for r in windows.rank_globally(df, ["s", "id"], "n").orderBy("s", "id").collect()]
    assert got == list(range(1, 1001))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the test tables")
def test_global_rank_with_other_columns(spark):
    """Several range partitions of rows with a column beyond the order's, against one window over all."""
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = QUERIES["rank_global_and_within"](spark, "/root/testdata/sf0.1").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    want = sorted(orders, key=lambda r: (-r.o_totalprice, r.o_orderkey))
    assert sorted((r.rank_global, r.o_orderkey) for r in got) == [(i + 1, r.o_orderkey) for i, r in enumerate(want)]


def test_as_of_ties(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 0, "y"), ("b", 5, "z")], "k string, t int, name string")
    right = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("a", 3, 9), ("a", 7, 4)], "k string, t int, v int")
    back = {r.name: r.v_backward for r in joins.as_of(left, right, ["k"], "t", "v").collect()}
    ahead = {r.name: r.v_forward for r in joins.as_of(left, right, ["k"], "t", "v", "forward").collect()}
    assert back == {"x": 2, "y": None, "z": None} and ahead == {"x": 2, "y": 9, "z": None}


def test_least_loaded(spark):
    df = spark.createDataFrame([("g", i, w) for i, w in enumerate([5, 1, 1, 1, 9])], "g string, i int, w int")
    got = {r.i: r.worker for r in windows.deal_least_loaded(df, ["g"], "i", "w", 2).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}
