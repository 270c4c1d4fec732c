"""Nearest rows in time, and running sums of large groups, against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, windows


@pytest.mark.parametrize("most", [None, 3.0])
def test_nearest_k(spark, most):
    r = random.Random(1)
    left = [(r.choice([1, 1, 1, 2, None]), r.choice([*range(12), None]), i % 5) for i in range(60)]
    right = [(r.choice([1, 1, 2, 3, None]), r.choice([*range(12), None]), i, "v") for i in range(40)]
    got = joins.nearest_k(spark.createDataFrame(left, "k int, at long, tag int"), spark.createDataFrame(right, "k int, when long, id int, tag2 string"), ["k"], "at", "when", "id", 3, most)
    want = []
    for k, at, tag in left:
        near = sorted((abs(at - w), w, i) for kk, w, i, _ in right if kk == k and w is not None) if k is not None and at is not None else []
        near = [n for n in near if most is None or n[0] <= most]
        want += [(k, at, tag, w, i, "v", n + 1) for n, (_, w, i) in enumerate(near[:3])]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_nearest_k_joins_no_key_with_itself(spark):
    """One key of many rows: candidates grow with the rows, not with their square."""
    n = 3000
    left, right = spark.range(n).selectExpr("1 AS k", "id * 2 AS at"), spark.range(n).selectExpr("1 AS k", "id * 2 + 1 AS when", "id AS i")
    out = joins.nearest_k(left, right, ["k"], "at", "when", "i", 2)
    assert out.count() == 2 * n
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "__q_down" in plan


def test_running_within(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), i, r.choice([1, 2, None])) for i in range(500)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = windows.running_within(df, ["g"], [F.desc("i")], {"n": F.lit(1).cast("long"), "s": F.coalesce(F.col("v"), F.lit(0)).cast("long")}).collect()
    want, sums = {}, {}
    for g, i, v in sorted(rows, key=lambda x: -x[1]):
        n, s = sums.get(g, (0, 0))
        sums[g] = want[g, i] = n + 1, s + (v or 0)
    assert {(x.g, x.i): (x.n, x.s) for x in got} == want and len(got) == 500
