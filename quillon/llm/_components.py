"""Connected components by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillon.llm._store import Workspace


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _written(work: Workspace, edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges, written, and what tells one state from another, counted as they are written."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    edges = work.write(edges.observe(seen, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")), name)
    return edges, (seen.get["n"], seen.get["x"])


def components(work: Workspace, links: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node in `links` (a, b: bigint); a component is named by its smallest node.

    Every round's edges are written, so lost executors cost no more than a
    round.  A hub's edges are dealt by the other end after each star, and the
    join on a hub is one that adaptive execution can split.
    """
    edges, state = _written(work, links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    turn = 0
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _linked_to_least(large)
        small = star.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(star.select("u", F.col("m").alias("v"))).distinct()
        turn += 1
        edges, now = _written(work, small, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
