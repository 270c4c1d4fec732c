"""Structural summaries of nested documents: which paths there are, of which kinds, how often and how large."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Paths and kinds that a task holds before it gives out what it has counted; documents with data for keys have many.
HELD = 1 << 16
_SKETCH = "path string, kind string, n bigint, least bigint, most bigint, total bigint"


def _kind(v) -> tuple[str, int | None]:
    """A value's kind and, for what has one, its size: members, keys or characters."""
    if isinstance(v, dict):
        return "object", len(v)
    if isinstance(v, list):
        return "array", len(v)
    if isinstance(v, str):
        return "text", len(v)
    if v is None:
        return "null", None
    return ("boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number"), None


def _walk(document) -> Iterator[tuple[str, str, int | None]]:
    """path, kind and size of every value, without recursion, so that no depth is too much."""
    ahead = [("$", document)]
    while ahead:
        path, v = ahead.pop()
        yield path, *_kind(v)
        if isinstance(v, dict):
            ahead += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            ahead += [(f"{path}[]", x) for x in v]


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, str], list] = {}

    def given() -> pa.RecordBatch:
        rows = [(*k, *v) for k, v in seen.items()]
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), *[pa.int64()] * 4))], ["path", "kind", "n", "least", "most", "total"])

    for batch in batches:
        for text in batch.column("document").to_pylist():
            try:
                found = [("$", "missing", None)] if text is None else _walk(json.loads(text))
            except (ValueError, RecursionError):
                found = [("$", "invalid", None)]
            for path, kind, size in found:
                s = seen.setdefault((path, kind), [0, None, None, None])
                s[0] += 1
                if size is not None:
                    s[1], s[2], s[3] = (size, size, size) if s[1] is None else (min(s[1], size), max(s[2], size), s[3] + size)
        if len(seen) > HELD:
            yield given()
            seen.clear()
    yield given()


def sketch(documents: DataFrame, column: str) -> DataFrame:
    """path, kind, n, least, most, total of the values of JSON documents, one pass over any number of them.

    Members of lists share a path, `$.turns[].role`.  least, most and total are
    of sizes: members of lists, keys of objects, characters of texts.  A null
    document is of kind missing, a text that is no document invalid.  Sketches of
    parts, put together by `merged`, are the sketch of the whole.
    """
    return merged(documents.select(F.col(column).cast("string").alias("document")).mapInArrow(_sketched, _SKETCH))


def merged(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("path", "kind").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))


def summary(sketches: DataFrame) -> DataFrame:
    """path, kinds (in order), n, null_share, present_share (of the values that could have it), mean_size."""
    whole = sketches.groupBy("path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"), F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("kind") == "null", F.col("n"))), F.lit(0)).alias("nulls"),
        F.sum("total").alias("total"), F.sum(F.when(F.col("total").isNotNull(), F.col("n"))).alias("sized"), F.sum(F.when(F.col("kind") == "object", F.col("n"))).alias("objects"),
    )
    # A key's values come from the objects of the path before it; of a list's members there are as many as there are.
    parent = F.when(F.col("path").endswith("[]"), None).otherwise(F.regexp_extract("path", r"^(.*)\.[^.]*\z", 1))
    holders = whole.select(F.col("path").alias("__q_parent"), F.col("objects").alias("__q_objects"))
    out = whole.withColumn("__q_up", parent).join(holders, F.col("__q_up") == F.col("__q_parent"), "left")
    return out.select("path", "kinds", "n", (F.col("nulls") / F.col("n")).alias("null_share"), (F.col("n") / F.col("__q_objects")).alias("present_share"), (F.col("total") / F.col("sized")).alias("mean_size"))
