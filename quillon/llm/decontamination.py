"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is short and a document long, so their Jaccard similarity says
little; what is searched is containment.  One random order of shingles gives
both sides MinHash values.  Items are partitioned by size, and an item of n
shingles keeps its floor(n/4) + 1 smallest values: a document that contains 75 %
of the item contains at least one of them, so the search misses nothing.  Of a
document only the values up to a partition's largest kept one are looked up
there, in the sorted values of all its items at once, so a document's cost
follows its own length (times the logarithm of the items).  What meets is
verified by intersecting the sorted shingles of item and document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm._store import small_batches

PERCENT = 75
#: Shingles of items that one broadcast holds (some 50 MB of hashes at most); more items are searched in several blocks.
BLOCK = 1 << 22
_PAIRS = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint, containment double"


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, sets = batch.column("item_id").to_pylist(), [], []
        rows = [(ids[row], len(s), s.view(np.int64)) for row, s in _text.shingles(*_text.buffers(batch.column("text"))) if len(s)]
        ids, n, sets = zip(*rows) if rows else ((), (), ())
        yield pa.record_batch({"item_id": pa.array(ids, pa.int64()), "n": pa.array(n, pa.int64()), "shingles": pa.array(list(sets), pa.list_(pa.int64()))})


@dataclass
class Partition:
    """Items of like size: the shingles that the smallest needs, the distinct sketch values in order, and of each its items."""

    least: int
    values: np.ndarray
    ends: np.ndarray
    owners: np.ndarray


class Block:
    """Some items in arrays: their sketches by size partition and their sorted shingle sets."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.n = np.array([len(s) for _, s in items], np.int64)
        self.need = -(-PERCENT * self.n // 100)
        self.shingles, self.at = np.concatenate([s for _, s in items]), np.concatenate([[0], np.cumsum(self.n)])
        keep = self.n - self.need + 1
        band = np.log2(self.n).astype(int)
        self.partitions = []
        for b in np.unique(band):
            of = np.flatnonzero(band == b)
            sketch = np.concatenate([np.sort(_text.mix(items[i][1]))[: keep[i]] for i in of])
            order = np.argsort(sketch, kind="stable")
            values, counts = np.unique(sketch, return_counts=True)
            self.partitions.append(Partition(int(self.need[of].min()), values, np.concatenate([[0], np.cumsum(counts)]), np.repeat(of, keep[of])[order]))

    def candidates(self, s: np.ndarray) -> list[int]:
        """Items whose sketch meets the document of shingles `s`."""
        found: set[int] = set()
        mixed = np.sort(_text.mix(s))
        for p in self.partitions:
            if len(s) >= p.least:
                low = mixed[: np.searchsorted(mixed, p.values[-1], "right")]
                at = np.searchsorted(p.values, low)
                for k in at[p.values[at] == low]:
                    found.update(p.owners[p.ends[k] : p.ends[k + 1]].tolist())
        return sorted(found)

    def search(self, s: np.ndarray) -> dict[int, int]:
        """Items found in the document of shingles `s`, with the shingles shared."""
        out = {}
        for i in self.candidates(s):
            item = self.shingles[self.at[i] : self.at[i + 1]]
            shared = int((s[np.minimum(np.searchsorted(s, item), len(s) - 1)] == item).sum())
            if shared >= self.need[i]:
                out[i] = shared
        return out


def _matches(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            ids, rows = batch.column("doc_id"), []
            for row, s in _text.shingles(*_text.buffers(batch.column("text"))):
                if len(s):
                    rows += [(ids[row].as_py(), b.ids[i], int(b.n[i]), n, n / int(b.n[i])) for i, n in b.search(s).items()]
            columns = zip(*rows) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", most: int = 0) -> Iterator[Block]:
    """The items in blocks of about `most` shingles, one partition after the other, so the driver holds one block at a time."""
    rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).mapInArrow(_item_rows, "item_id bigint, n bigint, shingles array<bigint>")
    small_batches(items.sparkSession)
    held, size = [], 0
    for r in rows.toLocalIterator():
        held.append((r.item_id, np.array(r.shingles, np.int64).view(np.uint64)))
        size += r.n
        if size >= (most or BLOCK):
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of each pair where the
    document contains PERCENT or more of the item's five-word shingles.

    The items are the query set: blocks of bounded size against all documents,
    one pass over the texts a block.  Null and blank texts or items match
    nothing; an item of fewer than five words is one shingle and matches only a
    document of just these words.  Repeated rows give repeated pairs.  Other
    columns are not read.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = None
    for block in blocks(items, item_id, item_text):
        part = source.mapInArrow(_matches(spark.sparkContext.broadcast(block)), _PAIRS)
        found = part if found is None else found.union(part)
    return spark.createDataFrame([], _PAIRS) if found is None else found


def _clean(block) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, s in _text.shingles(*_text.buffers(batch.column("text"))):
                keep[row] = not (len(s) and b.search(s))
            yield batch.filter(pa.array(keep))

    return run


def drop_contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of `docs` (with a column text) that contain no item; no row moves."""
    for block in blocks(items):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(block)), docs.schema)
    return docs
