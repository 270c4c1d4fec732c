"""Ranked lexical search with block-max pruning.

Documents are taken in blocks of neighbours, as they lie in their table, so the
index needs no shuffle.  A block is one row of a written table: its forward
index (per document the sorted term hashes with their counts).  A query's bound
in a block is the sum over its terms of weight times the block's largest
impact of the term.  Tasks hold some blocks at a time, sort them by each
query's bound and score forward indexes from the best block on, until the bound
falls below the query's threshold: its tenth best score so far, and never less
than the tenth best of the block with the highest bound of all, which is scored
first.  A task gives out ten rows a query at most, so what is merged at the end
grows with tasks, not with documents.

Terms are known by 64-bit hashes.  All scores are exact 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm._store import Workspace, bounded_batches

#: ASCII that is neither letter nor digit parts terms; every byte of other characters belongs to one.
SEPARATORS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Documents of a block, and postings that close one before.
BLOCK, POSTINGS = 64, 1 << 16
#: Blocks that a task holds at a time.
HELD = 64
#: Rows that the Parquet reader takes at a time; its default of 4096 blocks would hold a whole file's postings on the heap.
SCANNED = 16
#: How the index is written: pages and row groups end by size after any block, where the default puts 100 blocks at least in a page.
PAGES = {"parquet.page.size": 1 << 18, "parquet.page.size.row.check.min": 1, "parquet.block.size": 8 << 20}
#: (query, term) pairs that one pass over the index serves; more queries take more passes over the index, none over the texts.
CHUNK = 1 << 20
_INDEX = "ids array<bigint>, n array<bigint>, starts array<int>, terms array<bigint>, tfs array<int>"
_HITS = "item int, doc_id bigint, score bigint"


def _postings(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct sorted term hashes, their counts) of each text with a term."""
    data, offsets = _text.buffers(texts)
    for i, j in _text.slabs(offsets):
        w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SEPARATORS)
        h = w.hashes().view(np.int64)
        order = np.lexsort((h, w.row))
        row, h = w.row[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        tf, row, h = np.diff(np.append(at, len(h))), row[at], h[at]
        bounds = np.searchsorted(row, np.arange(j - i + 1))
        for r in np.flatnonzero(np.diff(bounds)):
            yield i + int(r), h[bounds[r] : bounds[r + 1]], tf[bounds[r] : bounds[r + 1]]


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        starts = np.cumsum([0, *(len(h) for _, h, _ in held)])
        tfs = [t for _, _, t in held]
        values = ([i for i, _, _ in held], [int(t.sum()) for t in tfs], starts, np.concatenate([h for _, h, _ in held]), np.concatenate(tfs))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in zip(values, kinds)]
        return pa.record_batch(arrays, ["ids", "n", "starts", "terms", "tfs"])

    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for row, h, tf in _postings(batch.column("text")):
            held.append((ids[row], h, tf))
            size += len(h)
            if len(held) >= BLOCK or size >= POSTINGS:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def write_index(work: Workspace, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The forward index of `docs`, one written row (block, ids, n, starts, terms, tfs) a block; documents without terms are in none."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(_index_batches, _INDEX)
    with bounded_batches(work.spark, scanned=SCANNED):
        return work.write(rows.withColumn("block", F.monotonically_increasing_id()), "index", PAGES)


def _df_batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(term, documents) of the forward indexes; terms of some million postings are summed before they leave."""
    held: list[np.ndarray] = []
    size = 0

    def summed() -> pa.RecordBatch:
        terms, counts = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"term": pa.array(terms, pa.int64()), "df": pa.array(counts, pa.int64())})

    for batch in batches:
        held.append(batch.column("terms").values.to_numpy(zero_copy_only=False))
        size += len(held[-1])
        if size >= most:
            yield summed()
            held, size = [], 0
    if size:
        yield summed()


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("item_id").to_pylist()
        for row, h, _ in _postings(batch.column("text")):
            yield pa.record_batch({"item_id": pa.array([ids[row]] * len(h), pa.int64()), "term": pa.array(h, pa.int64())})


class Queries:
    """Some queries in arrays: the terms in order with their weights, and of each term the queries that hold it."""

    def __init__(self, ids: np.ndarray, item: np.ndarray, term: np.ndarray, weight: np.ndarray, documents: int, tokens: int):
        order = np.lexsort((item, term))
        self.ids, self.documents, self.tokens = ids, documents, tokens
        self.terms, at = np.unique(term[order], return_index=True)
        self.weights, self.ends, self.items = weight[order][at], np.append(at, len(term)), item[order]

    def matches(self, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the block's postings that some query asks for: document, term, weighted impact."""
        at = np.minimum(np.searchsorted(self.terms, b.terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == b.terms)
        tf, m = b.tfs[hit], 10 + (90 * b.n * self.documents) // self.tokens
        doc, term = b.doc[hit], at[hit]
        return doc, term, self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))

    def spread(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each of `term` (by place) with every query that holds it: positions in `term`, queries."""
        count = self.ends[term + 1] - self.ends[term]
        place = np.repeat(np.arange(len(term)), count)
        step = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        return place, self.items[self.ends[term][place] + step]

    def bounds(self, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """No document of a block with these matches scores more, by query."""
        top = np.zeros(len(self.terms), np.int64)
        np.maximum.at(top, term, value)
        there = np.flatnonzero(top)
        place, item = self.spread(there)
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, item, top[there][place])
        return out

    def scores(self, b: Block, found: tuple, wanted: np.ndarray) -> np.ndarray:
        """Documents x wanted queries."""
        doc, term, value = found
        column = np.full(len(self.ids), -1)
        column[wanted] = np.arange(len(wanted))
        place, item = self.spread(term)
        kept = column[item] >= 0
        place, item = place[kept], column[item[kept]]
        out = np.zeros(len(b.ids) * len(wanted), np.int64)
        np.add.at(out, doc[place] * len(wanted) + item, value[place])
        return out.reshape(len(b.ids), len(wanted))


class Block:
    """One row of the index."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        def of(name: str) -> pa.Array:
            return batch.column(name)[row].values

        self.ids = of("ids").to_pylist()
        self.n, self.terms, self.tfs = (of(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "terms", "tfs"))
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(of("starts").to_numpy(zero_copy_only=False)))


def _order(hit: tuple[int, int | None]) -> tuple:
    """Best first: high scores, then small ids, those without one last."""
    return -hit[0], hit[1] is None, hit[1] or 0


class Best:
    """The best `k` documents of each query so far, and the score that a further one must reach."""

    def __init__(self, k: int, least: np.ndarray):
        self.k, self.least, self.hits = k, np.maximum(least, 1), [[] for _ in least]

    def take(self, b: Block, wanted: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least[wanted]
        for j in np.flatnonzero(good.any(axis=0)):
            i = wanted[j]
            self.hits[i] = sorted(self.hits[i] + [(int(scores[d, j]), b.ids[d]) for d in np.flatnonzero(good[:, j])], key=_order)[: self.k]
            if len(self.hits[i]) == self.k:
                self.least[i] = max(self.least[i], self.hits[i][-1][0])

    def rows(self) -> pa.RecordBatch:
        rows = [(i, d, s) for i, hits in enumerate(self.hits) for s, d in hits]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        return pa.record_batch([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item", "doc_id", "score"])


def _top_bounds(queries) -> Callable:
    """Each query's block of the highest bound among a task's: item, bound, block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        best, where = np.zeros(len(q.ids), np.int64), np.zeros(len(q.ids), np.int64)
        for batch in batches:
            blocks = batch.column("block").to_pylist()
            for row in range(batch.num_rows):
                bound = q.bounds(*q.matches(Block(batch, row))[1:])
                better = bound > best
                best[better], where[better] = bound[better], blocks[row]
        there = np.flatnonzero(best)
        yield pa.record_batch({"item": pa.array(there, pa.int32()), "bound": pa.array(best[there], pa.int64()), "block": pa.array(where[there], pa.int64())})

    return run


def _seed_hits(queries, k: int) -> Callable:
    """Scores the blocks for just the queries listed beside each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q: Queries = queries.value
        best = Best(k, np.zeros(len(q.ids), np.int64))
        for batch in batches:
            for row in range(batch.num_rows):
                b, wanted = Block(batch, row), batch.column("items")[row].values.to_numpy(zero_copy_only=False).astype(np.int64)
                best.take(b, wanted, q.scores(b, q.matches(b), wanted))
        yield best.rows()

    return run


def _pruned_hits(queries, k: int) -> Callable:
    """The task's best `k` of each query: blocks in the order of each query's bound, until the bound is below its threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = queries.value
        best = Best(k, least)
        for batch in batches:
            blocks = [Block(batch, row) for row in range(batch.num_rows)]
            found = [q.matches(b) for b in blocks]
            bounds = np.array([q.bounds(*f[1:]) for f in found]).reshape(len(blocks), len(q.ids))
            order = np.argsort(-bounds, axis=0, kind="stable")
            active = np.arange(len(q.ids))
            for at in order:
                active = active[bounds[at[active], active] >= best.least[active]]
                if not len(active):
                    break
                for k_ in np.unique(at[active]):
                    wanted = active[at[active] == k_]
                    best.take(blocks[k_], wanted, q.scores(blocks[k_], found[k_], wanted))
        yield best.rows()

    return run


def _top(hits: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def _search_chunk(work: Workspace, index: DataFrame, part: DataFrame, documents: int, tokens: int, k: int, name: str) -> DataFrame:
    """Hits of one chunk of (item_id, term, weight): CHUNK rows by expectation, so they and a number a query pass the driver."""
    spark = work.spark
    rows = part.toArrow()
    ids = rows.column("item_id").unique()
    item = rows.column("item_id").combine_chunks().dictionary_encode(null_encoding="encode")
    ids, item = item.dictionary.to_pylist(), item.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    queries = Queries(np.arange(len(ids)), item, *(rows.column(c).to_numpy().astype(np.int64) for c in ("term", "weight")), documents, tokens)
    sent = spark.sparkContext.broadcast(queries)
    tops = index.mapInArrow(_top_bounds(sent), "item int, bound bigint, block bigint")
    seeds = tops.groupBy("item").agg(F.max(F.struct("bound", "block")).alias("top")).groupBy("top.block").agg(F.collect_list("item").alias("items"))
    # One row a query of the chunk at most, so the hint's size is bounded; the index stays where it is.
    seeded = index.join(F.broadcast(seeds), "block").mapInArrow(_seed_hits(sent, k), _HITS)
    least = np.zeros(len(ids), np.int64)
    for r in _top(seeded, k).where(F.col("rank") == k).select("item", "score").collect():
        least[r.item] = r.score
    ready = spark.sparkContext.broadcast((queries, least))
    names = spark.createDataFrame([(i, d) for i, d in enumerate(ids)], "item int, item_id bigint")
    # Merged before it is written: a few files of the best hits, not one of each task over the index.
    hits = index.mapInArrow(_pruned_hits(ready, k), _HITS)
    found = work.write(_top(hits, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), name)
    sent.unpersist()
    ready.unpersist()
    return found


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", chunk: int = 0) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` documents of the highest scores above 0, equal scores by ascending doc_id (null last).

    Terms are runs of ASCII letters and digits and of all other characters
    beyond ASCII, A-Z lower-cased.  With N documents that hold terms, L terms in
    all of them and df documents with a term, the term weighs
    floor(1000 ln((2N + 2) / (2df + 1))); a document of n terms that holds it
    tf times adds weight * (10^9 tf div (1000 tf + 8 m)) where
    m = 10 + 90 n N div L.

    Null and blank texts hold no term.  Items of one id, or of none, are one
    query of all their terms; an item without a term that occurs has no rows.
    Repeated documents count and rank one by one.  Other columns are not read.
    """
    work = Workspace(spark, "search")
    index = write_index(work, docs, doc_id, text)
    sizes = index.select(F.size("ids").alias("d"), F.aggregate("n", F.lit(0).cast("long"), lambda s, x: s + x).alias("t")).agg(F.sum("d").alias("d"), F.sum("t").alias("t")).first()
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not sizes.d:
        return empty
    with bounded_batches(spark, HELD, 64 << 20, SCANNED):
        wanted = work.write(items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).mapInArrow(_item_batches, "item_id bigint, term bigint").distinct(), "queries")
        df = index.select("terms").mapInArrow(_df_batches, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2.0 * sizes.d + 2) / (2 * F.col("df") + 1))).cast("long")
        pairs = work.write(wanted.join(df, "term").select("item_id", "term", weight.alias("weight")).hint("rebalance"), "weighted")
        parts = max(1, -(-pairs.count() // (chunk or CHUNK)))
        found = empty
        for i in range(parts):
            part = pairs if parts == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i)
            if not part.isEmpty():
                found = found.union(_search_chunk(work, index, part, sizes.d, sizes.t, k, f"hits-{i}"))
    return found
