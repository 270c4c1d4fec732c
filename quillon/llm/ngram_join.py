"""Exact Jaccard self-join of word-shingle sets, down to connected components.

1. A pass over all texts counts the shingles that are frequent within 4000
   documents; the at most FREQUENT most frequent ones go last in the order of
   shingles, all others stand in hash order.  Any order gives the same links.
2. Documents with equal sets (two 64-bit digests) are one node.  Two sets can
   only link if the first quarter of each in that order meets (of the smaller
   set the first seventh), so only those shingles are listed.
3. Nodes look at hubs, drawn for each list, of the lists they are in; what
   verifies merges components.  Lists within one component need no further
   pair, and of lists with the same members the first is enough.  While lists
   are left that are much longer than a tile, another round draws other hubs.
4. What is left is compared exhaustively: lists are cut into cells of
   neighbouring size bands and tiles of at most about TILE rows and LOAD
   shingles, and tiles meet in pairs, but for tiles of one component.  A pair
   counts in the first list that its sets share; positions in the lists and
   bitmap signatures bound the overlap from above (bits that differ are
   shingles in one set only).
5. The sets of the rows that still have a partner join them in their tile, where
   sorted arrays are intersected.  A tile gives out a forest: a pair whose
   components have met there needs no look, so there are fewer links than rows.

Shingles are known by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm import _text
from quillon.llm._components import components
from quillon.llm._store import Workspace, small_batches

#: A pair links if PERCENT of the union is shared.
PERCENT = 75
FREQUENT = 1 << 16
#: Rows of a tile, and shingles of all its sets (8 MB).
TILE, LOAD = 512, 1 << 20
#: Hubs drawn for each list, and hubs that a node looks at, in the first round; twice as many in each later one, which has fewer lists.
HUBS, SEEDS = 2, 4
#: Rounds of hubs at most, and so many tiles a list of the mean row asks for another.
ROUNDS, LONG = 3, 4
#: First lists of a node that tell in which list a pair counts.
HEADS = 8
#: Bits of the filter that lets only sets of candidate nodes through, at most (128 MB), and for each node.
FILTER_BITS, BITS_A_NODE = 1 << 30, 16


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    return _text.shingles(*_text.buffers(batch.column("text")))


def _digests(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        sums = np.stack([s * np.uint64(0x9DDFEA08EB382D69), _text.mix(s ^ np.uint64(0x2545F4914F6CDD1D))]).sum(1, dtype=np.uint64)
        a, b = _text.mix(sums + np.uint64(len(s))).view(np.int64).tolist()
        return a, b


def _width(n: int, times: int = 1) -> int:
    """Bits of the signature of n shingles: a power of two, at least n, 256 to 32768, `times` as wide."""
    return times * min(max(256, 1 << (n - 1).bit_length()), 1 << 15)


def _bitmap(s: np.ndarray, times: int = 1) -> bytes:
    """Bit k says whether an odd number of shingles falls on k; halves fold into each other by xor."""
    w = _width(len(s), times)
    odd = np.bincount((s & np.uint64(w - 1)).astype(np.int64), minlength=w) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n_held = [], 0

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= max(4, len(held) // 500)
        return pa.record_batch({"h": h[often].view(np.int64), "n": n[often].astype(np.int64)})

    for batch in batches:
        for _, s in _sets(batch):
            held.append(s)
            n_held += len(s)
            if len(held) >= 4000 or n_held >= 1 << 20:
                yield counted()
                held, n_held = [], 0
    if held:
        yield counted()


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of at most FREQUENT shingles, by count over all documents (where one is rare among 4000 documents it isn't counted)."""
    counts = docs.select("text").mapInArrow(_count_frequent, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.desc("n"), "h").limit(FREQUENT).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def _signed(frequent) -> object:
    """Per document its set's size, digests, bitmap and first shingles in order (hashes as signed numbers of the
    same order), `n_early` of which aren't frequent; bitmap and shingles only where the task sees a set first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, seen = frequent.value, set()
        for batch in batches:
            n, d1, d2, early = (np.zeros(batch.num_rows, np.int64) for _ in range(4))
            bits, firsts = [None] * batch.num_rows, [None] * batch.num_rows
            for row, s in _sets(batch):
                if not len(s):
                    continue
                n[row], (d1[row], d2[row]) = len(s), (d := _digests(s))
                if d in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(d)
                bits[row] = _bitmap(s)
                keep = len(s) - -(-PERCENT * len(s) // 100) + 1
                if len(late):
                    is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s, early[row] = np.concatenate([s[~is_late], s[is_late]]), len(s) - is_late.sum()
                else:
                    early[row] = len(s)
                firsts[row] = (s[:keep] ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "n": n, "d1": d1, "d2": d2, "n_early": early, "bits": pa.array(bits, pa.binary()), "first": pa.array(firsts, pa.list_(pa.int64()))})

    return run


_SIGNED = "doc_id bigint, text_hash bigint, n bigint, d1 bigint, d2 bigint, n_early bigint, bits binary, first array<bigint>"
_TILE_KEY = ("h", "cell", "ta", "tb")
_TILE_ROW = "h bigint, cell bigint, ta bigint, tb bigint, node bigint, label bigint, pos int, late boolean, n bigint, own boolean, tile bigint, n_early int, heads array<bigint>"


def _shared_before(heads: np.ndarray, late: np.ndarray, h: int, h_late: bool) -> np.ndarray:
    """`heads` (of one row each) with what doesn't stand before the list's shingle replaced by 0."""
    before = (late < h_late) | ((late == h_late) & (heads < h))
    return np.where(before & (heads != 0), heads, 0)


class Tiles:
    """Rows of whole tile pairs, in arrays."""

    def __init__(self, t: pa.Table):
        names = ("node", "label", "n", "own", "tile", "pos", "late", "n_early")
        self.node, self.label, self.n, self.own, self.tile, self.pos, self.late, self.early = (t.column(c).to_numpy() for c in names)
        self.key = np.stack([t.column(c).to_numpy() for c in _TILE_KEY], 1)
        heads = t.column("heads").combine_chunks()
        lengths = heads.value_lengths().to_numpy()
        self.heads = np.zeros((len(t), HEADS), np.int64)
        self.heads[np.arange(HEADS) < lengths[:, None]] = heads.flatten().to_numpy()

    def groups(self) -> list[tuple[int, int]]:
        """First row and end of each tile pair that holds several components."""
        starts = np.flatnonzero(np.concatenate([[True], (self.key[1:] != self.key[:-1]).any(1)])) if len(self.key) else np.zeros(0, int)
        return [(a, b) for a, b in zip(starts, [*starts[1:], len(self.key)]) if b - a > 1 and (self.label[a:b] != self.label[a]).any()]

    def partners(self, a: int, b: int, bits: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
        """For each row of the tile pair [a, b), counted from a, the later rows that count here and that the bounds don't rule out."""
        at = slice(a, b)
        maps = [np.frombuffer(x, np.uint64) for x in bits]
        width = np.array([len(m) for m in maps])
        # Of each width the signatures that are at least as wide, folded to it.
        folded = {w: np.stack([np.bitwise_xor.reduce(m.reshape(-1, w), 0) if len(m) >= w else np.zeros(w, np.uint64) for m in maps]) for w in np.unique(width)}
        size, label, own, tile, left = self.n[at], self.label[at], self.own[at], self.tile[at], (self.n - self.pos)[at]
        heads = _shared_before(self.heads[at], np.arange(HEADS) >= self.early[at, None], self.key[a, 0], self.late[a])
        shallow = self.pos[at] < shallow_length(size)
        for i in range(b - a - 1):
            j = slice(i + 1, b - a)
            ok = (label[j] != label[i]) & (own[j] | own[i])
            if self.key[a, 2] != self.key[a, 3]:
                ok &= tile[j] != tile[i]
            both = size[j] + size[i]
            ok &= 100 * np.minimum(size[j], size[i]) >= PERCENT * np.maximum(size[j], size[i])
            ok &= (100 + PERCENT) * np.minimum(left[j], left[i]) >= PERCENT * both
            ok &= np.where(size[j] < size[i], shallow[j], np.where(size[j] > size[i], shallow[i], shallow[i] & shallow[j]))
            at_i = np.flatnonzero(ok)
            mine = heads[i][heads[i] != 0]
            if len(mine) and len(at_i):
                at_i = at_i[~np.isin(heads[j][at_i], mine).any(1)]
            if not len(at_i):
                continue
            common = np.minimum(width[j][at_i], width[i])
            kept = []
            for w in np.unique(common):
                some = at_i[common == w]
                apart = np.bitwise_count(folded[w][j][some] ^ folded[w][i]).sum(1, dtype=np.int64)
                kept.append(some[(100 + PERCENT) * apart <= (100 - PERCENT) * both[some]])
            found = np.concatenate(kept) + i + 1
            if len(found):
                yield i, found


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by tile pair, cut where one ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in _TILE_KEY], 1)
        open_ = int(np.flatnonzero((key == key[-1]).all(1))[0])
        if held and (open_ or (key[0] != last).any()):
            yield pa.Table.from_batches([*held, batch.slice(0, open_)]).combine_chunks()
            held = []
        elif open_:
            yield pa.Table.from_batches([batch.slice(0, open_)]).combine_chunks()
        held.append(batch.slice(open_))
        last = key[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tile_survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows, without their bitmaps, that have a partner in their tile pair which the bounds don't rule out."""
    for t in _whole_tiles(batches):
        tiles, bits, keep = Tiles(t), t.column("bits").to_pylist(), np.zeros(len(t), bool)
        for a, b in tiles.groups():
            for i, found in tiles.partners(a, b, bits[a:b]):
                keep[a + i] = True
                keep[a + found] = True
        yield from t.drop_columns(["bits"]).filter(pa.array(keep)).to_batches()


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct shingles are as similar as asked for."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return (100 + PERCENT) * shared >= PERCENT * (len(x) + len(y))


def _tile_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each tile pair the links (a, b) of nodes that join its components: a forest."""
    for t in _whole_tiles(batches):
        tiles, links = Tiles(t), []
        lists = t.column("shingles").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for a, b in tiles.groups():
            sets = [values[ends[k] : ends[k + 1]] for k in range(a, b)]
            part = tiles.label[a:b].copy()
            for i, found in tiles.partners(a, b, [_bitmap(s, 4) for s in sets]):
                for j in found:
                    if part[i] != part[j] and linked(sets[i], sets[j]):
                        part[part == part[j]] = part[i]
                        links.append((tiles.node[a + i], tiles.node[a + j]))
        x, y = np.array(links, np.int64).reshape(-1, 2).T
        yield pa.record_batch({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def shallow_length(n):
    """How many first shingles of a set of n can be the first that it shares with a set at least as large: the
    overlap must reach PERCENT / (100 + PERCENT) of both sizes, so 2 PERCENT / (100 + PERCENT) of the smaller."""
    return n + (-2 * PERCENT * n) // (100 + PERCENT) + 1


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with both sizes and bitmaps that the bounds don't rule out."""
    for batch in batches:
        keep = np.zeros(batch.num_rows, bool)
        na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
        for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
            if 100 * min(na[i], nb[i]) >= PERCENT * max(na[i], nb[i]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                w = min(len(p), len(q))
                apart = int(np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, w), 0) ^ np.bitwise_xor.reduce(q.reshape(-1, w), 0)).sum())
                keep[i] = (100 + PERCENT) * apart <= (100 - PERCENT) * (na[i] + nb[i])
        yield batch.filter(pa.array(keep)).select(["a", "b"])


def _passing(bitmap, n_bits: int) -> object:
    """(d1, d2, shingles) of the texts whose hash the filter lets through, once per task; only those are cut into shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = bitmap.value, set()
        for batch in batches:
            at = batch.column("text_hash").to_numpy() % n_bits
            part = batch.filter(pa.array((wanted[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            digests, sets = [], []
            for _, s in _sets(part):
                d = _digests(s)
                if not len(s) or d in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(d)
                digests.append(d)
                sets.append(s.view(np.int64))
            lengths = np.cumsum([0, *map(len, sets)])
            d1, d2 = np.array(digests, np.int64).reshape(-1, 2).T
            yield pa.record_batch({"d1": d1, "d2": d2, "shingles": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))})

    return run


def _shingle_sets(work: Workspace, docs: DataFrame, nodes: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """(node, shingles: sorted) of the `wanted` nodes, cut anew from the texts."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    keys = work.write(nodes.join(wanted, "node", "left_semi").select("node", "d1", "d2", "text_hash").observe(seen, F.count("*").alias("n")), name)
    n_bits = min(max(1 << 16, 1 << (BITS_A_NODE * seen.get["n"]).bit_length()), FILTER_BITS)
    at = F.pmod("text_hash", F.lit(n_bits))
    filled = np.zeros(n_bits // 8, np.uint8)
    # At most FILTER_BITS / 32768 rows of 4 KB, however many nodes there are.
    marks = keys.groupBy(F.bitmap_bucket_number(at + 1).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at + 1)))
    for bucket, bits in marks.collect():
        filled[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    sets = docs.select("text_hash", "text").mapInArrow(_passing(docs.sparkSession.sparkContext.broadcast(filled), n_bits), "d1 bigint, d2 bigint, shingles array<bigint>")
    return sets.join(keys.drop("text_hash"), ["d1", "d2"]).select("node", "shingles").dropDuplicates(["node"])


def _linked_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sorted sets x and y are as similar as asked for."""
    for batch in batches:
        x, y = ([v.values.to_numpy().view(np.uint64) for v in batch.column(c)] for c in "xy")
        yield batch.filter(pa.array([linked(*s) for s in zip(x, y)], pa.bool_())).select(["a", "b"])


def _verified(work: Workspace, docs: DataFrame, nodes: DataFrame, pairs: DataFrame, turn: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those whose sets are as similar as asked for."""
    sets = _shingle_sets(work, docs, nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), f"seeded{turn}")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(_linked_pairs, "a bigint, b bigint")


def _hub_pairs(work: Workspace, rows: DataFrame, nodes: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of a node and a hub of another label: of each list a few members of smallest hash in this turn are
    hubs, and a node looks at those hubs that most of its lists name; the bitmaps rule out some."""
    n_hubs, n_seeds = (HUBS, SEEDS) if not turn else (2 * HUBS, 2 * SEEDS)
    # Written, so that a hot list's join with its hubs is one that adaptive execution can split.
    hubs = work.write(rows.groupBy("h").agg(*[F.min(F.struct(F.xxhash64(F.lit(turn), F.lit(k), "node").alias("o"), "node", "label")).alias(f"hub{k}") for k in range(n_hubs)]), f"hubs{turn}")
    seen = rows.join(hubs, "h").select("node", "label", F.explode(F.array(*[f"hub{k}" for k in range(n_hubs)])).alias("hub")).where("hub.label <> label")
    votes = seen.groupBy("node", F.col("hub.node").alias("hub")).agg(F.count("*").alias("votes"))
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("votes"), "hub"))
    seeds = votes.withColumn("k", best).where(F.col("k") <= n_seeds).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    sides = {s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"}
    bounded = seeds.join(sides["b"], "b").join(sides["a"], "a").select("a", "b", "na", "nb", "bits_a", "bits_b").mapInArrow(_bounded, "a bigint, b bigint")
    return work.write(bounded, f"seeds{turn}")


def _merged(work: Workspace, labels: DataFrame | None, links: DataFrame, turn: str) -> DataFrame:
    """(node, label) of all nodes that have ever linked, after these links of nodes."""
    if labels is None:
        return work.write(components(work, links, f"cc{turn}").withColumnRenamed("component", "label"), f"labels{turn}")
    side = {s: labels.select(F.col("node").alias(s), F.col("label").alias(f"l{s}")) for s in "ab"}
    edges = links.join(side["a"], "a", "left").join(side["b"], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    tops = components(work, edges, f"cc{turn}").select(F.col("node").alias("label"), F.col("component").alias("top"))
    old = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    fresh = tops.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels.select("node"), "node", "left_anti")
    return work.write(old.union(fresh), f"labels{turn}")


def _open_lists(work: Workspace, rows: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, bool]:
    """`rows` with new labels, of the lists that still hold several; of lists of the same nodes (known by two hashes)
    the first in the order of shingles, as that is where their pairs count.  And whether lists are long for tiles."""
    labelled = rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lists = labelled.groupBy("h").agg(F.first("late").alias("late"), F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("size"), F.sum("n").alias("load"), F.bit_xor(F.xxhash64("node")).alias("n1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("n2"))
    lists = lists.where("x <> y").groupBy("size", "n1", "n2").agg(F.min(F.struct("late", "h", "load")).alias("first")).select("first.h", "size", "first.load")
    seen = Observation(f"open-{uuid.uuid4().hex[:8]}")
    open_ = work.write(labelled.drop("size", "load").join(lists, "h").observe(seen, F.count("*").alias("n"), F.sum("size").alias("size")), f"open{turn}")
    return open_, (seen.get["size"] or 0) > LONG * TILE * seen.get["n"]


def jaccard_components(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row of `docs`.

    Two documents link when they share PERCENT or more of the union of their
    five-word shingles.  A null or blank text has an empty set and links with
    nothing, so its component is its own id.  Rows with equal texts are one
    node and in one component; rows that repeat an id each give a row.  A null
    id is never a component's name unless it has no other.  Other columns of
    `docs` are not read.
    """
    return _components(spark, docs, doc_id, text)


def _components(spark: SparkSession, docs: DataFrame, doc_id: str, text: str, *more: str) -> DataFrame:
    """What jaccard_components returns; with "text_hash" in `more` also the hash of each row's text."""
    work = Workspace(spark, "ngrams")
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs))
    full = work.write(docs.mapInArrow(_signed(frequent), _SIGNED), "full")
    listed = work.write(full.where("first IS NOT NULL").drop("doc_id").dropDuplicates(["d1", "d2"]).withColumn("node", F.monotonically_increasing_id()), "listed")
    signed = work.write(full.select("doc_id", "n", "d1", "d2", *more), "signed")
    nodes = work.write(listed.select("node", "d1", "d2", "text_hash", "n", "bits"), "nodes")
    work.drop("full")

    rows = listed.select("node", "n", "n_early", F.posexplode("first").alias("pos", "h"))
    rows = rows.select("h", "node", "n", "pos", (F.col("pos") >= F.col("n_early")).alias("late"), (F.col("pos") < shallow_length_column(F.col("n"))).alias("shallow"))
    # A node lists a shingle once, so rows are nodes.
    shared = rows.groupBy("h").agg(F.count("*").alias("nodes"), F.bool_or("shallow").alias("any")).where("nodes > 1 AND any").select("h")
    rows = work.write(rows.drop("shallow").join(shared, "h", "left_semi").withColumns({"label": F.col("node"), "size": F.lit(0).cast("long"), "load": F.lit(0).cast("long")}), "live")
    work.drop("listed")

    labels, turn, again = None, 0, True
    while again and turn < ROUNDS:
        links = work.write(_verified(work, docs, nodes, _hub_pairs(work, rows, nodes, turn), turn), f"links{turn}")
        labels = _merged(work, labels, links, str(turn))
        rows, again = _open_lists(work, rows, labels, turn)
        work.drop(f"seeds{turn}", f"seeded{turn}", f"hubs{turn}", "live" if not turn else f"open{turn - 1}", f"labels{turn - 1}")
        turn += 1
    survivors = work.write(_placed(rows, nodes).mapInArrow(_tile_survivors, _TILE_ROW), "survivors")
    sets = _shingle_sets(work, docs, nodes, survivors.select("node").distinct(), "compared")
    links = _dealt(survivors.join(sets, "node").select(*survivors.columns, "shingles")).mapInArrow(_tile_links, "a bigint, b bigint")
    labels = _merged(work, labels, work.write(links, "links"), "last")

    by_set = labels.join(nodes.select("node", "d1", "d2"), "node").select("d1", "d2", "label")
    result = signed.join(by_set, ["d1", "d2"], "left").select("doc_id", "n", F.coalesce("label", "d1").alias("top"), F.when(F.col("label").isNull(), F.col("d2")).alias("top2"), *more)
    result = work.write(result, "topped")
    least = work.write(result.where("n > 0").groupBy("top", "top2").agg(F.min("doc_id").alias("least")), "least").select(F.col("top").alias("t"), F.col("top2").alias("t2"), "least")
    result = result.join(least, (F.col("top") == F.col("t")) & F.col("top2").eqNullSafe(F.col("t2")) & (F.col("n") > 0), "left")
    return result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def shallow_length_column(n: Column) -> Column:
    return n - F.ceil(n * (2 * PERCENT) / (100 + PERCENT)) + 1


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)


def _placed(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of open lists in their tile pairs, with bitmaps and the first open lists of each node.

    A list that fits into one tile is one cell.  Else a node stands in its own
    band's cell and as a guest in the next one's.  A component of more than
    a tile in a cell has tiles of its own, and no two of these meet; all
    others share tiles.
    """
    rows = open_.withColumn("band", F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT))))
    fits = (F.col("size") <= TILE) & (F.col("load") <= LOAD)
    zero = F.lit(0).cast("long")
    small = rows.where(fits).select("h", F.lit(-1).cast("long").alias("cell"), zero.alias("ta"), zero.alias("tb"), "node", "label", "pos", "late", F.lit(True).alias("own"), zero.alias("tile"))
    large = rows.where(~fits).withColumn("cell", F.explode(F.array("band", F.col("band") + 1))).withColumn("own", F.col("band") == F.col("cell"))
    tiles = F.count("*") / TILE + F.sum("n") / LOAD
    group = F.when(F.col("c") > 1, F.col("label"))
    counts = large.groupBy("h", "cell", "label").agg(tiles.alias("c")).groupBy("h", "cell", group.alias("g")).agg(F.ceil(F.sum("c")).alias("tiles"))
    # At most one entry per tile of the cell.
    cells = counts.groupBy("h", "cell").agg(F.array_sort(F.collect_list(F.struct("g", "tiles"))).alias("groups"))
    before = F.transform("groups", lambda _, i: F.aggregate(F.slice("groups", F.lit(1), i), zero, lambda s, x: s + x["tiles"]))
    cells = cells.withColumn("groups", F.zip_with("groups", before, lambda x, b: F.struct(x["g"].alias("g"), x["tiles"].alias("tiles"), b.alias("before"))))
    placed = large.join(cells, ["h", "cell"])
    mine = F.filter("groups", lambda x: x["g"] == F.col("label"))
    placed = placed.withColumn("mine", F.when(F.size(mine) > 0, F.get(mine, 0)).otherwise(F.get(F.filter("groups", lambda x: x["g"].isNull()), 0)))
    placed = placed.withColumn("tile", F.col("mine.before") + F.pmod(F.xxhash64("node"), F.col("mine.tiles")))
    met = F.filter("groups", lambda x: F.col("mine.g").isNull() | ~x["g"].eqNullSafe(F.col("mine.g")))
    placed = placed.withColumn("other", F.explode(F.flatten(F.transform(met, lambda x: F.sequence(x["before"], x["before"] + x["tiles"] - 1)))))
    large = placed.select("h", "cell", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "node", "label", "pos", "late", "own", "tile")
    # The signatures come last, so they move once.
    first = F.slice(F.array_sort(F.collect_list(F.struct("late", "h"))), 1, HEADS)
    heads = open_.groupBy("node").agg(first.alias("first")).select("node", F.size(F.filter("first", lambda x: ~x["late"])).alias("n_early"), F.col("first.h").alias("heads"))
    rows = small.union(large).join(nodes.select("node", "n", "bits").join(heads, "node"), "node")
    return _dealt(rows.select(*_TILE_KEY, "node", "label", "pos", "late", "n", "own", "tile", "n_early", "heads", "bits"))


def keep_first(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that lead their component (the smallest id); those without words all stay.

    Of rows that repeat an id and a component all stay.  A row is known by its
    id and the hash of its text, so that rows that repeat an id but not the text
    are judged each by its own component.
    """
    led = _components(spark, docs, doc_id, text, "text_hash").where("n_shingles > 0 AND NOT component_id <=> doc_id")
    gone = Workspace(spark, "near-copies").write(led.select(F.col("doc_id").alias("__q_gone"), F.col("text_hash").alias("__q_hash")).distinct(), "gone")
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__q_gone")) & (F.xxhash64(text) == F.col("__q_hash")), "left_anti")
