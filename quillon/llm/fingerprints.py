"""Document fingerprints: Order MinHash.

Every k-mer of a text's UTF-8 bytes is numbered by its occurrences.  Each of
SLOTS hash orders selects the TUPLE smallest numbered k-mers, which keep their
order in the text and are hashed together.  Equal slots of two fingerprints
estimate a similarity that, unlike Jaccard's, falls when parts change places,
and so follows the edit distance.

The orders are shifts of one random order on a ring: order j starts at point j
of the ring, so its smallest k-mers are the next ones clockwise.  One sort of a
text serves all SLOTS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm._store import small_batches

K, SLOTS, TUPLE = 8, 64, 2
_POINTS = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 64, SLOTS, np.uint64)
_ODD = np.array([pow(0xB492B66FBE98F273, K - k, 1 << 64) for k in range(K)], np.uint64)


def fingerprint(text: bytes) -> np.ndarray:
    """SLOTS 32-bit values; a text shorter than K bytes is one k-mer, an empty one none."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    if not len(data):
        return np.zeros(SLOTS, np.uint32)
    with np.errstate(over="ignore"):
        if len(data) >= K:
            kmers = _text.mix(sum(((data[k : len(data) - K + 1 + k] + np.uint64(1)) * _ODD[k] for k in range(K)), np.uint64(0)))
        else:
            kmers = _text.mix(((data + np.uint64(1)) * _ODD[: len(data)]).sum(keepdims=True))
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        occurrence = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        numbered = np.where(occurrence == 0, ranked, _text.mix(ranked + occurrence.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
        if not new.all():
            again = np.argsort(numbered, kind="stable")
            numbered, order = numbered[again], order[again]
        first = np.searchsorted(numbered, _POINTS)
        chosen = np.sort(order[(first[:, None] + np.arange(min(TUPLE, len(order)))) % len(order)], 1)
        h = np.zeros(SLOTS, np.uint64)
        for column in chosen.T:
            h = _text.mix(h * np.uint64(0x9E3779B97F4A7C15) + kmers[column])
    return (h >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float((a == b).mean())


def _key(doc_id: Column) -> Column:
    """Sorts null ids below all others."""
    return F.coalesce(doc_id, F.lit(-(1 << 63)).cast("long"))


def neighbour_buckets(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """bucket, key, doc_id, text, guest: the texts cut into runs of descending ids.

    A run's last text needs the first of the run below it (of the highest run,
    for the lowest), so the rows of that id stand there too, as guests.  Only
    ids are read to place the cuts, and at most `buckets` of them come to the
    driver.
    """
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", _key(F.col("doc_id")))
    cuts = keyed.agg(F.percentile_approx("key", [i / buckets for i in range(1, buckets)], 10_000).alias("c"), F.max("key").alias("high")).first()
    cuts, high = sorted({c for c in (cuts.c or []) if c < cuts.high}), cuts.high
    # Run i holds the ids in (cut i - 1, cut i]; its highest id is a cut or the highest of all.
    run = _position("key", cuts)
    heads = [*cuts, high]
    place = F.col("key").isin([h for h in heads if h is not None])
    up = F.pmod(run + 1, F.lit(len(heads)))
    rows = keyed.withColumn("own", run).withColumn("at", F.explode(F.when(place, F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest")), F.struct(up.alias("bucket"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("own").alias("bucket"), F.lit(False).alias("guest"))))))
    return rows.select("at.bucket", "at.guest", "key", "doc_id", "text")


def _position(name: str, cuts: list[int]) -> Column:
    """How many cuts lie below the value: a balanced tree of comparisons, as deep as the logarithm of their number."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(name) <= cuts[mid], tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(cuts))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, guest, key descending, text): each with the one after it; a run's last with its first guest."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held, bucket, out = None, None, []

    def pair(doc: tuple, after: tuple) -> None:
        own, own_print, text = doc[0], doc[2], doc[1]
        cut = len(text) // 2
        edited = (text[: len(text) - cut] + after[1][:cut]).encode()
        edited_print = fingerprint(edited)
        out.append((own, len(text), hashlib.sha256(edited).hexdigest(), own_print.byteswap().tobytes().hex(), edited_print.byteswap().tobytes().hex(), likeness(own_print, edited_print), likeness(own_print, after[2])))

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, types)], names)
        out.clear()
        return batch

    for batch in batches:
        for b, guest, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text"))):
            text = text or ""
            if b == bucket and held is None:
                continue  # further guests of a run that has met its first
            doc = (doc_id, text, fingerprint(text.encode()))
            if b == bucket:
                pair(held, doc)
                held = None if guest else doc
            else:
                held, bucket = (None if guest else doc), b
        yield flush()


def fingerprint_documents(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of an edited form of it, and how like they are.

    The edited text has the last floor(n_chars / 2) code points replaced by as
    many first ones (or all) of the next document in descending doc_id, after
    the last the first.  A null text counts as empty; rows that repeat an id
    follow each other by text; null ids come last.  A single row is its own
    next.  Other columns are not read.
    """
    small_batches(spark)
    buckets = min(2000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = neighbour_buckets(docs, doc_id, text, buckets)
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("key"), F.coalesce("text", F.lit("")))
    return dealt.select("bucket", "guest", "doc_id", "text").mapInArrow(_compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
