"""A content-addressed store of token ids.

`write_store` tokenizes every text, cuts the ids into chunks where a rolling
hash over the last WINDOW ids says so, and writes three tables:

chunks    digest, width, ids   each distinct chunk once, ids little-endian and
                               unsigned, two or four bytes wide, as the file's
                               column says; the digest is of their four-byte form
recipes   part, doc_id, first, n_tokens, digests, lengths, root
                               one row per document in ascending doc_id order;
                               `first` counts the ids before it in its part
manifest  part, offset, n_docs, n_tokens, root
                               one row per part, its offset over the whole store
                               and the Merkle root of its documents' roots

A document's root is the Merkle root of its chunks' digests.  `read_store`
checks every digest and root it passes and gives the documents back.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm._store import small_batches

WINDOW = 8
LEAST, MOST = 128, 4096
#: A chunk ends where so many bits of the rolling hash are zero: after 512 ids on average.
CUT_BITS = 9
#: Bytes of text that a Python worker encodes in one go.
SLICE = 2 << 20
#: Segments whose ids a Python worker keeps, and bytes of these segments and their ids.
MEMO, MEMO_BYTES = 1_000_000, 64 << 20
#: The normalizer and pre-tokenizer of the definitions whose texts may be cut into segments.  White space
#: parts pre-tokens, so do letters and closing punctuation, and small letters are the only form, so a segment's ids
#: don't depend on what stands beside it.
SEGMENTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_POLY = 0xEDB88320

_made: dict[int, object] = {}


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over `leaves` in order; a level's odd last node moves up as it is."""
    level = [_digest(b"\0" + x) for x in leaves] or [_digest(b"")]
    while len(level) > 1:
        level = [_digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


#: Bytes of lower-cased text: white space, letters (all beyond ASCII are taken for such at first), closing punctuation, all else.
_BLANK, _LETTER, _CLOSING, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
_KIND[97:123] = _KIND[128:] = _LETTER
_KIND[[ord(c) for c in ".,;:!?"]] = _CLOSING
#: Printable ASCII signs between letters: a segment that wasn't cut from its piece, and means the same alone.
_WHOLE = re.compile(r"(?=.*[!-`{-~])(?:[!-~]|[^\W\d_])+")


def _segments(data: np.ndarray) -> tuple[np.ndarray, pa.StringArray]:
    """Where the segments of lower-cased text start, and the segments: pieces between white space, cut where letters
    and closing punctuation meet, unless they hold anything else."""
    kind = _KIND[data]
    solid = kind != _BLANK
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    if not len(begins):
        return begins, pa.array([], pa.string())
    whole = np.logical_or.reduceat(kind == _OTHER, begins)
    cuts = np.flatnonzero(solid[1:] & solid[:-1] & (kind[1:] != kind[:-1])) + 1
    cuts = cuts[~whole[np.searchsorted(begins, cuts, "right") - 1]]
    starts = np.sort(np.concatenate([begins, cuts]))
    stops = np.minimum(np.concatenate([starts[1:], [len(data)]]), ends[np.searchsorted(begins, starts, "right") - 1])
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int32)
    return starts, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[solid].tobytes()))


def _listed(segments: pa.StringArray) -> list[str]:
    """The segments, which hold no line feed, as Python strings: one long string split is cheaper than many made."""
    if not len(segments):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(segments)], segments), "\n")[0].as_py().split("\n")


class Memo:
    """Ids of segments: a number for each, and all ids end to end. Beyond MEMO segments or MEMO_BYTES the half that texts use least is forgotten."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.ids, self.ends, self.used = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.n_ids = self.n_bytes = 0

    def add(self, segments: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, m = len(self.at), len(self.at) + len(segments)
        if m > len(self.ends):
            self.ends, self.used = (np.concatenate([x, np.zeros(m, x.dtype)]) for x in (self.ends, self.used))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(self.n_ids + len(ids), "<u4")])
        self.at.update(zip(segments, range(n, m)))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.ends[n:m] = self.n_ids + np.cumsum(lengths)
        self.n_ids += len(ids)
        self.n_bytes += 4 * len(ids) + sum(map(len, segments))

    def lists(self) -> pa.LargeListArray:
        n = len(self.at)
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate([np.zeros(1, np.int64), self.ends[:n]])), pa.array(self.ids[: self.n_ids]))

    def shrink(self) -> None:
        n = len(self.at)
        kept = np.sort(np.argpartition(self.used[:n], n // 2)[n // 2 :])
        names, lists, used = list(self.at), self.lists().take(pa.array(kept)), self.used[kept]
        self.__init__()
        self.add([names[i] for i in kept], lists.values.to_numpy(), np.diff(lists.offsets.to_numpy()))
        self.used[: len(kept)] = used


class Encoder:
    """Ids of whole texts.

    By a definition whose normalizer and pre-tokenizer are SEGMENTED, texts are
    cut into segments, and each distinct one of many texts is encoded once and
    remembered.  Words of
    small ASCII letters are encoded many at a time, without normalising and
    splitting what needs neither; in a vocabulary with word ends the ids tell
    where each word stops.  Texts with other signs beyond ASCII, and other
    tokenizers, encode every text as it is.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        parts = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        suffix = parts["model"].get("end_of_word_suffix")
        self.final = self.letters = self.normal = None
        if suffix:
            vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
            self.final = np.zeros(max(vocabulary.values()) + 1, bool)
            self.final[[i for word, i in vocabulary.items() if word.endswith(suffix)]] = True
            split, bytes_ = {"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            self.letters = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": split}))
            self.normal = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, bytes_]}}))
        model = parts["model"]
        plain_bpe = model["type"] == "BPE" and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback"))
        cut = parts.get("truncation") or parts.get("padding") or any(x["normalized"] for x in parts.get("added_tokens", []))
        self.memo, self.by_segment = Memo(), plain_bpe and not cut and all(parts[k] == v for k, v in SEGMENTED.items())

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _remember(self, segments: list[str]) -> None:
        for i in range(0, len(segments), 10_000):
            raw = self._plain(segments[i : i + 10_000])
            self.memo.add(segments[i : i + 10_000], np.frombuffer(b"".join(raw), "<u4"), np.array([len(x) // 4 for x in raw]))

    def _words(self, words: list[str]) -> None:
        """Remembers the ids of letter words, all of them ASCII or none."""
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            if self.final is not None:
                joined = " ".join(part)
                as_is = joined == joined.lower() and unicodedata.is_normalized("NFC", joined)
                tokenizer = self.tokenizer if not as_is else self.letters if joined.isascii() else self.normal
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.final[ids]) + 1
                if len(ends) == len(part) and len(ids) == ends[-1]:
                    self.memo.add(part, ids, np.diff(ends, prepend=0))
                    continue
            self._remember(part)

    def _numbers(self, segments: list[str]) -> np.ndarray:
        """The memo's numbers of distinct segments; -1 for one that may have been cut wrong, as its letters of the kind's table aren't all such."""
        if self.memo.at and (len(self.memo.at) + len(segments) > MEMO or self.memo.n_bytes > MEMO_BYTES):
            self.memo.shrink()
        find, n = self.memo.at.get, len(segments)
        known = np.fromiter(map(find, segments, repeat(-1)), np.int32, n)
        new = np.flatnonzero(known < 0).tolist()
        if new:
            fresh = [segments[i] for i in new]
            letters = [x for x in fresh if x.isalpha()]
            self._words([x for x in letters if x.isascii()])
            self._words([x for x in letters if not x.isascii()])
            self._remember([x for x in fresh if not x.isalpha() and (x.isascii() or _WHOLE.fullmatch(x) and x == x.lower())])
            known[new] = np.fromiter(map(find, fresh, repeat(-1)), np.int32, len(fresh))
        self.memo.used[known[known >= 0]] += 1
        return known

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the ids as unsigned 32-bit integers."""
        if not self.by_segment:
            return [np.frombuffer(x, "<u4") for x in self._plain([x or "" for x in texts])]
        # Capital sigma and dotted I are the letters whose small form depends on what is around or is no letter alone.
        small = [(x if "\u03a3" in x or "\u0130" in x else x.lower()).encode() if x else b"" for x in texts]
        places = np.cumsum([0, *(len(x) + 1 for x in small)])
        starts, segments = _segments(np.frombuffer(b"\n".join(small) + b"\n", np.uint8))
        coded = segments.dictionary_encode()
        number = self._numbers(_listed(coded.dictionary))[coded.indices.to_numpy()]
        odd = number < 0
        taken = self.memo.lists().take(pa.array(number, mask=odd if odd.any() else None))
        # Null lists are empty; a text's ids lie between those of its first segment and the next text's.
        ids, until = taken.values.to_numpy(), taken.offsets.to_numpy()[np.searchsorted(starts, places)]
        out = [ids[a:b] for a, b in zip(until, until[1:])]
        # Whole texts where a segment isn't what its bytes made of it.
        again = np.unique(np.searchsorted(places, starts[odd], "right") - 1)
        for i, raw in zip(again, self._plain([texts[i] for i in again])):
            out[i] = np.frombuffer(raw, "<u4")
        return out


def _encoder(definition: str) -> Encoder:
    key = hash(definition)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(definition)
    return _made[key]


def cuts(texts: list[np.ndarray]) -> list[list[int]]:
    """Where the chunks of each text's ids end: where the hash of the last
    WINDOW ids says so, at least LEAST and at most MOST ids after the last cut,
    and at the end."""
    gap = np.zeros(WINDOW, np.uint64)
    ids = np.concatenate([x for t in texts for x in (gap, t)], dtype=np.uint64)
    with np.errstate(over="ignore"):
        # A random number for each id, 0 for those between two texts, and its sum over the window.
        random = ids * np.uint64(0x9E3779B97F4A7C15)
        random ^= random >> np.uint64(32)
        random *= np.uint64(0xD6E8FEB86659FD93)
        h = np.cumsum(random, dtype=np.uint64)
        h[WINDOW:] -= h[:-WINDOW].copy()
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at = (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist()
    out, begin = [], 0
    for t in texts:
        begin += WINDOW
        last, end, found = begin, begin + len(t), []
        while last < end:
            i = bisect_left(at, last + LEAST)
            last = min(at[i] if i < len(at) else end, last + MOST, end)
            found.append(last - begin)
        out.append(found)
        begin = end
    return out


def _chunked(definition, end_id: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, end = _encoder(definition.value), set(), np.array([end_id], "<u4")
        for batch in batches:
            for lo, hi in _text.slabs(_text.buffers(batch.column("text"))[1], SLICE):
                part = batch.slice(lo, hi - lo)
                rows, texts = [], [np.concatenate([ids, end]) for ids in encode(part.column("text").to_pylist())]
                for doc, ids, ends in zip(part.column("doc_id").to_pylist(), texts, cuts(texts)):
                    raw, starts = ids.tobytes(), [0, *ends[:-1]]
                    short = ids.astype("<u2").tobytes() if ids.max() < 65536 else None
                    digests, payloads = [], []
                    for a, b in zip(starts, ends):
                        d = _digest(raw[4 * a : 4 * b])
                        digests.append(d)
                        # Only the first of equal chunks carries its ids, as long as the task remembers it.
                        payloads.append(None if d in seen else raw[4 * a : 4 * b] if short is None else short[2 * a : 2 * b])
                        if len(seen) < 200_000:
                            seen.add(d)
                    rows.append((doc, len(ids), digests, [b - a for a, b in zip(starts, ends)], payloads, merkle(digests)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()))], ["doc_id", "n_tokens", "digests", "lengths", "payloads", "root"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`first`: ids before each document in its part; the rows come in order."""
    before = 0
    for batch in batches:
        n = batch.column("n_tokens").to_numpy()
        first = before + np.cumsum(n) - n
        before += int(n.sum())
        yield pa.record_batch([batch.column("part"), batch.column("doc_id"), pa.array(first, pa.int64()), *(batch.column(c) for c in ("n_tokens", "digests", "lengths", "root"))], ["part", "doc_id", "first", "n_tokens", "digests", "lengths", "root"])


def _part_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part from rows sorted by (part, first): a binary counter of roots, so memory is the tree's depth."""
    part, docs, tokens, stack = None, 0, 0, []

    def out() -> pa.RecordBatch:
        root = b""
        for _, h in reversed(stack):
            root = _digest(b"\1" + h + root) if root else h
        return pa.record_batch([[part], [docs], [tokens], [root]], schema=pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())]))

    for batch in batches:
        for p, n, digests, root in zip(*(batch.column(c).to_pylist() for c in ("part", "n_tokens", "digests", "root"))):
            if p != part and docs:
                yield out()
                docs, tokens, stack = 0, 0, []
            if merkle(digests) != root:
                raise ValueError(f"a recipe in part {p} doesn't have its root")
            part, docs, tokens, height, h = p, docs + 1, tokens + n, 0, _digest(b"\0" + root)
            while stack and stack[-1][0] == height:
                h, height = _digest(b"\1" + stack.pop()[1] + h), height + 1
            stack.append((height, h))
    if docs:
        yield out()


def _roots(recipes: DataFrame) -> DataFrame:
    rows = recipes.select("part", "first", "n_tokens", "digests", "root").repartition("part").sortWithinPartitions("part", "first")
    return rows.mapInArrow(_part_roots, "part int, n_docs bigint, n_tokens bigint, root binary")


def write_store(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes `docs` to a store at `path`; `tokenizer` is the tokenizers library's JSON definition.

    A null text counts as empty; every document ends with `end_id`.  Rows that
    repeat an id are documents of their own, next to each other; null ids come
    first.  Other columns are not read.  An empty table gives empty tables.
    """
    small_batches(spark)
    definition = spark.sparkContext.broadcast(tokenizer)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, digests array<binary>, lengths array<int>, payloads array<binary>, root binary"
    staged = source.mapInArrow(_chunked(definition, end_id), schema)
    staged.write.option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema(staged.schema).parquet(f"{path}/staged")

    chunks = staged.select(F.explode(F.arrays_zip("digests", "lengths", "payloads")).alias("c")).select(F.col("c.digests").alias("digest"), F.expr("length(c.payloads) div c.lengths").cast("int").alias("width"), F.col("c.payloads").alias("ids"))
    chunks.where("ids IS NOT NULL").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")

    recipes = staged.drop("payloads").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id())
    recipes = recipes.select("part", "doc_id", "n_tokens", "digests", "lengths", "root").mapInArrow(_numbered, "part int, doc_id bigint, first bigint, n_tokens bigint, digests array<binary>, lengths array<int>, root binary")
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/staged")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    # One row per part, as many as the shuffle has partitions.
    parts = sorted(_roots(spark.read.schema(recipes.schema).parquet(f"{path}/recipes")).collect())
    offset, rows = 0, []
    for p in parts:
        rows.append((p.part, offset, p.n_docs, p.n_tokens, p.root))
        offset += p.n_tokens
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


_MANIFEST = "part int, offset bigint, n_docs bigint, n_tokens bigint, root binary"
_RECIPES = "part int, doc_id bigint, first bigint, n_tokens bigint, digests array<binary>, lengths array<int>, root binary"
_CHUNKS = "digest binary, width int, ids binary"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest, CRC-32 and number of the ids of each stored chunk; fails where a chunk isn't what its digest says."""
    for batch in batches:
        crc, n = [], []
        for digest, width, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "width", "ids"))):
            wide = np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()
            if _digest(wide) != digest:
                raise ValueError("a chunk doesn't have its digest")
            crc.append(zlib.crc32(wide))
            n.append(len(wide) // 4)
        yield pa.record_batch({"chunk": batch.column("digest"), "crc": pa.array(crc, pa.int64()), "held": pa.array(n, pa.int64())})


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of polynomials over GF(2) modulo CRC-32's, bit-reversed, element by element."""
    out, a, b = np.zeros_like(a), a.copy(), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), (b >> np.uint32(1)) ^ np.uint32(_POLY), b >> np.uint32(1))
    return out


def shift_crc(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What `crc` adds to the CRC-32 of a string in which `n_bytes` more bytes follow."""
    crc, left = crc.astype(np.uint32), n_bytes.astype(np.uint64)
    power = np.full(1, 1 << 23, np.uint32)  # x^8: one byte
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        crc[odd] = _times(np.broadcast_to(power, odd.sum()), crc[odd])
        power = _times(power, power)
        left >>= np.uint64(1)
    return crc


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = shift_crc(batch.column("crc").to_numpy(), 4 * batch.column("after").to_numpy())
        yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "start", "n_tokens", "length", "held")), pa.array(crc.astype(np.int64))], ["doc_id", "start", "n_tokens", "length", "held", "crc"])


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, digest, length, after (ids after the chunk), seq of each chunk of each recipe."""
    recipes = spark.read.schema(_RECIPES).parquet(f"{path}/recipes")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").select(F.col("part").alias("m"), "offset")
    placed = recipes.join(manifest, F.col("part") == F.col("m")).withColumn("start", F.col("offset") + F.col("first"))
    rows = placed.select("doc_id", "start", "n_tokens", "lengths", F.posexplode("digests").alias("seq", "digest"))
    length = F.element_at("lengths", F.col("seq") + 1).cast("long")
    after = F.col("n_tokens") - F.aggregate(F.slice("lengths", F.lit(1), F.col("seq") + 1), F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.select("doc_id", "start", "n_tokens", "seq", "digest", length.alias("length"), after.alias("after"))


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Fails unless the recipes have the roots and counts that the manifest states."""
    found = {tuple(r) for r in _roots(spark.read.schema(_RECIPES).parquet(f"{path}/recipes")).collect()}
    if found != {(r.part, r.n_docs, r.n_tokens, r.root) for r in spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").collect()}:
        raise ValueError("the recipes are not what the manifest states")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    Chunks are read and checked where they lie; a document's CRC is combined
    from its chunks', so no ids move.
    """
    verify_manifest(spark, path)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(_checked, "chunk binary, crc bigint, held bigint")
    rows = _entries(spark, path).join(chunks, F.col("digest") == F.col("chunk"), "left")
    missing = F.when(F.col("chunk").isNull() | (F.col("held") != F.col("length")), F.raise_error(F.lit("a chunk is missing or has another length")))
    rows = rows.withColumn("held", F.coalesce(missing.cast("long"), F.col("held")))
    rows = rows.mapInArrow(_shifted, "doc_id bigint, start bigint, n_tokens bigint, length bigint, held bigint, crc bigint")
    return rows.groupBy("doc_id", "start").agg(F.sum("held").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (array<bigint>) of every document, rebuilt from chunks."""
    verify_manifest(spark, path)
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks").mapInArrow(_opened, "chunk binary, ids array<bigint>")
    rows = _entries(spark, path).join(chunks, F.col("digest") == F.col("chunk"))
    parts = rows.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("parts"))
    return parts.select("doc_id", "start", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(x, f"<u{w}").astype(np.int64) for w, x in zip(batch.column("width").to_pylist(), batch.column("ids").to_pylist())]
        yield pa.record_batch({"chunk": batch.column("digest"), "ids": pa.array(ids, pa.list_(pa.int64()))})
