"""Language ID with spans.

Script ranges narrow the candidates of each word to the languages that use its
script.  Its score in each is the log-likelihood of its n-grams of letters
under counts from labelled texts.  Viterbi over the words of a text
with a penalty for each switch labels spans; the languages' shares of the
letters decide the text's label.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import _text
from quillon.llm._store import small_batches

#: Labelled texts that the fit sees at most, and n-grams that the model keeps.
SAMPLE, GRAMS = 10_000, 50_000
ORDERS = (1, 2, 3, 4)
#: Cost of a switch of languages between two words, in nats.
SWITCH = 6.0
#: A single word says no more than this for or against a language, in nats.
WORD_LIMIT = 8.0
MEMO = 200_000

#: Letters, and numbers that are no decimal digits.
_LETTERS = re.compile(r"[^\W\d_]+")
#: Ranges of scripts: Latin, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, Kana, Hangul, Han. Fixed values of the Unicode blocks.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x9FFF)],
}


def letter_words(text: str | None) -> list[str]:
    """Runs of letters in the lower-cased text; signs of numbers (such as one half) are no letters."""
    found = _LETTERS.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


_STARTS = np.array(sorted(a for ranges in SCRIPTS.values() for a, _ in ranges))
_ENDS = np.array([dict(r for ranges in SCRIPTS.values() for r in ranges)[a] for a in _STARTS])
_SCRIPT = np.array([next(i for i, ranges in enumerate(SCRIPTS.values()) if any(a == x for x, _ in ranges)) for a in _STARTS])
_ODD = np.array([pow(0xA0761D6478BD642F, k + 1, 1 << 64) for k in range(max(ORDERS))], np.uint64)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, each between `^` and `$` and a line feed, and the word each belongs to."""
    codes = np.frombuffer("".join(f"^{w}$\n" for w in words).encode("utf-32-le"), "<u4").astype(np.uint64)
    return codes, np.cumsum(codes == 10) - (codes == 10)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, order and word of every n-gram within the words; `^` and `$` mark their ends in those of two and more letters."""
    codes, word = _codes(words)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            m = len(codes) - n + 1
            if m > 0:
                h = sum((codes[k : m + k] * _ODD[k] for k in range(n)), np.full(m, n, np.uint64))
                ok = (word[:m] == word[n - 1 :]) & (codes[n - 1 :] != 10)
                if n == 1:
                    ok &= (codes != 94) & (codes != 36)
                out.append((_text.mix(h[ok]), np.full(int(ok.sum()), n), word[:m][ok]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))


def scripts(words: list[str]) -> np.ndarray:
    """Number of the script of each word's first letter; len(SCRIPTS) outside all ranges."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    at = np.maximum(np.searchsorted(_STARTS, first, "right") - 1, 0)
    return np.where((first >= _STARTS[at]) & (first <= _ENDS[at]), _SCRIPT[at], len(SCRIPTS))


@dataclass
class Model:
    """Languages, those that use each script, and the n-grams' sorted hashes with a score in each language."""

    languages: list[str]
    uses: np.ndarray
    hashes: np.ndarray
    scores: np.ndarray
    name: str

    def words(self, words: list[str]) -> np.ndarray:
        """For each word a score in each language: 0 for the likeliest, down to -WORD_LIMIT, which languages of other scripts have."""
        h, _, word = grams(words)
        at = np.searchsorted(self.hashes, h)
        hit = self.hashes[np.minimum(at, len(self.hashes) - 1)] == h
        at, word = at[hit], word[hit]
        total = np.stack([np.bincount(word, self.scores[at, k], len(words)) for k in range(len(self.languages))], 1)
        total = np.where(self.uses[scripts(words)], total, -np.inf)
        return np.maximum(total - total.max(1, keepdims=True), -WORD_LIMIT).astype(np.float32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language how often each n-gram (kind: its order) and each script (kind 0) occurs."""
    for batch in batches:
        words: dict[str, Counter] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            words.setdefault(lang, Counter()).update(letter_words(text))
        for lang, counts in words.items():
            if counts:
                n = np.fromiter(counts.values(), np.int64)
                h, order, word = grams(list(counts))
                keys, first, at = np.unique(h, return_index=True, return_inverse=True)
                kind, times = order[first], np.bincount(at, n[word]).astype(np.int64)
                used = np.bincount(scripts(list(counts)), n, len(SCRIPTS) + 1).astype(np.int64)
                yield pa.record_batch({"gram": np.concatenate([keys.view(np.int64), np.arange(len(used))]), "kind": np.concatenate([kind, np.zeros(len(used), np.int64)]), "lang": pa.array([lang] * (len(keys) + len(used))), "n": np.concatenate([times, used])})


def fit(labelled: DataFrame, sample: int = SAMPLE, most: int = GRAMS) -> Model:
    """A model from texts with their languages (text, lang); rows without either are void.

    It learns from the `sample` different texts of smallest hash and keeps the
    `most` n-grams that occur most often; without any text it has no language.
    Of several languages of one text the first by code point counts.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select(F.xxhash64("text").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    rows = rows.where(F.col("h") <= F.lit(last)).groupBy("h").agg(F.any_value("text").alias("text"), F.min("lang").alias("lang"))
    counts = rows.select("text", "lang").mapInArrow(_counted, "gram bigint, kind bigint, lang string, n bigint").groupBy("gram", "kind", "lang").agg(F.sum("n").alias("n"))
    by_gram = counts.groupBy("gram", "kind").agg(F.sum("n").alias("all"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "n")))).alias("by"))
    kept = by_gram.orderBy((F.col("kind") == 0).desc(), F.desc("all"), "gram").limit(most).collect()
    languages = sorted({x for r in kept for x in r["by"]})
    n = np.array([[r["by"].get(x, 0) for x in languages] for r in kept], float).reshape(len(kept), len(languages))
    gram, kind = np.array([r["gram"] for r in kept], np.int64), np.array([r["kind"] for r in kept], np.int64)
    uses = np.zeros((len(SCRIPTS) + 1, len(languages)), bool)
    uses[gram[kind == 0]] = n[kind == 0] > 0.001 * n[kind == 0].sum(0)
    uses[~uses.any(1)] = True
    scores = np.zeros_like(n, dtype=np.float32)
    for order in ORDERS:
        of = kind == order
        if of.any():
            p = np.log((n[of] + 0.5) / (n[of].sum(0) + 0.5))
            scores[of] = (p - p.mean(1, keepdims=True)) * order / sum(ORDERS)
    hashes, scores = gram[kind > 0].view(np.uint64), scores[kind > 0]
    by_hash = np.argsort(hashes, kind="stable")
    return Model(languages, uses, hashes[by_hash], scores[by_hash], uuid.uuid4().hex)


def viterbi(scores: np.ndarray, at: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word of many texts at once.

    `scores` has a row per word, text after text; `at` the n + 1 offsets.  A
    step takes the next word of every text that has one.
    """
    # As wide as the number of languages asks for.
    number = np.min_scalar_type(-scores.shape[1])
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    first, longest = at[:-1][order], int(n.max()) if len(n) else 0
    alive = np.searchsorted(-n[order], -np.arange(longest), "left")
    best = np.zeros((len(order), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, number)
    for t in range(longest):
        k = alive[t]
        b = best[:k]
        if t:
            top = b.argmax(1)
            jump = b[np.arange(k), top][:, None] - np.float32(switch)
            came[first[:k] + t] = np.where(b >= jump, np.arange(b.shape[1]), top[:, None])
            b = np.maximum(b, jump)
        best[:k] = b + scores[first[:k] + t]
    path = np.zeros(len(scores), number)
    state = best.argmax(1).astype(number)
    last = at[1:][order] - 1
    for t in range(longest):
        k = alive[t]
        where = last[:k] - t
        path[where] = state[:k]
        state[:k] = came[where, state[:k]]
    return path


#: Words with their scores, of the model of that name, that a Python worker keeps.
_memo: dict[str, np.ndarray] = {}
_memo_of = [""]


def _labelled(batch: pa.RecordBatch, model: Model) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """Letter words of each text, offsets, languages and letters of the words."""
    texts = [letter_words(x) for x in batch.column("text").to_pylist()]
    at = np.cumsum([0, *map(len, texts)])
    used = list(set().union(*texts))
    if not used or not model.languages:
        return texts, at, np.zeros(at[-1], np.int8), np.zeros(at[-1], np.int64)
    if model.name != _memo_of[0] or len(_memo) + len(used) > MEMO:
        _memo.clear()
        _memo_of[0] = model.name
    new = [w for w in used if w not in _memo]
    if new:
        _memo.update(zip(new, model.words(new)))
    number = dict(zip(used, range(len(used))))
    table = np.stack([_memo[w] for w in used])
    index = np.fromiter((number[w] for ws in texts for w in ws), np.int64, at[-1])
    return texts, at, viterbi(table[index], at), np.fromiter(map(len, used), np.int64, len(used))[index]


def _predicted(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                _, at, path, letters = _labelled(part, m)
                langs, scores = [], []
                for i in range(part.num_rows):
                    if at[i] == at[i + 1] or not m.languages:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    share = np.bincount(path[at[i] : at[i + 1]], letters[at[i] : at[i + 1]], len(m.languages))
                    langs.append(m.languages[int(share.argmax())])
                    scores.append(float(share.max() / share.sum()))
                yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred (`und` without a letter) and score (its share of the letters) of every row; no other column is read."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_predicted(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, lang_pred string, score double")


def _spans(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts, at, path, _ = _labelled(part, m)
                rows = []
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    p = path[at[i] : at[i + 1]]
                    cuts = [0, *(np.flatnonzero(p[1:] != p[:-1]) + 1).tolist(), len(p)] if len(p) and m.languages else [0]
                    rows += [(doc, a, b, m.languages[p[a]], " ".join(texts[i][a:b])) for a, b in zip(cuts, cuts[1:])]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "first_word", "end_word", "lang", "words"])

    return run


def spans(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, first_word, end_word, lang, words of each span of one language in every text."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_spans(docs.sparkSession.sparkContext.broadcast(model)), "doc_id bigint, first_word bigint, end_word bigint, lang string, words string")


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Predictions for every row of `docs` (doc_id, text, lang), learnt from those
    whose crc32(doc_id as text) mod 3 is not 1 and that have a language."""
    small_batches(spark)
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 3
    model = fit(docs.where(fold != 1))
    return predict(docs, model).withColumn("held_out", fold == 1).select("doc_id", "held_out", "lang_pred", "score")
