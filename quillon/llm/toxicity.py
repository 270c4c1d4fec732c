"""Toxicity: cumulative-link ordinal regression on sparse text features.

Features are the letter words of a text and their first 4, 5 and 6 bytes, as
presence.  A grade k is reached with probability sigmoid(x.w - t_k): all
thresholds t_0 < t_1 < ... share the weights w.  The expected severity is the
sum of these probabilities.  The model is fitted on at most SAMPLE labelled
documents, chosen by hash of their id, and keeps the FEATURES features that
differ most between clean and toxic documents.
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

#: Labelled documents and features that the fit sees at most.
SAMPLE, FEATURES = 20_000, 4096
#: A feature's share among toxic documents differs from that among clean ones by so many standard errors.
LEAST_Z = 4.0
PREFIXES = (4, 5, 6, None)
#: A document has a grade, and is toxic if that is 1 or more, if it reaches it with at least this probability.
REJECT = 0.5


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct feature hashes) of each text."""
    for i, j in _text.slabs(offsets):
        w = _text.Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _text.NON_LETTER)
        h = np.stack([w.hashes(n) for n in PREFIXES])
        at = w.first_of_row
        for row in range(j - i):
            yield i + row, np.unique(h[:, at[row] : at[row + 1]])


@dataclass
class Model:
    """Sorted feature hashes with their weights, and increasing thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def reach(self, s: np.ndarray) -> np.ndarray:
        """Probability of each grade from 1 on."""
        score = 0.0
        if len(self.features) and len(s):
            at = np.searchsorted(s, self.features)
            score = float(self.weights[s[np.minimum(at, len(s) - 1)] == self.features].sum())
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -40, 40)))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each feature in the clean and the toxic documents of a batch."""
    for batch in batches:
        grade = batch.column("grade").to_numpy()
        got = list(_features(*_text.buffers(batch.column("text"))))
        if got:
            h, at = np.unique(np.concatenate([s for _, s in got]), return_inverse=True)
            toxic = np.repeat(grade[[r for r, _ in got]] > 0, [len(s) for _, s in got])
            yield pa.record_batch({"h": h.view(np.int64), "clean": np.bincount(at[~toxic], minlength=len(h)), "toxic": np.bincount(at[toxic], minlength=len(h))})


def _chosen(features: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.zeros(0, np.int32)] * batch.num_rows
            for row, s in _features(*_text.buffers(batch.column("text"))):
                if len(s) and len(features):
                    at = np.searchsorted(s, features)
                    rows[row] = np.flatnonzero(s[np.minimum(at, len(s) - 1)] == features).astype(np.int32)
            yield pa.record_batch({"grade": batch.column("grade"), "x": pa.array(rows, pa.list_(pa.int32()))})

    return run


def fit_cumulative_link(rows: list[np.ndarray], grades: np.ndarray, n_features: int, ridge: float = 1e-3, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of `grades` (0, 1, ...), by full-batch Adam.

    The first threshold is free, each further one lies exp(g) above the one
    before it, so they stay in order.
    """
    k = int(grades.max()) if len(grades) else 0
    indices = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    theta = np.concatenate([np.zeros(n_features), [2.0], np.zeros(max(k - 1, 0))])
    if not k:
        return theta[:n_features], np.full(1, 40.0)
    m, v = np.zeros_like(theta), np.zeros_like(theta)

    def sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))

    for step in range(1, steps + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1 :])
        t = theta[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(owner, w[indices], len(rows)) if len(indices) else np.zeros(len(rows))
        reach = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - t), np.zeros((len(rows), 1))], 1)
        slope = reach * (1 - reach)
        p = np.maximum(reach[np.arange(len(rows)), grades] - reach[np.arange(len(rows)), grades + 1], 1e-12)
        low, high = slope[np.arange(len(rows)), grades] / p, slope[np.arange(len(rows)), grades + 1] / p
        d_score = -(low - high) / len(rows)
        d_t = np.zeros(k)
        np.add.at(d_t, grades[grades > 0] - 1, low[grades > 0] / len(rows))
        np.add.at(d_t, grades[grades < k], -high[grades < k] / len(rows))
        d_w = np.bincount(indices, d_score[owner], n_features) + ridge * w / n_features if len(indices) else ridge * w
        d_gap = np.cumsum(d_t[::-1])[::-1][1:] * gaps
        g = np.concatenate([d_w, [d_t.sum()], d_gap])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return theta[:n_features], theta[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(theta[n_features + 1 :]))])


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """A model from `docs` (doc_id, text) and `labels` (doc_id, grade: 0 is clean).

    Labels of the same document count by their highest grade; null labels and
    labels of no document are void.  Without both clean and toxic labels the
    model finds everything clean.
    """
    small_batches(spark)
    graded = labels.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    # At most `sample` ids, so the join sends no text anywhere but from the scan.
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    labelled = docs.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")
    counts = labelled.mapInArrow(_presence, "h bigint, clean bigint, toxic bigint").groupBy("h").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("clean + toxic >= 3")
    by_grade = {bool(r["t"]): r["n"] for r in chosen.groupBy((F.col("grade") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    if len(by_grade) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.full(1, 40.0))
    n1, n0 = by_grade[True], by_grade[False]
    share = (F.col("toxic") + F.col("clean") + 1) / float(n1 + n0 + 2)
    z = (F.col("toxic") / n1 - F.col("clean") / n0) / F.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    best = counts.withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "h").limit(features).select("h").toArrow()
    hashes = np.sort(best.column("h").to_numpy().view(np.uint64))
    rows = labelled.mapInArrow(_chosen(hashes), "grade int, x array<int>").toArrow()
    x = [r.values.to_numpy() for r in rows.column("x")]
    weights, thresholds = fit_cumulative_link(x, rows.column("grade").to_numpy().astype(np.int64), len(hashes))
    return Model(hashes, weights, thresholds)


def _scored(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            reach = np.tile(m.reach(np.zeros(0, np.uint64)), (batch.num_rows, 1))
            for row, s in _features(*_text.buffers(batch.column("text"))):
                reach[row] = m.reach(s)
            grade = (reach >= REJECT).sum(1)
            yield pa.record_batch([batch.column("doc_id"), pa.array(grade.astype(np.int32)), pa.array(reach.sum(1)), pa.array(reach[:, 0]), pa.array(reach[:, 0] >= REJECT)], ["doc_id", "grade", "severity", "p_toxic", "toxic"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, grade (the median: the highest that is as likely reached as not), severity (expected grade), p_toxic
    and toxic of every row; a null or letterless text has no feature and the base severity. Other columns are not read."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(_scored(spark.sparkContext.broadcast(model)), "doc_id bigint, grade int, severity double, p_toxic double, toxic boolean")


def _clean(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for row, s in _features(*_text.buffers(batch.column("text"))):
                keep[row] = m.reach(s)[0] < REJECT
            yield batch.filter(pa.array(keep))

    return run


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` (with a column text) that are not toxic, unchanged."""
    return docs.mapInArrow(_clean(spark.sparkContext.broadcast(model)), docs.schema)


def severity_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Grades from a binary flag: 0 clean, 1 toxic, 2 toxic in a text of good quality.

    The table labels has only `toxic` and `quality`; where a toxic document's
    quality is 1 the abuse is readable and weighs more.
    """
    return labels.select("doc_id", F.when(F.col("toxic") == 1, F.lit(1) + F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).when(F.col("toxic") == 0, 0).alias("grade"))
