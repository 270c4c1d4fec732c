"""The corpus pipeline: documents in, a content-addressed token store out.

Each stage works on what the one before it has kept.  The last returns, per
document of the mixed corpus, what is read back from the store's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontamination, mixing, ngram_join, token_store, toxicity
from quillon.llm._store import Workspace
from quillon.llm.queries import tokenizer_definition


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on this corpus' labels, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(spark, docs, toxicity.fit(spark, docs, toxicity.severity_labels(docs, labels)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; documents without words all stay."""
    return ngram_join.keep_first(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontamination.drop_contaminated(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes."""
    # The operator's own columns stand aside for documents' columns of these names.
    kept = {c: f"__kept_{c}" for c in docs.columns if c.lower() in ("size", "source_size", "target", "copies")}
    mixed = mixing.mix_sources(spark, docs.withColumnsRenamed(kept))
    copies = mixing.repeat_copies(mixed, [kept.get(c, c) for c in docs.columns])
    return copies.withColumnsRenamed({v: k for k, v in kept.items()})


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every copy, read back from the store."""
    path = Workspace(spark, "pipeline").path("store")
    token_store.write_store(spark, docs, path, tokenizer_definition())
    return token_store.read_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_store", store_tokens),
]

#: No SQL can express the trained classifier, the rounding or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all documents, each result but the last written and read again."""
    work = Workspace(spark, "corpus")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
