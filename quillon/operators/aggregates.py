"""Aggregates: weighted and class-averaged combinations, means with conventions, best-of, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_mean(value: Column, weight: Column) -> Column:
    """Sum of value * weight over the sum of weights, at least 1."""
    return F.sum(value * weight) / F.greatest(F.sum(weight), F.lit(1))


def mean_valid(value: Column) -> Column:
    """Mean of the values above -1; -1 without any."""
    return F.coalesce(F.avg(F.when(value > -1, value)), F.lit(-1.0))


def mean_null_as_zero(value: Column) -> Column:
    return F.avg(F.coalesce(value, F.lit(0.0)))


def mean_nonzero(value: Column) -> Column:
    return F.coalesce(F.avg(F.nullif(value, F.lit(0.0))), F.lit(0.0))


def best_of(row: Column, *order: Column) -> Column:
    """The row with the largest order."""
    return F.max_by(row, F.struct(*order))


def vote(label: Column) -> Column:
    """The most frequent label, the smallest of equals."""
    return F.mode(label, True)


def average_of_averages(df: DataFrame, category: str, group: str, value: str) -> DataFrame:
    """Per category and group the mean; then both the mean of the categories' means and the mean over all rows."""
    leaf = df.groupBy(category, group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("n"))
    per = leaf.groupBy(category).agg(F.avg("m").alias("m"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    return per.agg(F.avg("m").alias("mean_of_means"), (F.sum("s") / F.sum("n")).alias("mean_of_rows"))


def roll(df: DataFrame, levels: list[str], aggregates: list[Column]) -> DataFrame:
    """(all levels), all but the last, ..., the grand total; `level` counts the kept ones."""
    return df.rollup(*levels).agg(F.grouping_id().alias("grouping"), *aggregates)


def confusion(df: DataFrame, truth: Column, predicted: Column) -> DataFrame:
    """Counts and closed-form scores of a binary decision; 1e-6 is added to the denominators."""
    c = df.agg(*[F.count_if(t & p).alias(n) for n, t, p in (("tp", truth, predicted), ("fp", ~truth, predicted), ("fn", truth, ~predicted), ("tn", ~truth, ~predicted))])
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": tp / (tp + fp + 1e-6), "recall": tp / (tp + fn + 1e-6), "fpr": fp / (fp + tn + 1e-6)})
    p, r = F.col("precision"), F.col("recall")
    return c.withColumns({"f1": 2 * p * r / (p + r + 1e-6), "mcc": (tp * tn - fp * fn) / (F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6)})


def top_share(df: DataFrame, key: str, score: str, correct: str, k: int) -> Column:
    """Share of keys whose correct row is among the k best scores."""
    from pyspark.sql.window import Window

    ranked = df.withColumn("__q_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.desc(correct))))
    return ranked.groupBy(key).agg(F.max((F.col("__q_n") <= k) & F.col(correct)).alias("hit")).agg(F.avg(F.col("hit").cast("double")).alias("top_k"))
