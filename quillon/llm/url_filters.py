"""URL filters: expand, join on short hash prefixes, confirm, apply precedence.

Each URL becomes a few expressions, one per host suffix (cut at dots) and per
prefix of its path at a length that some rule has.  The expressions' SHA-256
digests meet the rules' in an equi-join on the first four bytes; only equal
full digests count.  Of the rules that fit a URL the longest (host and path
together, then the longer host, then the later verdict word: block before
allow) decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._sql import LOWER, UPPER

SHORT = 8  # hex digits of a digest in the join: four bytes


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)

#: Stands between host and path where they are hashed; a URL's host and path end before it.
MARK = "#"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _hashed(df: DataFrame, expression: str) -> DataFrame:
    digest = F.sha2(F.col(expression), 256)
    return df.withColumn("__q_digest", digest).withColumn("__q_short", F.substring(digest, 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule and verdict of every row's URL.

    `rules` has host, path and verdict.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's path.  Rows keep their
    number: repeated rows are judged alike; a null or scheme-less URL has empty
    host and path, no rule and the default verdict.  Empty tables give empty
    results, an empty rule table only defaults.  Columns of `pages` named host,
    path, rule or verdict are replaced, all others stay.  Rules with a null
    host, path or verdict are void.
    """
    rules = _hashed(rules.select("host", "path", "verdict").dropna().select(F.translate("host", UPPER, LOWER).alias("__q_host"), F.col("path").alias("__q_path"), F.col("verdict").alias("__q_verdict")).withColumn("__q_rule", F.concat("__q_host", "__q_path")).withColumn("__q_expression", F.concat("__q_host", F.lit(MARK), "__q_path")), "__q_expression").drop("__q_expression")
    # At most as many numbers as the longest path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("__q_path")).distinct().toLocalIterator())
    host, path, parts = F.col("__q_h"), F.col("__q_p"), F.split("__q_h", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    each = pages.select(F.col(url).alias("__q_url")).where(F.col(url).isNotNull()).distinct()
    each = each.select("__q_url", url_host(F.col("__q_url")).alias("__q_h"), url_path(F.col("__q_url")).alias("__q_p")).where(host != "")
    each = each.select("__q_url", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit(MARK), p))))).alias("__q_expression"))
    each = _hashed(each, "__q_expression").drop("__q_expression")
    found = each.join(rules.withColumnRenamed("__q_digest", "__q_full"), "__q_short").where(F.col("__q_digest") == F.col("__q_full"))
    best = found.groupBy("__q_url").agg(F.max(F.struct(F.length("__q_rule").alias("n"), F.length("__q_host").alias("h"), F.col("__q_verdict").alias("verdict"), F.col("__q_rule").alias("rule"))).alias("__q_best"))
    judged = pages.withColumn("__q_key", F.col(url)).join(best, F.col("__q_key") == F.col("__q_url"), "left")
    out = {"host": F.coalesce(url_host(F.col("__q_key")), F.lit("")), "path": F.coalesce(url_path(F.col("__q_key")), F.lit("")), "rule": F.col("__q_best.rule"), "verdict": F.coalesce("__q_best.verdict", F.lit(default))}
    return judged.withColumns(out).drop("__q_key", "__q_url", "__q_best")
