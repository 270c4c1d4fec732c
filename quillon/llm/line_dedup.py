"""Line dedup by distinct-site spread.

Every line hash has a HyperLogLog sketch of the sites (sources) that carry it;
sketches merge by aggregation.  Lines whose estimate lies within a band around
the threshold get an exact distinct count; those clearly above go without.
Lines spread over at least `sites` sites are boilerplate and leave every
document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._store import Workspace

SITES = 5
#: A line that holds this isn't blank.
NOT_BLANK = r"[^\x20\x09-\x0D]"
LG_K = 10
#: Relative half-width of the band that is counted exactly: over ten standard errors of a sketch of 2^LG_K slots.
BAND = 0.5


def boilerplate_lines(work: Workspace, lines: DataFrame, sites: int = SITES) -> DataFrame:
    """Hashes h1, h2 of the lines that at least `sites` distinct sites carry; `lines` has h1, h2, site (null is no site)."""
    lines = lines.where(F.col("site").isNotNull())
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - BAND))
    spread = work.write(spread, "spread")
    sure = spread.where(F.col("estimate") > sites * (1 + BAND)).select("h1", "h2")
    near = spread.where(F.col("estimate") <= sites * (1 + BAND)).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    exact = lines.join(near, (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2")))
    exact = exact.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("h1", "h2")
    return work.write(sure.union(exact), "boilerplate")


def _without(lines: str, gone: str) -> str:
    """The array `lines` without the positions in the sorted array `gone`: what lies between two of them, piece by piece."""
    piece = "(a, b) -> slice(l.lines, a + 2, b - a - 1)"
    return f"transform(array(named_struct('lines', {lines}, 'gone', {gone})), l -> flatten(zip_with(concat(array(-1), l.gone), concat(l.gone, array(size(l.lines))), {piece})))[0]"


def dedup_lines(spark: SparkSession, docs: DataFrame, sites: int = SITES, text: str = "text", site: str = "source") -> DataFrame:
    """`docs` without boilerplate lines, with n_lines and n_removed.

    A line is what lies between line feeds; blank lines (of ASCII white space
    only) are kept and never counted as boilerplate.  A null text stays null
    with 0 lines; an empty text has one blank line.  A null site spreads nothing
    but its lines are removed like others.  Repeated rows are treated alike.
    Columns named n_lines or n_removed are replaced, all others stay.
    """
    work = Workspace(spark, "lines")
    keys = {"__q_t1": F.xxhash64(text), "__q_t2": F.xxhash64(F.lit(1), F.col(text))}
    exploded = docs.select(F.col(site).cast("string").alias("site"), *[c.alias(n) for n, c in keys.items()], F.posexplode(F.split(F.col(text), "\n")).alias("at", "line")).where(F.col("line").rlike(NOT_BLANK))
    lines = exploded.select("site", *keys, "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), F.col("line")).alias("h2"))
    bad = boilerplate_lines(work, lines.select("h1", "h2", "site"), sites).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"))
    hits = lines.join(bad, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).groupBy(*keys).agg(F.array_sort(F.collect_set("at")).alias("__q_gone"))
    hits = work.write(hits, "hits").withColumnsRenamed({n: f"{n}_hit" for n in keys})
    joined = docs.withColumns(keys).join(hits, [F.col(n) == F.col(f"{n}_hit") for n in keys], "left").withColumn("__q_text", F.col(text))
    cleaned = F.when(F.col("__q_gone").isNull(), F.col("__q_text")).otherwise(F.array_join(F.expr(_without(r"split(__q_text, '\n')", "__q_gone")), "\n"))
    out = {
        "n_lines": F.when(F.col("__q_text").isNull(), 0).otherwise(F.length("__q_text") - F.length(F.translate("__q_text", "\n", "")) + 1).cast("long"),
        "n_removed": F.when(F.col("__q_gone").isNull(), 0).otherwise(F.size("__q_gone")).cast("long"),
        text: cleaned,
    }
    return joined.withColumns(out).drop(*keys, *[f"{n}_hit" for n in keys], "__q_gone", "__q_text")
