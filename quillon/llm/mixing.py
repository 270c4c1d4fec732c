"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents all have the same fractional number of copies, its target
over its size.  Each document in turn, from the longest to the shortest, meets
the pool of those after it: a random transfer moves words between it and all of
the pool alike until the document has a whole number of copies (or the pool
can't give or take more), keeping their sum of words and each document's
expected copies.  Documents of like size meet first: each band of sizes folds in
blocks of about BLOCK documents, each leaving its shortest open, level by level,
until at most KEEP open ones are left in a band, and the root folds what all
bands of a source left open.  What is open at the end is short, unless a
document outweighs all others, and is drawn by its fraction.  A root that would
end more than NEAR off its source's target, as happens to sources of a few
dozen documents, is drawn anew, DRAWS times in all at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm._sql import uniform, word_count
from quillon.llm._store import Workspace

BLOCK, KEEP = 64, 16
#: Share of a target that a root may be off before it is drawn anew, and draws; with one draw the expected copies are exact.
NEAR, DRAWS = 0.01, 8
#: Sizes of a band differ by less than this factor.
BAND = 1.25
MOST_COPIES = 3
#: Sorts by falling size.
_OF = "struct<o: bigint, h: bigint, doc: bigint, text: bigint, size: bigint, m: bigint, base: bigint>"
_ITEM = f"struct<of: {_OF}, frac: double>"

#: A pool's item has alpha * frac + beta copies by now; mass and words are sums over the pool, without that change.
#: One step: x has f copies and rises by up or falls by down words, which the pool gives (of `held`) or takes (into `room`).
_FOLD = f"""
aggregate(items, named_struct('alpha', 1D, 'beta', 0D, 'mass', aggregate(items, 0D, (n, x) -> n + x.frac * x.of.size), 'words', aggregate(items, 0L, (n, x) -> n + x.of.size),
    'open', cast(null as {_ITEM}), 'done', cast(array() as array<struct<of: {_OF}, copies: bigint>>)),
  (s, x) -> transform(transform(transform(array(named_struct('f', greatest(0D, least(1D, s.alpha * x.frac + s.beta)), 'mass', s.mass - x.frac * x.of.size, 'words', s.words - x.of.size)),
    v -> named_struct('f', v.f, 'mass', v.mass, 'words', v.words, 'held', greatest(0D, least(cast(v.words as double), s.alpha * v.mass + s.beta * v.words)))),
    v -> named_struct('f', v.f, 'mass', v.mass, 'words', v.words, 'held', v.held, 'room', v.words - v.held, 'up', least((1 - v.f) * x.of.size, v.held), 'down', least(v.f * x.of.size, v.words - v.held),
        'u', pmod(xxhash64({{seed}}, {{level}}, x.of.h), 4503599627370496) / 4503599627370496D)),
    v -> CASE
      WHEN s.open IS NOT NULL THEN named_struct('alpha', s.alpha, 'beta', s.beta, 'mass', v.mass, 'words', v.words, 'open', s.open, 'done', concat(s.done, array(named_struct('of', x.of, 'copies', x.of.base + cast(round(v.f) as bigint)))))
      WHEN v.words <= 0 THEN named_struct('alpha', s.alpha, 'beta', s.beta, 'mass', v.mass, 'words', v.words, 'open', named_struct('of', x.of, 'frac', v.f), 'done', s.done)
      WHEN v.u * (v.up + v.down) < v.down THEN named_struct(
        'alpha', s.alpha * if(v.held > 0, 1 - v.up / v.held, 1D), 'beta', s.beta * if(v.held > 0, 1 - v.up / v.held, 1D), 'mass', v.mass, 'words', v.words,
        'open', if(v.up < (1 - v.f) * x.of.size, named_struct('of', x.of, 'frac', v.f + v.up / x.of.size), cast(null as {_ITEM})),
        'done', if(v.up < (1 - v.f) * x.of.size, s.done, concat(s.done, array(named_struct('of', x.of, 'copies', x.of.base + 1)))))
      ELSE named_struct(
        'alpha', s.alpha * if(v.room > 0, 1 - v.down / v.room, 1D), 'beta', s.beta * if(v.room > 0, 1 - v.down / v.room, 1D) + if(v.room > 0, v.down / v.room, 0D), 'mass', v.mass, 'words', v.words,
        'open', if(v.down < v.f * x.of.size, named_struct('of', x.of, 'frac', v.f - v.down / x.of.size), cast(null as {_ITEM})),
        'done', if(v.down < v.f * x.of.size, s.done, concat(s.done, array(named_struct('of', x.of, 'copies', x.of.base))))) END)[0])
"""


def source_targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, weight, target from one row (source, source_size) per source.

    Weights 1, 2, 3 repeat over the sources by code point, null last.  A target
    is the smaller of `most` times the source's size and weight times one
    common level, which is what resharing every excess by weight comes to.
    The windows see one row per source, never documents.
    """
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    s = sizes.withColumn("weight", (rank - 1) % 3 + 1).withColumn("cap", (F.col("source_size") * most).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight")).withColumn("k", F.row_number().over(Window.orderBy("ratio", F.col("source").asc_nulls_last())))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    s = s.withColumn("level", level)
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("k", "level"))).over(every)["level"])
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _folded(open_: DataFrame, seed: int, level: int, *block: str) -> DataFrame:
    """Per source and block (band and n, which are its band's, are kept): the open item and those done."""
    items = open_.groupBy("source", *block).agg(F.first("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items"))
    return items.select("source", *block, "n", F.expr(_FOLD.format(seed=seed, level=level)).alias("s"))


def mix_sources(spark: SparkSession, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, size: Column | None = None, text_key: Column | None = None) -> DataFrame:
    """`docs` with size, source_size, target and copies (0 to MOST_COPIES) of every row.

    Size is the number of words, 0 for a null text.  Null sources are one
    source, the last.  Rows equal in id, text and source are one item of
    several copies that share the item's copies evenly.  A document without
    words carries no mass; its copies are drawn by its fraction alone.  Null
    ids are an id like any other.  Columns of these four names are replaced,
    others stay.  The outcome depends on the rows and `seed` only.
    """
    work = Workspace(spark, "mixing")
    names = ["__q_doc", "__q_source", "__q_text"]
    keyed = docs.withColumns({"__q_doc": F.col(doc_id).cast("long"), "__q_source": F.col(source).cast("string"), "__q_text": F.xxhash64(text) if text_key is None else text_key})
    items = work.write(keyed.withColumn("__q_size", word_count(F.col(text)) if size is None else size).groupBy(*names).agg(F.max("__q_size").alias("__q_size"), F.count("*").alias("m")), "items")
    sizes = items.groupBy(F.col("__q_source").alias("source")).agg(F.sum(F.col("__q_size") * F.col("m")).alias("source_size"))
    targets = work.write(source_targets(sizes), "targets")

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    h = F.xxhash64(F.lit(seed), "__q_doc", "__q_text", "__q_size")
    of = F.struct((-F.col("__q_size")).alias("o"), h.alias("h"), F.col("__q_doc").alias("doc"), F.col("__q_text").alias("text"), F.col("__q_size").alias("size"), "m", F.floor("total").alias("base"))
    rated = items.join(targets, F.col("__q_source").eqNullSafe(F.col("source"))).withColumn("total", rate * F.col("m"))
    rated = rated.select("source", F.struct(of.alias("of"), (F.col("total") - F.floor("total")).alias("frac")).alias("item"))
    whole = (F.col("item.frac") <= 0) | (F.col("item.of.size") <= 0)
    drawn = F.col("item.of.base") + (uniform(F.lit(seed + 1), F.col("item.of.h")) < F.col("item.frac")).cast("long")
    parts = [rated.where(whole).select("source", "item.of", drawn.alias("copies"))]
    open_ = rated.where(~whole).withColumn("band", F.floor(F.log(F.col("item.of.size")) / math.log(BAND)))
    counts = work.write(open_.groupBy("source", "band").agg(F.count("*").alias("n")), "bands")
    most, level = counts.agg(F.max("n")).first()[0] or 0, 0
    counts = counts.select(F.col("source").alias("c"), F.col("band").alias("c_band"), "n")
    open_ = open_.join(counts, F.col("source").eqNullSafe(F.col("c")) & (F.col("band") == F.col("c_band"))).select("source", "band", "n", "item")
    while most > KEEP:
        fold = F.col("n") > KEEP
        dealt = open_.where(fold).withColumn("n", F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(KEEP // 2)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64(F.lit(level), "item.of.h"), F.col("n")))
        folded = work.write(_folded(dealt, seed, level, "band", "block"), f"level{level}")
        parts.append(folded.select("source", F.explode("s.done").alias("d")).select("source", "d.of", "d.copies"))
        open_ = open_.where(~fold).union(folded.select("source", "band", "n", F.col("s.open").alias("item")))
        most, level = max(math.ceil(most / BLOCK), KEEP // 2), level + 1
    # At most KEEP items a band, so some hundreds a source.
    items = open_.groupBy("source").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    root = items.select("source", "draw", "items", F.expr(_FOLD.format(seed=f"{seed} + 1000003 * draw", level=level)).alias("s"))
    last = F.struct(F.col("s.open.of").alias("of"), (F.col("s.open.of.base") + (uniform(F.lit(seed + 1), F.col("draw"), F.col("s.open.of.h")) < F.col("s.open.frac")).cast("long")).alias("copies"))
    root = root.select("source", "draw", "items", F.concat("s.done", F.array(last)).alias("done"))
    over = F.aggregate("done", F.lit(0.0), lambda n, x: n + x["copies"] * x["of"]["size"]) - F.aggregate("items", F.lit(0.0), lambda n, x: n + (x["of"]["base"] + x["frac"]) * x["of"]["size"])
    near = root.withColumn("off", F.abs(over)).join(targets.select(F.col("source").alias("t"), "target"), F.col("source").eqNullSafe(F.col("t"))).withColumn("off", F.when(F.col("off") > NEAR * F.col("target"), F.col("off")).otherwise(0.0))
    root = work.write(near.groupBy("source").agg(F.min_by("done", F.struct("off", "draw")).alias("done")), "root")
    parts.append(root.select("source", F.explode("done").alias("d")).select("source", "d.of", "d.copies"))
    result = parts[0]
    for part in parts[1:]:
        result = result.union(part)
    result = work.write(result.select(F.col("source").alias("__r_source"), F.col("of.doc").alias("__r_doc"), F.col("of.size").alias("__r_size"), F.col("of.text").alias("__r_text"), F.col("of.m").alias("__r_m"), F.col("copies").alias("__r_copies")), "copies")
    targets = targets.select(F.col("source").alias("__t_source"), F.col("source_size").alias("__t_size"), F.col("target").alias("__t_target"))
    same = [F.col(n).eqNullSafe(F.col(n.replace("__q", "__r"))) for n in names]
    joined = keyed.join(result, same).join(targets, F.col("__q_source").eqNullSafe(F.col("__t_source")))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
    copies = F.expr("__r_copies div __r_m") + (nth <= F.col("__r_copies") % F.col("__r_m")).cast("long")
    out = {"size": F.col("__r_size"), "source_size": F.col("__t_size"), "target": F.col("__t_target"), "copies": copies}
    return joined.withColumns(out).drop(*names, "__r_source", "__r_doc", "__r_size", "__r_text", "__r_m", "__r_copies", "__t_source", "__t_size", "__t_target")


def repeat_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of `mixed` as often as it has copies, with `columns` only."""
    repeated = mixed.where(F.col("copies") > 0).withColumn("__q_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*columns)
