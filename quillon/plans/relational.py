"""Queries over windows, joins, aggregates, sets and text, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as X
from quillon.operators import aggregates as A
from quillon.operators import dedup as D
from quillon.operators import joins as J
from quillon.operators import windows as W
from quillon.plans.tables import FRAMES_SQL, frames, micros, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {FRAMES_SQL},
  n AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY frame) AS i FROM frames),
  s AS (SELECT cam, frame FROM n WHERE (i - 1) % 2 = 0),
  g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY cam ORDER BY frame) AS gap FROM s),
  m AS (SELECT cam, median(gap) FILTER (WHERE gap > 0) AS med FROM g GROUP BY cam),
  r AS (SELECT g.cam, g.frame, CAST(sum(CASE WHEN gap > med * 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY g.cam ORDER BY frame) AS BIGINT) AS run_index, med * 2.5 AS max_gap FROM g JOIN m USING (cam)),
  p AS (SELECT *, row_number() OVER (PARTITION BY cam, run_index ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY cam, run_index) AS len FROM r),
  sizes AS (SELECT unnest([3, 5]) AS size),
  starts AS (SELECT DISTINCT cam, run_index, size, unnest(list_distinct(list_concat(range(0, len - size + 1, 2), [len - size]))) AS st FROM (SELECT DISTINCT cam, run_index, len FROM p) CROSS JOIN sizes WHERE len >= size),
  w AS (SELECT s.cam, s.run_index, s.size, s.st, min(p.frame) AS start_frame, max(p.frame) AS end_frame, list(p.frame ORDER BY p.frame) AS f, any_value(p.max_gap) AS max_gap
    FROM starts s JOIN p ON p.cam = s.cam AND p.run_index = s.run_index AND p.i BETWEEN s.st AND s.st + s.size - 1 GROUP BY ALL)
  SELECT cam, run_index, CAST(size AS INTEGER) AS window_size, start_frame, end_frame, end_frame - start_frame AS frame_span,
    list_max([f[k + 1] - f[k] FOR k IN range(1, len(f))]) AS max_frame_gap, round((end_frame - start_frame) / (size - 1), 6) AS mean_frame_gap,
    list_max([f[k + 1] - f[k] FOR k IN range(1, len(f))]) <= max_gap AS continuity_ok,
    row_number() OVER (PARTITION BY cam ORDER BY start_frame, size, end_frame, run_index, st) - 1 AS window_no FROM w""")
def temporal_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimate, find runs by median gap, cut fixed windows of several sizes, number them: per camera."""
    sampled = W.every_nth(frames(spark, sf_dir), ["cam"], ["frame"], 2)
    runs = W.sessions(sampled, ["cam"], "frame", 2.5).select("cam", "frame", "run_index", "max_gap")
    out = None
    for size in (3, 5):
        w = W.fixed_windows(runs, ["cam", "run_index"], ["frame"], size, 2)
        w = w.groupBy("cam", "run_index", "window_start").agg(F.array_sort(F.collect_list("frame")).alias("f"), F.first("max_gap").alias("max_gap"))
        w = w.withColumn("window_size", F.lit(size))
        out = w if out is None else out.union(w)
    f = F.col("f")
    gap = F.array_max(F.zip_with(F.slice(f, F.lit(2), F.size(f) - 1), F.slice(f, F.lit(1), F.size(f) - 1), lambda b, a: b - a))
    first, last = F.get(f, 0), F.element_at(f, -1)
    out = out.withColumns({"start_frame": first, "end_frame": last, "frame_span": last - first, "max_frame_gap": gap, "mean_frame_gap": F.round((last - first) / (F.col("window_size") - 1), 6), "continuity_ok": gap <= F.col("max_gap")})
    out = W.rank_within(out, ["cam"], ["start_frame", "window_size", "end_frame", "run_index", "window_start"], "n")
    return out.select("cam", "run_index", "window_size", "start_frame", "end_frame", "frame_span", "max_frame_gap", "mean_frame_gap", "continuity_ok", (F.col("n") - 1).alias("window_no"))


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank_global,
    row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank_within FROM orders""")
def rank_global_and_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderpriority")
    order = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    return W.rank_within_ranges(W.rank_globally(o, order, "rank_global"), ["o_orderpriority"], order, "rank_within").select("o_orderkey", F.col("rank_global").cast("long").alias("rank_global"), F.col("rank_within").cast("long").alias("rank_within"))


@query("""WITH n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
  k AS (SELECT DISTINCT user_id, CAST(round_even(j * (n - 1) / 19.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT user_id, n FROM n WHERE n > 20) CROSS JOIN range(20) t(j))
  SELECT event_id, user_id FROM n WHERE n <= 20 OR EXISTS (SELECT 1 FROM k WHERE k.user_id = n.user_id AND k.i = n.i)""")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts")
    return W.even_sample(e, ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE (n - 1) % 7 = 0")
def every_nth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.every_nth(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 7).select("event_id")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
  WHERE c <= 40 OR n BETWEEN floor(c * 0.05) + 1 AND c - floor(c * 0.05)""")
def trim_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.trim_ends(table(spark, sf_dir, "events", "event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"]).select("event_id")


@query("""SELECT s_suppkey, s_nationkey, CAST(floor(n / 16) AS BIGINT) AS bucket, n % 16 AS slot FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)""")
def bucket_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    return W.pages(s, ["s_nationkey"], ["s_suppkey"], 16, "bucket", "slot").select("s_suppkey", "s_nationkey", F.col("bucket").cast("long").alias("bucket"), F.col("slot").cast("long").alias("slot"))


@query("SELECT event_id, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS label FROM events")
def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.dense_ids(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), ["user_id"], "event_type", "label").select("event_id", F.col("label").cast("long").alias("label"))


@query("""WITH p AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90), a AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2),
  f AS (SELECT *, row_number() OVER (ORDER BY user_id, event_type) AS pair_id FROM p)
  SELECT user_id, event_type, pair_id, true AS positive FROM f UNION ALL
  SELECT user_id, event_type, (SELECT count(*) FROM p) + row_number() OVER (ORDER BY o, user_id, event_type), false FROM a ANTI JOIN p USING (user_id, event_type)""")
def pair_rekey_with_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value")
    return W.pair_ids(e.where("value > 90"), e, ["user_id", "event_type"], "event_id").select("user_id", "event_type", F.col("pair_id").cast("long").alias("pair_id"), "positive")


@query("""WITH p AS (SELECT DISTINCT l_suppkey % 7 AS seq, l_partkey AS trk FROM lineitem), u AS (SELECT trk FROM p GROUP BY trk HAVING count(*) > 1),
  n AS (SELECT seq, trk, (SELECT max(l_partkey) FROM lineitem) + row_number() OVER (ORDER BY trk, seq) AS new_id FROM p JOIN u USING (trk))
  SELECT p.seq, p.trk, coalesce(n.new_id, p.trk) AS new_id FROM p LEFT JOIN n USING (seq, trk)""")
def unique_ids_on_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select((F.col("l_suppkey") % 7).alias("seq"), F.col("l_partkey").alias("trk")).distinct()
    return W.unique_ids(p, "seq", "trk", "new_id").select("seq", "trk", F.col("new_id").cast("long").alias("new_id"))


@query("""WITH w AS (SELECT DISTINCT l_orderkey AS image, l_partkey % 5 AS category, l_suppkey % 4 AS worker, l_extendedprice AS score, l_linenumber, l_partkey FROM lineitem),
  k AS (SELECT * FROM w QUALIFY worker = min(worker) OVER (PARTITION BY image, category))
  SELECT image, category, worker, score, l_partkey, row_number() OVER (PARTITION BY image ORDER BY score DESC, worker, l_linenumber, l_partkey) AS rank FROM k
  QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, worker, l_linenumber, l_partkey) <= 2""")
def topk_per_key_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_linenumber")
    l = l.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 5).alias("category"), (F.col("l_suppkey") % 4).alias("worker"), F.col("l_extendedprice").alias("score"), "l_linenumber", "l_partkey").distinct()
    return D.merge_dumps(l, ["image", "category"], "image", "worker", "score", ["l_linenumber", "l_partkey"], 2).select("image", "category", "worker", "score", "l_partkey", F.col("rank").cast("long").alias("rank"))


@query("""SELECT l_partkey, l_orderkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey DESC) = 1""")
def best_of_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_partkey", "l_orderkey", "l_extendedprice")
    best = A.best_of(F.struct("l_orderkey", "l_extendedprice"), F.col("l_extendedprice"), F.col("l_orderkey"))
    return l.groupBy("l_partkey").agg(best.alias("b")).select("l_partkey", "b.l_orderkey", "b.l_extendedprice")


@query("""WITH c AS (SELECT CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS DOUBLE) AS tn FROM labels JOIN documents USING (doc_id)),
  p AS (SELECT *, tp / (tp + fp + 1e-6) AS pr, tp / (tp + fn + 1e-6) AS re FROM c)
  SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(pr, 6) AS "precision", round(re, 6) AS recall,
    round(2 * pr * re / (pr + re + 1e-6), 6) AS f1, round(fp / (fp + tn + 1e-6), 6) AS fpr,
    round((tp * tn - fp * fn) / (sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) + 1e-6), 6) AS mcc FROM p""")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents", "doc_id"), "doc_id")
    c = A.confusion(l, F.col("quality") == 1, F.col("toxic") == 1)
    return c.select("tp", "fp", "fn", "tn", *[F.round(x, 6).alias(x) for x in ("precision", "recall", "f1", "fpr", "mcc")])


@query("""SELECT coalesce(r_name, '*') AS region, coalesce(n_name, '*') AS nation, grouping(r_name, n_name) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity,
    round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1), 6) AS weighted_discount
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def rollup_weighted_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_suppkey", "l_quantity", "l_discount").join(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    l = l.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    r = A.roll(l, ["r_name", "n_name"], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 6).alias("weighted_discount")])
    return r.select(F.coalesce("r_name", F.lit("*")).alias("region"), F.coalesce("n_name", F.lit("*")).alias("nation"), F.col("grouping").cast("long").alias("level"), "n", "quantity", "weighted_discount")


@query("""WITH leaf AS (SELECT s_nationkey % 5 AS sup, s_nationkey AS cat, avg(s_acctbal) AS m, sum(s_acctbal) AS s, count(*) AS n FROM supplier GROUP BY 1, 2),
  per AS (SELECT sup, avg(m) AS m, sum(s) AS s, sum(n) AS n FROM leaf GROUP BY sup) SELECT round(avg(m), 6) AS mean_of_means, round(sum(s) / sum(n), 6) AS mean_of_rows FROM per""")
def average_of_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("sup", F.col("s_nationkey") % 5)
    return A.average_of_averages(s, "sup", "s_nationkey", "s_acctbal").select(F.round("mean_of_means", 6).alias("mean_of_means"), F.round("mean_of_rows", 6).alias("mean_of_rows"))


@query("""SELECT user_id, label, round(m, 6) AS mean_value FROM (SELECT user_id, event_type AS label, count(*) AS c FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) = 1)
  JOIN (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) USING (user_id)""")
def mode_and_mean_per_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    return e.groupBy("user_id").agg(A.vote(F.col("event_type")).alias("label"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("""SELECT c_nationkey, round(avg(coalesce(v, 0)), 6) AS null_as_zero, round(coalesce(avg(nullif(v, 0)), 0), 6) AS nonzero_only, round(coalesce(avg(CASE WHEN c_acctbal > -1 THEN c_acctbal END), -1), 6) AS valid_only
  FROM (SELECT *, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS v FROM customer) GROUP BY c_nationkey""")
def mean_null_conventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("v", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")))
    return c.groupBy("c_nationkey").agg(F.round(A.mean_null_as_zero(F.col("v")), 6).alias("null_as_zero"), F.round(A.mean_nonzero(F.col("v")), 6).alias("nonzero_only"), F.round(A.mean_valid(F.col("c_acctbal")), 6).alias("valid_only"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS g, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS g, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders WHERE o_orderstatus = 'F')
  SELECT g, count(*) AS n_common FROM (SELECT * FROM a INTERSECT SELECT * FROM b) GROUP BY g HAVING count(*) >= 2""")
def intersect_groups_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderstatus").select(F.col("o_custkey").alias("g"), F.month("o_orderdate").alias("m"), "o_orderstatus")
    return J.common_groups(o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"), ["g"], "m", 2)


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)),
  l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
  SELECT 'customer' AS section, count(*) AS n FROM c UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM l""")
def semi_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").where("c_mktsegment = 'BUILDING'")
    kept = J.cascade(c, (table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), "o_custkey", "o_orderkey"), (table(spark, sf_dir, "lineitem", "l_orderkey"), "l_orderkey", "l_orderkey"))
    out = [t.agg(F.count("*").alias("n")).select(F.lit(n).alias("section"), "n") for n, t in zip(("customer", "orders", "lineitem"), kept)]
    return out[0].union(out[1]).union(out[2])


@query("""WITH f AS (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1)
  SELECT * FROM f UNION ALL SELECT c_custkey, 0.0, 0 FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM f)""")
def anti_missing_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))
    return J.missing_as_default(table(spark, sf_dir, "customer", "c_custkey"), f, ["c_custkey"], {"total": 0.0, "n": 0})


@query("SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON s_nationkey = n_nationkey")
def left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0").withColumnRenamed("n_nationkey", "s_nationkey")
    return J.fill_from(table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey"), n, "s_nationkey", ["n_name"], {"n_name": "unknown"}).select("s_suppkey", "n_name")


@query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, max(event_id) AS e FROM events WHERE event_type = 'view' GROUP BY 1, 2)
  SELECT p.event_id, b.e AS last_view, f.e AS next_view FROM p ASOF LEFT JOIN v b ON p.user_id = b.user_id AND p.ts >= b.ts ASOF LEFT JOIN v f ON p.user_id = f.user_id AND p.ts <= f.ts""")
def asof_both_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    p, v = e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")
    b = J.as_of(p, v.withColumnRenamed("event_id", "e"), ["user_id"], "ts", "e", "backward", "last_view")
    return J.as_of(b, v.withColumnRenamed("event_id", "e"), ["user_id"], "ts", "e", "forward", "next_view").select("event_id", "last_view", "next_view")


@query("""SELECT p.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(p.ts) - epoch_us(v.ts)), v.ts, v.event_id) AS nearest_rank
  FROM events p JOIN events v ON p.user_id = v.user_id WHERE p.event_type = 'purchase' AND v.event_type = 'view' QUALIFY nearest_rank <= 3""")
def asof_nearest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", micros("ts").alias("at"))
    v = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), micros("ts").alias("view_at"))
    return J.nearest_k(p, v, ["user_id"], "at", "view_at", "view_id", 3).select("event_id", "view_id", F.col("nearest_rank").cast("long").alias("nearest_rank"))


@query("""SELECT source, doc_id, priority FROM (SELECT *, CASE WHEN lang = 'en' AND n_chars > 2000 THEN 0 WHEN lang = 'en' THEN 1 WHEN n_chars > 2000 THEN 2 END AS priority FROM documents)
  WHERE priority IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY priority, n_chars, doc_id) = 1""")
def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars")
    long, en = F.col("n_chars") > 2000, F.col("lang") == "en"
    return J.by_priority(d, ["source"], [en & long, en, long], ["n_chars", "doc_id"]).select("source", "doc_id", "priority")


BUCKETS = [("all", 0.0, 1e9), ("small", 0.0, 10.0), ("medium", 10.0, 30.0), ("large", 30.0, 1e9)]


@query("""SELECT bucket, count(*) AS n, round(avg(p_retailprice), 6) AS mean_price FROM part JOIN (VALUES ('all', 0.0, 1e9), ('small', 0.0, 10.0), ('medium', 10.0, 30.0), ('large', 30.0, 1e9)) b(bucket, lo, hi)
  ON p_size BETWEEN lo AND hi GROUP BY bucket""")
def range_bucket_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_size", "p_retailprice")
    return J.overlapping_buckets(p, "p_size", BUCKETS).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"))


@query("""WITH h AS (SELECT event_id, user_id, ts, event_type <> 'error' AND value > 30 AS hit FROM events), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM h),
  s AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS BIGINT) AS streak FROM i)
  SELECT event_id, streak, bool_or(streak >= 4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS confirmed FROM s""")
def confirmation_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type", "value").withColumn("hit", (F.col("event_type") != "error") & (F.col("value") > 30))
    return W.streak(e, ["user_id"], ["ts", "event_id"], "hit", 4).select("event_id", "streak", "confirmed")


@query("""WITH RECURSIVE o AS (SELECT event_id, user_id, value > 30 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
  r AS (SELECT user_id, event_id, n, CAST(greatest(-2, least(5, 1 + CASE WHEN hit THEN 1 ELSE -1 END)) AS BIGINT) AS keep_alive FROM o WHERE n = 1
    UNION ALL SELECT o.user_id, o.event_id, o.n, greatest(-2, least(5, r.keep_alive + CASE WHEN o.hit THEN 1 ELSE -1 END)) FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
  SELECT user_id, event_id, keep_alive FROM r""")
def keep_alive_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value").withColumn("hit", F.col("value") > 30)
    return W.saturating_counter(e, ["user_id"], "event_id", "hit", -2, 5, 1).select("user_id", "event_id", "keep_alive")


@query("""SELECT event_id, coalesce(lead(event_type, 3) OVER w, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def lookahead_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    return W.look_ahead(e, ["user_id"], ["ts", "event_id"], "event_type", 3, "later").select("event_id", "later")


@query(r"""SELECT p_partkey, left(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(n), '[^A-Za-z0-9._-]', '_', 'g'), '_+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), ''), 'object'), 80) AS slug,
    CAST(nullif(regexp_extract(n, '(\d+)[^0-9]*$', 1), '') AS BIGINT) AS digits, CASE WHEN instr(k, '_') > 0 THEN left(k, length(k) - length(string_split(k, '_')[-1]) - 1) ELSE k END AS head, CASE WHEN instr(k, '_') > 0 THEN string_split(k, '_')[-1] END AS tail,
    replace(regexp_replace(k, '_0$', ''), '_', ' ') AS cleaned, list_distinct_in_order AS variants FROM (SELECT p_partkey, p_name || ' #' || p_partkey || ' (' || p_type || ')' AS n, replace(p_name, ' ', '_') || '_' || p_partkey % 3 AS k,
      CASE WHEN lower(p_type) = p_type THEN [p_type] ELSE [p_type, lower(p_type)] END || CASE WHEN contains(lower(p_type), 'steel') THEN ['metal part', 'part'] ELSE [] END AS list_distinct_in_order FROM part)""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand")
    n = F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string"), F.lit(" ("), F.col("p_type"), F.lit(")"))
    k = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), (F.col("p_partkey") % 3).cast("string"))
    head, tail = X.split_key(k)
    return p.select("p_partkey", X.slugify(n).alias("slug"), X.last_digits(n).alias("digits"), head.alias("head"), tail.alias("tail"), X.clean_target(k).alias("cleaned"), X.variants(F.concat(F.lit(" "), "p_type"), {"steel": ["metal part", "part"]}).alias("variants"))


@query("""WITH t AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant' AND contains(text, 'a')) AS last FROM conversations GROUP BY conv_id)
  SELECT conv_id, turn, role FROM conversations JOIN t USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 2 OR turn >= last""")
def chat_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two messages and all from the last assistant message that holds a marker."""
    from pyspark.sql.window import Window

    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    marked = (F.col("role") == "assistant") & F.contains("text", F.lit("a"))
    last = F.max(F.when(marked, F.col("turn"))).over(Window.partitionBy("conv_id"))
    ranked = W.rank_within(c.withColumn("last", last), ["conv_id"], ["turn"], "n")
    return ranked.where((F.col("n") <= 2) | (F.col("turn") >= F.col("last"))).select("conv_id", "turn", "role")


@query("""WITH z AS (SELECT bool_or(conv_id = 0) AS z FROM conversations) SELECT conv_id + CASE WHEN z THEN 1 ELSE 0 END AS conv_id, count(*) AS n FROM conversations CROSS JOIN z GROUP BY 1""")
def reindex_if_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations", "conv_id")
    out = D.shift_if_zero({"conversations": (c.select("conv_id").distinct(), "conv_id"), "turns": (c.select(F.lit(1).cast("long").alias("turn_id"), F.col("conv_id").alias("of")), "turn_id")}, {"conversations": [("turns", "of")]})
    return out["turns"].groupBy(F.col("of").alias("conv_id")).agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.not_done(table(spark, sf_dir, "documents", "doc_id"), table(spark, sf_dir, "labels", "doc_id"), ["doc_id"])


@query("""SELECT k, count(*) AS n, round(avg(CAST(v AS DOUBLE)), 6) AS mean FROM (SELECT unnest(json_keys(props)) AS k, json_extract_string(props, '$.' || unnest(json_keys(props))) AS v FROM events) GROUP BY k""")
def json_map_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "props")
    m = e.select(F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return m.groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("try_cast(v as double)")), 6).alias("mean"))


@query("""SELECT 'lineitem without order' AS violation, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
  SELECT 'orders without customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL
  SELECT 'repeated (order, line)', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL
  SELECT 'discount outside [0, 1]', count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1""")
def validity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o, c = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    checks = {
        "lineitem without order": J.referential_gaps(l.select("l_orderkey"), o, "l_orderkey", "o_orderkey"),
        "orders without customer": J.referential_gaps(o.select("o_custkey"), c, "o_custkey", "c_custkey"),
        "repeated (order, line)": l.groupBy("l_orderkey", "l_linenumber").count().where("count > 1"),
        "discount outside [0, 1]": l.select("l_discount").where("l_discount < 0 OR l_discount > 1"),
    }
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("violation"), "n") for name, t in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""WITH c AS (SELECT user_id, max(event_id) FILTER (WHERE event_type IN ('purchase', 'error')) AS last FROM events GROUP BY 1)
  SELECT e.user_id, CASE WHEN any_value(last) IS NULL THEN 'full' WHEN count(*) FILTER (WHERE event_type IN ('click', 'view') AND event_id > last) > 0 THEN 'partial' ELSE 'fetch' END AS mode,
    count(*) FILTER (WHERE event_type IN ('click', 'view') AND event_id > last) AS n_since FROM events e JOIN c ON e.user_id = c.user_id GROUP BY e.user_id""")
def action_log_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the next pass has to do, from each key's log: all, what was refined since the last pass, or nothing but fetch."""
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    last = F.max(F.when(F.col("event_type").isin("purchase", "error"), F.col("event_id"))).over(Window.partitionBy("user_id"))
    since = F.count_if(F.col("event_type").isin("click", "view") & (F.col("event_id") > F.col("last")))
    g = e.withColumn("last", last).groupBy("user_id").agg(F.max("last").alias("last"), since.alias("n_since"))
    return g.select("user_id", F.when(F.col("last").isNull(), "full").when(F.col("n_since") > 0, "partial").otherwise("fetch").alias("mode"), "n_since")
