"""Queries of selections, fallbacks and perturbed boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import filters as L
from quillon.operators import selection as S
from quillon.operators import tracks as T
from quillon.plans.relational import query
from quillon.plans.tables import part_boxes, table


def _u(seed: int, *keys: str) -> str:
    """`selection.uniform` in SQL."""
    return f"(CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(keys)})), 1, 8) AS BIGINT) / 4294967296.0)"


_QUERIES_SQL = """q AS (SELECT l_orderkey, l_linenumber, l_returnflag AS text, CASE WHEN l_linestatus = 'O' THEN l_discount END AS box, CASE WHEN l_quantity < 25 THEN l_tax END AS points, CAST(l_quantity AS BIGINT) AS n_out, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_tax > 0.03 END AS instance, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_discount > 0.02 END AS pixel FROM lineitem)"""


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as queries: text, box, points, targets and completeness flags."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    q = l.select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("text"), F.when(F.col("l_linestatus") == "O", F.col("l_discount")).alias("box"), F.when(F.col("l_quantity") < 25, F.col("l_tax")).alias("points"),
        F.array_repeat(F.lit(1), F.col("l_quantity").cast("int")).alias("targets"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") > 0.03).alias("instance"), F.when(F.col("l_linenumber") % 4 != 0, F.col("l_discount") > 0.02).alias("pixel"),
    )
    return q


@query(f"""WITH {_QUERIES_SQL} SELECT l_orderkey, l_linenumber, CASE WHEN text = 'R' THEN 'text' WHEN box IS NOT NULL OR points IS NOT NULL THEN 'geometry' WHEN n_out > 40 THEN 'targets' WHEN NOT (coalesce(instance, false) AND coalesce(pixel, true)) THEN 'incomplete' WHEN instance IS NOT TRUE THEN 'not true' END AS reason FROM q""")
def query_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each query leaves: its text, its geometry, its many targets, its completeness; null for those that stay."""
    reasons = {
        "text": ~S.without_texts(F.col("text"), ["R"]), "geometry": ~S.without_geometry(F.col("box"), F.col("points")), "targets": ~S.few_targets(F.col("targets"), 40),
        "incomplete": ~L.exhaustive_query(F.col("instance"), F.col("pixel")), "not true": ~S.strictly_true(F.col("instance")),
    }
    return _queries(spark, sf_dir).select("l_orderkey", "l_linenumber", S.first_reason(reasons).alias("reason"))


@query("""WITH v AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey AS id, coalesce(n.id, (SELECT min(id) FROM v)) AS next FROM orders o ASOF LEFT JOIN v n ON o.o_orderkey <= n.id""")
def next_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order the first at or after it that may be used, from the start again behind the last."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "P").alias("ok"))
    return S.next_valid(o.select("id"), o, "id", "ok", 1000)


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS BIGINT) - 1 AS position FROM lineitem""")
def valid_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return S.valid_position(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_quantity") > 20).select("l_orderkey", "l_linenumber", "position")


@query(f"""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM d),
  p AS (SELECT *, least(4, (n - 1) // 2) AS step FROM s WHERE n >= 3), b AS (SELECT *, i - CAST(floor({_u(7, "user_id")} * (n - 1 - step * 2 + 1)) AS BIGINT) AS off FROM p)
  SELECT user_id, off // step AS day, count(*) AS n FROM b JOIN events e USING (user_id) WHERE CAST(e.ts AS DATE) = b.day AND off >= 0 AND off % step = 0 AND off // step < 3 GROUP BY 1, 2""")
def strided_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each user's days, four apart or closer, from a random one."""
    e = table(spark, sf_dir, "events", "user_id", "ts").select("user_id", F.to_date("ts").alias("day"))
    return S.strided_stages(e, ["user_id"], "day", 3, 4, 7).groupBy("user_id", "day").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS seg, l_linenumber AS frame, CASE WHEN l_orderkey % 3 > 0 THEN l_orderkey % 100 END AS stable FROM lineitem), r AS (SELECT l_orderkey AS seg, l_linenumber AS frame, max(l_partkey) AS region FROM lineitem WHERE l_orderkey % 2 = 0 AND l_quantity > 30 GROUP BY 1, 2),
  j AS (SELECT c.*, r.region, EXISTS (SELECT 1 FROM r x WHERE x.seg = c.seg) AS has_region FROM c LEFT JOIN r ON r.seg = c.seg AND r.frame = c.frame)
  SELECT seg, frame, coalesce(region, stable) AS region, region IS NULL AS is_fallback FROM j WHERE region IS NOT NULL OR (NOT has_region AND stable IS NOT NULL)""")
def conditional_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a sheet with their region; a segment's stable one only where it has no region at all."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity").withColumnsRenamed({"l_orderkey": "seg", "l_linenumber": "frame"})
    cells = l.select("seg", "frame").distinct().withColumn("stable", F.when(F.col("seg") % 3 > 0, F.col("seg") % 100))
    regions = l.where("seg % 2 = 0 AND l_quantity > 30").groupBy("seg", "frame").agg(F.max("l_partkey").alias("region"))
    return S.conditional_fallback(cells, regions, ["seg"], "frame", "region", "stable").select("seg", "frame", "region", "is_fallback")


@query("""SELECT event_id, coalesce(minute(ts) % 16 = 0, false) OR coalesce(CASE WHEN event_type <> 'error' THEN value / 200.0 END < 0.1, false) AS anew FROM events""")
def recondition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events set their track anew: every 16th minute, or a low overlap."""
    e = table(spark, sf_dir, "events", "event_id", "ts", "event_type", "value")
    overlap = F.when(F.col("event_type") != "error", F.col("value") / 200.0)
    return e.select("event_id", S.recondition(F.minute("ts"), overlap, 16, 0.1).alias("anew"))


@query("""WITH n AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2), f AS (SELECT l_suppkey, n, count(*) AS f FROM n GROUP BY 1, 2), u AS (SELECT l_suppkey, arg_min(n, (-f, n)) AS usual FROM f GROUP BY 1)
  SELECT l_suppkey, usual, CAST(sum(CASE WHEN n <> usual THEN f ELSE 0 END) AS BIGINT) AS n_odd FROM f JOIN u USING (l_suppkey) GROUP BY 1, 2""")
def uniform_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.uniform_counts(table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey"), ["l_suppkey"], "l_partkey")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS i FROM lineitem)
  SELECT l_orderkey, list(l_tax ORDER BY l_tax DESC, i) AS scores, list(l_partkey ORDER BY l_tax DESC, i) AS parts, count(*) FILTER (WHERE l_tax > 0.04) AS n_above, list(CASE WHEN l_orderkey % 2 = 0 THEN 1.0 WHEN i < 3 THEN l_tax ELSE 0 END ORDER BY i) AS filled FROM x GROUP BY 1""")
def score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as parallel arrays by descending score, how many exceed a threshold, and scores filled up where they are missing."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax")
    rows = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax"))).alias("s"))
    d = rows.select("l_orderkey", F.col("s.l_tax").alias("scores"), F.col("s.l_partkey").alias("parts"))
    d = d.withColumn("filled", S.scores_for(F.col("parts"), F.when(F.col("l_orderkey") % 2 != 0, F.slice("scores", 1, 2)))).withColumn("n_above", S.above(F.col("scores"), 0.04).cast("long"))
    return S.by_score(d, "scores", ["parts"])


@query("""SELECT p_partkey, 'first.' || p_brand AS source, p_name AS item FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, 'objects[' || i || ']', w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part)""")
def items_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations out of a map and a list, with the path that each came by."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_name", "p_size")
    d = p.select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.create_map("p_brand", "p_name")).alias("m"), F.split("p_name", " ").alias("l"))
    return S.items_of(d, ["p_partkey"], [("m", "first"), ("l", "objects")])


_MOVED = {c: f"greatest(0.0, least(150.0, {c} + (2 * {_u(3 + k, 'id')} - 1) * least(0.1 * ({'x2 - x1' if c[0] == 'x' else 'y2 - y1'}), 3.0)))" for k, c in enumerate(("x1", "y1", "x2", "y2"))}


@query(f"""WITH b AS (SELECT p_partkey AS id, CAST(p_partkey % 97 AS DOUBLE) AS x1, CAST((p_partkey * 31) % 89 AS DOUBLE) AS y1, CAST(p_partkey % 97 + 10 + p_size AS DOUBLE) AS x2, CAST((p_partkey * 31) % 89 + 12 + p_partkey % 17 AS DOUBLE) AS y2 FROM part)
  SELECT id, {", ".join(f"round({v}, 6) AS {c}" for c, v in _MOVED.items())}, round(x1 + (x2 - x1) * CASE WHEN id % 2 = 0 THEN 0.5 ELSE {_u(11, "id")} END, 6) AS px, round(y1 + (y2 - y1) * CASE WHEN id % 2 = 0 THEN 0.5 ELSE {_u(12, "id")} END, 6) AS py FROM b""")
def noised_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with moved corners, and a point of each: its middle or a drawn one."""
    b = part_boxes(spark, sf_dir)
    mode = F.when(F.col("id") % 2 == 0, "center").otherwise("random")
    n, p = S.noised(F.col("b"), F.lit(150), F.lit(150), 0.1, 3.0, 3, F.col("id")), S.point_in(F.col("b"), mode, 11, F.col("id"))
    return b.select("id", n.alias("n"), p.alias("p")).select("id", *[F.round(f"n.{c}", 6).alias(c) for c in _MOVED], F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"))


@query("""SELECT o_custkey, count(*) AS n_files FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderstatus = 'F' GROUP BY 1""")
def present_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.present_folders(expected, table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'"), "o_custkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS n FROM lineitem WHERE l_quantity >= 10) WHERE n <= 2""")
def best_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two best lines of each order, of those that reach the threshold."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").where("l_quantity >= 10")
    return T.best_detections(l, "l_orderkey", "l_extendedprice", ["l_partkey", "l_suppkey", "l_linenumber"], -1.0, 2).drop("l_quantity")
