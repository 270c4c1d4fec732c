"""Queries over the choices around annotation cases, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import masks as M
from quillon.operators import cases as C
from quillon.plans.relational import query
from quillon.plans.tables import table


@query("""SELECT user_id, event_type AS view, min(event_id) AS frame FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'signup' THEN 0 WHEN starts_with(event_type, 'p') THEN 1 ELSE 2 END, event_type) = 1""")
def choose_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_type", "event_id").select("user_id", F.col("event_type").alias("view"), F.col("event_id").alias("frame"))
    return C.choose_source(e, ["user_id"], "view", "frame", "signup", "p")


@query("""SELECT user_id, min(event_type) FILTER (WHERE starts_with(event_type, 'v')) AS source, count(DISTINCT event_type) FILTER (WHERE NOT starts_with(event_type, 'v')) AS n_targets FROM events GROUP BY 1""")
def split_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = C.split_views(table(spark, sf_dir, "events", "user_id", "event_type"), ["user_id"], "event_type", "v")
    return v.select("user_id", "source", F.size("targets").cast("long").alias("n_targets"))


@query("""SELECT user_id, CAST(floor((n - 1) / 16) AS BIGINT) AS page, arg_min(event_id, n) AS first, arg_max(event_id, n) AS last, count(*) AS n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY 1, 2""")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.page_bounds(table(spark, sf_dir, "events", "user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], "event_id", 16)


@query("""WITH w AS (SELECT user_id, min(event_id) AS o FROM events WHERE value > 95 GROUP BY 1) SELECT u.user_id, e.value, (SELECT arg_max(x.event_type, x.event_id) FROM events x WHERE x.user_id = u.user_id AND x.value <= 95 AND (w.o IS NULL OR x.event_id < w.o)) AS error
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN w USING (user_id) LEFT JOIN events e ON e.event_id = w.o""")
def first_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value")
    return C.first_success(e, ["user_id"], "event_id", F.col("value") > 95, F.col("value"), F.col("event_type"))


@query("""SELECT event_id, i.n AS index FROM events JOIN (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS n FROM events GROUP BY 1, 2) i USING (user_id, event_type)""")
def first_seen_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = C.first_seen_index(table(spark, sf_dir, "events", "user_id", "event_id", "event_type"), ["user_id"], "event_id", "event_type")
    return e.select("event_id", F.col("index").cast("long").alias("index"))


@query("""WITH b AS (SELECT p_partkey // 20 AS grp, p_partkey % 20 AS x, p_partkey % 30 AS y, 1 + p_size % 12 AS w, 1 + p_size % 9 AS h FROM part), c AS (SELECT grp, y, h, unnest(range(x, x + w)) AS px FROM b), p AS (SELECT DISTINCT grp, px, unnest(range(y, y + h)) AS py FROM c)
  SELECT grp, count(*) AS pixels FROM p GROUP BY 1""")
def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as run-length masks in 40 by 40 images, united per twenty keys."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("grp", F.floor(F.col("p_partkey") / 20))
    k, s = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    runs = C.box_runs(k % 20, k % 30, 1 + s % 12, 1 + s % 9, 40, 40)
    return C.mask_union(p.select("grp", runs.alias("runs")), ["grp"], "runs")


@query("""SELECT p_partkey, (1 + p_size % 12) * (1 + p_size % 9) AS area, [p_partkey % 20, p_partkey % 30, p_partkey % 20 + p_size % 12, p_partkey % 30 + p_size % 9] AS bounds FROM part""")
def box_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes to runs and back to their area and bounds (far edges inclusive)."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size")
    k, s = F.col("p_partkey").cast("int"), F.col("p_size").cast("int")
    runs = p.select("p_partkey", C.box_runs(k % 20, k % 30, 1 + s % 12, 1 + s % 9, 40, 40).alias("runs"))
    return runs.select("p_partkey", M.area(F.col("runs")).alias("area"), M.bounds(F.col("runs"), F.lit(40)).alias("bounds"))


@query("""WITH f AS (SELECT l_orderkey % 97 AS video, l_suppkey % 7 AS cls, l_partkey AS det FROM lineitem GROUP BY ALL), m AS (SELECT * FROM f WHERE det % 3 = 0), neg AS (SELECT DISTINCT video, cls FROM f WHERE (video + cls) % 2 = 0), inc AS (SELECT DISTINCT video, cls FROM f WHERE (video * cls) % 5 = 1)
  SELECT video, cls, count(*) AS n FROM f WHERE det % 3 = 0 OR (EXISTS (SELECT 1 FROM neg WHERE neg.video = f.video AND neg.cls = f.cls) AND NOT EXISTS (SELECT 1 FROM inc WHERE inc.video = f.video AND inc.cls = f.cls)) GROUP BY 1, 2""")
def open_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_partkey").select((F.col("l_orderkey") % 97).alias("video"), (F.col("l_suppkey") % 7).alias("cls"), F.col("l_partkey").alias("det")).distinct()
    pairs = f.select("video", "cls").distinct()
    kept = C.open_world(f, f.where("det % 3 = 0"), pairs.where("(video + cls) % 2 = 0"), pairs.where("(video * cls) % 5 = 1"), ["video", "cls", "det"], "video", "cls")
    return kept.groupBy("video", "cls").agg(F.count("*").alias("n"))
