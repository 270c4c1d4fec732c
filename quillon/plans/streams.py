"""Streaming queries: events read as they would grow, run over what is there; each has a batch statement in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.relational import ORACLE_SQL, QUERIES, query
from quillon.streaming import runs, sessions, states

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.read_growing(spark, sf_dir, EVENTS, glob="events.parquet")


@query("""WITH h AS (SELECT event_id, user_id, event_type <> 'error' AND value > 30 AS hit FROM events), i AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM h),
  s AS (SELECT *, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY event_id) AS BIGINT) AS streak FROM i) SELECT user_id, event_id, streak, bool_or(streak >= 4) OVER (PARTITION BY user_id ORDER BY event_id) AS confirmed FROM s""")
def stream_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("hit", (F.col("event_type") != "error") & (F.col("value") > 30))
    return runs.run_available(states.confirm(e, "user_id", "event_id", "hit", 4), "confirm")


def stream_keep_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("hit", F.col("value") > 30)
    return runs.run_available(states.keep_alive(e, "user_id", "event_id", "hit", -2, 5, 1), "keep-alive")


QUERIES["stream_keep_alive"], ORACLE_SQL["stream_keep_alive"] = stream_keep_alive, ORACLE_SQL["keep_alive_counter"]


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'error' AS gone, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c, lead(event_id, 14) OVER w AS due, max(event_id) OVER (PARTITION BY user_id) AS final FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  x AS (SELECT user_id, event_id, CASE WHEN n + 14 <= c THEN due ELSE final END AS emitted_at FROM e) SELECT x.user_id, x.event_id, x.emitted_at, (SELECT count(*) FROM e WHERE e.user_id = x.user_id AND e.gone AND e.event_id <= x.emitted_at) AS n_hidden FROM x""")
def stream_delay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event goes out 14 events after its own, or at its user's last one; error events remove themselves.

    A stream doesn't know which event is the last; the test table does.
    """
    last = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("final"))
    e = _events(spark, sf_dir).join(last, "user_id").withColumns({"is_last": F.col("event_id") == F.col("final"), "removed": F.when(F.col("event_type") == "error", F.array("event_id")).otherwise(F.array().cast("array<bigint>"))})
    out = runs.run_available(states.delayed(e, "user_id", "event_id", "is_last", "removed", 15), "delay")
    return out.select("user_id", "event_id", "emitted_at", F.size("hidden").cast("long").alias("n_hidden"))


@query("""SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of the windows that the watermark has closed."""
    out = runs.run_available(runs.windowed_counts(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "1 hour", "1 day"), "windows")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def stream_hot_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions, their events as frames, event types as objects; a step-by-step machine that SQL doesn't state: tests compare it with a direct one."""
    from pyspark.sql.window import Window

    e = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "event_type", "value")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    obj = F.pmod(F.xxhash64("event_type"), F.lit(1000))
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")) == 1
    at = runs.shared_path(spark, "sessions")
    none = F.array().cast("array<bigint>")
    rows = e.select("user_id", "event_type", "event_id", "value", n.alias("frame"), obj.alias("obj"), first.alias("is_new"))
    rows = rows.select("user_id", F.col("frame").cast("long").alias("frame"), F.when(F.col("is_new"), F.array("obj")).otherwise(none).alias("new"), F.when(F.col("value") > 40, F.array("obj")).otherwise(none).alias("matched"), F.when(F.col("value") <= 40, F.array("obj")).otherwise(none).alias("missed"), F.array(F.array("obj", F.lit(1).cast("long"))).alias("groups"))
    rows.write.parquet(at)
    stream = runs.read_growing(spark, at, rows.schema)
    return runs.run_available(states.hot_start(stream, "user_id", "frame"), "hot-start")


QUERIES["stream_hot_start"] = stream_hot_start


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest value of each user and type, kept in versions by replayable micro-batches."""
    at = runs.shared_path(spark, "upsert")
    e = _events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"))

    runs.upsert_into(e, f"{at}/out", f"{at}/state", ["user_id", "event_type"], every=1, mode="update").awaitTermination()
    return runs.current(spark, f"{at}/out", ["user_id", "event_type"]).select("user_id", "event_type", "value")


QUERIES["stream_upsert"] = stream_upsert
ORACLE_SQL["stream_upsert"] = "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2"


# Conversations as tracking sessions: a turn is a frame and brings an object of its number, long texts lose what is there.
_SESSIONS_SQL = """f AS (SELECT conv_id AS k, turn AS f, length(text) % 3 = 0 AS lost, length(text) % 4 = 0 AS drops, turn = max(turn) OVER (PARTITION BY conv_id) AS final FROM conversations)"""


def _sessions(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """The frames, written to a folder and read as they would grow."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("k"), F.col("turn").alias("f"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn)").alias("at"), F.length("text").alias("n"))
    last = rows.groupBy("k").agg(F.max("f").alias("final"))
    rows = rows.join(last, "k").select("k", "f", "at", *[v.alias(c) for c, v in columns.items()])
    at = runs.shared_path(spark, "frames")
    rows.write.parquet(at)
    return runs.read_growing(spark, at, rows.schema)


@query(f"""WITH {_SESSIONS_SQL}, o AS (SELECT a.k, a.f AS object, b.f, sum(CASE WHEN b.lost AND b.f > a.f THEN 1 ELSE 0 END) OVER w AS missed, sum(CASE WHEN b.f = a.f THEN 1 WHEN b.lost THEN -1 ELSE 1 END) OVER w AS alive FROM f a JOIN f b ON a.k = b.k AND b.f >= a.f WINDOW w AS (PARTITION BY a.k, a.f ORDER BY b.f)),
  gone AS (SELECT k, object, min(f) AS at FROM o WHERE missed >= 2 AND f < object + 5 GROUP BY 1, 2)
  SELECT f.k, f.f, coalesce((SELECT list(object ORDER BY object) FROM gone WHERE gone.k = f.k AND gone.at = f.f), []) AS removed,
    coalesce((SELECT list(o.object ORDER BY o.object) FROM o LEFT JOIN gone g ON g.k = o.k AND g.object = o.object WHERE o.k = f.k AND o.f = f.f AND o.missed > 0 AND o.alive <= 0 AND (g.at IS NULL OR g.at > f.f)), []) AS suppressed FROM f""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that a session removes and suppresses, frame by frame, with typed state."""
    none, earlier = F.array().cast("array<bigint>"), F.when(F.col("f") > 0, F.sequence(F.lit(0).cast("long"), F.col("f") - 1)).otherwise(F.array().cast("array<bigint>"))
    lost = F.col("n") % 3 == 0
    frames = _sessions(spark, sf_dir, new=F.array("f"), matched=F.when(lost, none).otherwise(earlier), missed=F.when(lost, earlier).otherwise(none), empty=none, occluded=none, gone=none, groups=F.array().cast("array<array<bigint>>"))
    rules = sessions.Rules(delay=5, unmatched=2, low=-(1 << 20), high=1 << 20, start=1)
    with sessions.typed_state(spark):
        return runs.run_available(sessions.hot_start(frames, "k", "f", "at", rules), "sessions").select("k", "f", "removed", "suppressed")


@query(f"""WITH {_SESSIONS_SQL}, e AS (SELECT k, f, least(f + 2, (SELECT max(f) FROM f m WHERE m.k = f.k)) AS emitted_at FROM f),
  x AS (SELECT k, f, emitted_at, unnest([f, f + 1, f + 2]) AS object FROM e), y AS (SELECT x.*, EXISTS (SELECT 1 FROM f d WHERE d.k = x.k AND d.drops AND d.f <= x.emitted_at AND d.f + 1 = x.object) AS gone FROM x)
  SELECT k, f, emitted_at, coalesce(list(object ORDER BY object) FILTER (NOT gone), []) AS objects FROM y GROUP BY ALL""")
def stream_delayed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that go out two later, without what was removed meanwhile, with typed state."""
    f = F.col("f")
    frames = _sessions(spark, sf_dir, objects=F.array(f, f + 1, f + 2), removed=F.when(F.col("n") % 4 == 0, F.array(f + 1)), last=f == F.col("final"))
    with sessions.typed_state(spark):
        return runs.run_available(sessions.delayed_output(frames, "k", "f", "at", delay=3), "delayed").select("k", "f", "emitted_at", "objects")
