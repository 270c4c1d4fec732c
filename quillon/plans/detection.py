"""Queries over boxes, masks, suppression, matching and metrics, with their SQL.

part plays scored boxes of images; where a metric needs an assignment, the
boxes lie on a grid so that each detection meets one ground truth at most and
SQL can state the result.  Assignments proper are tested by brute force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import boxes as B
from quillon.functions import masks as M
from quillon.functions import text as X
from quillon.operators import filters as L
from quillon.operators import matching as H
from quillon.operators import metrics as E
from quillon.operators import suppression as S
from quillon.operators import tracks as T
from quillon.operators import windows as W
from quillon.operators.partitions import tasks_for
from quillon.plans.relational import ORACLE_SQL, QUERIES, query
from quillon.plans.tables import BOXES_SQL, part_boxes, table

#: Pairs of boxes meet on a grid of this cell size.
CELL = 24.0
#: Boxes of a task; each is a row in four to five cells.
EACH = 50_000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "part"), EACH)


def _round(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {BOXES_SQL} SELECT grp, a, b, round(inter / (aa + ab - inter), 6) AS iou, round(inter / (aa + ab - inter) - (hull - (aa + ab - inter)) / hull, 6) AS giou,
    round(inter / aa, 6) AS ioa, round(inter / (least(aa, ab) + 1e-8), 6) AS iom FROM pairs WHERE a < b AND inter / (aa + ab - inter) > 0.2""")
def box_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = S.group_pairs(part_boxes(spark, sf_dir), ["grp"], "id", ["b"], CELL, "b", _tasks(spark, sf_dir))
    a, b = F.col("a.b"), F.col("b.b")
    out = p.select("grp", F.col("a.item").alias("a"), F.col("b.item").alias("b"), B.iou(a, b).alias("iou"), B.giou(a, b).alias("giou"), B.ioa(a, b).alias("ioa"), B.iom(a, b).alias("iom"))
    return out.where("iou > 0.2").select("grp", "a", "b", *_round("iou", "giou", "ioa", "iom"))


def _ranked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.ranked(part_boxes(spark, sf_dir), ["grp"], "score", ["id"])


def _ranked_sql(condition: str) -> str:
    return f"""{BOXES_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, id) AS rank FROM boxes),
      against AS (SELECT p.grp, x.rank AS winner, y.rank AS loser FROM pairs p JOIN ranked x ON x.id = p.a JOIN ranked y ON y.id = p.b WHERE x.rank < y.rank AND {condition})"""


@query(f"""WITH {_ranked_sql("inter / (aa + ab - inter) > 0.4")} SELECT r.id, r.rank FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM against t WHERE t.grp = r.grp AND t.loser = r.rank)""")
def nms_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked_boxes(spark, sf_dir)
    return S.fast_nms(r, ["grp"], "id", S.conflicts(r, ["grp"], "id", "rank", "b", B.iou, 0.4, cell=CELL, tasks=_tasks(spark, sf_dir))).select("id", F.col("rank").cast("long").alias("rank"))


def _greedy_sql(condition: str, select: str) -> str:
    return f"""WITH RECURSIVE {_ranked_sql(condition)},
      listed AS (SELECT r.grp, r.id, r.rank, coalesce(t.w, CAST([] AS BIGINT[])) AS w FROM ranked r LEFT JOIN (SELECT grp, loser, list(winner) AS w FROM against GROUP BY 1, 2) t ON t.grp = r.grp AND t.loser = r.rank),
      fold AS (SELECT grp, rank, [rank] AS kept FROM listed WHERE rank = 1
        UNION ALL SELECT l.grp, l.rank, CASE WHEN list_has_any(f.kept, l.w) THEN f.kept ELSE list_append(f.kept, l.rank) END FROM fold f JOIN listed l ON l.grp = f.grp AND l.rank = f.rank + 1),
      done AS (SELECT grp, arg_max(kept, rank) AS kept FROM fold GROUP BY grp)
      {select}"""


@query(_greedy_sql("inter / (aa + ab - inter) > 0.4", "SELECT l.id, l.rank FROM listed l JOIN done d ON d.grp = l.grp WHERE list_contains(d.kept, l.rank)"))
def nms_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked_boxes(spark, sf_dir)
    return S.greedy_nms(r, ["grp"], "id", "rank", S.conflicts(r, ["grp"], "id", "rank", "b", B.iou, 0.4, cell=CELL, tasks=_tasks(spark, sf_dir))).select("id", F.col("rank").cast("long").alias("rank"))


@query(_greedy_sql("inter / (least(aa, ab) + 1e-8) > 0.3", "SELECT l.id, list_contains(d.kept, l.rank) AS kept FROM listed l JOIN done d ON d.grp = l.grp"))
def overlap_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both what is kept and what is removed by the share of the smaller area."""
    r = _ranked_boxes(spark, sf_dir)
    kept = S.greedy_nms(r, ["grp"], "id", "rank", S.conflicts(r, ["grp"], "id", "rank", "b", B.iom, 0.3, cell=CELL, tasks=_tasks(spark, sf_dir))).select("id", F.lit(True).alias("kept"))
    return r.select("id").join(kept, "id", "left").na.fill(False, ["kept"])


@query(_greedy_sql("inter / (aa + ab - inter) >= 0.4", "SELECT l.id, list_contains(d.kept, l.rank) AS has_box FROM listed l JOIN done d ON d.grp = l.grp"))
def frame_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppressed boxes stay as rows without a box; reaching the threshold suppresses."""
    r = _ranked_boxes(spark, sf_dir)
    kept = S.greedy_nms(r, ["grp"], "id", "rank", S.conflicts(r, ["grp"], "id", "rank", "b", B.iou, 0.4, True, CELL, _tasks(spark, sf_dir))).select("id", F.lit(True).alias("kept"))
    return r.join(kept, "id", "left").withColumn("b", F.when(F.col("kept"), F.col("b"))).select("id", F.col("b").isNotNull().alias("has_box"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as tracks: 128 keys are a video of sixteen tracks over eight frames."""
    k = F.col("id")
    return part_boxes(spark, sf_dir).select("b", "score", F.floor(k / 128).alias("video"), (F.floor(k / 8) % 16).alias("track"), (k % 8).alias("t"))


_TRACKS_SQL = """tracks AS (SELECT p_partkey // 128 AS video, p_partkey // 8 % 16 AS track, p_partkey % 8 AS t, p_retailprice AS score, CAST(p_partkey % 97 AS DOUBLE) AS x1, CAST((p_partkey * 31) % 89 AS DOUBLE) AS y1,
    CAST(p_partkey % 97 + 10 + p_size AS DOUBLE) AS x2, CAST((p_partkey * 31) % 89 + 12 + p_partkey % 17 AS DOUBLE) AS y2 FROM part),
  pairs AS (SELECT a.video, a.t, a.track AS a, b.track AS b, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
    (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab FROM tracks a JOIN tracks b ON a.video = b.video AND a.t = b.t AND a.track < b.track)"""


@query(f"""WITH {_TRACKS_SQL}, w AS (SELECT video, track, sum((x2 - x1) * (y2 - y1)) AS s FROM tracks GROUP BY 1, 2), s AS (SELECT video, a, b, sum(i) AS i, sum(aa) AS aa, sum(ab) AS ab FROM pairs GROUP BY 1, 2, 3)
  SELECT s.video, s.a, s.b, round(i / (s.aa + s.ab - i), 6) AS both_iou, round(i / (x.s + y.s - i), 6) AS any_iou FROM s JOIN w x ON x.video = s.video AND x.track = s.a JOIN w y ON y.video = s.video AND y.track = s.b""")
def track_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of tracks over the frames of both, and over those of either."""
    t = _tracks(spark, sf_dir)
    both = S.track_overlap(t, ["video"], "track", "t", "b", B.intersection, B.area, True).withColumnRenamed("iou", "both_iou")
    either = S.track_overlap(t, ["video"], "track", "t", "b", B.intersection, B.area, False).withColumnRenamed("iou", "any_iou")
    return both.join(either, ["video", "a", "b"]).select("video", "a", "b", *_round("both_iou", "any_iou"))


@query(f"""WITH RECURSIVE {_TRACKS_SQL}, r AS (SELECT video, track, row_number() OVER (PARTITION BY video ORDER BY max(score) DESC, track) AS rank FROM tracks GROUP BY 1, 2),
  s AS (SELECT video, a, b, sum(i) / (sum(aa) + sum(ab) - sum(i)) AS iou FROM pairs GROUP BY 1, 2, 3),
  against AS (SELECT s.video, greatest(x.rank, y.rank) AS loser, list(least(x.rank, y.rank)) AS w FROM s JOIN r x ON x.video = s.video AND x.track = s.a JOIN r y ON y.video = s.video AND y.track = s.b WHERE iou >= 0.08 GROUP BY 1, 2),
  listed AS (SELECT r.*, coalesce(w, CAST([] AS BIGINT[])) AS w FROM r LEFT JOIN against g ON g.video = r.video AND g.loser = r.rank),
  fold AS (SELECT video, rank, [rank] AS kept FROM listed WHERE rank = 1 UNION ALL SELECT l.video, l.rank, CASE WHEN list_has_any(f.kept, l.w) THEN f.kept ELSE list_append(f.kept, l.rank) END FROM fold f JOIN listed l ON l.video = f.video AND l.rank = f.rank + 1),
  done AS (SELECT video, arg_max(kept, rank) AS kept FROM fold GROUP BY 1)
  SELECT l.video, l.track, count(*) AS n_frames, list_contains(any_value(d.kept), any_value(l.rank)) AS kept FROM listed l JOIN done d ON d.video = l.video JOIN tracks t ON t.video = l.video AND t.track = l.track GROUP BY 1, 2""")
def track_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tracks(spark, sf_dir)
    scores = t.groupBy("video", "track").agg(F.max("score").alias("score"))
    out = S.track_nms(t, scores, ["video"], "track", "t", "b", "score", B.intersection, B.area, 0.08)
    return out.groupBy("video", "track").agg(F.count("*").alias("n_frames"), (F.count("b") > 0).alias("kept"))


def assignment_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the best one-to-one assignment of even to odd boxes: pairs and total overlap. No SQL can state an optimum; tests compare it with brute force."""
    p = S.group_pairs(part_boxes(spark, sf_dir), ["grp"], "id", ["b"], CELL, "b", _tasks(spark, sf_dir))
    a, b = F.col("a"), F.col("b")
    pairs = p.where((a["item"] + b["item"]) % 2 == 1).select("grp", F.when(a["item"] % 2 == 0, a["item"]).otherwise(b["item"]).alias("g"), F.when(a["item"] % 2 == 0, b["item"]).otherwise(a["item"]).alias("d"), B.iou(a["b"], b["b"]).alias("iou"))
    return H.assign(pairs, ["grp"], "g", "d", "iou").groupBy("grp").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("total"))


QUERIES["assignment_total"] = assignment_total


# Ground truth k of an image lies at (100 k, 0), 40 wide and high; its detection is shifted by s both ways.
_IOU = "(40.0 - s) * (40.0 - s) / (3200.0 - (40.0 - s) * (40.0 - s))"
_GRID_SQL = f"""g AS (SELECT DISTINCT l_orderkey AS image, l_partkey % 3 AS phrase, l_suppkey % 11 AS gt FROM lineitem),
  d0 AS (SELECT l_orderkey AS image, l_partkey % 3 AS phrase, (l_suppkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) % 11 AS dt, CAST(max(l_quantity) / 50.0 AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2, 3),
  d AS (SELECT *, (image * 7 + dt * 5 + phrase) % 23 AS s FROM d0),
  o AS (SELECT g.image, g.phrase, g.gt, d.dt, d.score, {_IOU} AS iou FROM g JOIN d ON g.image = d.image AND g.phrase = d.phrase AND g.gt = d.dt)"""


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground truths, detections (every third line's beside its ground truth) and the overlaps of those that meet."""
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    beside = F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    rows = l.select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).alias("phrase"), (F.col("l_suppkey") % 11).alias("item"), ((F.col("l_suppkey") + beside) % 11).alias("found"), (F.col("l_quantity") / 50.0).alias("q"))
    g = rows.select("image", "phrase", F.col("item").alias("gt")).distinct()
    d = rows.groupBy("image", "phrase", F.col("found").alias("dt")).agg(F.max("q").alias("score"))
    # Boxes follow from the keys: made after the join, they are in no shuffle.
    shift = ((F.col("image") * 7 + F.col("dt") * 5 + F.col("phrase")) % 23).cast("double")
    side = F.lit(40.0)
    iou = B.iou(B.from_xywh(F.col("gt") * 100.0, F.lit(0.0), side, side), B.from_xywh(F.col("dt") * 100.0 + shift, shift, side, side))
    o = g.join(d, ["image", "phrase"]).withColumn("iou", iou).where("iou > 0").select("image", "phrase", "gt", "dt", "score", "iou")
    return g, d, o


_LEVELS = ", ".join(f"{x:.2f}" for x in E.BOX_LEVELS)
_UNITS_SQL = f"""{_GRID_SQL}, f AS (SELECT * FROM d WHERE score >= 0.5), u AS (SELECT DISTINCT l_orderkey AS image, l_partkey % 3 AS phrase FROM lineitem),
  levels AS (SELECT CAST(unnest([{_LEVELS}]) AS DOUBLE) AS threshold),
  n AS (SELECT u.*, (SELECT count(*) FROM g WHERE g.image = u.image AND g.phrase = u.phrase) AS n_gt, (SELECT count(*) FROM f WHERE f.image = u.image AND f.phrase = u.phrase) AS n_dt FROM u),
  c AS (SELECT n.*, threshold, (SELECT count(*) FROM o WHERE o.score >= 0.5 AND o.image = n.image AND o.phrase = n.phrase AND o.iou >= threshold) AS tp FROM n CROSS JOIN levels),
  units AS (SELECT *, n_dt - tp AS fp, n_gt - tp AS fn, CASE WHEN n_gt > 0 OR n_dt > 0 THEN 2 * (tp / (n_dt + 1e-4)) * (tp / (n_gt + 1e-4)) / (tp / (n_dt + 1e-4) + tp / (n_gt + 1e-4) + 1e-4) END AS f1 FROM c)"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, d, o = _grid(spark, sf_dir)
    units = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey").select(F.col("l_orderkey").alias("image"), (F.col("l_partkey") % 3).alias("phrase"))
    return E.phrase_units(units, g, d.where("score >= 0.5"), o.where("score >= 0.5"), ["image", "phrase"])


@query(f"WITH {_UNITS_SQL} SELECT image, phrase, round(threshold, 2) AS threshold, n_gt, n_dt, tp, fp, fn, round(f1, 6) AS f1 FROM units")
def phrase_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _units(spark, sf_dir).select("image", "phrase", F.round("threshold", 2).alias("threshold"), "n_gt", "n_dt", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(f"""WITH {_UNITS_SQL}, s AS (SELECT threshold, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(CASE WHEN n_gt > 0 THEN fp ELSE 0 END) AS DOUBLE) AS pfp, sum(f1) FILTER (WHERE n_gt > 0) AS f1s,
    CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt > 0) AS DOUBLE) AS itp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt > 0) AS DOUBLE) AS ifp, CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt = 0) AS DOUBLE) AS ifn, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt = 0) AS DOUBLE) AS itn FROM units GROUP BY threshold),
  m AS (SELECT *, tp / (tp + pfp + 1e-4) AS pp, tp / (tp + fn + 1e-4) AS r, tp / (tp + fp + 1e-4) AS p, (itp * itn - ifp * ifn) / (sqrt((itp + ifp) * (itp + ifn) * (itn + ifp) * (itn + ifn)) + 1e-6) AS mcc FROM s)
  SELECT round(threshold, 2) AS threshold, round(2 * p * r / (p + r + 1e-4), 6) AS micro_f1, round(2 * pp * r / (pp + r + 1e-4), 6) AS positive_f1, round(f1s / nullif(itp, 0), 6) AS macro_f1, round(mcc, 6) AS il_mcc, round(2 * pp * r / (pp + r + 1e-4) * mcc, 6) AS cgf1 FROM m""")
def phrase_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.phrase_summary(_units(spark, sf_dir)).select(F.round("threshold", 2).alias("threshold"), *_round("micro_f1", "positive_f1", "macro_f1", "il_mcc", "cgf1"))


@query(f"""WITH {_UNITS_SQL}, a AS (SELECT image, phrase % 1 AS phrase, phrase AS annotator, avg(f1) AS m FROM units GROUP BY ALL)
  SELECT image, CAST(coalesce(max(annotator) FILTER (WHERE m IS NULL), arg_min(annotator, (-m, annotator))) AS BIGINT) AS annotator FROM a GROUP BY image""")
def best_annotator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of an image play its annotators."""
    u = _units(spark, sf_dir).withColumnRenamed("phrase", "annotator")
    return E.best_annotator(u, ["image"], "annotator").select("image", F.col("annotator").cast("long").alias("annotator")).distinct()


@query(f"""WITH {_GRID_SQL}, m AS (SELECT d.phrase AS category, threshold, d.score, d.image * 100 + d.dt AS ord, coalesce(o.iou >= threshold, false) AS hit FROM d CROSS JOIN (SELECT CAST(unnest([0.5, 0.75]) AS DOUBLE) AS threshold) LEFT JOIN o ON o.image = d.image AND o.phrase = d.phrase AND o.dt = d.dt),
  n AS (SELECT phrase AS category, count(*) AS n FROM g GROUP BY 1),
  c AS (SELECT m.*, n.n, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS k FROM m JOIN n USING (category) WINDOW w AS (PARTITION BY m.category, threshold ORDER BY score DESC, ord)),
  e AS (SELECT *, tp / n AS recall, max(tp / k) OVER (PARTITION BY category, threshold ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c),
  r AS (SELECT category, threshold, j, (SELECT arg_min(e.env, e.k) FROM e WHERE e.category = x.category AND e.threshold = x.threshold AND e.recall >= j / 100.0 - 1e-11) AS p FROM (SELECT DISTINCT category, threshold FROM e) x CROSS JOIN range(101) t(j))
  SELECT r.category, r.threshold, round(sum(coalesce(p, 0)) / 101, 6) AS ap, round(any_value(q.recall), 6) AS recall FROM r JOIN (SELECT category, threshold, max(recall) AS recall FROM e GROUP BY 1, 2) q ON q.category = r.category AND q.threshold = r.threshold GROUP BY 1, 2""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, d, o = _grid(spark, sf_dir)
    truth = g.select("image", "phrase", "gt", F.lit(False).alias("ignore"), F.lit(False).alias("crowd"))
    found = d.select("image", "phrase", F.col("dt").alias("det"), "score")
    m = H.match_flags(truth, found, o.select("image", "phrase", "gt", F.col("dt").alias("det"), "iou"), ["image", "phrase"], [0.5, 0.75])
    m = m.withColumnRenamed("phrase", "category").withColumn("ord", F.col("image") * 100 + F.col("det"))
    levels = F.array(*[F.struct(F.lit(i).alias("case"), F.lit(t).alias("threshold")) for i, t in enumerate((0.5, 0.75))])
    n = g.groupBy(F.col("phrase").alias("category")).agg(F.count("*").alias("n")).withColumn("case", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return E.precision_curves(m, n, ["category"], 2).select("category", F.get(levels, F.col("case"))["threshold"].alias("threshold"), *_round("ap", "recall"))


# events as detections: sequence the user, time the day, ids the hour's residue; ids correspond with a switch on day 15.
_SEQ_SQL = """ev AS (SELECT user_id AS seq, date_diff('day', TIMESTAMP '2024-01-01', ts) AS t, hour(ts) % 6 AS item, event_type FROM events),
  g AS (SELECT DISTINCT seq, t, item AS gt FROM ev WHERE event_type IN ('view', 'click')), k AS (SELECT DISTINCT seq, t, item AS trk FROM ev WHERE event_type NOT IN ('view', 'click')),
  s AS (SELECT g.seq, g.t, gt, trk, 0.31 + 0.1 * ((g.seq + g.t) % 7) AS sim FROM g JOIN k ON g.seq = k.seq AND g.t = k.t AND gt = (trk + CASE WHEN g.t > 15 THEN 1 ELSE 0 END) % 6)"""


def _sequences(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events", "user_id", "ts", "event_type").select(F.col("user_id").alias("seq"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("t"), (F.hour("ts") % 6).alias("item"), "event_type")
    seen = F.col("event_type").isin("view", "click")
    g, k = ev.where(seen).select("seq", "t", F.col("item").alias("gt")).distinct(), ev.where(~seen).select("seq", "t", F.col("item").alias("trk")).distinct()
    fits = F.col("gt") == (F.col("trk") + F.when(F.col("t") > 15, 1).otherwise(0)) % 6
    s = g.join(k, ["seq", "t"]).where(fits).withColumn("sim", 0.31 + 0.1 * ((F.col("seq") + F.col("t")) % 7))
    return g, k, s


_HOTA_SQL = f"""WITH {_SEQ_SQL}, levels AS (SELECT j * 0.05 AS alpha FROM range(1, 20) t(j)), ng AS (SELECT seq, gt, count(*) AS n FROM g GROUP BY 1, 2), nk AS (SELECT seq, trk, count(*) AS n FROM k GROUP BY 1, 2),
  m AS (SELECT s.seq, alpha, s.gt, s.trk, count(*) AS m, sum(sim) AS ss FROM s JOIN levels ON sim >= alpha - 2.220446049250313e-16 GROUP BY 1, 2, 3, 4),
  a AS (SELECT m.seq, alpha, sum(m) AS tp, sum(ss) AS ss, sum(m * m / greatest(1, ng.n + nk.n - m)) AS aa, sum(m * m / greatest(1, ng.n)) AS ar, sum(m * m / greatest(1, nk.n)) AS ap FROM m JOIN ng ON ng.seq = m.seq AND ng.gt = m.gt JOIN nk ON nk.seq = m.seq AND nk.trk = m.trk GROUP BY 1, 2),
  q AS (SELECT seq, coalesce(x.n, 0) AS ngt, coalesce(y.n, 0) AS ntk FROM (SELECT seq, count(*) AS n FROM g GROUP BY 1) x FULL JOIN (SELECT seq, count(*) AS n FROM k GROUP BY 1) y USING (seq)),
  f AS (SELECT q.seq, l.alpha, coalesce(tp, 0) AS tp, ngt - coalesce(tp, 0) AS fn, ntk - coalesce(tp, 0) AS fp, greatest(1e-10, coalesce(ss, 0)) / greatest(1e-10, coalesce(tp, 0)) AS loc_a, coalesce(aa, 0) / greatest(1, coalesce(tp, 0)) AS ass_a, coalesce(ar, 0) / greatest(1, coalesce(tp, 0)) AS ass_re, coalesce(ap, 0) / greatest(1, coalesce(tp, 0)) AS ass_pr FROM q CROSS JOIN levels l LEFT JOIN a ON a.seq = q.seq AND a.alpha = l.alpha)"""


@query(f"{_HOTA_SQL} SELECT seq, round(alpha, 2) AS alpha, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, round(loc_a, 6) AS loc_a, round(ass_a, 6) AS ass_a, round(ass_re, 6) AS ass_re, round(ass_pr, 6) AS ass_pr FROM f")
def hota_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = E.hota_sequences(*_sequences(spark, sf_dir), ["seq"])
    return h.select("seq", F.round("alpha", 2).alias("alpha"), "tp", "fn", "fp", *_round("loc_a", "ass_a", "ass_re", "ass_pr"))


@query(f"""{_HOTA_SQL}, c AS (SELECT alpha, CAST(sum(tp) AS DOUBLE) AS tp, sum(fn) AS fn, sum(fp) AS fp, greatest(1e-10, sum(loc_a * tp)) / greatest(1e-10, sum(tp)) AS loc_a, sum(ass_a * tp) / greatest(1, sum(tp)) AS ass_a, sum(ass_re * tp) / greatest(1, sum(tp)) AS ass_re, sum(ass_pr * tp) / greatest(1, sum(tp)) AS ass_pr FROM f GROUP BY alpha),
  x AS (SELECT *, tp / greatest(1, tp + fn) AS det_re, tp / greatest(1, tp + fp) AS det_pr, tp / greatest(1, tp + fn + fp) AS det_a FROM c)
  SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT avg(sqrt(det_a * ass_a)) AS hota, avg(det_a) AS det_a, avg(ass_a) AS ass_a, avg(det_re) AS det_re, avg(det_pr) AS det_pr, avg(ass_re) AS ass_re, avg(ass_pr) AS ass_pr, avg(loc_a) AS loc_a, avg(sqrt(det_re * ass_a)) AS owta FROM x) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def hota_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = E.hota_combined(E.hota_sequences(*_sequences(spark, sf_dir), ["seq"]))
    return E.long_form(E.over_levels(combined), [], E.HOTA_FIELDS).select("metric", F.round("value", 6).alias("value"))


@query(f"""WITH {_SEQ_SQL} SELECT f.seq, coalesce(dets, 0) AS dets, coalesce(ids, 0) AS ids, coalesce(gt_dets, 0) AS gt_dets, coalesce(gt_ids, 0) AS gt_ids, frames FROM (SELECT seq, count(DISTINCT t) AS frames FROM (SELECT seq, t FROM g UNION ALL SELECT seq, t FROM k) GROUP BY 1) f
  LEFT JOIN (SELECT seq, count(*) AS dets, count(DISTINCT trk) AS ids FROM k GROUP BY 1) a USING (seq) LEFT JOIN (SELECT seq, count(*) AS gt_dets, count(DISTINCT gt) AS gt_ids FROM g GROUP BY 1) b USING (seq)""")
def detection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k, _ = _sequences(spark, sf_dir)
    return E.detection_counts(g, k, ["seq"])


_TETA_SQL = f"""WITH {_SEQ_SQL}, gc AS (SELECT *, gt % 2 AS cls FROM g), kc AS (SELECT *, (trk + seq) % 2 AS cls FROM k), levels AS (SELECT j * 0.05 AS alpha FROM range(20) t(j)),
  sc AS (SELECT s.*, gc.cls FROM s JOIN gc ON gc.seq = s.seq AND gc.t = s.t AND gc.gt = s.gt), close AS (SELECT DISTINCT seq, cls, t, trk FROM sc WHERE sim >= 0.5), pool AS (SELECT DISTINCT seq, cls, trk FROM close),
  mine AS (SELECT sc.* FROM sc JOIN pool USING (seq, cls, trk)), ng AS (SELECT seq, cls, gt, count(*) AS n FROM gc GROUP BY ALL), nk AS (SELECT pool.seq, pool.cls, pool.trk, count(*) AS n FROM pool JOIN k ON k.seq = pool.seq AND k.trk = pool.trk GROUP BY ALL),
  r AS (SELECT mine.*, alpha, kc.cls AS kcls FROM mine JOIN levels ON sim >= alpha - 2.220446049250313e-16 JOIN kc ON kc.seq = mine.seq AND kc.t = mine.t AND kc.trk = mine.trk),
  m AS (SELECT seq, cls, alpha, gt, trk, count(*) AS m FROM r GROUP BY ALL),
  a AS (SELECT m.seq, m.cls, alpha, sum(m) AS tp, sum(m * m / greatest(1, ng.n + nk.n - m)) AS aa FROM m JOIN ng ON ng.seq = m.seq AND ng.cls = m.cls AND ng.gt = m.gt JOIN nk ON nk.seq = m.seq AND nk.cls = m.cls AND nk.trk = m.trk GROUP BY 1, 2, 3),
  c AS (SELECT seq, cls, alpha, count(*) FILTER (WHERE kcls = cls) AS ctp, count(*) FILTER (WHERE kcls <> cls) AS cfn FROM r GROUP BY 1, 2, 3), w AS (SELECT seq, kcls AS cls, alpha, count(*) AS cfp FROM r WHERE kcls <> cls GROUP BY 1, 2, 3),
  tk AS (SELECT r.seq, r.cls, alpha, count(*) AS taken FROM r JOIN close ON close.seq = r.seq AND close.cls = r.cls AND close.t = r.t AND close.trk = r.trk GROUP BY 1, 2, 3),
  e AS (SELECT seq, cls, count(*) AS n FROM gc GROUP BY 1, 2), nc AS (SELECT seq, cls, count(*) AS n FROM close GROUP BY 1, 2), keys AS (SELECT seq, cls, alpha FROM e CROSS JOIN levels UNION SELECT seq, cls, alpha FROM w),
  f AS (SELECT keys.seq, keys.cls, keys.alpha, coalesce(tp, 0) AS loc_tp, coalesce(e.n, 0) - coalesce(tp, 0) AS loc_fn, CASE WHEN e.n IS NULL THEN 0 ELSE coalesce(nc.n - coalesce(taken, 0), 0) END AS loc_fp, coalesce(aa, 0) / greatest(1, coalesce(tp, 0)) AS assoc_a,
      CASE WHEN keys.alpha >= 0.4999999 THEN coalesce(ctp, 0) ELSE 0 END AS cls_tp, CASE WHEN keys.alpha >= 0.4999999 THEN coalesce(cfn, 0) ELSE 0 END AS cls_fn, CASE WHEN keys.alpha >= 0.4999999 THEN coalesce(cfp, 0) ELSE 0 END AS cls_fp
    FROM keys LEFT JOIN e USING (seq, cls) LEFT JOIN nc USING (seq, cls) LEFT JOIN a USING (seq, cls, alpha) LEFT JOIN c USING (seq, cls, alpha) LEFT JOIN tk USING (seq, cls, alpha) LEFT JOIN w USING (seq, cls, alpha))"""


def _teta(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, k, s = _sequences(spark, sf_dir)
    return E.teta_sequences(g.withColumn("cls", F.col("gt") % 2), k.withColumn("cls", (F.col("trk") + F.col("seq")) % 2), s, ["seq"])


@query(f"{_TETA_SQL} SELECT seq, CAST(cls AS BIGINT) AS cls, round(alpha, 2) AS alpha, CAST(loc_tp AS BIGINT) AS loc_tp, CAST(loc_fn AS BIGINT) AS loc_fn, CAST(loc_fp AS BIGINT) AS loc_fp, round(assoc_a, 6) AS assoc_a, CAST(cls_tp AS BIGINT) AS cls_tp, CAST(cls_fn AS BIGINT) AS cls_fn, CAST(cls_fp AS BIGINT) AS cls_fp FROM f")
def teta_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _teta(spark, sf_dir).select("seq", F.col("cls").cast("long").alias("cls"), F.round("alpha", 2).alias("alpha"), *[F.col(c).cast("long").alias(c) for c in ("loc_tp", "loc_fn", "loc_fp")], F.round("assoc_a", 6).alias("assoc_a"), "cls_tp", "cls_fn", "cls_fp")


@query(f"""{_TETA_SQL}, x AS (SELECT cls, alpha, sum(loc_tp) / greatest(1, sum(loc_tp + loc_fn + loc_fp)) AS loc_a, sum(assoc_a * loc_tp) / greatest(1, sum(loc_tp)) AS assoc_a, sum(cls_tp) / greatest(1, sum(cls_tp + cls_fn + cls_fp)) AS cls_a FROM f GROUP BY 1, 2),
  y AS (SELECT cls, avg(loc_a) AS loc_a, avg(assoc_a) AS assoc_a, avg(cls_a) FILTER (WHERE alpha >= 0.4999999) AS cls_a FROM x GROUP BY 1)
  SELECT CAST(cls AS BIGINT) AS cls, round(loc_a, 6) AS loc_a, round(assoc_a, 6) AS assoc_a, round(cls_a, 6) AS cls_a, round((loc_a + assoc_a + cls_a) / 3, 6) AS teta FROM y""")
def teta_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.teta_scores(_teta(spark, sf_dir), ["cls"]).select(F.col("cls").cast("long").alias("cls"), *_round("loc_a", "assoc_a", "cls_a", "teta"))


@query("""WITH d AS (SELECT l_orderkey AS frame, l_partkey % 13 AS det, max(l_extendedprice) / 100000.0 AS score FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), k AS (SELECT l_orderkey AS frame, l_suppkey % 13 AS trk, bool_or(l_tax > 0.01) AS nonempty FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2),
  o AS (SELECT d.frame, det, trk, ((d.frame * 3 + det * 7 + trk * 11) % 20) / 20.0 AS iou FROM d JOIN k ON d.frame = k.frame), f AS (SELECT frame, det FROM d WHERE score >= 0.7 AND NOT EXISTS (SELECT 1 FROM o WHERE o.frame = d.frame AND o.det = d.det AND iou >= 0.9)),
  u AS (SELECT frame, trk FROM k WHERE nonempty AND NOT EXISTS (SELECT 1 FROM o WHERE o.frame = k.frame AND o.trk = k.trk AND iou >= 0.9)),
  s AS (SELECT *, count(*) OVER (PARTITION BY frame, det) AS nd, count(*) OVER (PARTITION BY frame, trk) AS nk FROM o WHERE iou >= 0.8)
  SELECT 'new' AS kind, frame, det AS item FROM f UNION ALL SELECT 'unmatched', frame, trk FROM u UNION ALL SELECT 'recondition', s.frame, s.trk FROM s JOIN d ON d.frame = s.frame AND d.det = s.det WHERE nd = 1 AND nk = 1 AND d.score >= 0.8 AND NOT EXISTS (SELECT 1 FROM f WHERE f.frame = d.frame AND f.det = d.det)""")
def associate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_tax").withColumn("frame", F.col("l_orderkey"))
    d = l.where("l_linenumber <= 3").groupBy("frame", (F.col("l_partkey") % 13).alias("det")).agg((F.max("l_extendedprice") / 100000.0).alias("score")).withColumn("kept", F.lit(True))
    k = l.where("l_linenumber > 3").groupBy("frame", (F.col("l_suppkey") % 13).alias("trk")).agg(F.bool_or(F.col("l_tax") > 0.01).alias("nonempty"))
    o = d.select("frame", "det").join(k.select("frame", "trk"), "frame").withColumn("iou", ((F.col("frame") * 3 + F.col("det") * 7 + F.col("trk") * 11) % 20) / 20.0)
    fresh, lost, best = H.associate(d, k, o, ["frame"], 0.7, 0.9, 0.9)
    named = [(fresh, "new", "det"), (lost, "unmatched", "trk"), (best, "recondition", "trk")]
    parts = [t.select(F.lit(n).alias("kind"), "frame", F.col(c).alias("item")) for t, n, c in named]
    return parts[0].union(parts[1]).union(parts[2])


@query("""SELECT user_id, list_sum([x FOR x, i IN runs IF i % 2 = 0]) AS n_set, len(runs) AS n_runs, runs[1] AS first_run FROM (SELECT user_id, list_concat(CASE WHEN first THEN [0] ELSE [] END, runs) AS runs FROM (SELECT user_id, list(n ORDER BY island) AS runs, arg_min(v, island) AS first FROM
    (SELECT user_id, island, any_value(v) AS v, count(*) AS n FROM (SELECT user_id, event_id, v, sum(CASE WHEN v = p THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM
      (SELECT user_id, event_id, value > 50 AS v, lag(value > 50) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)) GROUP BY 1, 2) GROUP BY 1))""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as bits, coded to runs, to text and back."""
    e = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    bits = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("value") > 50).cast("int").alias("v")))).alias("rows"))
    r = bits.select("user_id", M.encode_bits(F.transform("rows", lambda x: x["v"])).alias("runs")).withColumn("text", M.encode_text("runs")).withColumn("runs", M.decode_text("text"))
    return r.select("user_id", M.area(F.col("runs")).alias("n_set"), F.size("runs").cast("long").alias("n_runs"), F.get("runs", 0).alias("first_run"))


@query("""WITH m AS (SELECT p_partkey AS id, p_partkey // 50 AS grp, p_partkey % 40 AS a, 20 + p_size AS b FROM part), p AS (SELECT x.grp, x.id AS a, y.id AS b, greatest(least(x.a + x.b, y.a + y.b) - greatest(x.a, y.a), 0) AS i, x.b AS aa, y.b AS ab FROM m x JOIN m y ON x.grp = y.grp AND x.id < y.id)
  SELECT a, b, i AS shared, round(i / greatest(aa + ab - i, 1), 6) AS iou, round(i / (least(aa, ab) + 1e-8), 6) AS iom FROM p WHERE i > 0""")
def mask_overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of one run each, compared by their runs."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_size").withColumn("grp", F.floor(F.col("p_partkey") / 50))
    runs = F.array(F.col("p_partkey") % 40, (F.col("p_size") + 20).cast("long"), F.lit(500).cast("long"))
    # Intervals and areas once a mask, not once a pair.
    masks = p.select("grp", "p_partkey", M.run_intervals(runs).alias("r"), M.area(runs).alias("n"))
    pairs = S.group_pairs(masks, ["grp"], "p_partkey", ["r", "n"])
    out = pairs.withColumn("shared", M.shared_pixels(F.col("a.r"), F.col("b.r"))).where("shared > 0")
    a, b, i = F.col("a.n"), F.col("b.n"), F.col("shared")
    out = out.withColumns({"iou": (i / F.greatest(a + b - i, F.lit(1))), "iom": i / (F.least(a, b) + 1e-8)})
    return out.select(F.col("a.item").alias("a"), F.col("b.item").alias("b"), "shared", *_round("iou", "iom"))


@query("""SELECT p_partkey, [least(greatest(x / 120.0, 0), 1), least(greatest(y / 110.0, 0), 1), least(greatest((x + w) / 120.0, 0), 1), least(greatest((y + h) / 110.0, 0), 1)] AS normal, [x + w / 2, y + h / 2, w, h] AS centred, [120.0 - (x + w), y, 120.0 - x, y + h] AS flipped, w * h AS area, (x + w / 2) / 200.0 > 0.1 AND (x + w / 2) / 200.0 < 0.9 AND (y + h / 2) / 200.0 > 0.1 AND (y + h / 2) / 200.0 < 0.9 AS inner_box,
    [round_even(10 + x / 200.0 * 64, 0), round_even(5 + y / 200.0 * 48, 0)] AS cell, greatest(0, 1 - sqrt((x - y) * (x - y) + (w - h) * (w - h)) / 50.0) AS close
  FROM (SELECT p_partkey, CAST(p_partkey % 97 AS DOUBLE) AS x, CAST((p_partkey * 31) % 89 AS DOUBLE) AS y, CAST(10 + p_size AS DOUBLE) AS w, CAST(12 + p_partkey % 17 AS DOUBLE) AS h FROM part)""")
def box_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = part_boxes(spark, sf_dir)
    b = F.col("b")
    as_array = lambda x: F.array(x["x1"], x["y1"], x["x2"], x["y2"])
    xywh = B.to_xywh(b)
    near = B.scale(b, F.lit(1 / 200.0), F.lit(1 / 200.0))
    cell = B.map_to_cell(F.array(b["x1"] / 200.0, b["y1"] / 200.0, b["x2"] / 200.0, b["y2"] / 200.0), F.lit(10), F.lit(5), F.lit(64), F.lit(48))
    close = B.euclidean_similarity(F.array(F.get(xywh, 0), F.get(xywh, 2)), F.array(F.get(xywh, 1), F.get(xywh, 3)), 50.0)
    return p.select(F.col("id").alias("p_partkey"), as_array(B.normalize(b, F.lit(120.0), F.lit(110.0))).alias("normal"), B.to_cxcywh(b).alias("centred"), as_array(B.hflip(b, F.lit(120.0))).alias("flipped"), B.area(b).alias("area"), B.away_from_border(near, 0.1).alias("inner_box"), F.slice(cell, 1, 2).alias("cell"), close.alias("close"))


@query("""SELECT doc_id, CAST(pos AS INTEGER) AS t, CAST(value AS DOUBLE) AS value FROM (SELECT vec_id AS doc_id, unnest(embedding) AS value, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) WHERE value > 0.1""")
def frames_from_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumnRenamed("vec_id", "doc_id")
    return T.frames_of(e, ["doc_id"], ["embedding"]).where("embedding > 0.1").select("doc_id", "t", F.col("embedding").cast("double").alias("value"))


@query("""WITH d AS (SELECT user_id AS video, event_type AS track, hour(ts) AS t, max(value) AS score FROM events GROUP BY 1, 2, 3) SELECT video, track, round(avg(score), 6) AS score, count(*) AS n_boxes, 24 - count(*) AS n_missing FROM d GROUP BY 1, 2""")
def tracks_from_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per frame to arrays over all 24 frames: places without a row hold zero boxes and the missing score."""
    e = table(spark, sf_dir, "events", "user_id", "event_type", "ts", "value").groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("track"), F.hour("ts").alias("t")).agg(F.max("value").alias("score"))
    e = e.withColumns({"b": F.array(*[F.col("score")] * 4), "m": F.lit("x"), "label": F.col("track")})
    lengths = e.select("video").distinct().withColumn("n_frames", F.lit(24))
    t = T.tracks_of(e, lengths, "video", "track", "t", "b", "m", "score", "label")
    return t.select("video", "track", F.round("score", 6).alias("score"), F.size(F.filter("masks", lambda m: m.isNotNull())).cast("long").alias("n_boxes"), F.size(F.filter("frame_scores", lambda s: s < -1e7)).cast("long").alias("n_missing"))


_CASCADE_SQL = """q AS (SELECT o_custkey AS dp, o_orderkey AS query, o_orderkey % 4 AS stage, o_orderkey % 3 AS image, list_distinct([o_orderkey % 5, o_orderkey % 7]) AS objects FROM orders WHERE o_totalprice > 150000),
  q0 AS (SELECT * FROM q WHERE dp IN (SELECT dp FROM q WHERE stage = 0)), qs AS (SELECT *, dense_rank() OVER (PARTITION BY dp ORDER BY stage) - 1 AS ns FROM q0),
  i AS (SELECT dp, image, row_number() OVER (PARTITION BY dp ORDER BY image) - 1 AS ni FROM (SELECT DISTINCT dp, image FROM q0)),
  o AS (SELECT dp, image, object, row_number() OVER (PARTITION BY dp, image ORDER BY object) - 1 AS no FROM (SELECT DISTINCT dp, image, unnest(objects) AS object FROM q0) WHERE object <> 3)"""


@query(f"""WITH {_CASCADE_SQL}, x AS (SELECT query, sum(o.no + 1) AS s, count(o.no) AS n FROM (SELECT dp, image, query, unnest(objects) AS object FROM qs) e LEFT JOIN o USING (dp, image, object) GROUP BY 1)
  SELECT qs.dp, qs.query, qs.ns AS stage, i.ni AS image, x.n AS n_objects, CAST(coalesce(x.s, 0) AS BIGINT) AS object_sum FROM qs JOIN i USING (dp, image) JOIN x USING (query)""")
def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as datapoints, orders as queries of stages, keys' residues as images and objects."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    k = F.col("o_orderkey")
    q = o.select(F.col("o_custkey").alias("dp"), k.alias("query"), (k % 4).alias("stage"), (k % 3).alias("image"), F.array_distinct(F.array(k % 5, k % 7)).alias("objects"), "o_totalprice")
    objects = q.select("dp", "image").distinct().withColumn("object", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))))
    kept, _, _ = L.cascade_filter(q, objects, q.select("dp", "image").distinct(), F.col("o_totalprice") > 150000, F.col("object") == 3)
    total = F.aggregate("objects", F.lit(0).cast("long"), lambda s, x: s + x + 1)
    return kept.select("dp", "query", F.col("stage").cast("long").alias("stage"), F.col("image").cast("long").alias("image"), F.size("objects").cast("long").alias("n_objects"), total.alias("object_sum"))


@query("""SELECT doc_id, CASE WHEN length(trim(t)) = 0 THEN '-' ELSE trim(t) END AS shown, regexp_replace(regexp_replace('```json' || chr(10) || lang || chr(10) || '```', '^```(json)?\\s*', ''), '\\s*```$', '') AS bare, coalesce(nullif(source, ''), lang, 'none') AS first_known
  FROM (SELECT doc_id, lang, source, coalesce(source, '') AS t FROM documents)""")
def text_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    fenced = F.concat(F.lit("```json\n"), F.col("lang"), F.lit("\n```"))
    return d.select("doc_id", X.safe_text(F.col("source")).alias("shown"), X.strip_fences(fenced).alias("bare"), X.first_nonempty(F.col("source"), F.col("lang"), default="none").alias("first_known"))


@query("""WITH w AS (SELECT l_orderkey AS k, l_partkey AS owner, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) SELECT k AS place, owner FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY s DESC, owner) = 1""")
def arbitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_extendedprice").select(F.col("l_orderkey").alias("place"), F.col("l_partkey").alias("owner"), F.col("l_extendedprice").alias("s"))
    return S.arbitrate(l, ["place"], "owner", "s")


@query("""WITH o AS (SELECT user_id AS frame, event_type AS obj, max(CASE WHEN value < 20 THEN event_id ELSE -1 END) AS last FROM events GROUP BY 1, 2), p AS (SELECT a.frame, a.obj AS a, a.last AS la, b.obj AS b, b.last AS lb FROM o a JOIN o b ON a.frame = b.frame AND a.obj < b.obj)
  SELECT DISTINCT frame, CASE WHEN la > lb THEN a ELSE b END AS item FROM p WHERE (la > lb AND lb > -1) OR (lb > la AND la > -1)""")
def recent_occlusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "events", "user_id", "event_type", "event_id", "value").groupBy(F.col("user_id").alias("frame"), F.col("event_type").alias("obj")).agg(F.max(F.when(F.col("value") < 20, F.col("event_id")).otherwise(-1)).alias("last"))
    p = S.group_pairs(o, ["frame"], "obj", ["last"])
    return S.most_recently_hidden(p.select("frame", F.col("a.item").alias("a"), F.col("a.last").alias("last_a"), F.col("b.item").alias("b"), F.col("b.last").alias("last_b")), ["frame"])


@query("""WITH p AS (SELECT o_custkey AS img, o_orderkey % 2 AS gt, o_orderkey AS det, o_totalprice AS score, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_custkey, o_orderkey % 2) AS n FROM orders),
  q AS (SELECT *, greatest(0.0, 1 - CAST(3 AS DOUBLE) / n) * (n - 1) AS pl FROM p), c AS (SELECT img, gt, any_value(pl) AS pl, max(score) FILTER (WHERE i = floor(pl)) AS low, max(score) FILTER (WHERE i = ceil(pl)) AS high FROM q GROUP BY 1, 2)
  SELECT q.img, q.gt, q.det FROM q JOIN c ON c.img = q.img AND c.gt = q.gt WHERE score > low + (c.pl - floor(c.pl)) * (high - low) AND score > 50000""")
def one_to_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images with two ground truths, orders as detections."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice").select(F.col("o_custkey").alias("img"), (F.col("o_orderkey") % 2).alias("gt"), F.col("o_orderkey").alias("det"), F.col("o_totalprice").alias("score"))
    return H.one_to_many(o, ["img"], "gt", "score", 3, 50000.0).select("img", "gt", "det")


@query("""WITH n AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders WHERE o_orderpriority = '1-URGENT'), k AS (SELECT o_custkey, count(*) AS c FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1)
  SELECT n.o_custkey, n.o_orderkey FROM n LEFT JOIN k USING (o_custkey) WHERE r <= 9 - coalesce(k.c, 0)""")
def within_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as new detections beside a customer's others, at most nine in all."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    now = o.where(~urgent).groupBy("o_custkey").agg(F.count("*").alias("n"))
    return H.within_cap(o.where(urgent), now, ["o_custkey"], "o_totalprice", ["o_orderkey"], 9).select("o_custkey", "o_orderkey")


def least_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of a nation, one by one to the least loaded of four workers."""
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("load", F.floor(F.abs("s_acctbal") / 100))
    return W.deal_least_loaded(s, ["s_nationkey"], "s_suppkey", "load", 4).select("s_nationkey", "s_suppkey", "worker")


least_loaded_sql = """WITH RECURSIVE s AS (SELECT s_nationkey, s_suppkey, CAST(floor(abs(s_acctbal) / 100) AS BIGINT) AS load, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS n FROM supplier),
  r AS (SELECT s_nationkey, s_suppkey, n, 0 AS worker, [load, 0, 0, 0] AS loads FROM s WHERE n = 1
    UNION ALL SELECT s.s_nationkey, s.s_suppkey, s.n, list_position(r.loads, list_min(r.loads)) - 1, list_transform(r.loads, lambda x, i: CASE WHEN i = list_position(r.loads, list_min(r.loads)) THEN x + s.load ELSE x END) FROM r JOIN s ON s.s_nationkey = r.s_nationkey AND s.n = r.n + 1)
  SELECT s_nationkey, s_suppkey, CAST(worker AS BIGINT) AS worker FROM r"""
QUERIES["least_loaded"], ORACLE_SQL["least_loaded"] = least_loaded, least_loaded_sql


@query("""SELECT round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS top_k FROM (SELECT o_custkey, bool_or(n <= 3 AND c) AS hit FROM (SELECT o_custkey, o_orderpriority = '1-URGENT' AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderpriority = '1-URGENT' DESC) AS n FROM orders) GROUP BY 1)""")
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators.aggregates import top_share as share

    o = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderpriority").withColumn("c", F.col("o_orderpriority") == "1-URGENT")
    return share(o, "o_custkey", "o_totalprice", "c", 3).select(F.round("top_k", 6).alias("top_k"))


@query("""SELECT event_id, '$.' || k AS path, json_extract_string(props, '$.' || k) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)""")
def json_key_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.sources.annotations import json_strings

    return json_strings(table(spark, sf_dir, "events", "event_id", "props"), "event_id", "props")


@query("""WITH o AS (SELECT o_custkey AS g, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders),
  best AS (SELECT g, c FROM (SELECT DISTINCT g, c FROM o) ORDER BY c DESC, g LIMIT 1), k AS (SELECT o.item, row_number() OVER (ORDER BY o.n) - 1 AS i, count(*) OVER () AS c FROM o JOIN best USING (g) WHERE o.c <= 40 OR n BETWEEN floor(o.c * 0.05) + 1 AND o.c - floor(o.c * 0.05))
  SELECT item FROM k WHERE c <= 12 OR i IN (SELECT CAST(round_even(j * (c - 1) / 11.0, 0) AS BIGINT) FROM range(12) t(j))""")
def same_object_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group with most items (the smallest of equals), its ends trimmed, evenly sampled."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("item"), "o_orderdate")
    best = o.groupBy("g").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "g").limit(1).select("g")
    kept = W.trim_ends(o.join(best, "g", "left_semi"), ["g"], ["o_orderdate", "item"])
    return W.even_sample(kept, ["g"], ["o_orderdate", "item"], 12).select("item")


@query("""WITH w AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, user_id AS cam, event_id AS s, event_id + 7 + event_id % 5 AS e FROM events), q AS (SELECT o_orderkey AS seg, o_custkey % 15 AS cam, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 7 END AS i FROM orders),
  b AS (SELECT cam, arg_min(s, (e - s, i)) AS s FROM w GROUP BY cam)
  SELECT q.seg, coalesce(w.s, b.s) AS start FROM q LEFT JOIN w ON w.cam = q.cam AND w.i = q.i LEFT JOIN b ON b.cam = q.cam""")
def window_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A segment's window: the one it names, else the shortest of its camera, the first of equals, else none."""
    from quillon.operators.joins import resolve_windows

    e = table(spark, sf_dir, "events", "event_id", "user_id").select(F.col("user_id").alias("cam"), F.col("event_id").alias("start"), (F.col("event_id") + 7 + F.col("event_id") % 5).alias("end"))
    w = W.rank_within(e, ["cam"], ["start"], "i").withColumn("i", F.col("i") - 1)
    q = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("seg"), (F.col("o_custkey") % 15).alias("cam"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).alias("i"))
    return resolve_windows(q, w, "seg", "cam", "i", "start", "end").select("seg", "start")


@query("""SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def grouped_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as images with the ordered list of their orders, empty where they have none."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice").withColumnRenamed("o_custkey", "c_custkey")
    v = T.by_video(table(spark, sf_dir, "customer", "c_custkey"), o, "c_custkey", ["o_orderkey"])
    return v.select("c_custkey", F.size("rows").cast("long").alias("n"), F.round(F.aggregate("rows", F.lit(0.0), lambda s, r: s + r["o_totalprice"]), 2).alias("total"))
