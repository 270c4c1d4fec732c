"""Queries of tracks of masks: sixteen vectors are a video of four frames with four objects, two of which swap in the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import mask_evaluation as M
from quillon.operators import matching as H
from quillon.operators import metrics as E
from quillon.operators import runs as R
from quillon.plans.masks import _FOUND, _PIXELS, _TRUTH, _masks
from quillon.plans.relational import QUERIES, query
from quillon.plans.tables import table
from quillon.streaming.runs import shared_path

_TRACKS_SQL = f"""{_PIXELS}, gm AS (SELECT c // 16 AS video, c // 16 % 5 AS phrase, (c // 4) % 4 AS t, c % 4 AS gt, p FROM g WHERE c // 16 % 6 <> 2), dm AS (SELECT c // 16 AS video, c // 16 % 5 AS phrase, (c // 4) % 4 AS t, CASE WHEN (c // 4) % 4 = 3 AND c % 4 < 2 THEN 1 - c % 4 ELSE c % 4 END AS trk, p FROM d WHERE c // 16 % 7 <> 3),
  ga AS (SELECT video, phrase, t, gt, count(*) AS n FROM gm GROUP BY ALL), da AS (SELECT video, phrase, t, trk, count(*) AS n FROM dm GROUP BY ALL), sh AS (SELECT gm.video, gm.phrase, gm.t, gt, trk, count(*) AS n FROM gm JOIN dm ON gm.video = dm.video AND gm.t = dm.t AND gm.p = dm.p GROUP BY ALL),
  perms AS (SELECT a * 64 + b * 16 + c * 4 + d AS pid, unnest([0, 1, 2, 3]) AS gt, unnest([a, b, c, d]) AS trk FROM range(4) w(a), range(4) x(b), range(4) y(c), range(4) z(d) WHERE a <> b AND a <> c AND a <> d AND b <> c AND b <> d AND c <> d)"""

_SIM_SQL = f"""{_TRACKS_SQL}, s AS (SELECT sh.video, sh.phrase, sh.t, sh.gt, sh.trk, sh.n / (ga.n + da.n - sh.n) AS sim FROM sh JOIN ga USING (video, t, gt) JOIN da USING (video, t, trk)),
  sr AS (SELECT *, sim / (sum(sim) OVER (PARTITION BY video, t, gt) + sum(sim) OVER (PARTITION BY video, t, trk) - sim) AS share FROM s), ng AS (SELECT video, gt, count(*) AS n_g FROM ga GROUP BY ALL), nk AS (SELECT video, trk, count(*) AS n_k FROM da GROUP BY ALL),
  al AS (SELECT video, gt, trk, any_value(n_g) AS n_g, any_value(n_k) AS n_k, sum(share) / (any_value(n_g) + any_value(n_k) - sum(share)) AS al FROM sr JOIN ng USING (video, gt) JOIN nk USING (video, trk) GROUP BY ALL),
  w AS (SELECT sr.*, n_g, n_k, al * sim AS weight FROM sr JOIN al USING (video, gt, trk)), tot AS (SELECT video, t, pid, sum(weight) AS total FROM w JOIN perms USING (gt, trk) GROUP BY ALL), best AS (SELECT video, t, arg_max(pid, total) AS pid FROM tot GROUP BY ALL),
  m AS (SELECT w.* FROM w JOIN best USING (video, t) JOIN perms p ON p.pid = best.pid AND p.gt = w.gt AND p.trk = w.trk), levels AS (SELECT j::DOUBLE * 0.05::DOUBLE AS alpha FROM range(1, 20) r(j)),
  a AS (SELECT video, phrase, alpha, gt, trk, count(*)::DOUBLE AS c, sum(sim) AS ss, any_value(n_g) AS n_g, any_value(n_k) AS n_k FROM m JOIN levels ON sim >= alpha - 2.3e-16 GROUP BY ALL),
  v AS (SELECT phrase, alpha, sum(c) AS tp, sum(ss) AS ss, sum(c * c / (n_g + n_k - c)) AS ass FROM a GROUP BY ALL), n AS (SELECT phrase, (SELECT count(*) FROM ga WHERE ga.phrase = q.phrase) AS g, (SELECT count(*) FROM da WHERE da.phrase = q.phrase) AS d FROM (SELECT DISTINCT phrase FROM (SELECT phrase FROM ga UNION ALL SELECT phrase FROM da)) q),
  x AS (SELECT phrase, alpha, coalesce(tp, 0) AS tp, g, d, coalesce(ass / tp, 0) AS ass_a, CASE WHEN tp > 0 THEN ss / tp ELSE 1 END AS loc_a FROM n CROSS JOIN levels LEFT JOIN v USING (phrase, alpha))"""


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth (video, phrase, t, gt) and found (video, phrase, t, trk) masks; some videos lack one side."""
    c = F.col("c")
    video, t, o = F.floor(c / 16), F.floor(c / 4) % 4, c % 4
    swapped = F.when((t == 3) & (o < 2), 1 - o).otherwise(o)
    g = _masks(spark, sf_dir, _TRUTH).select(video.alias("video"), (video % 5).alias("phrase"), t.alias("t"), o.alias("gt"), "x", "y0", "y1").where("video % 6 <> 2")
    d = _masks(spark, sf_dir, _FOUND).select(video.alias("video"), (video % 5).alias("phrase"), t.alias("t"), swapped.alias("trk"), "x", "y0", "y1").where("video % 7 <> 3")
    return g, d


@query(f"WITH {_SIM_SQL} SELECT phrase, round(avg(sqrt(tp / greatest(1, g + d - tp) * ass_a)), 6) AS hota, round(avg(tp / greatest(1, g + d - tp)), 6) AS det_a, round(avg(ass_a), 6) AS ass_a, round(avg(loc_a), 6) AS loc_a FROM x GROUP BY 1")
def mask_hota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracking accuracy of masks by phrase."""
    out = M.hota(*_tracks(spark, sf_dir), ["video", "phrase"], ["phrase"])
    return out.select("phrase", *[F.round(n, 6).alias(n) for n in ("hota", "det_a", "ass_a", "loc_a")])


_VOLUME_SQL = f"""{_TRACKS_SQL}, vo AS (SELECT s.video, s.phrase, s.gt, s.trk, s.n / (a.n + b.n - s.n) AS iou FROM (SELECT video, phrase, gt, trk, sum(n) AS n FROM sh GROUP BY ALL) s JOIN (SELECT video, gt, sum(n) AS n FROM ga GROUP BY ALL) a USING (video, gt) JOIN (SELECT video, trk, sum(n) AS n FROM da GROUP BY ALL) b USING (video, trk))"""


@query(f"""WITH {_VOLUME_SQL}, tot AS (SELECT video, pid, sum(iou) AS total FROM vo JOIN perms USING (gt, trk) GROUP BY ALL), best AS (SELECT video, arg_max(pid, total) AS pid FROM tot GROUP BY 1), m AS (SELECT vo.* FROM vo JOIN best USING (video) JOIN perms p ON p.pid = best.pid AND p.gt = vo.gt AND p.trk = vo.trk),
  u AS (SELECT video, threshold, (SELECT count(DISTINCT gt) FROM ga WHERE ga.video = q.video) AS n_gt, (SELECT count(DISTINCT trk) FROM da WHERE da.video = q.video) AS n_dt, (SELECT count(*) FROM m WHERE m.video = q.video AND m.iou >= threshold) AS tp FROM (SELECT DISTINCT vec_id // 16 AS video FROM embeddings) q, (VALUES (0.5::DOUBLE), (0.55::DOUBLE), (0.6::DOUBLE)) l(threshold))
  SELECT video, video % 5 AS phrase, threshold, n_gt, n_dt, tp, n_dt - tp AS fp, n_gt - tp AS fn FROM u""")
def mask_phrase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tracks of masks matched by their volumes: counts per video, phrase and threshold."""
    units = table(spark, sf_dir, "embeddings", "vec_id").select(F.floor(F.col("vec_id") / 16).alias("video")).distinct().withColumn("phrase", F.col("video") % 5)
    rows = M.phrase_rows(units, *_tracks(spark, sf_dir), ["video", "phrase"])
    return rows.where("threshold < 0.61").select("video", "phrase", F.round("threshold", 2).alias("threshold"), "n_gt", "n_dt", "tp", "fp", "fn")


_SCORE_SQL = "sc AS (SELECT vec_id // 16 AS video, CASE WHEN (vec_id // 4) % 4 = 3 AND vec_id % 4 < 2 THEN 1 - vec_id % 4 ELSE vec_id % 4 END AS trk, avg(abs(embedding[64]::DOUBLE)) AS score FROM embeddings WHERE vec_id // 16 % 7 <> 3 GROUP BY ALL)"


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("vec_id")
    t, o = F.floor(c / 4) % 4, c % 4
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.floor(c / 16).alias("video"), F.when((t == 3) & (o < 2), 1 - o).otherwise(o).alias("trk"), F.abs(F.col("embedding")[63].cast("double")).alias("s"))
    return rows.where("video % 7 <> 3").groupBy("video", (F.col("video") % 5).alias("phrase"), "trk").agg(F.avg("s").alias("score"))


@query(f"""WITH RECURSIVE {_VOLUME_SQL}, {_SCORE_SQL}, levels AS (SELECT unnest([0.5, 0.55, 0.6])::DOUBLE AS threshold), d4 AS (SELECT video, trk, score, row_number() OVER (PARTITION BY video ORDER BY score DESC, trk) AS k, coalesce((SELECT list({{'iou': iou, 'gt': vo.gt}} ORDER BY iou DESC, vo.gt DESC) FROM vo WHERE vo.video = sc.video AND vo.trk = sc.trk), []) AS o FROM sc),
  walk AS (SELECT video, threshold, 0::BIGINT AS k, []::BIGINT[] AS taken, 0::BIGINT AS trk, 0::DOUBLE AS score, false AS hit FROM (SELECT DISTINCT video FROM sc), levels
    UNION ALL SELECT w.video, w.threshold, d4.k, CASE WHEN len(f) > 0 THEN list_append(w.taken, f[1].gt) ELSE w.taken END, d4.trk, d4.score, len(f) > 0 FROM walk w JOIN d4 ON d4.video = w.video AND d4.k = w.k + 1, LATERAL (SELECT [x FOR x IN d4.o IF x.iou >= w.threshold AND NOT list_contains(w.taken, x.gt)] AS f)),
  n AS (SELECT phrase, count(*) AS n FROM (SELECT DISTINCT video, phrase, gt FROM ga) GROUP BY 1),
  c AS (SELECT video % 5 AS phrase, threshold, n, hit, sum(hit::INT) OVER o AS tp, row_number() OVER o AS i FROM walk JOIN n ON n.phrase = video % 5 WHERE k > 0 WINDOW o AS (PARTITION BY video % 5, threshold ORDER BY score DESC, video, trk)),
  e AS (SELECT *, max(tp / i) OVER (PARTITION BY phrase, threshold ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c), h AS (SELECT phrase, threshold, n, tp, arg_min(env, i) AS env FROM e WHERE hit GROUP BY ALL),
  r AS (SELECT phrase, threshold, j, arg_min(env, tp) AS p FROM h JOIN range(101) q(j) ON tp * 100.0 / n >= j - 1e-9 GROUP BY ALL) SELECT n.phrase, l.threshold, round(coalesce((SELECT sum(p) FROM r WHERE r.phrase = n.phrase AND r.threshold = l.threshold), 0) / 101, 6) AS ap FROM n, levels l""")
def mask_video_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision of tracks of masks by phrase: four detections compete for four truths."""
    out = M.precision(*_tracks(spark, sf_dir), _scores(spark, sf_dir), "video", "phrase", {"all": (0, 1e10)}, [0.5, 0.55, 0.6])
    return out.select("phrase", F.round("threshold", 2).alias("threshold"), F.round("ap", 6).alias("ap"))


def mask_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One report of several evaluators over the same tracks; its parts have their own queries and SQL."""
    at, both = shared_path(spark, "tracks"), _tracks(spark, sf_dir)
    for name, df in zip("gd", both):
        df.write.parquet(f"{at}/{name}")
    g, d = (spark.read.schema(df.schema).parquet(f"{at}/{name}") for name, df in zip("gd", both))
    units = table(spark, sf_dir, "embeddings", "vec_id").select(F.floor(F.col("vec_id") / 16).alias("video")).distinct().withColumn("phrase", F.col("video") % 5)
    phrases = E.phrase_summary(M.phrase_rows(units, g, d, ["video", "phrase"])).agg(F.avg("cgf1").alias("cgf1"), F.avg("positive_f1").alias("positive_f1"), F.avg("il_mcc").alias("il_mcc"))
    precision = M.precision(g, d, _scores(spark, sf_dir), "video", "phrase", {"all": (0, 1e10)}).agg(F.avg("ap").alias("map"))
    classed = lambda s: s.withColumn("cls", F.col("phrase"))
    teta = M.teta(classed(g), classed(d), ["video"])
    parts = {"hota": E.long_form(M.hota(g, d, ["video", "phrase"]), [], E.HOTA_FIELDS), "teta": E.long_form(teta, [], ["teta", "loc_a", "assoc_a", "cls_a"]), "phrases": E.long_form(phrases, [], ["cgf1", "positive_f1", "il_mcc"]), "precision": E.long_form(precision, [], ["map"])}
    return M.joined_report(spark, parts).select("evaluator", "metric", F.round("value", 6).alias("value"))



QUERIES["mask_report"] = mask_report


@query(f"""WITH {_TRACKS_SQL}, s AS (SELECT sh.video, sh.t, sh.gt, sh.trk, sh.n / (ga.n + da.n - sh.n) AS sim FROM sh JOIN ga USING (video, t, gt) JOIN da USING (video, t, trk)), tot AS (SELECT video, t, pid, sum(sim) AS total FROM s JOIN perms USING (gt, trk) GROUP BY ALL), best AS (SELECT video, t, arg_max(pid, total) AS pid FROM tot GROUP BY ALL),
  one AS (SELECT s.* FROM s JOIN best USING (video, t) JOIN perms p ON p.pid = best.pid AND p.gt = s.gt AND p.trk = s.trk), f AS (SELECT DISTINCT video, t FROM ga), h AS (SELECT DISTINCT video, t FROM da)
  SELECT 'new' AS kind, da.video, da.t, trk AS det, NULL::BIGINT AS trk FROM da LEFT JOIN f USING (video, t) WHERE f.t IS NULL OR NOT EXISTS (SELECT 1 FROM s WHERE s.video = da.video AND s.t = da.t AND s.trk = da.trk AND sim >= 0.55) AND da.trk >= 1
  UNION ALL SELECT 'lost', ga.video, ga.t, NULL, gt FROM ga JOIN h USING (video, t) WHERE NOT EXISTS (SELECT 1 FROM one WHERE one.video = ga.video AND one.t = ga.t AND one.gt = ga.gt AND sim >= 0.58)
  UNION ALL SELECT 'many', video, t, trk, gt FROM s WHERE sim >= 0.55 UNION ALL SELECT 'one', video, t, trk, gt FROM one""")
def mask_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections and tracks of masks, frame by frame: new ones, lost ones, all pairs that overlap enough, and the best one-to-one match."""
    g, d = _tracks(spark, sf_dir)
    keys = ["video", "t"]
    dets = d.select(*keys, F.col("trk").alias("det")).distinct().withColumn("score", F.col("det").cast("double"))
    tracks = g.select(*keys, F.col("gt").alias("trk")).distinct()
    pairs = M.similarity(g, d, ["video"]).select(*keys, F.col("trk").alias("det"), F.col("gt").alias("trk"), F.col("sim").alias("iou"))
    fresh, lost, many, one = H.associate_both(dets, tracks, pairs, keys, 0.55, 0.58, 1.0)
    none = F.lit(None).cast("long")
    named = lambda k, df: df.select(F.lit(k).alias("kind"), *keys, *[F.col(c) if c in df.columns else none.alias(c) for c in ("det", "trk")])
    return named("new", fresh).unionByName(named("lost", lost)).unionByName(named("many", many)).unionByName(named("one", one))


@query(f"""WITH RECURSIVE {_TRACKS_SQL}, r AS (SELECT sh.video, sh.t, sh.trk, sh.gt, ga.gt = 2 AND sh.video % 3 = 0 AS crowd, ga.gt = 3 AND sh.video % 2 = 0 AS skip, CASE WHEN ga.gt = 2 AND sh.video % 3 = 0 THEN sh.n / da.n ELSE sh.n / (ga.n + da.n - sh.n) END AS iou FROM sh JOIN ga USING (video, t, gt) JOIN da USING (video, t, trk)),
  c AS (SELECT video, t, trk, list({{'iou': iou, 'gt': gt, 'crowd': crowd, 'ign': crowd OR skip}} ORDER BY crowd OR skip, iou DESC, gt DESC) AS o FROM r GROUP BY ALL), levels AS (SELECT unnest([0.5, 0.55, 0.6])::DOUBLE AS threshold),
  e AS (SELECT vec_id // 16 AS video, (vec_id // 4) % 4 AS t, CASE WHEN (vec_id // 4) % 4 = 3 AND vec_id % 4 < 2 THEN 1 - vec_id % 4 ELSE vec_id % 4 END AS trk, abs(embedding[64]::DOUBLE) AS score FROM embeddings WHERE vec_id // 16 % 7 <> 3),
  dk AS (SELECT e.*, row_number() OVER (PARTITION BY video, t ORDER BY score DESC, trk) AS k, coalesce(o, []) AS o FROM e LEFT JOIN c USING (video, t, trk)),
  walk AS (SELECT video, t, threshold, 0::BIGINT AS k, []::BIGINT[] AS taken, false AS hit, false AS ign FROM (SELECT DISTINCT video, t FROM dk), levels
    UNION ALL SELECT w.video, w.t, w.threshold, dk.k, CASE WHEN len(f) > 0 THEN list_append(w.taken, f[1].gt) ELSE w.taken END, len(f) > 0, len(f) > 0 AND f[1].ign FROM walk w JOIN dk ON dk.video = w.video AND dk.t = w.t AND dk.k = w.k + 1, LATERAL (SELECT [x FOR x IN dk.o IF x.iou >= w.threshold AND (x.crowd OR NOT list_contains(w.taken, x.gt))] AS f))
  SELECT video, threshold, count(*) FILTER (hit AND NOT ign) AS hits, count(*) FILTER (ign) AS ignored, count(*) AS n FROM walk WHERE k > 0 GROUP BY 1, 2""")
def crowd_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of a frame that compete for its truths, some of which are ignored and some crowds, by the public protocol."""
    g, d = _tracks(spark, sf_dir)
    keys, crowd, skip = ["video", "t"], (F.col("gt") == 2) & (F.col("video") % 3 == 0), (F.col("gt") == 3) & (F.col("video") % 2 == 0)
    truth = g.select(*keys, "gt").distinct().select(*keys, "gt", (crowd | skip).alias("ignore"), crowd.alias("crowd"))
    c = F.col("vec_id")
    t, o = F.floor(c / 4) % 4, c % 4
    scores = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.floor(c / 16).alias("video"), t.alias("t"), F.when((t == 3) & (o < 2), 1 - o).otherwise(o).alias("det"), F.abs(F.col("embedding")[63].cast("double")).alias("score")).where("video % 7 <> 3")
    pairs = R.overlaps(g.drop("phrase"), d.drop("phrase"), keys, "gt", "trk").join(R.areas(d, [*keys, "trk"], "size"), [*keys, "trk"])
    pairs = pairs.select(*keys, "gt", F.col("trk").alias("det"), F.when(crowd, F.col("shared") / F.col("size")).otherwise(F.col("iou")).alias("iou"))
    m = H.greedy_match(truth, scores, pairs, keys, [0.5, 0.55, 0.6])
    return m.groupBy("video", F.round("threshold", 2).alias("threshold")).agg(F.count_if(F.col("hit") & ~F.col("ignored")).alias("hits"), F.count_if("ignored").alias("ignored"), F.count("*").alias("n"))
