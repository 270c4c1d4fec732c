"""Queries of whole evaluation reports, over the grid of `plans.detection`, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import evaluation as V
from quillon.operators import matching as H
from quillon.operators import metrics as E
from quillon.plans.detection import _GRID_SQL, _UNITS_SQL, _grid, _units
from quillon.plans.relational import query

_LEVELS = [0.5, 0.75]
# Every tenth ground truth is ignored; areas are made up from the image and the item.
_AREA_SQL = f"""{_GRID_SQL}, ranges AS (SELECT * FROM (VALUES ('all', 0.0, 1e10), ('small', 0.0, 16384.0), ('medium', 16384.0, 65536.0), ('large', 65536.0, 1e10)) t(area_range, lo, hi)), levels AS (SELECT CAST(unnest([0.5, 0.75]) AS DOUBLE) AS threshold),
  ga AS (SELECT *, (image * 13 + gt * 7) % 10 * 9000 + 100 AS area, (image + gt) % 10 = 0 AS ignore FROM g), da AS (SELECT *, (image * 13 + dt * 7 + 3) % 10 * 9000 + 100 AS area, row_number() OVER (PARTITION BY image, phrase ORDER BY score DESC, dt) AS place FROM d),
  gr AS (SELECT ga.*, area_range, ignore OR NOT area BETWEEN lo AND hi AS out FROM ga CROSS JOIN ranges),
  m AS (SELECT da.phrase AS category, r.area_range, threshold, da.score, da.place, da.image * 100 + da.dt AS ord, coalesce(o.iou >= threshold, false) AS hit, CASE WHEN coalesce(o.iou >= threshold, false) THEN gr.out ELSE NOT da.area BETWEEN lo AND hi END AS ignored
    FROM da CROSS JOIN ranges r CROSS JOIN levels LEFT JOIN o ON o.image = da.image AND o.phrase = da.phrase AND o.dt = da.dt LEFT JOIN gr ON gr.image = o.image AND gr.phrase = o.phrase AND gr.gt = o.gt AND gr.area_range = r.area_range),
  n AS (SELECT phrase AS category, area_range, count(*) AS n FROM gr WHERE NOT out GROUP BY 1, 2),
  c AS (SELECT m.*, n.n, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS tp, row_number() OVER w AS k FROM m JOIN n USING (category, area_range) WHERE NOT ignored WINDOW w AS (PARTITION BY m.category, m.area_range, threshold ORDER BY score DESC, ord)),
  e AS (SELECT *, max(tp / k) OVER (PARTITION BY category, area_range, threshold ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM c),
  f AS (SELECT category, area_range, threshold, tp, any_value(n) AS n, arg_min(env, k) AS env FROM e WHERE hit GROUP BY 1, 2, 3, 4),
  x AS (SELECT category, area_range, threshold, j, arg_min(env, tp) AS p FROM f JOIN range(101) t(j) ON tp * 100.0 / n >= j - 1e-9 AND (tp - 1) * 100.0 / n < j - 1e-9 OR (tp = 1 AND j = 0) GROUP BY 1, 2, 3, 4),
  s AS (SELECT n.category, n.area_range, threshold, coalesce((SELECT sum(p) FROM x WHERE x.category = n.category AND x.area_range = n.area_range AND x.threshold = l.threshold), 0) / 101 AS ap,
    {", ".join(f"(SELECT count(*) FROM m WHERE hit AND NOT ignored AND place <= {k} AND m.category = n.category AND m.area_range = n.area_range AND m.threshold = l.threshold) / n.n AS recall_{k}" for k in V.DETECTIONS)} FROM n CROSS JOIN levels l)"""


def _area_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, d, o = _grid(spark, sf_dir)
    by = ["image", "phrase"]
    image = F.col("image")
    truth = g.withColumns({"area": (image * 13 + F.col("gt") * 7) % 10 * 9000 + 100, "ignore": (image + F.col("gt")) % 10 == 0, "crowd": F.lit(False)})
    found = d.withColumnRenamed("dt", "det").withColumn("area", (image * 13 + F.col("det") * 7 + 3) % 10 * 9000 + 100)
    m = V.area_flags(truth, found, o.select(*by, "gt", F.col("dt").alias("det"), "iou"), by, V.PIXEL_AREAS, _LEVELS)
    m = m.withColumn("ord", image * 100 + F.col("det")).withColumnRenamed("phrase", "category")
    n = V.area_truths(truth.withColumnRenamed("phrase", "category"), ["category"])
    return V.precision_recall(m, n, ["category"], V.PIXEL_AREAS, _LEVELS)


@query(f"WITH {_AREA_SQL} SELECT category, area_range, threshold, round(ap, 6) AS ap, round(recall_1, 6) AS recall_1, round(recall_10, 6) AS recall_10, round(recall_100, 6) AS recall_100 FROM s")
def area_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision and recall per category, area range and threshold, with ignored ground truths."""
    return _area_scores(spark, sf_dir).select("category", "area_range", "threshold", *[F.round(c, 6).alias(c) for c in ("ap", "recall_1", "recall_10", "recall_100")])


@query(f"""WITH {_AREA_SQL} SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT avg(ap) FILTER (WHERE area_range = 'all') AS AP, avg(ap) FILTER (WHERE area_range = 'all' AND threshold = 0.5) AS AP50, avg(ap) FILTER (WHERE area_range = 'all' AND threshold = 0.75) AS AP75,
    {", ".join(f"avg(recall_{k}) FILTER (WHERE area_range = 'all') AS AR_{k}" for k in V.DETECTIONS)}, {", ".join(f"avg(ap) FILTER (WHERE area_range = '{a}') AS AP_{a}, avg(recall_100) FILTER (WHERE area_range = '{a}') AS AR_{a}" for a in ("small", "medium", "large"))} FROM s) ON COLUMNS(*) INTO NAME metric VALUE value)""")
def box_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.box_report(_area_scores(spark, sf_dir), "category").select("metric", F.round("value", 6).alias("value"))


_SUMMARY_SQL = f"""{_UNITS_SQL}, s AS (SELECT threshold, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(fp) AS DOUBLE) AS fp, CAST(sum(fn) AS DOUBLE) AS fn, CAST(sum(CASE WHEN n_gt > 0 THEN fp ELSE 0 END) AS DOUBLE) AS pfp, sum(f1) FILTER (WHERE n_gt > 0) AS f1s,
    CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt > 0) AS DOUBLE) AS itp, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt > 0) AS DOUBLE) AS ifp, CAST(count(*) FILTER (WHERE n_gt > 0 AND n_dt = 0) AS DOUBLE) AS ifn, CAST(count(*) FILTER (WHERE n_gt = 0 AND n_dt = 0) AS DOUBLE) AS itn FROM units GROUP BY threshold),
  m AS (SELECT *, tp / (tp + pfp + 1e-4) AS pp, tp / (tp + fn + 1e-4) AS r, tp / (tp + fp + 1e-4) AS p, (itp * itn - ifp * ifn) / (sqrt((itp + ifp) * (itp + ifn) * (itn + ifp) * (itn + ifn)) + 1e-6) AS mcc, itp / (itp + ifp + 1e-6) AS ip, itp / (itp + ifn + 1e-6) AS ir FROM s),
  w AS (SELECT round(threshold, 2) AS threshold, 2 * pp * r / (pp + r + 1e-4) * mcc AS "cgF1", p AS precision, r AS recall, 2 * p * r / (p + r + 1e-4) AS "F1", f1s / nullif(itp, 0) AS "positive_macro_F1", 2 * pp * r / (pp + r + 1e-4) AS "positive_micro_F1", pp AS positive_micro_precision,
    ip AS "IL_precision", ir AS "IL_recall", 2 * ip * ir / (ip + ir + 1e-6) AS "IL_F1", ifp / (ifp + itn + 1e-6) AS "IL_FPR", mcc AS "IL_MCC" FROM m),
  l AS (SELECT threshold AS t, metric, value FROM (UNPIVOT w ON COLUMNS(* EXCLUDE threshold) INTO NAME metric VALUE value)),
  named AS (SELECT metric, CAST(NULL AS DOUBLE) AS threshold, avg(CASE WHEN value > -1 THEN value END) AS value FROM l GROUP BY 1 UNION ALL SELECT metric, t, value FROM l WHERE t IN (0.5, 0.75) AND metric NOT LIKE 'IL%')"""


@query(f"WITH {_SUMMARY_SQL} SELECT metric, threshold, round(value, 6) AS value FROM named")
def phrase_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 26 scores of the phrase metrics: means over the thresholds, values at 0.5 and 0.75, image-level scores."""
    scores = V.named_scores(E.phrase_summary(_units(spark, sf_dir)), V.PHRASE_NAMES, V.IMAGE_NAMES)
    return scores.select("metric", "threshold", F.round("value", 6).alias("value"))


@query(f"""WITH {_SUMMARY_SQL} SELECT w.metric, w.threshold, round(n.value, 6) AS value FROM (VALUES ('cgF1', NULL), ('F1', 0.75), ('IL_MCC', NULL), ('IL_MCC', 0.5), ('F2', NULL)) w(metric, threshold) LEFT JOIN named n ON n.metric = w.metric AND n.threshold IS NOT DISTINCT FROM w.threshold""")
def metric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores looked up by name and threshold, where no threshold is a key of its own."""
    scores = V.named_scores(E.phrase_summary(_units(spark, sf_dir)), V.PHRASE_NAMES, V.IMAGE_NAMES)
    wanted = spark.createDataFrame([("cgF1", None), ("F1", 0.75), ("IL_MCC", None), ("IL_MCC", 0.5), ("F2", None)], "metric string, threshold double")
    return V.metric_values(scores, wanted).select("metric", "threshold", F.round("value", 6).alias("value"))


@query(f"""WITH {_UNITS_SQL}, j AS (SELECT image, phrase, sum(iou) AS j FROM o WHERE score >= 0.5 GROUP BY 1, 2), x AS (SELECT units.*, fp = 0 AND fn = 0 AS perfect, CASE WHEN n_gt > 0 AND n_dt > 0 THEN coalesce(j, 0) / least(n_gt, n_dt) END AS j FROM units LEFT JOIN j USING (image, phrase))
  SELECT round(threshold, 2) AS threshold, round(count(*) FILTER (WHERE perfect AND n_gt > 0) / (count(*) FILTER (WHERE n_gt > 0) + 1e-9), 6) AS perfect_positive, round(count(*) FILTER (WHERE perfect AND n_gt = 0) / (count(*) FILTER (WHERE n_gt = 0) + 1e-9), 6) AS perfect_negative,
    round(sum(f1) FILTER (WHERE n_gt > 0) / count(*) FILTER (WHERE n_gt > 0), 6) AS macro_f1_all, round(sum(j) / (count(j) + 1e-9), 6) AS j FROM x GROUP BY threshold""")
def perfect_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of units found perfectly, the macro score of all positive units and the mean overlap of matches."""
    g, d, o = _grid(spark, sf_dir)
    by = ["image", "phrase"]
    matched = H.assign(o.where("score >= 0.5"), by, "gt", "dt", "iou")
    r = V.perfect_rates(V.unit_scores(_units(spark, sf_dir), matched, by))
    return r.select(F.round("threshold", 2).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("perfect_positive", "perfect_negative", "macro_f1_all", "j")])
