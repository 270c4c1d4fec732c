"""Queries of run-length masks as relations, with their SQL over pixels.

Every vector is a mask of 24 by 32 pixels: its numbers in turn give runs of
zeros and of ones until the image is full.  Truth and found masks scale them
differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import points as P
from quillon.operators import runs as R
from quillon.operators.partitions import tasks_for
from quillon.plans.relational import query
from quillon.plans.tables import table

_H, _W = 24, 32
#: Lengths of runs of zeros and of ones for a number of size 1.
_TRUTH, _FOUND = (100, 80), (95, 86)
#: Vectors of a task: the sweep over boundaries sorts some 0.2 MB of rows for each.
_EACH = 1000


def _tasks(spark: SparkSession, sf_dir: str) -> int:
    return tasks_for(table(spark, sf_dir, "embeddings"), _EACH)


def _masks(spark: SparkSession, sf_dir: str, scales: tuple[int, int], tasks: int | None = None) -> DataFrame:
    counts = F.transform("embedding", lambda v, i: F.lit(1) + F.floor(F.abs(v.cast("double")) * F.when(i % 2 == 0, scales[0]).otherwise(scales[1])))
    return R.segments(table(spark, sf_dir, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("c"), counts.alias("counts")), ["c"], "counts", _H, _W, _tasks(spark, sf_dir) if tasks is None else tasks)


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings", "vec_id").select(F.col("vec_id").alias("c"))


def _pixels_sql(name: str, scales: tuple[int, int]) -> str:
    return f"""{name} AS (SELECT c, p // {_H} AS x, p % {_H} AS y, p FROM (SELECT c, unnest(range(e - n, least(e, {_H * _W}))) AS p
    FROM (SELECT c, i, n, CAST(sum(n) OVER (PARTITION BY c ORDER BY i) AS BIGINT) AS e FROM (SELECT c, i, CAST(1 + floor(abs(v::DOUBLE) * CASE WHEN i % 2 = 1 THEN {scales[0]} ELSE {scales[1]} END) AS BIGINT) AS n FROM (SELECT vec_id AS c, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))) WHERE i % 2 = 0 AND e - n < {_H * _W}))"""


_PIXELS = f"{_pixels_sql('g', _TRUTH)}, {_pixels_sql('d', _FOUND)}, cs AS (SELECT vec_id AS c FROM embeddings)"


@query(f"""WITH {_PIXELS}, u AS (SELECT DISTINCT c, p FROM (SELECT c, p FROM g UNION ALL SELECT c, p FROM d)), i AS (SELECT c, p, p - row_number() OVER (PARTITION BY c ORDER BY p) AS k FROM u),
  r AS (SELECT c, min(p) AS a, max(p) + 1 AS b FROM i GROUP BY c, k), t AS (SELECT c, a - lag(b, 1, 0) OVER (PARTITION BY c ORDER BY a) AS z, b - a AS o, a, b FROM r)
  SELECT cs.c, CASE WHEN max(b) IS NULL THEN [{_H * _W}] WHEN max(b) < {_H * _W} THEN list_append(flatten(list([z, o] ORDER BY a)), {_H * _W} - max(b)) ELSE flatten(list([z, o] ORDER BY a)) END AS counts FROM cs LEFT JOIN t ON t.c = cs.c GROUP BY cs.c""")
def united_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run lengths of the union of both masks of each vector."""
    both = _masks(spark, sf_dir, _TRUTH).unionByName(_masks(spark, sf_dir, _FOUND))
    return R.to_counts(R.union(both, ["c"]), _every(spark, sf_dir), ["c"], _H, _W)


@query(f"""WITH {_PIXELS}, n AS (SELECT coalesce(g.c, d.c) AS c, g.p IS NOT NULL AS a, d.p IS NOT NULL AS b FROM g FULL JOIN d ON g.c = d.c AND g.p = d.p)
  SELECT cs.c, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS missed, count(*) FILTER (b AND NOT a) AS wrong, count(*) FILTER (a <> b) AS differ, {_H * _W} - count(*) FILTER (a) AS outside FROM cs LEFT JOIN n ON n.c = cs.c GROUP BY 1""")
def mask_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of intersection, differences, exclusive or and complement."""
    a, b, every = _masks(spark, sf_dir, _TRUTH), _masks(spark, sf_dir, _FOUND), _every(spark, sf_dir)
    rules = {"both": lambda a, b: a & b, "missed": lambda a, b: a & ~b, "wrong": lambda a, b: b & ~a, "differ": lambda a, b: a != b}
    out = every.join(R.compared(a, b, ["c"], rules), "c", "left")
    return out.join(R.areas(R.complement(a, every, ["c"], _H, _W), ["c"], "outside"), "c", "left").na.fill(0)


_RADIUS = R.boundary_radius(_H, _W)
_EDGES = ", ".join(f"""b{s} AS (SELECT c, x, y FROM (SELECT c, x - dx AS x, y - dy AS y FROM {s}, k UNION ALL SELECT c, x, y - dy FROM {s}, k WHERE x = {_W - 1} AND dx = 1 UNION ALL SELECT c, x - dx, y FROM {s}, k WHERE y = {_H - 1} AND dy = 1 UNION ALL SELECT c, x, y FROM {s}, k WHERE x = {_W - 1} AND y = {_H - 1} AND dx = 1 AND dy = 1)
    WHERE x >= 0 AND y >= 0 GROUP BY c, x, y HAVING count(*) < 4), w{s} AS (SELECT DISTINCT c, x + i AS x, y + j AS y FROM b{s}, range(-{_RADIUS}, {_RADIUS + 1}) p(i), range(-{_RADIUS}, {_RADIUS + 1}) q(j))""" for s in "gd")
_SCORES = f"""{_PIXELS}, k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(dx, dy)), {_EDGES},
  n AS (SELECT c, (SELECT count(*) FROM bg WHERE bg.c = cs.c) AS ng, (SELECT count(*) FROM bd WHERE bd.c = cs.c) AS nd, (SELECT count(*) FROM bg JOIN wd USING (c, x, y) WHERE bg.c = cs.c) AS hg, (SELECT count(*) FROM bd JOIN wg USING (c, x, y) WHERE bd.c = cs.c) AS hd FROM cs),
  s AS (SELECT c, CASE WHEN nd = 0 THEN 1.0 WHEN ng = 0 THEN 0.0 ELSE hd / nd END AS p, CASE WHEN ng = 0 THEN 1.0 WHEN nd = 0 THEN 0.0 ELSE hg / ng END AS r FROM n), f AS (SELECT c, p, r, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f FROM s)"""


def _boundary_scores(spark: SparkSession, sf_dir: str, tasks: int) -> DataFrame:
    return R.boundary_scores(_masks(spark, sf_dir, _TRUTH, tasks), _masks(spark, sf_dir, _FOUND, tasks), _every(spark, sf_dir), ["c"], _H, _W, _RADIUS)


@query(f"WITH {_SCORES} SELECT c, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f FROM f")
def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary precision, recall and F of each vector's masks."""
    return _boundary_scores(spark, sf_dir, _tasks(spark, sf_dir)).select("c", *[F.round(n, 6).alias(n) for n in ("precision", "recall", "f")])


_IOU = "iou AS (SELECT g.c, count(*) AS i FROM g JOIN d USING (c, p) GROUP BY 1), j AS (SELECT c, i / ((SELECT count(*) FROM g WHERE g.c = iou.c) + (SELECT count(*) FROM d WHERE d.c = iou.c) - i) AS iou FROM iou)"


@query(f"""WITH {_SCORES}, {_IOU}, u AS (SELECT c // 20 AS unit, avg(iou) AS j, sum(f) / (count(*) + 1e-9) AS f FROM j JOIN f USING (c) GROUP BY 1)
  SELECT unit, round(j, 6) AS j, round(f, 6) AS f, round((j + f) / 2, 6) AS jf FROM u""")
def jf_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J, F and J&F of units of twenty vectors: matched masks by overlap and boundary."""
    tasks = _tasks(spark, sf_dir)
    pairs = R.overlaps(_masks(spark, sf_dir, _TRUTH, tasks).withColumn("g", F.col("c")), _masks(spark, sf_dir, _FOUND, tasks).withColumn("d", F.col("c")), ["c"], "g", "d", tasks)
    matched = pairs.select("c", "iou", F.floor(F.col("c") / 20).alias("unit"))
    return R.jf_scores(matched, _boundary_scores(spark, sf_dir, tasks), ["c"], ["unit"]).select("unit", *[F.round(n, 6).alias(n) for n in ("j", "f", "jf")])


@query(f"""WITH {_PIXELS}, o AS (SELECT g.c AS a, d.c AS b, count(*) AS shared FROM g JOIN d ON g.c // 20 = d.c // 20 AND g.p = d.p GROUP BY 1, 2), n AS (SELECT c, count(*) AS n FROM g GROUP BY 1), m AS (SELECT c, count(*) AS n FROM d GROUP BY 1)
  SELECT a // 20 AS image, a, b, shared, round(shared / (n.n + m.n - shared), 6) AS iou, round(shared / (least(n.n, m.n) + 1e-8), 6) AS iom FROM o JOIN n ON n.c = a JOIN m ON m.c = b""")
def mask_ious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of many runs against those of the same image of twenty, by column and tile."""
    tasks = _tasks(spark, sf_dir)
    of = lambda n, lengths: _masks(spark, sf_dir, lengths, tasks).withColumn("image", F.floor(F.col("c") / 20)).withColumnRenamed("c", n)
    pairs = R.overlaps(of("a", _TRUTH), of("b", _FOUND), ["image"], "a", "b", tasks)
    return pairs.select("image", "a", "b", "shared", F.round("iou", 6).alias("iou"), F.round("iom", 6).alias("iom"))


def _components_sql(name: str, source: str) -> str:
    """Each pixel of `source` (c, p) with the least pixel that it is connected with, by corners too: stretches of columns that touch share labels."""
    return f"""{name}_s AS (SELECT c, x, min(p) AS a, max(p) AS b FROM (SELECT c, p, p // {_H} AS x, p - row_number() OVER (PARTITION BY c, p // {_H} ORDER BY p) AS k FROM {source}) GROUP BY c, x, k),
  {name}_half AS (SELECT l.c, l.a AS u, r.a AS v FROM {name}_s l JOIN {name}_s r ON r.c = l.c AND r.x = l.x + 1 AND r.a - {_H} <= l.b + 1 AND l.a <= r.b - {_H} + 1), {name}_near AS (SELECT c, u, v FROM {name}_half UNION ALL SELECT c, v, u FROM {name}_half),
  {name}_labels(c, p, label) USING KEY (c, p) AS (SELECT c, a, a FROM {name}_s UNION SELECT e.c, e.u, min(l.label) FROM {name}_labels l JOIN {name}_near e ON e.c = l.c AND e.v = l.p JOIN recurring.{name}_labels o ON o.c = e.c AND o.p = e.u WHERE l.label < o.label GROUP BY e.c, e.u),
  {name} AS (SELECT c, p, label, count(*) OVER (PARTITION BY c, label) AS size FROM (SELECT c, unnest(range(a, b + 1)) AS p, label FROM {name}_s JOIN {name}_labels l USING (c) WHERE l.p = a))"""


@query(f"WITH RECURSIVE {_PIXELS}, {_components_sql('parts', 'g')} SELECT c, label, count(*) AS size FROM parts GROUP BY 1, 2")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of each mask: their first pixel and their size."""
    return R.components(_masks(spark, sf_dir, _TRUTH), ["c"], _H).select("c", "label", "size").distinct()


@query(f"""WITH RECURSIVE {_PIXELS}, off AS (SELECT cs.c, p FROM cs CROSS JOIN range({_H * _W}) r(p) ANTI JOIN g USING (c, p)), {_components_sql('gaps', 'off')}, filled AS (SELECT c, p FROM g UNION ALL SELECT c, p FROM gaps WHERE size <= 9), {_components_sql('parts', 'filled')},
  kept AS (SELECT c, p, size, count(*) OVER (PARTITION BY c) AS n FROM parts) SELECT c, count(*) AS pixels, CAST(sum(p) AS BIGINT) AS place FROM kept WHERE size > least(n // 2, 9) GROUP BY 1""")
def clean_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks without holes and specks of nine pixels or fewer: pixels left and the sum of their numbers."""
    clean = R.without_specks(_masks(spark, sf_dir, _TRUTH), _every(spark, sf_dir), ["c"], _H, _W, 9)
    n, first = F.col("y1") - F.col("y0"), F.col("x") * _H + F.col("y0")
    return clean.groupBy("c").agg(F.sum(n).alias("pixels"), F.sum(first * n + F.expr("(y1 - y0) * (y1 - y0 - 1) div 2")).alias("place"))


def _depth_sql(name: str, a: str, b: str) -> str:
    return f"""{name}_e AS (SELECT {a}.c, {a}.x, {a}.y FROM {a} ANTI JOIN {b} USING (c, p)), {name}_z AS (SELECT cs.c, x, y FROM cs CROSS JOIN range(-1, {_W + 1}) i(x) CROSS JOIN range(-1, {_H + 1}) j(y) ANTI JOIN {name}_e USING (c, x, y)),
  {name}_d AS (SELECT e.c, e.x, e.y, min((e.x - z.x) * (e.x - z.x) + (e.y - z.y) * (e.y - z.y)) AS d FROM {name}_e e JOIN {name}_z z ON z.c = e.c AND abs(z.x - e.x) <= 12 GROUP BY 1, 2, 3)"""


@query(f"""WITH {_PIXELS}, {_depth_sql('n', 'g', 'd')}, {_depth_sql('p', 'd', 'g')}, deep AS (SELECT c, kind, x, y, d FROM (SELECT *, 1 AS kind FROM n_d UNION ALL SELECT *, 0 FROM p_d) QUALIFY row_number() OVER (PARTITION BY c, kind ORDER BY d DESC, y, x) = 1),
  best AS (SELECT * FROM deep QUALIFY row_number() OVER (PARTITION BY c ORDER BY d DESC, kind) = 1) SELECT cs.c, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(kind, 0) = 1 AS positive FROM cs LEFT JOIN best ON best.c = cs.c""")
def error_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next click corrects most: the deepest pixel of what is missed or wrongly found."""
    return R.error_points(_masks(spark, sf_dir, _TRUTH), _masks(spark, sf_dir, _FOUND), _every(spark, sf_dir), ["c"])


@query(f"WITH {_PIXELS}, {_depth_sql('n', 'g', 'd')} SELECT c, count(*) AS pixels, CAST(sum(d) AS BIGINT) AS d2, CAST(max(d) AS BIGINT) AS deepest FROM n_d GROUP BY 1")
def distance_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances to the nearest pixel outside of what is missed, summed up by mask."""
    missed = R.combined(_masks(spark, sf_dir, _TRUTH), _masks(spark, sf_dir, _FOUND), ["c"], lambda a, b: a & ~b)
    return R.squared_distances(missed, ["c"]).groupBy("c").agg(F.count("*").alias("pixels"), F.sum("d2").alias("d2"), F.max("d2").alias("deepest"))


@query(f"""WITH v AS (SELECT vec_id // 3 AS item, vec_id AS o, [CAST(floor(embedding[2 * k - 1]::DOUBLE * 70) AS BIGINT) + 15 FOR k IN range(1, 13)] AS xs, [CAST(floor(embedding[2 * k]::DOUBLE * 60) AS BIGINT) + 11 FOR k IN range(1, 13)] AS ys FROM embeddings), e AS (SELECT item, o, xs[i] AS xa, ys[i] AS ya, xs[i % 12 + 1] AS xb, ys[i % 12 + 1] AS yb FROM (SELECT *, unnest(range(1, 13)) AS i FROM v)),
  cr AS (SELECT item, o, s, x, list_sort(list(ya + (x - xa) * (yb - ya) / (xb - xa)::DOUBLE)) AS y FROM e, range({_W}) r(x), range(2) q(s) WHERE CASE WHEN s = 0 THEN x >= least(xa, xb) AND x < greatest(xa, xb) ELSE x > least(xa, xb) AND x <= greatest(xa, xb) END GROUP BY ALL),
  sp AS (SELECT item, x, unnest([[y[2 * k - 1], y[2 * k]] FOR k IN range(1, len(y) // 2 + 1)]) AS ab FROM cr UNION ALL SELECT item, xa, [least(ya, yb)::DOUBLE, greatest(ya, yb)::DOUBLE] FROM e WHERE xa = xb AND xa BETWEEN 0 AND {_W - 1}),
  px AS (SELECT DISTINCT item, x, y FROM sp, range({_H}) r(y) WHERE y >= floor(ab[1] + 0.5) AND y <= ceil(ab[2] - 0.5))
  SELECT item, count(*) AS pixels, CAST(sum(x * {_H} + y) AS BIGINT) AS place, min(x) AS left_most, max(y) AS lowest FROM px GROUP BY 1""")
def polygon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as polygons of twelve vertices, three an item, filled and united."""
    point = lambda v, i: F.floor(v.cast("double") * F.when(i % 2 == 0, 70).otherwise(60)) + F.when(i % 2 == 0, 15).otherwise(11)
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    polygons = vectors.select(F.floor(F.col("vec_id") / 3).alias("item"), F.transform(F.slice("embedding", 1, 24), point).alias("points"))
    filled = R.polygon_segments(polygons, ["item"], "points", _H, _W)
    n, first = F.col("y1") - F.col("y0"), F.col("x") * _H + F.col("y0")
    return filled.groupBy("item").agg(F.sum(n).alias("pixels"), F.sum(first * n + F.expr("(y1 - y0) * (y1 - y0 - 1) div 2")).alias("place"), F.min("x").alias("left_most"), (F.max("y1") - 1).alias("lowest"))


@query(f"""WITH {_PIXELS}, z AS (SELECT * FROM (VALUES (11, 15), (50, 70)) t(h, w)), r AS (SELECT g.c, h, w, i, j FROM z, range(50) a(j), range(70) b(i), g WHERE j < h AND i < w AND g.x = i * {_W} // w AND g.y = j * {_H} // h)
  SELECT c, h, count(*) AS pixels, CAST(sum(i * h + j) AS BIGINT) AS place FROM r GROUP BY 1, 2""")
def resized_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks in a smaller and a larger size, by the nearest pixel."""
    masks, out = _masks(spark, sf_dir, _TRUTH), None
    for h, w in ((11, 15), (50, 70)):
        n, first = F.col("y1") - F.col("y0"), F.col("x") * h + F.col("y0")
        one = R.resized(masks, ["c"], _H, _W, h, w).groupBy("c").agg(F.sum(n).alias("pixels"), F.sum(first * n + F.expr("(y1 - y0) * (y1 - y0 - 1) div 2")).alias("place")).withColumn("h", F.lit(h))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_PIXELS} SELECT cs.c, CASE WHEN count(p) = 0 THEN [0, 0, 0, 0]::BIGINT[] ELSE [min(x), min(y), max(x), max(y)]::BIGINT[] END AS box FROM cs LEFT JOIN d ON d.c = cs.c AND d.x >= 4 AND d.y < 20 GROUP BY 1""")
def mask_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of masks in a part of the image, four zeros for what has no pixel there."""
    part = _masks(spark, sf_dir, _FOUND).where("x >= 4 AND y0 < 20").withColumn("y1", F.least("y1", F.lit(20).cast("long")))
    return P.mask_boxes(part, _every(spark, sf_dir), ["c"], empty=F.array_repeat(F.lit(0).cast("long"), 4))


_DRAWS_SQL = "(('0x' || substr(md5('5:' || kind || ':' || c || ':' || i), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH {_PIXELS}, n AS (SELECT c, x, y, row_number() OVER (PARTITION BY c ORDER BY p) - 1 AS place, count(*) OVER (PARTITION BY c) AS n FROM g), a AS (SELECT DISTINCT c, i, n, 'mask' AS kind FROM n, range(3) r(i)),
  e AS (SELECT coalesce(g.c, d.c) AS c, coalesce(g.p, d.p) AS p, g.p IS NOT NULL AS positive FROM g FULL JOIN d ON g.c = d.c AND g.p = d.p WHERE g.p IS NULL OR d.p IS NULL), en AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY p) - 1 AS place, count(*) OVER (PARTITION BY c) AS n FROM e), b AS (SELECT DISTINCT c, i, n, 'error' AS kind FROM en, range(3) r(i))
  SELECT 'mask' AS kind, a.c, a.i::INTEGER AS i, x, y, true AS positive FROM a JOIN n ON n.c = a.c AND n.place = CAST(floor({_DRAWS_SQL.replace('c ||', 'a.c ||')} * a.n) AS BIGINT)
  UNION ALL SELECT 'error', b.c, b.i::INTEGER, p // {_H}, p % {_H}, positive FROM b JOIN en ON en.c = b.c AND en.place = CAST(floor({_DRAWS_SQL.replace('c ||', 'b.c ||')} * b.n) AS BIGINT)""")
def sampled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pixels of each mask and three of what it has wrong, drawn by a keyed hash."""
    g, d = _masks(spark, sf_dir, _TRUTH), _masks(spark, sf_dir, _FOUND)
    one = P.from_masks(g, ["c"], 3, 5).withColumn("kind", F.lit("mask"))
    two = P.from_errors(g, d, _every(spark, sf_dir), ["c"], 3, 5, _H, _W).withColumn("kind", F.lit("error"))
    return one.unionByName(two)
