"""Queries of rotated boxes, transform chains and document structures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import boxes
from quillon.functions import rotated as Q
from quillon.operators import structure as G
from quillon.operators import suppression as S
from quillon.operators import transforms as T
from quillon.operators.partitions import tasks_for
from quillon.plans.detection import EACH
from quillon.plans.relational import query
from quillon.plans.tables import table


@query("""WITH b AS (SELECT vec_id AS id, vec_id // 20 AS grp, 50 + 100 * embedding[1]::DOUBLE AS cx, 50 + 100 * embedding[2]::DOUBLE AS cy, 10 + 100 * abs(embedding[3]::DOUBLE) AS w, 5 + 100 * abs(embedding[4]::DOUBLE) AS h, 720 * embedding[5]::DOUBLE AS angle FROM embeddings),
  k AS (SELECT *, cos(radians(angle)) AS c, sin(radians(angle)) AS s FROM b), ij AS (SELECT * FROM (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) t(n, i, j)),
  p AS (SELECT grp, id, n, cx + c * i * w / 2 + s * j * h / 2 AS x, cy - s * i * w / 2 + c * j * h / 2 AS y FROM k, ij), e AS (SELECT p.*, q.x AS u, q.y AS v FROM p JOIN p q ON q.id = p.id AND q.n = (p.n + 1) % 4),
  pr AS (SELECT a.id AS a, b.id AS b, a.w * a.h AS aa, b.w * b.h AS ab FROM b a JOIN b ON a.grp = b.grp AND a.id < b.id AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) <= sqrt(a.w ** 2 + a.h ** 2) / 2 + sqrt(b.w ** 2 + b.h ** 2) / 2),
  c AS (SELECT pr.a, pr.b, p.x, p.y FROM pr JOIN p ON p.id = pr.a JOIN k o ON o.id = pr.b WHERE abs((p.x - o.cx) * o.c - (p.y - o.cy) * o.s) <= o.w / 2 AND abs((p.x - o.cx) * o.s + (p.y - o.cy) * o.c) <= o.h / 2
    UNION ALL SELECT pr.a, pr.b, p.x, p.y FROM pr JOIN p ON p.id = pr.b JOIN k o ON o.id = pr.a WHERE abs((p.x - o.cx) * o.c - (p.y - o.cy) * o.s) <= o.w / 2 AND abs((p.x - o.cx) * o.s + (p.y - o.cy) * o.c) <= o.h / 2
    UNION ALL SELECT a, b, x + t * (u - x), y + t * (v - y) FROM (SELECT pr.a, pr.b, f.x, f.y, f.u, f.v, ((g.x - f.x) * (g.v - g.y) - (g.y - f.y) * (g.u - g.x)) / d AS t, ((g.x - f.x) * (f.v - f.y) - (g.y - f.y) * (f.u - f.x)) / d AS r
      FROM pr JOIN e f ON f.id = pr.a JOIN e g ON g.id = pr.b, LATERAL (SELECT (f.u - f.x) * (g.v - g.y) - (f.v - f.y) * (g.u - g.x) AS d) WHERE d <> 0) WHERE t BETWEEN 0 AND 1 AND r BETWEEN 0 AND 1),
  o AS (SELECT *, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM c WINDOW w AS (PARTITION BY a, b)), r AS (SELECT a, b, dx * coalesce(lead(dy) OVER w, first(dy) OVER w) - dy * coalesce(lead(dx) OVER w, first(dx) OVER w) AS z FROM o WINDOW w AS (PARTITION BY a, b ORDER BY atan2(dy, dx))),
  i AS (SELECT a, b, sum(z) / 2 AS n FROM r GROUP BY 1, 2) SELECT a, b, round(n, 4) AS shared, round(n / (aa + ab - n), 6) AS iou FROM i JOIN pr USING (a, b) WHERE n / (aa + ab - n) > 0.001""")
def rotated_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rotated boxes of images of twenty: pairs that meet by the cells of their upright bounds."""
    v = lambda i: F.col("embedding")[i].cast("double")
    b = Q.rotated(50 + 100 * v(0), 50 + 100 * v(1), 10 + 100 * F.abs(v(2)), 5 + 100 * F.abs(v(3)), 720 * v(4))
    boxes = table(spark, sf_dir, "embeddings", "vec_id", "embedding").select("vec_id", F.floor(F.col("vec_id") / 20).alias("grp"), b.alias("r")).withColumn("b", Q.bounds(F.col("r")))
    pairs = S.group_pairs(boxes, ["grp"], "vec_id", ["r"], 32.0, "b", tasks_for(boxes, EACH))
    out = pairs.select(F.col("a.item").alias("i"), F.col("b.item").alias("j"), Q.intersection(F.col("a.r"), F.col("b.r")).alias("n"), (Q.area(F.col("a.r")) + Q.area(F.col("b.r"))).alias("both"))
    iou = F.col("n") / (F.col("both") - F.col("n"))
    return out.where(iou > 0.001).select(F.col("i").alias("a"), F.col("j").alias("b"), F.round("n", 4).alias("shared"), F.round(iou, 6).alias("iou"))


_DRAW_SQL = lambda name, key: f"(('0x' || substr(md5('7:{name}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


@query(f"""WITH b AS (SELECT vec_id AS id, 50 + 120 * embedding[1]::DOUBLE AS x1, 40 + 120 * embedding[2]::DOUBLE AS y1, 20 + 100 * abs(embedding[3]::DOUBLE) AS w, 10 + 100 * abs(embedding[4]::DOUBLE) AS h,
    40 + floor({_DRAW_SQL('width', 'vec_id // 4')} * 41) AS cw, 30 + floor({_DRAW_SQL('height', 'vec_id // 4')} * 31) AS ch, {_DRAW_SQL('left', 'vec_id // 4')} AS ul, {_DRAW_SQL('top', 'vec_id // 4')} AS ut, {_DRAW_SQL('flip', 'vec_id')} < 0.5 AS flips FROM embeddings),
  c AS (SELECT *, floor(ul * (100 - cw + 1)) AS l, floor(ut * (80 - ch + 1)) AS t FROM b), k AS (SELECT id, flips, cw, ch, greatest(0, least(cw, greatest(0, x1) - l)) AS x1, greatest(0, least(cw, least(100, x1 + w) - l)) AS x2, greatest(0, least(ch, greatest(0, y1) - t)) AS y1, greatest(0, least(ch, least(80, y1 + h) - t)) AS y2 FROM c),
  f AS (SELECT id, cw, ch, CASE WHEN flips THEN cw - x2 ELSE x1 END AS x1, CASE WHEN flips THEN cw - x1 ELSE x2 END AS x2, y1, y2 FROM k WHERE x2 > x1 AND y2 > y1), z AS (SELECT *, least(cw, ch) AS lo, greatest(cw, ch) AS hi FROM f), s AS (SELECT *, CASE WHEN hi / lo * 64 > 100 THEN 100 * lo / hi ELSE 64 END AS short FROM z),
  n AS (SELECT *, CASE WHEN lo = short THEN cw ELSE round_even(short * cw / lo, 0) END AS nw, CASE WHEN lo = short THEN ch ELSE round_even(short * ch / lo, 0) END AS nh FROM s)
  SELECT id, round(x1 * nw / cw + 3, 6) AS x1, round(y1 * nh / ch + 2, 6) AS y1, round(x2 * nw / cw + 3, 6) AS x2, round(y2 * nh / ch + 2, 6) AS y2, nw + 4 AS w, nh + 2 AS h FROM n""")
def transform_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes through a crop drawn per datapoint of four frames, a flip drawn per frame, a resize and a padding."""
    v, point, one = (lambda i: F.col("embedding")[i].cast("double")), F.floor(F.col("vec_id") / 4), F.col("vec_id")
    u = lambda name, key: T.drawn(7, name, key)
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumns({"cw": T.drawn_between(u("width", point), 40, 80), "ch": T.drawn_between(u("height", point), 30, 60), "b": boxes.from_xywh(50 + 120 * v(0), 40 + 120 * v(1), 20 + 100 * F.abs(v(2)), 10 + 100 * F.abs(v(3)))})
    rows = rows.withColumns({"l": T.drawn_between(u("left", point), 0, 100 - F.col("cw")), "t": T.drawn_between(u("top", point), 0, 80 - F.col("ch"))})
    steps = T.chain(T.crop(F.col("t"), F.col("l"), F.col("ch"), F.col("cw")), T.flip(u("flip", one) < 0.5), T.resize_shorter(64, 100), T.pad(3, 2, 1, 0))
    out = rows.withColumn("m", T.composed(steps, 100, 80)).select(one.alias("id"), "m", T.map_box(F.col("m"), F.col("b")).alias("o")).where("o IS NOT NULL")
    return out.select("id", *[F.round(F.col("o")[c], 6).alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("m.w").alias("w"), F.col("m.h").alias("h"))


_DOCUMENTS_SQL = """docs AS (SELECT CASE WHEN turn % 3 = 2 THEN to_json({'conv': conv_id, 'turn': {'no': turn, 'role': role, 'words': w, 'note': NULL}})
    ELSE to_json({'conv': conv_id, 'turn': {'no': turn, 'role': role, 'words': w, 'note': {'score': turn / 2, 'first': turn = 0}}, 'tags': [role, NULL, role]}) END AS j FROM (SELECT *, [{'n': len(x), 'long': CASE WHEN len(x) > 4 THEN true END} FOR x IN string_split(text, ' ')] AS w FROM conversations))"""
_TREE_SQL = f"""{_DOCUMENTS_SQL}, t AS (SELECT regexp_replace(fullkey, '\\[\\d+\\]', '[]', 'g') AS path, CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'text' WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' ELSE 'integer' END AS kind,
    CASE type WHEN 'OBJECT' THEN len(json_keys(value)) WHEN 'ARRAY' THEN json_array_length(value) WHEN 'VARCHAR' THEN length(value ->> '$') END AS size FROM docs, json_tree(docs.j) x)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a nested document."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    words = F.transform(F.split("text", " "), lambda w: F.struct(F.length(w).alias("n"), F.when(F.length(w) > 4, True).alias("long")))
    turn = lambda note: F.struct(F.col("turn").alias("no"), "role", words.alias("words"), note.alias("note"))
    note = F.struct((F.col("turn") / 2).alias("score"), (F.col("turn") == 0).alias("first"))
    with_nulls = {"ignoreNullFields": "false"}
    short = F.to_json(F.struct(F.col("conv_id").alias("conv"), turn(F.lit(None).cast("string")).alias("turn")), with_nulls)
    full = F.to_json(F.struct(F.col("conv_id").alias("conv"), turn(note).alias("turn"), F.array("role", F.lit(None), "role").alias("tags")), with_nulls)
    return rows.select(F.when(F.col("turn") % 3 == 2, short).otherwise(full).alias("j"))


@query(f"WITH {_TREE_SQL} SELECT path, kind, count(*) AS n, CAST(min(size) AS BIGINT) AS least, CAST(max(size) AS BIGINT) AS most, CAST(sum(size) AS BIGINT) AS total FROM t GROUP BY 1, 2")
def document_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths, kinds, counts and sizes of nested documents, one a turn."""
    return G.sketch(_documents(spark, sf_dir), "j")


@query(f"""WITH {_TREE_SQL}, w AS (SELECT path, list_sort(list(DISTINCT kind)) AS kinds, count(*) AS n, count(*) FILTER (kind = 'null') AS nulls, avg(size) AS mean_size, count(*) FILTER (kind = 'object') AS objects FROM t GROUP BY 1)
  SELECT w.path, w.kinds, w.n, round(w.nulls / w.n, 6) AS null_share, round(w.n / u.objects, 6) AS present_share, round(w.mean_size, 6) AS mean_size FROM w LEFT JOIN w u ON NOT ends_with(w.path, '[]') AND w.path = u.path || '.' || string_split(w.path, '.')[-1]""")
def document_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents look like: kinds, shares of nulls and of presence, mean sizes."""
    out = G.summary(G.sketch(_documents(spark, sf_dir), "j"))
    return out.select("path", "kinds", "n", *[F.round(c, 6).alias(c) for c in ("null_share", "present_share", "mean_size")])
