"""Queries on points: the first four numbers of an embedding are x, y, z and reflectance, its label the sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.operators import clouds, matching, tracker
from helmsway.sources.tables import table

EDGE = 0.1
KEYS = ["sweep"]


def points(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    axes = [e[i].cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "r"))]
    return table(spark, d, "embeddings").select(F.col("label").alias("sweep"), F.col("vec_id").alias("idx"), *axes)


def _rounded(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in cols})


def voxel_reduce(spark: SparkSession, d: str) -> DataFrame:
    """A1: mean point of every occupied cell."""
    return _rounded(clouds.voxel_reduce(points(spark, d), KEYS, EDGE), ["x", "y", "z", "r"])


def voxel_stats(spark: SparkSession, d: str) -> DataFrame:
    """A2: points in, cells, single and largest cells per sweep."""
    return clouds.voxel_stats(points(spark, d), KEYS, EDGE)


def roi_filter(spark: SparkSession, d: str) -> DataFrame:
    """Finite points inside the (scaled) range and region with a score over the threshold."""
    p = points(spark, d)
    x, y, z = (F.col(a) * 50 for a in ("x", "y", "z"))
    keep = g.finite(F.col("x"), F.col("y"), F.col("z")) & (g.planar_range(x, y) <= 10.0) & g.in_roi(x, y, z) & g.over(F.col("r"), 0.0)
    return p.where(keep).select("sweep", "idx")


def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Touching cells."""
    return clouds.neighbour_pairs(clouds.voxel_reduce(points(spark, d), KEYS, EDGE), KEYS)


def components(spark: SparkSession, d: str) -> DataFrame:
    """A4: connected cells, named by their smallest key."""
    return clouds.clusters(clouds.voxel_reduce(points(spark, d), KEYS, 0.05), KEYS)


def detections(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of three cells or more with centre, box and reflectance."""
    found = clouds.detections(clouds.voxel_reduce(points(spark, d), KEYS, 0.05), KEYS)
    return _rounded(found, ["cx", "cy", "cz", "reflectance", *[f"{a}_{b}" for a in ("min", "max") for b in "xyz"]])


def shape_table(spark: SparkSession, d: str) -> DataFrame:
    """Clusters (scaled) by shape, and by number of cells, in one pass."""
    found = clouds.detections(clouds.voxel_reduce(points(spark, d), KEYS, 0.05), KEYS)
    sides = [(F.col(f"max_{a}") - F.col(f"min_{a}")) * 10 for a in "xyz"]
    shaped = found.withColumn("shape", g.shape_class(*sides))
    tall = shaped.groupingSets([["shape"], ["voxel_count"]], "shape", "voxel_count")
    return tall.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("reflectance"), 6).alias("mean_reflectance"))


def answer_text(spark: SparkSession, d: str) -> DataFrame:
    """The answer of each sweep as a line of text."""
    n = nearest_in_path(spark, d)
    mm = F.round(F.col("distance") * 1000).cast("bigint").cast("string")
    return n.select("sweep", F.concat(F.lit("point "), F.col("idx").cast("string"), F.lit(" at "), mm, F.lit(" mm, "), F.col("candidates").cast("string"), F.lit(" on the path")).alias("answer"))


def ground_plane(spark: SparkSession, d: str) -> DataFrame:
    """Ground plane of each sweep."""
    return clouds.ground(clouds.voxel_reduce(points(spark, d), KEYS, EDGE), KEYS, EDGE)


def persistence(spark: SparkSession, d: str) -> DataFrame:
    """Share of a sweep's points with a point of the next sweep within 0.15."""
    p = points(spark, d)
    after = p.withColumn("sweep", F.col("sweep") - 1)
    hit = clouds.within_radius(p, after, KEYS, 0.15).select("sweep", "idx").distinct().withColumn("_hit", F.lit(1))
    joined = p.join(after.select("sweep").distinct(), "sweep", "left_semi").join(hit, ["sweep", "idx"], "left")
    return joined.groupBy("sweep").agg(F.count("_hit").alias("matched"), F.count(F.lit(1)).alias("total"))


def first_n_per_cell(spark: SparkSession, d: str) -> DataFrame:
    """The first four points of the first 50 pillars of each sweep, scaled into the region."""
    p = points(spark, d).select("sweep", "idx", ((F.col("x") + 0.5) * 60).alias("x"), (F.col("y") * 60).alias("y"), (F.col("z") * 2).alias("z"), "r")
    return clouds.pillars(p, KEYS, edge=4.0, most_points=4, most_cells=50).select("sweep", "idx", "row", "col", "place", "cell_no")


def point_in_rect(spark: SparkSession, d: str) -> DataFrame:
    """Each point named by the best of the sweep's turned boxes round it (points of high reflectance carry one)."""
    p = points(spark, d)
    tracks = p.select("sweep", F.col("idx").alias("track_id"), "x", "y")
    boxes = p.where(F.col("r") > 0.1).select("sweep", F.col("idx").alias("det_idx"), (F.col("idx") % 3).alias("class_id"), F.round(F.abs("z"), 1).alias("score"), "x", "y", F.lit(0.3).alias("dx"), F.lit(0.15).alias("dy"), F.col("r").alias("yaw"))
    return matching.name_tracks(tracks, boxes, KEYS, least=0.1)


def nearest_in_path(spark: SparkSession, d: str) -> DataFrame:
    """The nearest point ahead on a corridor of 0.1 either side, per sweep, and how many are on it."""
    on = (F.col("x") > 0) & (F.abs("y") <= 0.1)
    best = F.min_by(F.struct("idx", F.round("x", 6).alias("distance")), F.struct("x", "idx"))
    return points(spark, d).where(on).groupBy("sweep").agg(best.alias("_b"), F.count(F.lit(1)).alias("candidates")).select("sweep", "_b.*", "candidates")


def _near(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    after = p.withColumn("sweep", F.col("sweep") - 1)
    return clouds.within_radius(p, after, KEYS, 0.12).withColumn("cost", F.round("d2", 9))


def greedy_match(spark: SparkSession, d: str) -> DataFrame:
    """Points of neighbouring sweeps within 0.12, one to one, nearest first, by rounds of mutual best."""
    return matching.mutual_best(_near(spark, d).select("sweep", "idx", "idx2", "cost"), KEYS, "idx", "idx2", "cost").select("sweep", "idx", "idx2")


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).select("sweep", "idx", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + 0.1).alias("x1"), (F.col("y") + 0.1).alias("y1"), F.round("r", 4).alias("score"))


def nms(spark: SparkSession, d: str) -> DataFrame:
    """Boxes left after suppression of those that overlap a better one by more than 0.45."""
    return matching.nms(_boxes(spark, d), KEYS, "idx", "score").select("sweep", "idx")


def box_iou(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each box with those of its own sweep that its centre cell touches and that are numbered higher."""
    b = _boxes(spark, d).select("sweep", "idx", "x0", "y0", "x1", "y1")
    p = points(spark, d).withColumn("z", F.lit(0.0))
    near = clouds.within_radius(p, p, KEYS, 0.15).where(F.col("idx") < F.col("idx2")).select("sweep", "idx", "idx2")
    o = b.select("sweep", F.col("idx").alias("idx2"), *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")])
    j = near.join(b, ["sweep", "idx"]).join(o, ["sweep", "idx2"])
    iou = g.box_iou({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"o{c}") for c in ("x0", "y0", "x1", "y1")})
    return j.select("sweep", "idx", "idx2", F.round(iou, 6).alias("iou")).where(F.col("iou") > 0)


def track_points(spark: SparkSession, d: str) -> DataFrame:
    """ST10: points followed through rows of ten (a label is a drive, ten ids are a sweep)."""
    p = points(spark, d).select(F.col("sweep").alias("drive"), F.call_function("div", F.col("idx"), F.lit(10).cast("bigint")).alias("seq"), "idx", *[(F.col(a) * 10).alias(a) for a in "xyz"])
    told = tracker.follow(p.withColumn("at_ns", F.col("seq") * 103_000_000), "drive", "seq", "at_ns", "idx")
    return tracker.answers(told, ["drive", "seq"])


def most_urgent(spark: SparkSession, d: str) -> DataFrame:
    """Per drive of such points, the answer with the smallest positive time to contact."""
    return tracker.most_urgent(track_points(spark, d), ["drive"], "seq")


QUERIES = {
    f.__name__: f
    for f in (
        voxel_reduce, voxel_stats, roi_filter, neighbour_pairs, components, detections, shape_table, answer_text, ground_plane, persistence, first_n_per_cell, point_in_rect,
        nearest_in_path, greedy_match, nms, box_iou, track_points, most_urgent,
    )
}

_POINTS = "WITH RECURSIVE p AS (SELECT label AS sweep, vec_id AS idx, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, embedding[4]::DOUBLE AS r FROM embeddings)"


def _cells(edge: float) -> str:
    f = f"(({edge}::FLOAT)::DOUBLE)"
    return (
        _POINTS
        + f""", v AS (SELECT sweep, floor(x / {f})::BIGINT AS ix, floor(y / {f})::BIGINT AS iy, floor(z / {f})::BIGINT AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(r) AS r, count(*) AS n FROM p GROUP BY 1, 2, 3, 4),
k AS (SELECT *, ((ix + 1048576) << 42) + ((iy + 1048576) << 21) + (iz + 1048576) AS key FROM v)"""
    )


_CLOSURE = _cells(0.05) + """, e AS (SELECT a.sweep, a.key AS a, b.key AS b FROM k a JOIN k b ON a.sweep = b.sweep AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1),
reach AS (SELECT sweep, a, b FROM e UNION SELECT reach.sweep, reach.a, e.b FROM reach JOIN e ON reach.sweep = e.sweep AND reach.b = e.a),
c AS (SELECT sweep, a AS key, min(b) AS component FROM reach GROUP BY ALL)"""

SQL = {
    "voxel_reduce": _cells(EDGE) + " SELECT sweep, ix, iy, iz, key, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(r, 6) + 0.0 AS r FROM k",
    "voxel_stats": _cells(EDGE) + " SELECT sweep, sum(n)::BIGINT AS points_in, 0::BIGINT AS not_finite, 0::BIGINT AS off_grid, count(*) AS cells, count(*) FILTER (n = 1) AS single, max(n) AS largest FROM k GROUP BY sweep",
    "roi_filter": _POINTS + " SELECT sweep, idx FROM p WHERE sqrt(x * 50 * x * 50 + y * 50 * y * 50) <= 10 AND x * 50 >= 0 AND x * 50 < 69.12 AND y * 50 >= -39.68 AND y * 50 < 39.68 AND z * 50 >= -3 AND z * 50 < 1 AND r > 0",
    "neighbour_pairs": _cells(EDGE) + " SELECT a.sweep, a.ix, a.iy, a.iz, b.ix AS jx, b.iy AS jy, b.iz AS jz FROM k a JOIN k b ON a.sweep = b.sweep AND abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 AND abs(a.iz - b.iz) <= 1 AND b.key > a.key",
    "components": _CLOSURE + " SELECT sweep, ix, iy, iz, component FROM k JOIN c USING (sweep, key)",
    "detections": _CLOSURE
    + """, m AS (SELECT sweep, component, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z,
  count(*) AS voxel_count, avg(r) AS reflectance FROM k JOIN c USING (sweep, key) GROUP BY ALL HAVING count(*) >= 3)
SELECT sweep, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round(min_x, 6) + 0.0 AS min_x, round(min_y, 6) + 0.0 AS min_y, round(min_z, 6) + 0.0 AS min_z,
  round(max_x, 6) + 0.0 AS max_x, round(max_y, 6) + 0.0 AS max_y, round(max_z, 6) + 0.0 AS max_z, voxel_count, round(reflectance, 6) + 0.0 AS reflectance,
  (row_number() OVER (PARTITION BY sweep ORDER BY component) - 1)::INTEGER AS det_idx FROM m""",
    "shape_table": _CLOSURE
    + """, m AS (SELECT sweep, component, (max(x) - min(x)) * 10 AS dx, (max(y) - min(y)) * 10 AS dy, (max(z) - min(z)) * 10 AS dz, count(*) AS voxel_count, avg(r) AS reflectance FROM k JOIN c USING (sweep, key) GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT *, CASE WHEN greatest(dx, dy, dz) > 6 THEN 'merged' WHEN dx < 1 AND dy < 1 AND dz < 0.8 THEN 'fragment' ELSE 'object' END AS shape FROM m)
SELECT shape, voxel_count, count(*) AS n, round(avg(reflectance), 6) AS mean_reflectance FROM s GROUP BY GROUPING SETS ((shape), (voxel_count))""",
    "answer_text": _POINTS
    + """, c AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY x, idx) AS i, count(*) OVER (PARTITION BY sweep) AS candidates FROM p WHERE x > 0 AND abs(y) <= 0.1)
SELECT sweep, 'point ' || idx || ' at ' || round(round(x, 6) * 1000)::BIGINT || ' mm, ' || candidates || ' on the path' AS answer FROM c WHERE i = 1""",
    "persistence": _POINTS + """ SELECT a.sweep, count(*) FILTER (EXISTS (SELECT 1 FROM p b WHERE b.sweep = a.sweep + 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0225)) AS matched, count(*) AS total
FROM p a WHERE a.sweep + 1 IN (SELECT sweep FROM p) GROUP BY a.sweep""",
    "first_n_per_cell": _POINTS
    + """, s AS (SELECT sweep, idx, (x + 0.5) * 60 AS x, y * 60 AS y, z * 2 AS z FROM p), i AS (SELECT *, floor((x - 0.0) / 4.0)::BIGINT AS col, floor((y + 39.68) / 4.0)::BIGINT AS row FROM s WHERE x >= 0 AND x < 69.12 AND y >= -39.68 AND y < 39.68 AND z >= -3 AND z < 1),
n AS (SELECT *, (row_number() OVER (PARTITION BY sweep, row, col ORDER BY idx))::INTEGER AS place, (dense_rank() OVER (PARTITION BY sweep ORDER BY row, col))::INTEGER AS cell_no FROM i)
SELECT sweep, idx, row, col, place, cell_no FROM n WHERE place <= 4 AND cell_no <= 50""",
    "point_in_rect": _POINTS
    + """, b AS (SELECT sweep, idx AS det_idx, idx % 3 AS class_id, round(abs(z), 1) AS score, x, y, r AS yaw FROM p WHERE r > 0.1 AND round(abs(z), 1) >= 0.1),
h AS (SELECT p.sweep, p.idx AS track_id, b.det_idx, b.class_id, b.score, row_number() OVER (PARTITION BY p.sweep, p.idx ORDER BY b.score DESC, b.det_idx) AS i
  FROM p JOIN b ON p.sweep = b.sweep AND abs((p.x - b.x) * cos(yaw) + (p.y - b.y) * sin(yaw)) <= 0.15 AND abs((p.y - b.y) * cos(yaw) - (p.x - b.x) * sin(yaw)) <= 0.075)
SELECT p.sweep, p.idx AS track_id, det_idx, class_id, score FROM p LEFT JOIN h ON p.sweep = h.sweep AND p.idx = h.track_id AND h.i = 1""",
    "nearest_in_path": _POINTS
    + """, c AS (SELECT *, row_number() OVER (PARTITION BY sweep ORDER BY x, idx) AS i, count(*) OVER (PARTITION BY sweep) AS candidates FROM p WHERE x > 0 AND abs(y) <= 0.1)
SELECT sweep, idx, round(x, 6) AS distance, candidates FROM c WHERE i = 1""",
    "greedy_match": _POINTS
    + """, q AS (SELECT a.sweep, a.idx, b.idx AS idx2, row_number() OVER (PARTITION BY a.sweep ORDER BY round((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), 9), a.idx, b.idx) AS i
  FROM p a JOIN p b ON b.sweep = a.sweep + 1 AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 0.0144),
g AS (SELECT DISTINCT sweep, 0::BIGINT AS i, []::BIGINT[] AS l, []::BIGINT[] AS r FROM q
  UNION ALL SELECT g.sweep, q.i, CASE WHEN list_contains(l, idx) OR list_contains(r, idx2) THEN l ELSE list_append(l, idx) END, CASE WHEN list_contains(l, idx) OR list_contains(r, idx2) THEN r ELSE list_append(r, idx2) END
  FROM g JOIN q ON q.sweep = g.sweep AND q.i = g.i + 1),
t AS (SELECT sweep, arg_max(l, i) AS l, arg_max(r, i) AS r FROM g GROUP BY sweep)
SELECT sweep, unnest(l) AS idx, unnest(r) AS idx2 FROM t""",
    "nms": _POINTS
    + """, q AS (SELECT sweep, idx, x, y, row_number() OVER (PARTITION BY sweep ORDER BY round(r, 4) DESC, idx) AS i FROM p),
g AS (SELECT DISTINCT sweep, 0::BIGINT AS i, []::STRUCT(idx BIGINT, x DOUBLE, y DOUBLE)[] AS kept FROM q
  UNION ALL SELECT g.sweep, q.i, CASE WHEN len(list_filter(kept, lambda k: greatest(0.1 - abs(k.x - q.x), 0) * greatest(0.1 - abs(k.y - q.y), 0) * 1.45 > 0.45 * 0.02)) > 0 THEN kept
    ELSE list_append(kept, {'idx': q.idx, 'x': q.x, 'y': q.y}) END
  FROM g JOIN q ON q.sweep = g.sweep AND q.i = g.i + 1),
t AS (SELECT sweep, arg_max(kept, i) AS kept FROM g GROUP BY sweep), u AS (SELECT sweep, unnest(kept) AS k FROM t)
SELECT sweep, k.idx AS idx FROM u""",
    "box_iou": _POINTS
    + """, j AS (SELECT a.sweep, a.idx, b.idx AS idx2, greatest(least(a.x, b.x) + 0.1 - greatest(a.x, b.x), 0) * greatest(least(a.y, b.y) + 0.1 - greatest(a.y, b.y), 0) AS i
  FROM p a JOIN p b ON a.sweep = b.sweep AND a.idx < b.idx AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0225)
SELECT sweep, idx, idx2, round(i / (0.02 - i), 6) AS iou FROM j WHERE round(i / (0.02 - i), 6) > 0""",
}
