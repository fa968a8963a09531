"""Queries that check pairings again from other tables, and smaller figures of streams and clouds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.operators import pairing, ranks
from helmsway.operators.sequences import with_previous
from helmsway.plans import clouds, streams
from helmsway.plans.evidence import EPOCH, rows_once
from helmsway.sources.tables import table


def pair_check(spark: SparkSession, d: str) -> DataFrame:
    """Per epoch, from evidence alone: sweeps, those with a camera sample inside, and those whose sample gave detections to the tracker."""
    e = table(spark, d, "evidence").where(F.col("tov_start_ns") != 0).withColumn("at", F.struct(*EPOCH))
    sample = lambda s: e.where(F.col("stream") == s).groupBy(*EPOCH, "at", "seq").agg(*[F.min(c).alias(c) for c in ("tov_start_ns", "tov_end_ns", "arrival_ns")])
    spans = sample(1).select("at", "seq", F.col("tov_start_ns").alias("start_ns"), F.col("tov_end_ns").alias("end_ns"), F.col("tov_start_ns").alias("trigger_ns"), "arrival_ns")
    frames = sample(0).select("at", "seq", F.col("tov_start_ns").alias("at_ns"), "arrival_ns")
    paired = pairing.pair_interval(spans, frames, "at", wait=False)
    dets = e.where((F.col("edge") == "cam_det->track") & (F.col("outcome") == "Delivered")).select("at", F.col("seq").alias("pair_seq")).distinct().withColumn("_det", F.lit(1))
    joined = paired.join(dets, ["at", "pair_seq"], "left")
    per = joined.groupBy("at").agg(F.count(F.lit(1)).alias("sweeps"), F.count("pair_seq").alias("paired"), F.count("_det").alias("with_detections"))
    return per.select("at.*", "sweeps", "paired", "with_detections")


def side_choice(spark: SparkSession, d: str) -> DataFrame:
    """ST11, ST12: the camera a sweep goes by, left before right, and whether the right one, though it runs, has no frame for it."""
    left = streams.pair_interval(spark, d).select("drive", "seq", F.col("outcome").alias("left"))
    spans = streams.sweeps(spark, d).select("drive", "seq", F.col("tov_start_ns").alias("start_ns"), F.col("tov_end_ns").alias("end_ns"), "trigger_ns", "arrival_ns")
    frames = table(spark, d, "frames").where(F.col("side") == "right").groupBy("drive", "seq", F.col("tov_ns").alias("at_ns")).agg(F.min("arrival_ns").alias("arrival_ns"))
    right = pairing.pair_interval(spans, frames, "drive").select("drive", "seq", F.col("outcome").alias("right"))
    side = F.when(F.col("left") == "paired", "left").when(F.col("right") == "paired", "right").otherwise("expired")
    alone = (F.col("left") == "paired") & ~F.col("right").isin("paired", "pair_absent", "no_span")
    return left.join(right, ["drive", "seq"]).select("drive", "seq", side.alias("side"), alone.alias("one_camera"))


def rounded_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by rounded index, v[round(p/100 (n-1))], of the bytes of a sample per stream."""
    at = lambda p: F.round((F.col("n") - 1) * p / 100).cast("bigint") + 1
    return ranks.order_statistics(rows_once(spark, d), ["stream"], "payload_bytes", {f"p{p}": at(p) for p in (10, 50, 95)})


def timing_splits(spark: SparkSession, d: str) -> DataFrame:
    """Median and 95th percentile of decoding and processing time per stage, in microseconds."""
    e = table(spark, d, "evidence").where(F.col("outcome") == "Delivered")
    once = e.groupBy(*EPOCH, "edge", "stage", "seq").agg(F.min("decode_ns").alias("decode"), F.min(F.col("proc_end_ns") - F.col("proc_start_ns")).alias("proc"))
    long = once.select("stage", F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.call_function("div", F.col(n), F.lit(1000).cast("bigint")).alias("us")) for n in ("decode", "proc")])))
    return ranks.order_statistics(long, ["stage", "part"], "us", {"p50_us": ranks.nearest_rank(50), "p95_us": ranks.nearest_rank(95)})


def extents(spark: SparkSession, d: str) -> DataFrame:
    """Bounding box, number and widest side of each sweep's points."""
    sides = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
    boxes = clouds.points(spark, d).groupBy("sweep").agg(F.count(F.lit(1)).alias("points"), *sides)
    return boxes.withColumn("widest", F.round(F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") for a in "xyz"]), 6))


def merged_views(spark: SparkSession, d: str) -> DataFrame:
    """Points offered and kept by the views ahead and behind, put together per sweep."""
    p = clouds.points(spark, d).select("sweep", *[(F.col(a) * 50).alias(a) for a in ("x", "y", "z")])
    views = [
        p.groupBy("sweep").agg(F.count(F.lit(1)).alias("offered"), F.count_if(g.in_roi(F.col("x") * s, F.col("y") * s, F.col("z"))).alias("kept")) for s in (1.0, -1.0)
    ]
    return views[0].unionByName(views[1]).groupBy("sweep").agg(F.max("offered").alias("offered"), F.sum("kept").alias("kept"))


def decimated(spark: SparkSession, d: str) -> DataFrame:
    """every tenth point."""
    return clouds.points(spark, d).where(F.pmod("idx", F.lit(10)) == 0).select("sweep", "idx")


def known_policies(spark: SparkSession, d: str) -> DataFrame:
    """epochs by queue policy, those of an unknown policy counted and not read."""
    known = F.col("policy").isin("drop-oldest", "drop-newest", "block")
    return table(spark, d, "runs").groupBy(F.when(known, F.col("policy")).otherwise("unknown").alias("policy")).agg(F.count(F.lit(1)).alias("epochs"))


def ego_carry(spark: SparkSession, d: str) -> DataFrame:
    """M3: where a fixed point 10 m ahead at one reading is seen at the next, by the later one's motion."""
    rows = table(spark, d, "ego").where(g.finite(F.col("vf"), F.col("vl"), F.col("yaw_rate")) & F.col("tov_ns").isNotNull())
    once = rows.groupBy("drive", "tov_ns").agg(F.min(F.struct("seq", "vf", "vl", "yaw_rate")).alias("_r")).select("drive", "tov_ns", "_r.*")
    stepped = with_previous(once, ["drive"], "tov_ns", "prev", 60_000_000_000).where(F.col("tov_ns") - F.col("prev") < 1_000_000_000)
    dt = (F.col("tov_ns") - F.col("prev")) * 1e-9
    x, y = g.carried(F.lit(10.0), F.lit(0.0), F.col("vf"), F.col("vl"), F.col("yaw_rate"), dt)
    sane = (F.abs("vf") < 100) & (F.abs("vl") < 100) & (F.abs("yaw_rate") < 10)
    return stepped.where(sane).select("drive", "seq", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


QUERIES = {f.__name__: f for f in (pair_check, side_choice, rounded_percentiles, timing_splits, extents, merged_views, decimated, known_policies, ego_carry)}

SQL = {
    "pair_check": """
WITH s AS (SELECT run_id, epoch, stream, seq, min(tov_start_ns) AS a, min(tov_end_ns) AS b FROM evidence WHERE tov_start_ns <> 0 GROUP BY ALL),
p AS (SELECT l.run_id, l.epoch, l.seq, arg_min(c.seq, {'t': c.a, 'n': c.seq}) AS pair_seq FROM s l LEFT JOIN s c ON c.stream = 0 AND l.run_id = c.run_id AND l.epoch = c.epoch AND c.a >= l.a AND c.a < l.b AND l.b > l.a
  WHERE l.stream = 1 GROUP BY ALL),
d AS (SELECT DISTINCT run_id, epoch, seq AS pair_seq, 1 AS det FROM evidence WHERE edge = 'cam_det->track' AND outcome = 'Delivered' AND tov_start_ns <> 0)
SELECT run_id, epoch, count(*) AS sweeps, count(pair_seq) AS paired, count(det) AS with_detections FROM p LEFT JOIN d USING (run_id, epoch, pair_seq) GROUP BY run_id, epoch""",
    "side_choice": "WITH l AS (" + streams._pair_sql(0) + " SELECT drive, seq, outcome FROM paired), r AS (" + streams._pair_sql(0, "right") + """ SELECT drive, seq, outcome FROM paired)
SELECT drive, seq, CASE WHEN l.outcome = 'paired' THEN 'left' WHEN r.outcome = 'paired' THEN 'right' ELSE 'expired' END AS side,
  l.outcome = 'paired' AND r.outcome NOT IN ('paired', 'pair_absent', 'no_span') AS one_camera FROM l JOIN r USING (drive, seq)""",
    "rounded_percentiles": """
WITH e AS (SELECT run_id, epoch, edge, seq, unnest(min_by({'stream': stream, 'payload_bytes': payload_bytes}, {'a': arrival_ns, 's': arrival_seq})) FROM evidence GROUP BY run_id, epoch, edge, seq),
r AS (SELECT stream, payload_bytes AS v, row_number() OVER (PARTITION BY stream ORDER BY payload_bytes) AS i, count(*) OVER (PARTITION BY stream) AS n FROM e WHERE payload_bytes IS NOT NULL)
SELECT stream, n, max(v) FILTER (i = round((n - 1) * 10 / 100.0)::BIGINT + 1) AS p10, max(v) FILTER (i = round((n - 1) * 50 / 100.0)::BIGINT + 1) AS p50, max(v) FILTER (i = round((n - 1) * 95 / 100.0)::BIGINT + 1) AS p95 FROM r GROUP BY stream, n""",
    "timing_splits": """
WITH o AS (SELECT stage, min(decode_ns) // 1000 AS decode, min(proc_end_ns - proc_start_ns) // 1000 AS proc FROM evidence WHERE outcome = 'Delivered' GROUP BY run_id, epoch, edge, stage, seq),
l AS (UNPIVOT o ON decode, proc INTO NAME part VALUE us)
SELECT stage, part, count(us) AS n, quantile_disc(us, 0.5) AS p50_us, quantile_disc(us, 0.95) AS p95_us FROM l GROUP BY stage, part""",
    "extents": clouds._POINTS + """ SELECT sweep, count(*) AS points, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z,
  round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS widest FROM p GROUP BY sweep""",
    "merged_views": clouds._POINTS + """, q AS (SELECT sweep, x * 50 AS x, y * 50 AS y, z * 50 AS z FROM p)
SELECT sweep, count(*) AS offered, count(*) FILTER (z >= -3 AND z < 1 AND x >= 0 AND x < 69.12 AND y >= -39.68 AND y < 39.68) + count(*) FILTER (z >= -3 AND z < 1 AND -x >= 0 AND -x < 69.12 AND -y >= -39.68 AND -y < 39.68) AS kept FROM q GROUP BY sweep""",
    "decimated": "SELECT label AS sweep, vec_id AS idx FROM embeddings WHERE vec_id % 10 = 0",
    "known_policies": "SELECT CASE WHEN policy IN ('drop-oldest', 'drop-newest', 'block') THEN policy ELSE 'unknown' END AS policy, count(*) AS epochs FROM runs GROUP BY 1",
    "ego_carry": """
WITH o AS (SELECT drive, tov_ns, unnest(min({'seq': seq, 'vf': vf, 'vl': vl, 'w': yaw_rate})) FROM ego WHERE isfinite(vf) AND isfinite(vl) AND isfinite(yaw_rate) AND tov_ns IS NOT NULL GROUP BY drive, tov_ns),
p AS (SELECT *, tov_ns - lag(tov_ns) OVER (PARTITION BY drive ORDER BY tov_ns) AS step FROM o), m AS (SELECT *, step * 1e-9 AS dt FROM p WHERE step < 1000000000 AND abs(vf) < 100 AND abs(vl) < 100 AND abs(w) < 10)
SELECT drive, seq, round((10 - vf * dt) * cos(-w * dt) - (-vl * dt) * sin(-w * dt), 5) AS x, round((10 - vf * dt) * sin(-w * dt) + (-vl * dt) * cos(-w * dt), 5) AS y FROM m""",
}
