"""Clouds, matching and tracking against closed forms and brute force."""

import random

import numpy as np
from oracle import rows_of, same
from pyspark.sql import functions as F

from helmsway.operators import clouds, matching, tracker

POINTS = "sweep int, idx bigint, x double, y double, z double, r double"


def road(seed=0):
    """Flat ground at -1.7 m with three boxes on it."""
    r = np.random.default_rng(seed)
    ground = np.c_[r.uniform(-25, 25, (6000, 2)), -1.7 + r.normal(0, 0.01, 6000)]
    things = [np.c_[r.uniform(-1, 1, (400, 1)) + x, r.uniform(-0.8, 0.8, (400, 1)) + y, r.uniform(-1.2, 0, (400, 1))] for x, y in ((8, 0), (15, 6), (-10, -5))]
    p = np.vstack([ground, *things])
    return [(1, i, *map(float, q), 0.5) for i, q in enumerate(p)]


def test_road_with_three_things(spark):
    voxels = clouds.voxel_reduce(spark.createDataFrame(road(), POINTS), ["sweep"], 0.4).cache()
    plane = clouds.ground(voxels, ["sweep"], 0.4)
    p = plane.first()
    assert p["fitted"] and abs(p["nz"] - 1) < 1e-3 and abs(p["d"] - 1.7) < 0.05
    found = clouds.detections(clouds.above_ground(voxels, plane, ["sweep"], 0.4), ["sweep"]).collect()
    assert sorted((round(d["cx"]), round(d["cy"])) for d in found) == [(-10, -5), (8, 0), (15, 6)]


def test_order_of_points_does_not_matter(spark):
    rows = road(1)[:2000] + [(1, 9_000, float("nan"), 0.0, 0.0, 0.1), (1, 9_001, 1e9, 0.0, 0.0, 0.1)]
    one = clouds.voxel_reduce(spark.createDataFrame(rows, POINTS), ["sweep"], 0.2, exact=True).toPandas()
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, POINTS).repartition(5)
    assert rows_of(clouds.voxel_reduce(df, ["sweep"], 0.2, exact=True).toPandas()) == rows_of(one)
    stats = clouds.voxel_stats(df, ["sweep"], 0.2).first()
    assert (stats["points_in"], stats["not_finite"], stats["off_grid"], stats["cells"]) == (2002, 1, 1, len(one))


def test_diagonal_chain_is_one_object_and_plane_falls_back(spark):
    chain = [(1, i, i + 0.5, i + 0.5, i + 0.5, 0.1) for i in range(5)] + [(2, 0, 0.5, 0.5, 0.5, 0.1)]
    voxels = clouds.voxel_reduce(spark.createDataFrame(chain, POINTS), ["sweep"], 1.0)
    assert voxels.join(clouds.clusters(voxels, ["sweep"]), ["sweep", "ix", "iy", "iz"]).groupBy("sweep").agg(F.count_distinct("component")).orderBy("sweep").collect() == [(1, 1), (2, 1)]
    flat = {r["sweep"]: (r["fitted"], r["nz"], r["median_z"]) for r in clouds.ground(voxels, ["sweep"], 0.2).collect()}
    assert flat == {1: (False, 1.0, 2.5), 2: (False, 1.0, 0.5)}


def test_first_points_of_a_pillar(spark):
    rows = [(1, i, 1.0, 1.0, -1.0, i / 100) for i in range(40)] + [(1, 99, 70.0, 0.0, 0.0, 0.1), (1, 98, 0.0, -39.68, -3.0, 0.1)]
    got = clouds.pillars(spark.createDataFrame(rows, POINTS), ["sweep"]).collect()
    assert sorted(r["idx"] for r in got) == [*range(32), 98] and all(abs(r["mx"]) < 1e-9 for r in got)


def test_matching_by_rounds_equals_best_first(spark):
    r = random.Random(2)
    rows = [(g, a, b, float(r.choice([1, 1, 2, 3, 5]))) for g in range(12) for a in range(6) for b in range(6) if r.random() < 0.6]
    df = spark.createDataFrame(rows + rows[:5] + [(0, 1, 1, None), (0, 1, 2, float("nan"))], "g int, a int, b int, cost double")
    assert same(matching.mutual_best(df, ["g"], "a", "b", "cost").toPandas(), matching.greedy(df, ["g"], "a", "b", "cost").toPandas()) == ""
    assert matching.mutual_best(df.limit(0), ["g"], "a", "b", "cost").count() == 0


BOXES = "seq int, {id} bigint, x0 double, y0 double, x1 double, y1 double"


def test_fusion_goes_by_overlap_not_by_order(spark):
    tracks = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 1.0, 0.0, 11.0, 10.0), (1, 3, 50.0, 0.0, 60.0, 10.0)], BOXES.format(id="track_id"))
    dets = spark.createDataFrame([(1, 0, 1.0, 0.0, 11.0, 10.0, 7, 0.9)], BOXES.format(id="det_idx") + ", class_id int, confidence double")
    got = {r["track_id"]: (r["population"], r["det_idx"]) for r in matching.fuse(tracks, dets, ["seq"]).collect()}
    assert got == {1: ("lidar_only", None), 2: ("fused", 0), 3: ("lidar_only", None)}


def test_stereo(spark):
    left = spark.createDataFrame([(1, 0, 100.0, 50.0, 140.0, 90.0, 2), (1, 1, 100.0, 50.0, 140.0, 90.0, 3)], BOXES.format(id="det_idx") + ", class_id int")
    right = spark.createDataFrame([(1, 5, 80.0, 52.0, 120.0, 91.0, 2), (1, 6, 80.0, 70.0, 120.0, 91.0, 3)], BOXES.format(id="det_idx") + ", class_id int")
    assert [(r["det_idx"], r["right_idx"], r["range_m"]) for r in matching.stereo(left, right, ["seq"], 400.0).collect()] == [(0, 5, 20.0)]


def test_labels_take_their_best_detection(spark):
    labels = spark.createDataFrame([(1, 7, 0.0, 0.0, 10.0, 10.0), (1, 8, 90.0, 0.0, 95.0, 10.0)], BOXES.format(id="label"))
    dets = spark.createDataFrame([(1, 0, 2.0, 0.0, 12.0, 10.0), (1, 1, 0.0, 0.0, 10.0, 9.0)], BOXES.format(id="det_idx"))
    got = {r["label"]: r["det_idx"] for r in matching.best_labels(labels, dets, ["seq"], "label", 0.5).collect()}
    assert got == {7: 1, 8: None}


DETS = "drive string, seq bigint, at_ns bigint, idx bigint, x double, y double, z double"
STEP = 100_000_000


def moving(seqs):
    return [("d", s, s * STEP, 0, 10.0 + s * 0.5, 0.0, 0.0) for s in seqs]


def follow(spark, rows):
    return tracker.follow(spark.createDataFrame(rows, DETS), "drive", "seq", "at_ns", "idx").orderBy("seq", "track_id").collect()


def test_track_is_told_of_from_two_sightings_and_has_a_velocity(spark):
    got = follow(spark, moving(range(5)))
    assert [(r["seq"], r["track_id"], r["observations"]) for r in got] == [(s, 0, s + 1) for s in range(1, 5)]
    assert abs(got[-1]["vx"] - 5.0) < 1e-9


def test_coasts_once_then_dies(spark):
    blank = [("d", s, s * STEP, None, None, None, None) for s in (3, 4)]
    got = follow(spark, moving(range(3)) + blank + moving([5, 6]))
    assert [(r["seq"], r["track_id"], r["misses"]) for r in got] == [(1, 0, 0), (2, 0, 0), (3, 0, 1), (6, 1, 0)]


def test_gap_resets_and_order_of_rows_does_not_matter(spark):
    rows = moving([0, 1, 2, 7, 8])
    got = follow(spark, rows)
    assert [(r["seq"], r["stretch"], r["observations"]) for r in got] == [(1, 0, 2), (2, 0, 3), (8, 7, 2)]
    assert follow(spark, rows[::-1]) == got


def test_streaming_tracker_equals_batch(spark, tmp_path):
    from helmsway.streaming.tracks import follow_stream, read_replay, write_replay

    r = random.Random(4)
    rows = [("d", s, s * STEP, i, i * 4 + s * 0.3 + r.random() * 0.1, i * 2.0, 0.0) for s in [*range(6), *range(9, 15)] for i in range(3) if r.random() < 0.9]
    df = spark.createDataFrame(rows, DETS)
    write_replay(df, str(tmp_path / "in"), "seq", 3)
    query = follow_stream(read_replay(spark, str(tmp_path / "in"), df.schema), "drive", "seq", "at_ns", "idx").writeStream.format("memory").queryName("tracks").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = tracker.follow(df, "drive", "seq", "at_ns", "idx").drop("stretch").toPandas()
    assert len(batch) > 20 and same(spark.table("tracks").toPandas(), batch) == ""


def test_answers_flag_the_nearest_on_the_path(spark):
    tracks = spark.createDataFrame(
        [("d", 1, 5, 20.0, 0.0, -3.0, 0.0, 2, 0, 1.0), ("d", 1, 6, 12.0, 0.5, -2.0, 0.0, 2, 0, 1.0), ("d", 1, 7, 5.0, 0.0, 0.0, 0.0, 2, 1, 1.0), ("d", 1, 8, 8.0, 2.0, 0.0, 0.0, 2, 0, 1.0)],
        "drive string, seq int, track_id int, x double, y double, vx double, vy double, observations int, misses int, age_s double",
    )
    got = {r["track_id"]: (r["in_path"], r["nearest"], round(r["ttc_s"], 6)) for r in tracker.answers(tracks, ["drive", "seq"]).collect()}
    assert got == {5: (True, False, round(20 / 2.6, 6)), 6: (True, True, 7.5), 7: (False, False, 0.0), 8: (False, False, 0.0)}


def test_stream_join_waits_and_tells_of_the_lost(spark, tmp_path):
    from helmsway.streaming.tracks import pair_stream, read_replay, write_replay

    left = spark.createDataFrame([(i, i) for i in range(40)], "seq int, s int").select("seq", F.timestamp_seconds(F.col("s") * 10).alias("at"))
    right = left.where("seq % 4 > 0").withColumn("at", F.expr("at + INTERVAL 1 SECOND"))
    for name, df in (("l", left), ("r", right)):
        write_replay(df, str(tmp_path / name), "at", 4)
    stream = pair_stream(read_replay(spark, str(tmp_path / "l"), left.schema), read_replay(spark, str(tmp_path / "r"), left.schema), ["seq"], "at", "20 seconds")
    query = stream.writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r["seq"]: r["right_at"] is not None for r in spark.table("pairs").collect()}
    assert all(v == (k % 4 > 0) for k, v in got.items()) and sum(got.values()) == 30 and sum(not v for v in got.values()) >= 8
