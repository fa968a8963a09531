import math

import pytest
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.functions.config import RunConfig, drive_date, viewer_host
from helmsway.operators import matching

BOXES = "seq int, {id} bigint, x0 double, y0 double, x1 double, y1 double"


def test_right_image_confirms_demotes_and_finds(spark):
    fused = spark.createDataFrame(
        [(1, 1, 0, 0.9, 7, 0.8, "fused"), (1, 2, 1, 0.9, 7, 0.8, "fused"), (1, 3, None, None, None, None, "lidar_only"), (1, 4, None, None, None, None, "lidar_only")],
        "seq int, track_id bigint, det_idx bigint, iou double, class_id int, confidence double, population string",
    )
    right = spark.createDataFrame([(1, i, 20.0 * i, 0.0, 20.0 * i + 10, 10.0, i != 4) for i in (1, 2, 3, 4)], BOXES.format(id="track_id") + ", in_left boolean")
    dets = spark.createDataFrame([(1, 0, 20.0, 0.0, 30.0, 10.0, 7, 0.5), (1, 1, 40.0, 0.0, 50.0, 10.0, 3, 0.6), (1, 2, 60.0, 0.0, 70.0, 10.0, 5, 0.7), (1, 3, 80.0, 0.0, 90.0, 10.0, 5, 0.7)], BOXES.format(id="det_idx") + ", class_id int, confidence double")
    got = {r["track_id"]: (r["population"], r["det_idx"], r["class_id"], r["right_idx"]) for r in matching.confirm(fused, right, dets, ["seq"]).collect()}
    assert got == {1: ("fused", 0, 7, 0), 2: ("one_camera", 1, 7, None), 3: ("one_camera", None, 5, 2), 4: ("lidar_only", None, None, None)}


def test_pieces_of_a_fused_object(spark):
    row = lambda i, pop, x0, x1, x: (1, i, pop, x0, 0.0, x1, 10.0, x, 0.0, 0.0, 8.0, -1.0, -1.0, 12.0, 1.0, 1.0)
    tracks = spark.createDataFrame(
        [row(1, "fused", 0.0, 100.0, 10.0), row(2, "lidar_only", 90.0, 110.0, 12.3), row(3, "lidar_only", 91.0, 111.0, 10.0), row(4, "lidar_only", 10.0, 20.0, 12.6)],
        "seq int, track_id int, population string, x0 double, y0 double, x1 double, y1 double, x double, y double, z double, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double",
    )
    assert [r["track_id"] for r in matching.inside_fused(tracks, ["seq"], 0.5).collect()] == [2]


def test_records_that_contradict_themselves(spark):
    ok = ("fused", 3, True, True, True, 0, None)
    rows = [ok, ("fused", None, True, False, True, 0, None), ("lidar_only", 3, True, False, True, 0, None), ("unfused", None, False, True, False, 0, None), ("one_camera", 1, True, False, False, 1, None), ("lidar_only", None, False, False, False, 1, 2), ("odd", None, False, False, False, 0, None), ("lidar_only", None, False, False, False, 1, None)]
    df = spark.createDataFrame(rows, "population string, class_id int, in_frame boolean, nearest boolean, in_path boolean, misses int, lidar_class int")
    rule = matching.consistent("population", "class_id", "in_frame", "nearest", "in_path", "misses", "lidar_class")
    assert [r[0] for r in df.select(rule).collect()] == [True, False, False, False, False, False, False, True]


def test_stereo_check(spark):
    df = spark.createDataFrame([(10.0, 10.5), (20.0, 25.0), (0.0, 0.5), (40.0, 43.0)], "lidar double, stereo double")
    r = matching.stereo_check(df, "lidar", "stereo").first()
    assert (r["tracks"], r["median_abs_diff_m"], r["median_ratio"], r["within_fraction"]) == (4, 3.0, 1.075, 0.75)
    assert matching.stereo_check(df.limit(0), "lidar", "stereo").first()["tracks"] == 0


def test_map_round_trip(spark):
    lat, lon, yaw = F.lit(49.01), F.lit(8.43), F.lit(0.7)
    east, north = g.map_pose(lat, lon, yaw, lat, 0.8, -0.3)
    e, n = g.to_map(F.lit(5.0), F.lit(2.0), east, north, yaw)
    r = spark.range(1).select(*g.from_map(e, n, east, north, yaw), east, north).first()
    assert (r[0], r[1]) == pytest.approx((5.0, 2.0), abs=1e-6)
    scale = math.cos(math.radians(49.01)) * g.EARTH_RADIUS_M
    assert r[2] == pytest.approx(scale * math.radians(8.43) + math.cos(0.7) * 0.8 + math.sin(0.7) * 0.3)


def test_parameters():
    c = RunConfig("2011_09_26_drive_0005_sync", rate=None)
    assert not c.paced and RunConfig(c.drive).paced and drive_date(c.drive) == "2011_09_26" and viewer_host(" a.b ") == "a.b"
    for bad in ({"voxel_m": 0.0}, {"voxel_m": float("nan")}, {"capacity": 0}, {"capacity": 70_000}, {"policy": "none"}, {"rate": -1.0}, {"stale_ns": -1}):
        with pytest.raises(ValueError):
            RunConfig(c.drive, **bad)
    for f, v in ((drive_date, "drive_0005"), (viewer_host, "http://a"), (viewer_host, "a:9"), (viewer_host, " ")):
        with pytest.raises(ValueError):
            f(v)
