"""Answers by corners, the most urgent one, and what no track explains."""

from helmsway.operators import matching, tracker

TRACKS = "drive string, seq int, track_id int, x double, y double, vx double, vy double, observations int, misses int, age_s double"
BOX, RECT = ["min_x", "min_y", "max_x", "max_y"], ["lx", "ly", "ldx", "ldy", "lyaw"]


def test_gap_is_to_the_nearest_corner_and_the_rectangle_decides(spark):
    at = lambda i, box, rect, y=0.0: ("d", 1, i, 20.0, y, -3.0, 0.0, 2, 0, 1.0, *box, *rect)
    none = (None,) * 5
    rows = [
        at(1, (18.0, -1.0, 22.0, 1.0), none), at(2, (-1.0, -1.0, 22.0, 1.0), none), at(3, (17.0, 1.0, 22.0, 3.0), (20.0, 2.0, 4.0, 2.4, 0.0), 2.0),
        at(4, (16.0, 1.0, 22.0, 3.0), (20.0, 2.0, 4.0, 2.0, 0.0), 2.0), at(5, (None,) * 4, none),
    ]
    df = spark.createDataFrame(rows, TRACKS + "".join(f", {c} double" for c in BOX + RECT))
    got = {r["track_id"]: (r["distance_m"], r["in_path"], r["nearest"]) for r in tracker.answers(df, ["drive", "seq"], box=BOX, rect=RECT).collect()}
    assert got == {1: (18.0, True, False), 2: (-1.0, False, False), 3: (17.0, True, True), 4: (16.0, False, False), 5: (20.0, True, False)}


def test_rectangle_on_a_bend(spark):
    row = lambda i, y: ("d", 1, i, 10.0, y, 0.0, 0.0, 2, 0, 1.0, 10.0, y, 1.0, 1.0, 0.3, 0.05)
    df = spark.createDataFrame([row(1, 0.0), row(2, 2.7), row(3, 6.0)], TRACKS + "".join(f", {c} double" for c in [*RECT, "k"]))
    assert {r["track_id"]: r["in_path"] for r in tracker.answers(df, ["drive", "seq"], k="k", rect=RECT).collect()} == {1: False, 2: True, 3: False}


def test_most_urgent_is_the_least_positive_time(spark):
    rows = [("d", s, 7, t, n) for s, t, n in ((1, 0.0, True), (2, 4.0, True), (3, 2.5, True), (4, 2.5, True), (5, 1.0, False), (6, float("nan"), True))]
    df = spark.createDataFrame(rows, "drive string, seq int, track_id int, ttc_s double, nearest boolean")
    assert [tuple(r) for r in tracker.most_urgent(df, ["drive"], "seq").collect()] == [("d", 3, 7, 2.5, True)]


def test_unmatched_detections_are_camera_only(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    tracks = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 90.0, 0.0, 95.0, 5.0)], f"seq int, track_id bigint, {box}")
    dets = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 9.0, 2, 0.9), (1, 1, 1.0, 0.0, 11.0, 10.0, 2, 0.8), (2, 0, 0.0, 0.0, 5.0, 5.0, 2, 0.7)], f"seq int, det_idx bigint, {box}, class_id int, confidence double")
    fused = matching.fuse(tracks, dets, ["seq"]).cache()
    rest = matching.camera_only(dets, fused, ["seq"])
    assert {(r["seq"], r["det_idx"]) for r in rest.collect()} == {(1, 1), (2, 0)}
    assert {r["seq"]: tuple(r)[1:] for r in matching.fusion_balance(dets, fused, rest, ["seq"]).collect()} == {1: (2, 1, 1, True), 2: (1, 0, 1, True)}
    ranges = spark.createDataFrame([(2, 0, 5, 12.0), (1, 0, 1, 8.0)], "seq int, det_idx bigint, right_idx bigint, range_m double")
    assert [(r["seq"], r["range_m"]) for r in matching.camera_only(dets, fused, ["seq"], ranges).collect()] == [(2, 12.0)]
