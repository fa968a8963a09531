"""Tracks named by turned boxes: all pairs by hand, and a plan that doesn't make them."""

import math
import random

from helmsway.operators import matching


def case(spark):
    r = random.Random(5)
    tracks = [(1, i, r.uniform(-9, 9), r.uniform(-9, 9)) for i in range(300)] + [(2, 0, 0.0, 0.0), (1, 900, float("nan"), 0.0)]
    boxes = [(1, i, i % 3, r.choice([0.2, 0.5, 0.9]), r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(0.1, 2.5), r.uniform(0.1, 1.0), r.uniform(-4, 4)) for i in range(120)]
    return tracks, boxes, spark.createDataFrame(tracks, "sweep int, track_id int, x double, y double"), spark.createDataFrame(boxes, "sweep int, det_idx int, class_id int, score double, x double, y double, dx double, dy double, yaw double")


def test_names_equal_those_of_all_pairs(spark):
    tracks, boxes, t, b = case(spark)
    want = {}
    for s, i, x, y in tracks:
        inside = []
        for bs, k, _, score, bx, by, dx, dy, yaw in boxes:
            u, v = (x - bx) * math.cos(yaw) + (y - by) * math.sin(yaw), (y - by) * math.cos(yaw) - (x - bx) * math.sin(yaw)
            if bs == s and score >= 0.3 and abs(u) <= dx / 2 and abs(v) <= dy / 2:
                inside.append((-score, k))
        want[s, i] = min(inside)[1] if inside else None
    assert {(r["sweep"], r["track_id"]): r["det_idx"] for r in matching.name_tracks(t, b, ["sweep"]).collect()} == want
    assert sum(v is not None for v in want.values()) > 50


def test_boxes_are_joined_by_cell(spark):
    _, _, t, b = case(spark)
    plan = matching.name_tracks(t, b, ["sweep"])._jdf.queryExecution().executedPlan().toString()
    assert any("Join" in line and "_ix" in line and "_iy" in line for line in plan.splitlines())
