import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helmsway.functions import boxes
from helmsway.functions import geometry as g


def value(spark, *cols):
    r = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return r[0] if len(cols) == 1 else tuple(r)


def test_cells_floor_below_zero_and_use_the_32_bit_edge(spark):
    edge = float(np.float32(0.2))
    assert value(spark, *[g.cell(F.lit(x), 0.2) for x in (0.0, edge, np.nextafter(edge, 0), -1e-9, -edge)]) == (0, 1, 0, -1, -1)


def test_packed_keys_keep_the_order(spark):
    r = random.Random(1)
    cells = [tuple(r.choice([-(1 << 20), -3, -1, 0, 2, (1 << 20) - 1]) for _ in range(3)) for _ in range(60)]
    df = spark.createDataFrame(cells, "x bigint, y bigint, z bigint")
    keys = [(row[0], tuple(row[1:])) for row in df.select(g.packed_key(F.col("x"), F.col("y"), F.col("z")), "x", "y", "z").collect()]
    assert [c for _, c in sorted(keys)] == sorted(cells)


def test_nan_is_over_nothing_and_the_threshold_is_strict(spark):
    assert value(spark, *[g.over(F.lit(x), 0.3) for x in (float("nan"), 0.3, 0.31)]) == (False, False, True)
    assert value(spark, g.finite(F.lit(float("inf"))), g.finite(F.lit(1.0), F.lit(None).cast("double"))) == (False, False)


def box(*v):
    return dict(zip(("x0", "y0", "x1", "y1"), map(F.lit, v)))


def test_image_overlap(spark):
    a = box(0.0, 0.0, 2.0, 2.0)
    assert value(spark, g.box_iou(a, box(1.0, 0.0, 3.0, 2.0))) == pytest.approx(1 / 3)
    assert value(spark, g.box_iou(a, box(5.0, 0.0, 6.0, 1.0)), g.box_iou(box(1.0, 1.0, 1.0, 1.0), box(1.0, 1.0, 1.0, 1.0))) == (0.0, 0.0)
    assert value(spark, g.over_half(a, box(0.0, 0.0, 1.0, 2.0)), g.over_half(a, box(0.0, 0.0, 1.01, 2.0))) == (False, True)  # exactly one half fails


def test_turned_rectangles(spark):
    inside = lambda px, py, yaw: g.in_rotated_box(F.lit(px), F.lit(py), F.lit(1.0), F.lit(1.0), F.lit(4.0), F.lit(2.0), F.lit(yaw))
    assert value(spark, inside(3.0, 1.0, 0.0), inside(3.001, 1.0, 0.0), inside(1.0, 2.9, math.pi / 2), inside(2.9, 1.0, math.pi / 2)) == (True, False, True, False)
    assert boxes.turned_iou(np.array([0, 0, 2, 2, 0.0]), np.array([1, 0, 2, 2, 0.0])) == pytest.approx(1 / 3)
    assert boxes.turned_iou(np.array([0, 0, 2, 2, 0.0]), np.array([0, 0, 2, 2, math.pi / 4])) == pytest.approx(math.sqrt(2) / 2, abs=1e-3)
    assert boxes.turned_iou(np.array([0, 0, 2, 2, 0.0]), np.array([9, 0, 2, 2, 1.0])) == 0.0


def test_turned_overlap_against_sampling():
    r = np.random.default_rng(0)
    for _ in range(20):
        a, b = (np.r_[r.uniform(-1, 1, 2), r.uniform(0.5, 3, 2), r.uniform(0, 7)] for _ in range(2))
        p = r.uniform(-4, 4, (200_000, 2))

        def inside(box, p=p):
            d = p - box[:2]
            u, v = d[:, 0] * np.cos(box[4]) + d[:, 1] * np.sin(box[4]), d[:, 1] * np.cos(box[4]) - d[:, 0] * np.sin(box[4])
            return (abs(u) <= box[2] / 2) & (abs(v) <= box[3] / 2)

        i, j = inside(a), inside(b)
        assert boxes.turned_iou(a, b) == pytest.approx((i & j).sum() / (i | j).sum(), abs=0.03)


def test_path_round_trip(spark):
    for k in (0.0, 0.05, -0.02):
        x, y = g.path_point(F.lit(12.0), F.lit(-0.7), F.lit(k))
        offset, along = g.locate(x, y, F.lit(k))
        assert value(spark, offset, along) == pytest.approx((-0.7, 12.0), abs=1e-9)
    assert value(spark, g.curvature(F.lit(0.5), F.lit(0.3)), g.curvature(F.lit(10.0), F.lit(0.0005)), g.curvature(F.lit(10.0), F.lit(1.0))) == (0.0, 0.0, 0.1)


def test_time_to_contact(spark):
    t = lambda d, c, age: g.time_to_contact(F.lit(d), F.lit(c), F.lit(0.2), F.lit(age))
    assert value(spark, t(10.0, 5.4, 1.0), t(10.0, 0.3, 1.0), t(-1.0, 5.0, 1.0), t(10.0, 5.0, 0.0)) == (2.0, 0.0, 0.0, 0.0)


def test_gates_carry_and_shapes(spark):
    assert value(spark, g.gate_m(F.lit(0.1), 0.2, True), g.gate_m(F.lit(0.1), 0.2, False)) == pytest.approx((1.589, 2.991))
    assert value(spark, *g.carried(F.lit(10.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(math.pi / 2), F.lit(0.5))) == pytest.approx((5 * math.cos(math.pi / 4), -5 * math.sin(math.pi / 4)))
    assert value(spark, g.shape_class(F.lit(0.5), F.lit(0.5), F.lit(0.5)), g.shape_class(F.lit(7.0), F.lit(1.0), F.lit(1.0)), g.shape_class(F.lit(4.0), F.lit(2.0), F.lit(1.5))) == ("fragment", "merged", "object")


def test_projection(spark):
    p = [[100.0, 0.0, 50.0, 0.0], [0.0, 100.0, 40.0, 0.0], [0.0, 0.0, 1.0, 0.0]]
    a, b, w = g.projected(F.lit(0.0), F.lit(0.0), F.lit(10.0), p)
    assert value(spark, g.in_frame(a, b, w, F.lit(100.0), F.lit(80.0))) is True
    near = g.projected_box([F.lit(-1.0), F.lit(-1.0), F.lit(0.05)], [F.lit(1.0), F.lit(1.0), F.lit(3.0)], p, F.lit(100.0), F.lit(80.0))
    far = g.projected_box([F.lit(-1.0), F.lit(-1.0), F.lit(10.0)], [F.lit(1.0), F.lit(1.0), F.lit(20.0)], p, F.lit(100.0), F.lit(80.0))
    assert value(spark, near) is None and tuple(value(spark, far)) == (40.0, 30.0, 60.0, 50.0)


def test_suppression_depends_on_what_was_kept():
    b = np.array([[0, 0, 10, 10], [4, 0, 14, 10], [8, 0, 18, 10]], float)
    # the middle box falls to the first, so it can't take the third with it
    assert boxes.suppressed(np.array([0.9, 0.8, 0.7]), lambda i, r: boxes.image_iou(b[i], b[r]), 0.4).tolist() == [0, 2]
    assert boxes.suppressed(np.array([0.5, 0.5]), lambda i, r: np.array([0.01] * len(r)), 0.01, closed=True).tolist() == [0]
    assert boxes.suppressed(np.array([0.5, 0.5]), lambda i, r: np.array([0.01] * len(r)), 0.01).tolist() == [0, 1]


def test_camera_output_to_boxes():
    cells = sum((64 // s) * (32 // s) for s in (8, 16, 32))
    raw = np.zeros((cells, 7))
    raw[9] = [0.5, 0.5, math.log(2), 0.0, 0.9, 0.1, 0.8]  # stride 8, column 1, row 1
    raw[10] = [0.5, 0.5, 0, 0, 0.5, 0.6, 0.1]  # 0.3 isn't over the threshold
    got = boxes.camera_boxes(raw, 64, 32, (128, 64))
    assert got.shape == (1, 6) and got[0] == pytest.approx([8, 16, 40, 32, 1, 0.72])


def test_lidar_output_to_boxes():
    scores = np.full((3, 3, 18), -10.0)
    scores[1, 2, 0] = 2.0
    got = boxes.lidar_boxes(scores, np.zeros((3, 3, 42)), np.zeros((3, 3, 12)))
    assert got.shape == (1, 9) and got[0, :6] == pytest.approx([69.12, 0.0, -1.0, 3.9, 1.6, 1.56]) and got[0, 7] == 0
    assert math.isclose(math.sin(got[0, 6]), 0.0, abs_tol=1e-3) and got[0, 8] == pytest.approx(1 / (1 + math.exp(-2)))


def test_pixels():
    p = np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0]]], np.uint8)
    assert boxes.luma(p).tolist() == [[255, 0, 76]]
    f = boxes.fitted(np.full((4, 8, 3), 9, np.uint8), 16, 16)
    assert f.shape == (3, 16, 16) and (f[:, :8] == 9).all() and (f[:, 8:] == 114).all()
