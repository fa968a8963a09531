"""Geometry of the ground plane and of image boxes, as column expressions.

Lengths in metres, angles in radians, x forward, y to the left.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the pipeline's rules.
RANGE_LIMIT_M = 30.0
GRID_HALF = 1 << 20
PILLAR_ROI = ((0.0, 69.12), (-39.68, 39.68), (-3.0, 1.0))
PILLAR_EDGE_M, PILLAR_POINTS, PILLAR_CELLS = 0.16, 32, 40_000
MAX_RELATIVE_MPS, MAX_OBJECT_MPS, MAX_YAW_RPS = 20.35, 13.89, 0.252
HALF_WIDTH_M, MIN_PATH_MPS, MIN_CURVATURE = 0.91, 1.0, 1e-4
NEAR_PLANE = 0.1
STEREO_ROWS_PX, STEREO_WIDTHS, STEREO_LEAST_M = 8.0, 1.3, 2.0


def finite(*cols: Column) -> Column:
    """Whether all values are given and neither NaN nor infinite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def cell(c: Column, edge: float) -> Column:
    """Index of the grid cell that holds a coordinate; floors below zero too. The edge is a 32-bit number."""
    return F.floor(c.cast("double") / F.lit(edge).cast("float").cast("double")).cast("bigint")


def in_grid(*cells: Column) -> Column:
    """Whether indices fit the packed key."""
    ok = F.lit(True)
    for c in cells:
        ok = ok & (c >= -GRID_HALF) & (c < GRID_HALF)
    return ok


def packed_key(ix: Column, iy: Column, iz: Column) -> Column:
    """One BIGINT for three cell indices, in their order."""
    return F.shiftleft(ix + GRID_HALF, 42) + F.shiftleft(iy + GRID_HALF, 21) + (iz + GRID_HALF)


def planar_range(x: Column, y: Column) -> Column:
    return F.hypot(x, y)


def in_roi(x: Column, y: Column, z: Column) -> Column:
    """Whether a point lies in the pillar region, a half-open box."""
    ok = F.lit(True)
    for c, (a, b) in zip((x, y, z), PILLAR_ROI):
        ok = ok & (c >= a) & (c < b)
    return ok


def over(score: Column, threshold: float) -> Column:
    """score > threshold, false for NaN (which Spark takes to be the largest number)."""
    return (score > threshold) & ~F.isnan(score)


def gate_m(dt_s: Column, voxel_m: float, ego: Column | bool) -> Column:
    """How far an object can have moved between two sweeps, with or without known vehicle motion."""
    moved = F.lit(MAX_OBJECT_MPS) * dt_s + voxel_m
    blind = F.lit(MAX_RELATIVE_MPS) * dt_s + F.lit(MAX_YAW_RPS * RANGE_LIMIT_M) * dt_s + voxel_m
    return F.when(F.lit(ego) if isinstance(ego, bool) else ego, moved).otherwise(blind)


def carried(x: Column, y: Column, vf: Column, vl: Column, yaw_rate: Column, dt_s: Column) -> tuple[Column, Column]:
    """A world-fixed point as seen after the vehicle has moved on for ``dt_s``: shifted back, then turned back."""
    a = -yaw_rate * dt_s
    dx, dy = x - vf * dt_s, y - vl * dt_s
    return dx * F.cos(a) - dy * F.sin(a), dx * F.sin(a) + dy * F.cos(a)


def plane_height(x: Column, y: Column, z: Column, nx: Column, ny: Column, nz: Column, d: Column) -> Column:
    return nx * x + ny * y + nz * z + d


def plane_tilt_deg(nz: Column) -> Column:
    return F.degrees(F.acos(F.least(F.greatest(nz, F.lit(-1.0)), F.lit(1.0))))


def shape_class(dx: Column, dy: Column, dz: Column) -> Column:
    """merged if any side is over 6 m, fragment if small on all sides, else object."""
    return F.when(F.greatest(dx, dy, dz) > 6.0, "merged").when((dx < 1.0) & (dy < 1.0) & (dz < 0.8), "fragment").otherwise("object")


def box_area(b: dict[str, Column]) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Area common to two image boxes, 0 if they are apart."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Overlap by union; 0 where there is no union."""
    i = box_overlap(a, b)
    union = box_area(a) + box_area(b) - i
    return F.when(union > 0, i / union).otherwise(0.0)


def over_half(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """IoU strictly over one half, without a division."""
    return box_overlap(a, b) * 3 > box_area(a) + box_area(b)


def in_rotated_box(px: Column, py: Column, x: Column, y: Column, dx: Column, dy: Column, yaw: Column) -> Column:
    """Whether a point lies in a turned rectangle, its edge included."""
    ax, ay = px - x, py - y
    u = ax * F.cos(yaw) + ay * F.sin(yaw)
    v = ay * F.cos(yaw) - ax * F.sin(yaw)
    return (F.abs(u) <= dx / 2) & (F.abs(v) <= dy / 2)


def footprint(x: Column, y: Column, dx: Column, dy: Column, yaw: Column) -> list[tuple[Column, Column]]:
    """Corners of a turned rectangle, counter-clockwise from the rear right."""
    c, s = F.cos(yaw), F.sin(yaw)
    return [(x + u * dx / 2 * c - v * dy / 2 * s, y + u * dx / 2 * s + v * dy / 2 * c) for u, v in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def may_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two turned rectangles can overlap at all: centres nearer than half the sum of their diagonals."""
    far = (F.hypot(a["dx"], a["dy"]) + F.hypot(b["dx"], b["dy"])) / 2
    return F.hypot(a["x"] - b["x"], a["y"] - b["y"]) <= far


def curvature(vf: Column, yaw_rate: Column) -> Column:
    """Curvature of the path the vehicle is on, 1/m; 0 at walking pace, for nearly straight paths and unknown motion."""
    k = F.when(vf >= MIN_PATH_MPS, yaw_rate / vf)
    return F.when(finite(k) & (F.abs(k) >= MIN_CURVATURE), k).otherwise(0.0)


def locate(x: Column, y: Column, k: Column) -> tuple[Column, Column]:
    """(offset to the left of the path, distance along it) of a point, for a path of curvature ``k``."""
    r = F.lit(1.0) / F.nullif(k, F.lit(0.0))
    side = F.signum(r)
    offset = side * (F.abs(r) - F.hypot(x, y - r))
    along = F.abs(r) * F.atan2(x, side * (r - y))
    return F.when(k == 0, y).otherwise(offset), F.when(k == 0, x).otherwise(along)


def tangent(along: Column, k: Column) -> tuple[Column, Column]:
    """Direction of the path after ``along`` metres."""
    return F.cos(along * F.abs(k)), F.signum(k) * F.sin(along * F.abs(k))


def reaches(x: Column, y: Column, dx: Column, dy: Column, yaw: Column, k: Column, half_width: float) -> Column:
    """Whether a turned rectangle reaches the corridor of ``half_width`` either side of a path of curvature ``k``."""
    corners = footprint(x, y, dx, dy, yaw)
    r = F.lit(1.0) / F.nullif(k, F.lit(0.0))
    u = -x * F.cos(yaw) + (r - y) * F.sin(yaw)
    v = x * F.sin(yaw) + (r - y) * F.cos(yaw)
    near = F.hypot(F.greatest(F.abs(u) - dx / 2, F.lit(0.0)), F.greatest(F.abs(v) - dy / 2, F.lit(0.0)))
    far = F.greatest(*[F.hypot(a, b - r) for a, b in corners])
    straight = (F.least(*[b for _, b in corners]) <= half_width) & (F.greatest(*[b for _, b in corners]) >= -half_width)
    return F.when(k == 0, straight).otherwise((near <= F.abs(r) + half_width) & (far >= F.abs(r) - half_width))


def path_point(along: Column, offset: Column, k: Column) -> tuple[Column, Column]:
    """The point ``along`` metres down the path and ``offset`` to its left."""
    r = F.lit(1.0) / F.nullif(k, F.lit(0.0))
    side, theta = F.signum(r), along * F.abs(k)
    rho = F.abs(r) - side * offset
    return F.when(k == 0, along).otherwise(rho * F.sin(theta)), F.when(k == 0, offset).otherwise(r - side * rho * F.cos(theta))


def time_to_contact(distance: Column, closing: Column, gate: Column, age_s: Column) -> Column:
    """distance / (closing speed less what it may be off by), 0 unless both are positive; a new track has no speed yet."""
    sure = closing - gate * 2 / F.nullif(age_s, F.lit(0.0))
    return F.when((distance > 0) & (sure > 0), distance / sure).otherwise(0.0)


def projected(x: Column, y: Column, z: Column, p: list[list[float]]) -> tuple[Column, Column, Column]:
    """Homogeneous image coordinates (a, b, w) of a point under a 3x4 matrix."""
    return tuple(F.lit(r[0]) * x + F.lit(r[1]) * y + F.lit(r[2]) * z + F.lit(r[3]) for r in p)  # type: ignore[return-value]


def in_frame(a: Column, b: Column, w: Column, width: Column, height: Column) -> Column:
    """Whether a projected point falls into the image; needs no division."""
    return (w > 0) & (a >= 0) & (a < width * w) & (b >= 0) & (b < height * w)


def projected_box(lo: list[Column], hi: list[Column], p: list[list[float]], width: Column, height: Column) -> Column:
    """Image box of a cuboid, clipped to the image: struct(x0, y0, x1, y1).

    Null if a corner is not in front of the camera or nothing is left inside the image.
    """
    corners = [projected(x, y, z, p) for x in (lo[0], hi[0]) for y in (lo[1], hi[1]) for z in (lo[2], hi[2])]
    us, vs = [a / w for a, _, w in corners], [b / w for _, b, w in corners]
    clip = lambda c, top: F.least(F.greatest(c, F.lit(0.0)), top)
    x0, x1 = clip(F.least(*us), width), clip(F.greatest(*us), width)
    y0, y1 = clip(F.least(*vs), height), clip(F.greatest(*vs), height)
    seen = (F.least(*[w for _, _, w in corners]) > NEAR_PLANE) & (x1 > x0) & (y1 > y0)
    return F.when(seen, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def stereo_range_m(disparity_px: Column, px_m: float) -> Column:
    return F.lit(px_m) / F.nullif(disparity_px, F.lit(0.0))


EARTH_RADIUS_M = 6_378_137.0


def map_pose(lat: Column, lon: Column, yaw: Column, lat0: Column, ahead_m: float, left_m: float) -> tuple[Column, Column]:
    """(east, north) of a sensor mounted ahead and left of the receiver, on a Mercator map scaled at ``lat0`` (degrees)."""
    scale = F.cos(F.radians(lat0)) * EARTH_RADIUS_M
    east = scale * F.radians(lon)
    north = scale * F.log(F.tan(F.radians((lat + 90.0) / 2)))
    return east + F.cos(yaw) * ahead_m - F.sin(yaw) * left_m, north + F.sin(yaw) * ahead_m + F.cos(yaw) * left_m


def to_map(x: Column, y: Column, east: Column, north: Column, yaw: Column) -> tuple[Column, Column]:
    """A point of the sensor's frame on the map."""
    return east + x * F.cos(yaw) - y * F.sin(yaw), north + x * F.sin(yaw) + y * F.cos(yaw)


def from_map(e: Column, n: Column, east: Column, north: Column, yaw: Column) -> tuple[Column, Column]:
    """A point of the map in the sensor's frame."""
    de, dn = e - east, n - north
    return de * F.cos(yaw) + dn * F.sin(yaw), dn * F.cos(yaw) - de * F.sin(yaw)
