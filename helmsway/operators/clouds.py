"""Point clouds: grid reduction, ground, clusters, pillars, neighbours.

A cloud is a long table, one row per point: (keys, idx, x, y, z, r). The keys name a sweep. Steps on a
whole sweep in one task (ground, clusters) rely on a sweep being bounded by its sensor, some hundred
thousand points; everything else spreads over cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.functions import geometry as g

AXES = ["x", "y", "z"]
#: Half of the 26 neighbours of a cell: the other half are the same pairs from the other side.
FORWARD = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
MIN_CLUSTER = 3


def with_cells(points: DataFrame, edge: float) -> DataFrame:
    """Points with their cell indices ``ix, iy, iz``; points that aren't finite or fall off the grid are left out."""
    ok = g.finite(*[F.col(a) for a in (*AXES, "r")])
    celled = points.where(ok)
    for a in AXES:
        celled = celled.withColumn(f"i{a}", g.cell(F.col(a), edge))
    return celled.where(g.in_grid(*[F.col(f"i{a}") for a in AXES]))


def voxel_reduce(points: DataFrame, keys: list[str], edge: float, exact: bool = False) -> DataFrame:
    """(keys, ix, iy, iz, key, ``x, y, z, r`` means, ``n``) of every occupied cell.

    Means are of 64-bit sums. With ``exact`` each cell's sums run in order of ``idx``, so that they
    are the same bit for bit however the points were spread; the cell's points then come together.
    """
    cells = with_cells(points, edge)
    by = [*keys, "ix", "iy", "iz"]
    if exact:
        lists = cells.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("idx", *[F.col(c).cast("double").alias(c) for c in (*AXES, "r")]))).alias("_p"))
        sums = [(F.aggregate(F.col(f"_p.{c}"), F.lit(0.0), lambda total, v: total + v) / F.size("_p")).alias(c) for c in (*AXES, "r")]
        out = lists.select(*by, *sums, F.size("_p").cast("bigint").alias("n"))
    else:
        out = cells.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in (*AXES, "r")], F.count(F.lit(1)).alias("n"))
    return out.withColumn("key", g.packed_key(F.col("ix"), F.col("iy"), F.col("iz")))


def voxel_stats(points: DataFrame, keys: list[str], edge: float) -> DataFrame:
    """(keys, ``points_in, not_finite, off_grid, cells, single, largest``) per sweep."""
    ok = g.finite(*[F.col(a) for a in (*AXES, "r")])
    on = g.in_grid(*[g.cell(F.col(a), edge) for a in AXES])
    seen = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("points_in"), F.count_if(~ok).alias("not_finite"), F.count_if(ok & ~on).alias("off_grid"))
    cells = voxel_reduce(points, keys, edge).groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("largest"))
    joined = seen.join(cells, keys, "left")
    return joined.fillna(0, ["cells", "single", "largest"])


def neighbour_pairs(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, iz, jx, jy, jz) of touching occupied cells (26 neighbours), each pair once.

    Every cell asks for its 13 forward neighbours by an equality join.
    """
    steps = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(n) for v, n in zip(s, ("a", "b", "c"))]) for s in FORWARD])
    one = cells.select(*keys, "ix", "iy", "iz").distinct()
    asked = one.select(*keys, "ix", "iy", "iz", F.inline(steps)).select(
        *keys, "ix", "iy", "iz", (F.col("ix") + F.col("a")).alias("jx"), (F.col("iy") + F.col("b")).alias("jy"), (F.col("iz") + F.col("c")).alias("jz")
    )
    there = one.select(*keys, F.col("ix").alias("jx"), F.col("iy").alias("jy"), F.col("iz").alias("jz"))
    return asked.join(there, [*keys, "jx", "jy", "jz"]).select(*keys, "ix", "iy", "iz", "jx", "jy", "jz")


def _roots(keys: np.ndarray) -> np.ndarray:
    """Smallest row of the component of each cell, touching cells being joined; ``keys`` are packed, distinct and in order."""
    n, pairs = len(keys), []
    for a, b, c in FORWARD:
        wanted = keys + ((a << 42) + (b << 21) + c)
        at = np.minimum(np.searchsorted(keys, wanted), n - 1)
        here = np.flatnonzero(keys[at] == wanted)
        pairs.append(np.stack([here, at[here]], axis=1))
    pairs = np.concatenate(pairs)
    root = np.arange(n)
    a, b = pairs.T
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def clusters(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ix, iy, iz, ``component``): cells numbered by the smallest packed key of their component.

    Cells that touch, corners included, belong together. One sweep is one task.
    """
    kinds = dict(voxels.dtypes)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["ix", "iy", "iz"]).sort_values("key")
        root = _roots(pdf["key"].to_numpy(np.int64))
        return pdf[[*keys, "ix", "iy", "iz"]].assign(component=pdf["key"].to_numpy()[root])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["ix bigint, iy bigint, iz bigint, component bigint"])
    return voxels.select(*keys, "ix", "iy", "iz", "key").groupBy(*keys).applyInPandas(label, schema)


def detections(voxels: DataFrame, keys: list[str], least: int = MIN_CLUSTER) -> DataFrame:
    """(keys, ``det_idx``, centre, box, ``voxel_count, reflectance``) of each cluster of at least ``least`` cells."""
    cells = [*keys, "ix", "iy", "iz"]
    joined = voxels.join(clusters(voxels, keys), cells)
    box = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in AXES]
    found = joined.groupBy(*keys, "component").agg(
        *[F.avg(a).alias(f"c{a}") for a in AXES], *box, F.count(F.lit(1)).alias("voxel_count"), F.avg("r").alias("reflectance")
    )
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("component")) - 1
    return found.where(F.col("voxel_count") >= least).withColumn("det_idx", number).drop("component")


def _plane(seed: np.ndarray, band: float, median_z: float) -> tuple[float, float, float, float, bool]:
    """Ground plane (nx, ny, nz, d, fitted) through the seed, refitted twice to what lies within the band."""
    flat = (0.0, 0.0, 1.0, -median_z, False)
    plane, keep = flat, np.ones(len(seed), bool)
    for _ in range(3):
        near = seed[keep]
        if len(near) < 3:
            return plane
        middle = near.mean(axis=0)
        spread, axes = np.linalg.eigh((near - middle).T @ (near - middle))
        if np.sqrt(max(spread[1], 0.0) / len(near)) <= band:
            return flat
        normal = axes[:, 0] * (1.0 if axes[2, 0] >= 0 else -1.0)
        if normal[2] < np.sqrt(0.5):
            return flat
        plane = (*normal.tolist(), float(-normal @ middle), True)
        keep = np.abs(seed @ normal + plane[3]) <= band
    return plane


def ground(voxels: DataFrame, keys: list[str], band: float) -> DataFrame:
    """(keys, ``nx, ny, nz, d, fitted, median_z``): each sweep's ground plane.

    The seed is all cells within 30 m at or below their upper median height; with fewer than three,
    a seed along a line or a plane steeper than 45 degrees, the ground is level at the median.
    """
    kinds = dict(voxels.dtypes)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[AXES].to_numpy(float)
        p = p[np.isfinite(p).all(axis=1) & (np.hypot(p[:, 0], p[:, 1]) <= g.RANGE_LIMIT_M)]
        p = p[np.lexsort(p.T[::-1])]
        median = float(np.sort(p[:, 2])[len(p) // 2]) if len(p) else 0.0
        plane = _plane(p[p[:, 2] <= median], band, median)
        return pdf[keys].iloc[:1].assign(nx=plane[0], ny=plane[1], nz=plane[2], d=plane[3], fitted=plane[4], median_z=median)

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["nx double, ny double, nz double, d double, fitted boolean, median_z double"])
    return voxels.select(*keys, *AXES).groupBy(*keys).applyInPandas(fit, schema)


def above_ground(voxels: DataFrame, planes: DataFrame, keys: list[str], band: float) -> DataFrame:
    """Cells within 30 m and at least one band above the sweep's ground; what lies below it is ground too."""
    near = voxels.where(g.planar_range(F.col("x"), F.col("y")) <= g.RANGE_LIMIT_M)
    height = g.plane_height(*[F.col(c) for c in ("x", "y", "z", "nx", "ny", "nz", "d")])
    return near.join(planes, keys).where(height >= band).select(*voxels.columns)


def pillars(points: DataFrame, keys: list[str], edge: float = g.PILLAR_EDGE_M, most_points: int = g.PILLAR_POINTS, most_cells: int = g.PILLAR_CELLS, behind: bool = False) -> DataFrame:
    """The points that the lidar detector sees, with ten features each.

    Of every cell the first ``most_points`` by ``idx``, of every sweep the first ``most_cells`` cells in
    order of row and column; these limits are the detector's input format. Features: x, y, z, r, the
    offsets from the mean of the kept points and from the cell's centre. ``behind`` turns the view.
    """
    sign = -1.0 if behind else 1.0
    turned = points.where(g.finite(*[F.col(a) for a in (*AXES, "r")])).withColumn("x", F.col("x") * sign).withColumn("y", F.col("y") * sign)
    inside = turned.where(g.in_roi(*[F.col(a) for a in AXES]))
    (x0, _), (y0, _), _ = g.PILLAR_ROI
    celled = inside.withColumn("col", F.floor((F.col("x") - x0) / edge).cast("bigint")).withColumn("row", F.floor((F.col("y") - y0) / edge).cast("bigint"))
    per_cell = Window.partitionBy(*keys, "row", "col")
    kept = celled.withColumn("place", F.row_number().over(per_cell.orderBy("idx"))).where(F.col("place") <= most_points)
    cells = kept.select(*keys, "row", "col").distinct().withColumn("cell_no", F.row_number().over(Window.partitionBy(*keys).orderBy("row", "col")))
    kept = kept.join(cells.where(F.col("cell_no") <= most_cells), [*keys, "row", "col"])
    for a in AXES:
        kept = kept.withColumn(f"m{a}", F.col(a) - F.avg(a).over(per_cell))
    return kept.withColumn("px", F.col("x") - (F.col("col") + 0.5) * edge - x0).withColumn("py", F.col("y") - (F.col("row") + 0.5) * edge - y0)


def within_radius(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pairs (keys, left ``idx``, right ``idx2``, ``d2``) of points at most ``radius`` apart, by an equality join on cells.

    Right points stand in their own cell, left points ask for the 27 cells round theirs.
    """
    a = with_cells(left.withColumn("r", F.lit(0.0)), radius)
    b = with_cells(right.withColumn("r", F.lit(0.0)), radius)
    steps = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(k).alias("c")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    asked = a.select(*keys, "idx", *AXES, "ix", "iy", "iz", F.inline(steps)).select(
        *keys, "idx", *AXES, (F.col("ix") + F.col("a")).alias("ix"), (F.col("iy") + F.col("b")).alias("iy"), (F.col("iz") + F.col("c")).alias("iz")
    )
    there = b.select(*keys, F.col("idx").alias("idx2"), *[F.col(c).alias(f"{c}2") for c in AXES], "ix", "iy", "iz")
    d2 = sum(((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in AXES), F.lit(0.0))
    return asked.join(there, [*keys, "ix", "iy", "iz"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(*keys, "idx", "idx2", "d2")
