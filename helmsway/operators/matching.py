"""One-to-one matching of elements of two sides, best pairs first, and suppression of overlapping boxes.

Best-first matching with a strict order equals mutual-best rounds: a pair that is the best of both its
ends is taken, its ends leave, and so on. Rounds are windows over (keys, end) and need no group in one
task; where a frame's pairs are few, one task per frame does the same faster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.functions.boxes import image_iou, suppressed, turned_iou
from helmsway.operators.ranks import order_statistics, upper_median_rank
from helmsway.session import checkpointed


def mutual_best(pairs: DataFrame, keys: list[str], left: str, right: str, cost: str) -> DataFrame:
    """The pairs that best-first matching takes, in order of (cost, left, right), by rounds over the cluster.

    Pairs with a null or NaN cost are no pairs; repeated pairs count with their least cost.
    """
    open_ = pairs.where(F.col(cost).isNotNull() & ~F.isnan(F.col(cost).cast("double"))).groupBy(*keys, left, right).agg(F.min(cost).alias(cost))
    order = [F.col(cost), F.col(left), F.col(right)]
    taken: DataFrame | None = None
    while True:
        open_ = checkpointed(open_)
        best = open_.withColumn("_l", F.row_number().over(Window.partitionBy(*keys, left).orderBy(*order))).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, right).orderBy(*order)))
        now = checkpointed(best.where((F.col("_l") == 1) & (F.col("_r") == 1)).drop("_l", "_r"))
        if now.isEmpty():
            return now if taken is None else taken
        taken = now if taken is None else taken.unionByName(now)
        open_ = open_.join(now.select(*keys, left), [*keys, left], "left_anti").join(now.select(*keys, right), [*keys, right], "left_anti")


def greedy(pairs: DataFrame, keys: list[str], left: str, right: str, cost: str) -> DataFrame:
    """The same pairs, each group of ``keys`` (a frame or sweep, of bounded size) in one task."""
    kinds = dict(pairs.dtypes)
    names = [*keys, left, right, cost]

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf[cost].notna()].sort_values([cost, left, right])
        used_l, used_r, rows = set(), set(), []
        for i, (a, b) in enumerate(zip(pdf[left], pdf[right])):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                rows.append(i)
        return pdf.iloc[rows][names]

    return pairs.select(*names).groupBy(*keys).applyInPandas(take, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def nms(boxes: DataFrame, keys: list[str], idx: str, score: str, iou: float = 0.45) -> DataFrame:
    """Image boxes (x0, y0, x1, y1) kept when better ones suppress those that overlap them by more than ``iou``."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        b = pdf[["x0", "y0", "x1", "y1"]].to_numpy(float)
        return pdf.iloc[suppressed(pdf[score].to_numpy(float), lambda i, rows: image_iou(b[i], b[rows]), iou)]

    return boxes.groupBy(*keys).applyInPandas(keep, boxes.schema)


def turned_nms(boxes: DataFrame, keys: list[str], idx: str, score: str, iou: float = 0.01) -> DataFrame:
    """Ground boxes (x, y, dx, dy, yaw) kept likewise; here an overlap of ``iou`` itself suppresses."""

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx)
        b = pdf[["x", "y", "dx", "dy", "yaw"]].to_numpy(float)

        def overlaps(i: int, rows: np.ndarray) -> np.ndarray:
            near = np.hypot(*(b[rows, :2] - b[i, :2]).T) <= (np.hypot(*b[i, 2:4]) + np.hypot(b[rows, 2], b[rows, 3])) / 2
            return np.array([turned_iou(b[i], b[r]) if n else 0.0 for r, n in zip(rows, near)])

        return pdf.iloc[suppressed(pdf[score].to_numpy(float), overlaps, iou, closed=True)]

    return boxes.groupBy(*keys).applyInPandas(keep, boxes.schema)


def fuse(tracks: DataFrame, dets: DataFrame, keys: list[str]) -> DataFrame:
    """Image boxes of tracks and detections matched one to one at an overlap strictly over one half.

    (keys, ``track_id, det_idx, iou, class_id, confidence, population``) of every track: ``fused`` with
    its detection, else ``lidar_only``. The most overlapping pair goes first, ties by track and detection.
    """
    t = tracks.select(*keys, "track_id", *[F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")])
    joined = t.join(dets, keys)
    a = {c: F.col(f"t{c}") for c in ("x0", "y0", "x1", "y1")}
    b = {c: F.col(c) for c in ("x0", "y0", "x1", "y1")}
    pairs = joined.where(g.over_half(a, b)).withColumn("iou", g.box_iou(a, b)).withColumn("_cost", -F.col("iou"))
    best = greedy(pairs, keys, "track_id", "det_idx", "_cost")
    info = pairs.select(*keys, "track_id", "det_idx", "iou", "class_id", "confidence")
    fused = best.drop("_cost").join(info, [*keys, "track_id", "det_idx"])
    out = t.select(*keys, "track_id").join(fused, [*keys, "track_id"], "left")
    return out.withColumn("population", F.when(F.col("det_idx").isNotNull(), "fused").otherwise("lidar_only"))


def camera_only(dets: DataFrame, fused: DataFrame, keys: list[str], ranges: DataFrame | None = None) -> DataFrame:
    """The detections that ``fuse`` matched with no track; with ``ranges`` (of ``stereo``) just those with a range, which is added."""
    rest = dets.join(fused.where(F.col("det_idx").isNotNull()).select(*keys, "det_idx"), [*keys, "det_idx"], "left_anti")
    return rest if ranges is None else rest.join(ranges.where(F.col("range_m") > 0).select(*keys, "det_idx", "range_m"), [*keys, "det_idx"])


def fusion_balance(dets: DataFrame, fused: DataFrame, rest: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ``detections, fused, camera_only, ok``): whether every detection went just one place (``rest`` from ``camera_only``)."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    out = count(dets, "detections")
    for part in (count(fused.where(F.col("det_idx").isNotNull()), "fused"), count(rest, "camera_only")):
        out = out.join(part, keys, "full_outer")
    return out.fillna(0, ["detections", "fused", "camera_only"]).withColumn("ok", F.col("detections") == F.col("fused") + F.col("camera_only"))


def stereo(left: DataFrame, right: DataFrame, keys: list[str], px_m: float) -> DataFrame:
    """(keys, ``det_idx, right_idx, range_m``) of left detections that the right image has too.

    Same class, rows within 8 px, widths within a factor of 1.3, disparity positive and at most that of
    2 m. The cheapest pair goes first: difference of rows and widths, ties by left and right number.
    """
    r = right.select(*keys, "class_id", F.col("det_idx").alias("right_idx"), *[F.col(c).alias(f"r{c}") for c in ("x0", "y0", "x1", "y1")])
    j = left.join(r, [*keys, "class_id"])
    dy0, dy1 = F.abs(F.col("y0") - F.col("ry0")), F.abs(F.col("y1") - F.col("ry1"))
    wl, wr = F.col("x1") - F.col("x0"), F.col("rx1") - F.col("rx0")
    disparity = (F.col("x0") + F.col("x1") - F.col("rx0") - F.col("rx1")) / 2
    ok = (dy0 <= g.STEREO_ROWS_PX) & (dy1 <= g.STEREO_ROWS_PX) & (wl > 0) & (wr > 0) & (wl <= wr * g.STEREO_WIDTHS) & (wr <= wl * g.STEREO_WIDTHS)
    ok = ok & (disparity > 0) & (disparity <= px_m / g.STEREO_LEAST_M)
    pairs = j.where(ok).select(*keys, "det_idx", "right_idx", disparity.alias("_d"), (dy0 + dy1 + F.abs(wl - wr)).alias("cost"))
    best = greedy(pairs, keys, "det_idx", "right_idx", "cost").drop("cost")
    return best.join(pairs, [*keys, "det_idx", "right_idx"]).select(*keys, "det_idx", "right_idx", g.stereo_range_m(F.col("_d"), px_m).alias("range_m"))


def name_tracks(tracks: DataFrame, boxes: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """(keys, ``track_id, det_idx, class_id, score``): the best-scored ground box round each track's centre.

    A box may name several tracks; equal scores go to the smaller number. Tracks without a box have nulls.
    Boxes stand in cells as large as the widest half diagonal of their group, tracks ask the 9 round theirs.
    """
    b = boxes.where(F.col("score") >= least).withColumnsRenamed({"x": "bx", "y": "by"})
    inside = g.in_rotated_box(*[F.col(c) for c in ("x", "y", "bx", "by", "dx", "dy", "yaw")])
    hit = F.min_by(F.struct("det_idx", "class_id", "score"), F.struct(-F.col("score"), F.col("det_idx")))
    b = b.where(g.finite(F.col("bx"), F.col("by"), F.col("yaw")))
    wide = F.max(F.nanvl(F.hypot("dx", "dy"), F.lit(float("inf"))) / 2)
    edges = b.groupBy(*keys).agg(F.greatest(wide * 1.000001, F.lit(1e-3)).alias("_edge"))
    at = lambda c: F.floor(F.col(c) / F.col("_edge"))
    steps = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(j).alias("_j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    asking = tracks.where(g.finite(F.col("x"), F.col("y"))).join(edges, keys).select(*keys, "track_id", "x", "y", at("x").alias("_cx"), at("y").alias("_cy"), F.inline(steps))
    asking = asking.select(*keys, "track_id", "x", "y", (F.col("_cx") + F.col("_i")).alias("_ix"), (F.col("_cy") + F.col("_j")).alias("_iy"))
    there = b.join(edges, keys).withColumn("_ix", at("bx")).withColumn("_iy", at("by")).drop("_edge")
    named = asking.join(there, [*keys, "_ix", "_iy"]).where(inside).groupBy(*keys, "track_id").agg(hit.alias("_h"))
    return tracks.select(*keys, "track_id").join(named, [*keys, "track_id"], "left").select(*keys, "track_id", "_h.*")


def best_labels(labels: DataFrame, dets: DataFrame, keys: list[str], label: str, least: float) -> DataFrame:
    """(keys, label, ``det_idx, iou``): each labelled image box's most overlapping detection at ``least`` or more, else nulls."""
    d = dets.select(*keys, "det_idx", *[F.col(c).alias(f"d{c}") for c in ("x0", "y0", "x1", "y1")])
    iou = g.box_iou({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, {c: F.col(f"d{c}") for c in ("x0", "y0", "x1", "y1")})
    scored = labels.join(d, keys).withColumn("iou", iou).where(F.col("iou") >= least)
    best = scored.groupBy(*keys, label).agg(F.min_by(F.struct("det_idx", "iou"), F.struct(-F.col("iou"), F.col("det_idx"))).alias("_b"))
    return labels.select(*keys, label).join(best, [*keys, label], "left").select(*keys, label, "_b.*")


def confirm(fused: DataFrame, right_boxes: DataFrame, dets: DataFrame, keys: list[str]) -> DataFrame:
    """``fused`` (from ``fuse``) after a look at the right image, with ``right_idx`` and its overlap.

    ``right_boxes`` has each track's box in the right image (x0..y1) and whether it is ``in_left``, ``dets``
    the right detections. A fused track asks for a detection of its own class, a lidar_only track,
    if in the left image too, for any; pairs overlap by more than half and go one to one, the largest
    overlap first. A fused track without one becomes one_camera; a lidar_only track with one does too,
    takes its class and confidence, and has no left detection.
    """
    d = dets.select(*keys, F.col("det_idx").alias("right_idx"), F.col("class_id").alias("right_class"), F.col("confidence").alias("right_confidence"), *[F.col(c).alias(f"d{c}") for c in ("x0", "y0", "x1", "y1")])
    asked = fused.select(*keys, "track_id", "population", "class_id").join(right_boxes, [*keys, "track_id"]).join(d, keys)
    a, b = ({c: F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")} for p in ("", "d"))
    wanted = ((F.col("population") == "fused") & (F.col("class_id") == F.col("right_class"))) | ((F.col("population") == "lidar_only") & F.col("in_left"))
    pairs = asked.where(wanted & g.over_half(a, b)).withColumn("right_iou", g.box_iou(a, b)).withColumn("_cost", -F.col("right_iou"))
    best = greedy(pairs, keys, "track_id", "right_idx", "_cost").drop("_cost")
    told = best.join(pairs.select(*keys, "track_id", "right_idx", "right_iou", "right_class", "right_confidence"), [*keys, "track_id", "right_idx"])
    out = fused.join(told, [*keys, "track_id"], "left")
    seen, was = F.col("right_idx").isNotNull(), F.col("population")
    found = (was == "lidar_only") & seen
    return out.select(
        *keys, "track_id",
        F.when(found, F.lit(None)).otherwise(F.col("det_idx")).alias("det_idx"),
        F.when(found, F.col("right_iou")).otherwise(F.col("iou")).alias("iou"),
        F.when(found, F.col("right_class")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(found, F.col("right_confidence")).otherwise(F.col("confidence")).alias("confidence"),
        F.when(found | ((was == "fused") & ~seen), "one_camera").otherwise(was).alias("population"),
        "right_idx",
    )


def inside_fused(tracks: DataFrame, keys: list[str], grow_m: float) -> DataFrame:
    """(keys, ``track_id``) of lidar_only tracks that are a piece of a fused one of the same sweep.

    At least half of the image box lies in the fused track's, and the centre (x, y, z) in its box
    (min_x..max_z) grown by ``grow_m``.
    """
    fused = tracks.where(F.col("population") == "fused").select(*keys, *[F.col(c).alias(f"f_{c}") for c in ("x0", "y0", "x1", "y1", *[f"{m}_{a}" for m in ("min", "max") for a in "xyz"])])
    a, b = ({c: F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")} for p in ("", "f_"))
    common = g.box_overlap(a, b)
    deep = F.lit(True)
    for axis in "xyz":
        deep = deep & F.col(axis).between(F.col(f"f_min_{axis}") - grow_m, F.col(f"f_max_{axis}") + grow_m)
    rest = tracks.where(F.col("population") == "lidar_only")
    return rest.join(fused, keys).where((common > 0) & (common * 2 >= g.box_area(a)) & deep).select(*keys, "track_id").distinct()


def consistent(population: str, class_id: str, in_frame: str, nearest: str, in_path: str, misses: str, lidar_class: str):
    """Whether a record of an answer agrees with itself, as a column; the arguments name its columns.

    The nearest is on the path and was seen in this sweep; the population is known; just the matched
    have a camera class, are in the frame and were seen; only tracks seen have a lidar class.
    """
    fresh, matched = F.col(misses) == 0, F.col(population).isin("fused", "one_camera")
    known = F.col(population).isin("unfused", "fused", "lidar_only", "one_camera")
    return (
        (~F.col(nearest) | (F.col(in_path) & fresh)) & known & (matched == F.col(class_id).isNotNull()) & (~matched | (F.col(in_frame) & fresh)) & (F.col(lidar_class).isNull() | fresh)
    )


def stereo_check(pairs: DataFrame, lidar: str, stereo_range: str) -> DataFrame:
    """(``tracks, median_abs_diff_m, median_ratio, within_fraction``) of stereo ranges against the lidar's, one row.

    Within is a metre or a tenth of the distance, whichever is more; medians are to the nearest
    micrometre and millionth, as upper medians. Ratios are of positive distances only.
    """
    diff = F.abs(F.col(stereo_range) - F.col(lidar))
    ratio = F.when(F.col(lidar) > 0, F.col(stereo_range) / F.col(lidar))
    micro = F.inline(F.array(*[F.struct(F.lit(n).alias("what"), F.round(c * 1e6).cast("bigint").alias("v")) for n, c in (("diff", diff), ("ratio", ratio))]))
    medians = order_statistics(pairs.select(micro), ["what"], "v", {"median": upper_median_rank()})
    wide = medians.agg(*[(F.max(F.when(F.col("what") == n, F.col("median"))) / 1e6).alias(a) for n, a in (("diff", "median_abs_diff_m"), ("ratio", "median_ratio"))])
    whole = pairs.agg(F.count(F.lit(1)).alias("tracks"), F.avg((diff <= F.greatest(F.abs(F.col(lidar)) * 0.1, F.lit(1.0))).cast("int")).alias("within_fraction"))
    one = F.lit(1).alias("_one")
    return whole.select("*", one).join(wide.select("*", one), "_one").drop("_one")
