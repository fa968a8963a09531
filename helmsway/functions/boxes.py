"""Vectorised helpers on boxes of one frame: suppression, turned overlap, network output to boxes."""

from __future__ import annotations

import numpy as np

#: Anchor sizes (x, y, z), their bottoms and the two yaws per class of the lidar detector.
ANCHOR_SIZES = np.array([[3.9, 1.6, 1.56], [0.8, 0.6, 1.73], [1.76, 0.6, 1.73]])
ANCHOR_BOTTOMS = np.array([-1.78, -0.6, -0.6])
ANCHOR_YAWS = np.array([0.0, 1.57])
YAW_OFFSET = 0.78539


def image_iou(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Overlap by union of one image box (x0, y0, x1, y1) with each of others; 0 without a union."""
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    common = np.maximum(w, 0) * np.maximum(h, 0)
    area = lambda b: np.maximum(b[..., 2] - b[..., 0], 0) * np.maximum(b[..., 3] - b[..., 1], 0)
    union = area(box) + area(others) - common
    return np.where(union > 0, common / np.where(union > 0, union, 1), 0.0)


def suppressed(scores: np.ndarray, overlaps, threshold: float, closed: bool = False) -> np.ndarray:
    """Rows kept when each box, best score first (ties by row), falls to a kept one that it overlaps too far.

    ``overlaps(i, rows)`` gives box i's overlap with others; too far is > threshold, or >= if ``closed``.
    """
    kept: list[int] = []
    for i in np.lexsort((np.arange(len(scores)), -scores)):
        if kept:
            o = overlaps(i, np.array(kept))
            if (o >= threshold).any() if closed else (o > threshold).any():
                continue
        kept.append(int(i))
    return np.array(kept, int)


def corners(box: np.ndarray) -> np.ndarray:
    """Corners (4, 2) of a turned rectangle (x, y, dx, dy, yaw), counter-clockwise."""
    x, y, dx, dy, yaw = box
    u = np.array([[-dx, -dy], [dx, -dy], [dx, dy], [-dx, dy]]) / 2
    c, s = np.cos(yaw), np.sin(yaw)
    return u @ np.array([[c, s], [-s, c]]) + (x, y)


def turned_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Overlap by union of two turned rectangles: one clipped by the sides of the other; 0 for a union near 0."""
    shape = corners(a)
    clip = corners(b)
    for p, q in zip(clip, np.roll(clip, -1, axis=0)):
        if not len(shape):
            break
        side = (q[0] - p[0]) * (shape[:, 1] - p[1]) - (q[1] - p[1]) * (shape[:, 0] - p[0])
        out = []
        for i in range(len(shape)):
            j = (i + 1) % len(shape)
            if side[i] >= 0:
                out.append(shape[i])
            if side[i] * side[j] < 0:
                out.append(shape[i] + (shape[j] - shape[i]) * side[i] / (side[i] - side[j]))
        shape = np.array(out).reshape(-1, 2)
    common = 0.0
    if len(shape) > 2:
        x, y = shape.T
        common = abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2
    union = a[2] * a[3] + b[2] * b[3] - common
    return common / union if union > 1e-8 else 0.0


def camera_boxes(raw: np.ndarray, width: int, height: int, frame: tuple[int, int], threshold: float = 0.3) -> np.ndarray:
    """Rows (x0, y0, x1, y1, class, score) from the camera network's output for one frame.

    ``raw`` is (cells, 5 + classes) over grids of stride 8, 16 and 32 of a width x height input into
    which the frame was fitted from the top left. Kept are scores over the threshold (never NaN);
    boxes are in frame pixels, held inside the frame.
    """
    places, strides = [], []
    for s in (8, 16, 32):
        row, col = np.divmod(np.arange((height // s) * (width // s)), width // s)
        places.append(np.c_[col, row])
        strides.append(np.full(row.size, s))
    place, stride = np.vstack(places), np.concatenate(strides)[:, None]
    centre, size = (raw[:, :2] + place) * stride, np.exp(raw[:, 2:4]) * stride
    best = raw[:, 5:].argmax(axis=1)
    score = raw[:, 4] * raw[np.arange(len(raw)), 5 + best]
    ratio = min(width / frame[0], height / frame[1])
    box = np.c_[centre - size / 2, centre + size / 2] / ratio
    box = np.clip(box, 0, [frame[0], frame[1], frame[0], frame[1]])
    return np.c_[box, best, score][score > threshold]


def lidar_boxes(scores: np.ndarray, deltas: np.ndarray, directions: np.ndarray, threshold: float = 0.1) -> np.ndarray:
    """Rows (x, y, z, dx, dy, dz, yaw, class, score) from the lidar network's output for one view.

    ``scores`` (rows, cols, 18), ``deltas`` (rows, cols, 42) and ``directions`` (rows, cols, 12) are of six
    anchors per cell: three classes at two yaws. The best class's score must reach the threshold.
    """
    rows, cols = scores.shape[:2]
    logit = scores.reshape(rows, cols, 6, 3)
    value = 1 / (1 + np.exp(-logit))
    best = value.argmax(axis=-1)
    score = value.max(axis=-1)
    r, c, a = np.nonzero(score >= threshold)
    d = deltas.reshape(rows, cols, 6, 7)[r, c, a]
    size = ANCHOR_SIZES[a // 2]
    x0 = 69.12 / (cols - 1) * c if cols > 1 else np.zeros(len(c))
    y0 = -39.68 + (79.36 / (rows - 1) * r if rows > 1 else np.zeros(len(r)))
    z0 = ANCHOR_BOTTOMS[a // 2] + size[:, 2] / 2
    diagonal = np.hypot(size[:, 0], size[:, 1])
    box = np.c_[x0 + d[:, 0] * diagonal, y0 + d[:, 1] * diagonal, z0 + d[:, 2] * size[:, 2], size * np.exp(d[:, 3:6])]
    turn = ANCHOR_YAWS[a % 2] + d[:, 6] - YAW_OFFSET
    way = directions.reshape(rows, cols, 6, 2)[r, c, a]
    yaw = turn - np.floor(turn / np.pi) * np.pi + YAW_OFFSET + np.pi * (way[:, 0] <= way[:, 1])
    return np.c_[box, yaw, best[r, c, a], score[r, c, a]]


def luma(pixels: np.ndarray) -> np.ndarray:
    """Integer brightness of RGB pixels (..., 3)."""
    p = pixels.astype(np.uint32)
    return ((77 * p[..., 0] + 150 * p[..., 1] + 29 * p[..., 2]) >> 8).astype(np.uint8)


def fitted(pixels: np.ndarray, width: int, height: int, pad: int = 114) -> np.ndarray:
    """An RGB image as three planes (blue first) of a width x height input, scaled to fit from the top left.

    The scale is the smaller ratio, sizes are cut to whole pixels, values between pixels are weighted
    means, the rest is padded.
    """
    h, w = pixels.shape[:2]
    ratio = min(width / w, height / h)
    nw, nh = int(w * ratio), int(h * ratio)
    at = lambda n, m: np.clip((np.arange(n) + 0.5) * (m / n) - 0.5, 0, m - 1)
    ys, xs = at(nh, h), at(nw, w)
    y0, x0 = ys.astype(int), xs.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    p = pixels.astype(np.float32)
    top = p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx
    low = p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx
    out = np.full((3, height, width), float(pad), np.float32)
    out[:, :nh, :nw] = (top * (1 - fy) + low * fy)[..., ::-1].transpose(2, 0, 1)
    return out
