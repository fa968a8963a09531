"""Following objects from sweep to sweep.

A tracker's state depends on all sweeps before, but a break in the sweep numbers resets it. Drives are
therefore cut at the breaks, and each unbroken stretch is followed on its own: in one task, as the
state demands, sweep by sweep. The same step function serves the batch and the streaming form.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.operators.scan import running
from helmsway.operators.sequences import with_previous

COAST, EMIT = 1, 2
VOXEL_M = 0.2
TRACK_COLUMNS = "track_id bigint, x double, y double, z double, vx double, vy double, vz double, observations bigint, misses bigint, age_s double"


@dataclass
class Tracks:
    """Live tracks of one stretch: their positions, first positions and times, counts and ids."""

    seq: int | None = None
    at_ns: int = 0
    next_id: int = 0
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    pos: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    first: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    first_ns: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    last_ns: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    misses: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


def _carry(points: np.ndarray, ego: tuple[float, float, float], dt: float) -> np.ndarray:
    vf, vl, yaw = ego
    a = -yaw * dt
    x, y = points[:, 0] - vf * dt, points[:, 1] - vl * dt
    return np.c_[x * np.cos(a) - y * np.sin(a), x * np.sin(a) + y * np.cos(a), points[:, 2]]


def _matches(tracks: np.ndarray, dets: np.ndarray, gate: float) -> list[tuple[int, int]]:
    """Nearest pairs within the gate, one to one, in order of (distance, track, detection)."""
    d2 = ((tracks[:, None, :] - dets[None, :, :]) ** 2).sum(axis=2)
    t, d = np.nonzero(d2 <= gate * gate)
    out, used_t, used_d = [], set(), set()
    for i in np.lexsort((d, t, d2[t, d])):
        if t[i] not in used_t and d[i] not in used_d:
            used_t.add(t[i])
            used_d.add(d[i])
            out.append((int(t[i]), int(d[i])))
    return out


def step(s: Tracks, seq: int, at_ns: int, dets: np.ndarray, ego: tuple[float, float, float] | None) -> dict[str, np.ndarray]:
    """Takes in one sweep's detections (in order of their number) and gives the tracks worth telling of.

    Tracks are carried by the vehicle's motion, matched, coast over one sweep without a match, and
    die after two; what no track takes starts one. Told of are tracks seen twice or more. A sweep
    that doesn't follow the last one by number resets all.
    """
    if s.seq is None or seq != s.seq + 1:
        s.ids, s.pos, s.first = np.empty(0, np.int64), np.empty((0, 3)), np.empty((0, 3))
        s.first_ns, s.last_ns, s.seen, s.misses = (np.empty(0, np.int64) for _ in range(4))
        taken = []
    else:
        dt = max((at_ns - s.at_ns) * 1e-9, 0.0)
        if ego is not None and len(s.ids):
            s.pos, s.first = _carry(s.pos, ego, dt), _carry(s.first, ego, dt)
            gate = g.MAX_OBJECT_MPS * dt + VOXEL_M
        else:
            gate = (g.MAX_RELATIVE_MPS + g.MAX_YAW_RPS * g.RANGE_LIMIT_M) * dt + VOXEL_M
        taken = _matches(s.pos, dets, gate) if len(s.ids) and len(dets) else []
    s.misses = s.misses + 1
    for t, d in taken:
        s.pos[t] = dets[d]
        s.last_ns[t], s.misses[t] = at_ns, 0
        s.seen[t] += 1
    live = s.misses <= COAST
    new = np.array(sorted(set(range(len(dets))) - {d for _, d in taken}), int)
    n = len(new)
    s.ids = np.r_[s.ids[live], s.next_id + np.arange(n)]
    s.pos, s.first = np.vstack([s.pos[live], dets[new].reshape(-1, 3)]), np.vstack([s.first[live], dets[new].reshape(-1, 3)])
    s.first_ns, s.last_ns = np.r_[s.first_ns[live], np.full(n, at_ns)], np.r_[s.last_ns[live], np.full(n, at_ns)]
    s.seen, s.misses = np.r_[s.seen[live], np.ones(n, np.int64)], np.r_[s.misses[live], np.zeros(n, np.int64)]
    s.next_id, s.seq, s.at_ns = s.next_id + n, seq, at_ns
    told = s.seen >= EMIT
    span = (s.last_ns - s.first_ns)[told] * 1e-9
    v = (s.pos - s.first)[told] / np.where(span > 0, span, np.inf)[:, None]
    p = s.pos[told]
    return {
        "track_id": s.ids[told], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "vx": v[:, 0], "vy": v[:, 1], "vz": v[:, 2],
        "observations": s.seen[told], "misses": s.misses[told], "age_s": span,
    }


def unbroken(sweeps: DataFrame, drive: str, seq: str, chunk: int = 100_000) -> DataFrame:
    """Adds ``stretch``, the first number of the unbroken run of numbers that a sweep is in."""
    marked = with_previous(sweeps, [drive], seq, "_prev", chunk).withColumn("_first", F.when(F.col("_prev").isNull() | (F.col(seq) - F.col("_prev") > 1), F.col(seq)))
    return running(marked, [drive], seq, "_first", "stretch", chunk, how="max").drop("_prev", "_first")


def follow(dets: DataFrame, drive: str, seq: str, at_ns: str, idx: str, ego: tuple[str, str, str] | None = None) -> DataFrame:
    """(drive, seq, ``stretch``, track columns) per sweep of a long table of detections (x, y, z).

    ``ego`` names the columns of the vehicle's forward and lateral speed and yaw rate on each row, if
    known. Ids are numbered within a stretch. A sweep with no detections is a row with null ``idx``.
    A task takes the stretches of its partition one after another, a batch of sweeps at a time.
    """
    rows = unbroken(dets, drive, seq)
    kinds = dict(rows.dtypes)
    own = list(ego or ())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, of, rest = Tracks(), None, None
        for pdf, last in _with_last(frames):
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            stretches, numbers = pdf["_of"].to_numpy(), pdf[seq].to_numpy()
            starts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (stretches[1:] != stretches[:-1])][: len(pdf)])
            whole = len(pdf) if last or not starts.size else starts[-1]  # the last sweep may go on in the next batch
            rest = pdf.iloc[whole:]
            points, given, times, motions = pdf[["x", "y", "z"]].to_numpy(float), pdf[idx].notna().to_numpy(), pdf[at_ns].to_numpy(), pdf[own].to_numpy(float)
            starts, out = starts[starts < whole], []
            for a, b in zip(starts, [*starts[1:], whole]):
                if stretches[a] != of:
                    state, of = Tracks(), stretches[a]
                motion = tuple(motions[a]) if own and np.isfinite(motions[a]).all() else None
                told = step(state, int(numbers[a]), int(times[a]), points[a:b][given[a:b]], motion)
                out.append(told | {"_row": np.full(len(told["track_id"]), a)})
            if out:
                tracks = pd.DataFrame({c: np.concatenate([o[c] for o in out]) for c in out[0]})
                at = tracks.pop("_row").to_numpy(int)
                yield tracks.assign(**{c: pdf[c].to_numpy()[at] for c in (drive, seq, "stretch")})

    schema = f"`{drive}` {kinds[drive]}, `{seq}` {kinds[seq]}, stretch bigint, {TRACK_COLUMNS}"
    of = F.concat_ws("|", F.col("stretch"), F.col(drive).isNull(), F.col(drive).cast("string")).alias("_of")
    placed = rows.select(drive, seq, "stretch", at_ns, idx, "x", "y", "z", *own, of).repartition("_of").sortWithinPartitions("_of", seq, idx)
    return placed.mapInPandas(run, schema)


def _with_last(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, bool]]:
    """Each frame that has rows, and whether it is the last."""
    held = None
    for frame in frames:
        if len(frame):
            if held is not None:
                yield held, False
            held = frame
    if held is not None:
        yield held, True


def answers(tracks: DataFrame, keys: list[str], vf: str | None = None, k: str | None = None, voxel_m: float = VOXEL_M, box: list[str] | None = None, rect: list[str] | None = None) -> DataFrame:
    """Adds ``offset_m, distance_m, closing_mps, ttc_s, in_path, nearest`` to tracks.

    The path is the arc of curvature ``k`` (straight without); a track stands on it within half the
    vehicle's width and ahead. ``box`` names the columns of its cluster's box (min_x, min_y, max_x, max_y), of
    whose corners the nearest along the path is then its distance; ``rect`` those of its lidar box (x, y, dx,
    dy, yaw), which is then what must reach the corridor. Where these are null the centre counts. Only tracks seen in this sweep answer; the nearest, ties to the
    smaller id, is flagged.
    """
    path = F.col(k) if k else F.lit(0.0)
    offset, along = g.locate(F.col("x"), F.col("y"), path)
    tx, ty = g.tangent(along, path)
    toward = -(F.col("vx") * tx + F.col("vy") * ty)
    closing = toward + F.col(vf) if vf else toward
    ttc = g.time_to_contact(F.col("distance_m"), F.col("closing_mps"), F.lit(voxel_m), F.col("age_s"))
    distance, reach = along, F.abs("offset_m") <= g.HALF_WIDTH_M
    if box:
        x0, y0, x1, y1 = (F.col(c) for c in box)
        distance = F.coalesce(F.least(*[g.locate(x, y, path)[1] for x in (x0, x1) for y in (y0, y1)]), along)
    if rect:
        reach = F.coalesce(g.reaches(*[F.col(c) for c in rect], path, g.HALF_WIDTH_M), reach)
    told = (
        tracks.withColumn("offset_m", offset).withColumn("distance_m", distance).withColumn("closing_mps", closing).withColumn("ttc_s", ttc)
        .withColumn("in_path", (F.col("misses") == 0) & (F.col("distance_m") > 0) & reach)
    )
    first = F.min(F.when(F.col("in_path"), F.struct("distance_m", "track_id"))).over(Window.partitionBy(*keys))
    return told.withColumn("_n", first).withColumn("nearest", F.coalesce(F.col("in_path") & (F.col("track_id") == F.col("_n.track_id")), F.lit(False))).drop("_n")


def most_urgent(answers: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, the whole row) of the answer with the smallest positive time to contact, the first of equals.

    An answer is the nearest on the path of its sweep, as ``answers`` flags it.
    """
    closing = answers.where(F.col("nearest") & (F.col("ttc_s") > 0) & ~F.isnan("ttc_s"))
    rest = [c for c in answers.columns if c not in keys]
    return closing.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ttc_s", seq)).alias("_b")).select(*keys, "_b.*")
