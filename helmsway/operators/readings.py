"""Implausible readings: a hidden Markov model per source and field.

Each reading is in one of four states: normal, spike (a short departure from the readings round it),
stuck (the same value again and again) or out of range. The forward-backward probabilities of the
states assign the flags. What the model looks at:

- the leap from the reading before, beyond the usual steps there: between two normal readings it is
  small and, rarely, a true jump; into and out of a spike it is large;
- how far the reading lies from the line through the readings round it: near for a normal one;
- whether it is one of eight or more with exactly the same value, and whether it is beyond what a
  vehicle can do. These two are hard bounds, that leave next to no chance to other states.

Leaps and distances are in units of what is normal for the field of the source, a quantile over all its
readings. Transitions, the usual size of leaps and the usual distance are then fitted to each source
and field by Baum-Welch rounds: expected counts are summed per source by Spark and set beside those of a
prior. Holes in time begin a series anew; a hole is so many times the
median step of the source's field.

Series are cut into blocks of readings with a margin of neighbours on both sides, wider than all that a
reading's features look at, so a source with a large share of all readings is spread over tasks, no
task sees more than a block, and the size of a block changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.functions.hmm import posteriors
from helmsway.operators.scan import NS, numbered
from helmsway.session import checkpointed

#: Values that no road vehicle can have: m/s forward and to the side, rad/s.
HARD_BOUNDS = {"vf": (-60.0, 100.0), "vl": (-30.0, 30.0), "yaw_rate": (-6.0, 6.0)}
BLOCK, MARGIN = 4096, 160
STUCK_RUN, LONGEST_SPIKE = 8, 12
#: Readings round each one that its line goes through: a spike is never most of them. Steps that make the usual one.
WINDOW, STEPS = 2 * LONGEST_SPIKE + 3, 5
#: A hole is longer than so many median steps.
HOLE = 5
NORMAL, SPIKE, STUCK, RANGE = range(4)
KINDS = np.array(["normal", "spike", "stuck", "out_of_range"])
#: Prior of the model. Rows: from; columns: to. It counts as so many moves from each state.
TRANSITION = np.array(
    [
        [0.990, 0.005, 0.003, 0.002],
        [0.300, 0.690, 0.005, 0.005],
        [0.060, 0.005, 0.930, 0.005],
        [0.500, 0.020, 0.005, 0.475],
    ]
)
INITIAL = np.array([0.97, 0.01, 0.01, 0.01])
PRIOR_MOVES, PRIOR_READINGS = 100.0, 50.0
#: Prior mean of normal leaps and of the logarithm of normal distances, in normal deviations.
LEAP, AWAY = 1.2, 0.8
#: Share of true jumps among normal steps; middle size and steepness of the sizes of jumps and spikes.
JUMPS, JUMP_SIZE, JUMP_SHAPE = 1e-4, 30.0, 4.0
#: Weight of a distance beside leaps, as distances of neighbours say much the same.
AWAY_WEIGHT = 0.5
#: Chance of a reading beyond a hard bound in any other state.
HARDLY = 1e-9
#: Baum-Welch rounds, and blocks that a task looks at side by side.
ROUNDS, SIDE_BY_SIDE = 1, 32
COUNTS = 20
SERIES = ["_source", "_field"]


def normal_scales(readings: DataFrame, bounds: dict, chunk_ns: int = 600 * NS) -> DataFrame:
    """(source, field, ``hole_ns``, ``scale``): the shortest hole, and how far readings usually lie from the middle of their neighbours.

    Two quantiles of that distance (distances of 0 left out), each brought to the size of a standard
    deviation; the larger counts. Neighbours are taken within chunks of time: a reading at the edge
    of a chunk does without. A field that never changes has a thousandth of its largest value.
    """
    w = Window.partitionBy(*SERIES, F.call_function("div", F.col("_time"), F.lit(chunk_ns).cast("bigint"))).orderBy("_time")
    v = F.col("_value")
    inside = F.lit(True)
    for name, (low, high) in bounds.items():
        inside = F.when(F.col("_field") == name, v.between(low, high)).otherwise(inside)
    away = F.abs(v - (F.lag(v).over(w) + F.lead(v).over(w)) / 2)
    d = readings.select(*SERIES, away.alias("_away"), (F.col("_time") - F.lag("_time").over(w)).alias("_step"), F.when(inside, F.abs(v)).alias("_size"))
    found = d.groupBy(*SERIES).agg(
        F.percentile_approx(F.when(F.col("_away") > 0, F.col("_away")), [0.5, 0.8], 2000).alias("_q"),
        F.percentile_approx("_step", 0.5, 2000).alias("_usual"),
        F.max("_size").alias("_most"),
    )
    scale = F.coalesce(F.greatest(F.col("_q")[0] / 0.826, F.col("_q")[1] / 1.570), F.greatest(F.col("_most") * 1e-3, F.lit(1e-9)), F.lit(1e-9))
    return found.select(*SERIES, F.greatest(F.coalesce("_usual", F.lit(0)) * HOLE, F.lit(1)).alias("hole_ns"), scale.alias("_scale"))


def _usual(d: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Median of the STEPS values before and after each of ``d``, within its group; 0 where there is none."""
    at = np.arange(d.size) + group * (STEPS + 1)
    wide = np.full(at[-1] + 1, np.nan)
    wide[at] = d
    s = pd.Series(wide)
    before = s.shift(1).rolling(STEPS, min_periods=1).median().fillna(0)
    after = s[::-1].shift(1).rolling(STEPS, min_periods=1).median()[::-1].fillna(0)
    return before.to_numpy()[at], after.to_numpy()[at]


def _leaps(v: np.ndarray, t: np.ndarray, group: np.ndarray) -> np.ndarray:
    """What of the step that leads to each reading neither the usual step nor the usual rate explains; NaN at the start of a group.

    Usual is that of the steps before or after, whichever explains more. A lost reading doubles the
    step but not the rate; a time written late changes the rate but not the step.
    """
    if v.size < 2:
        return np.full(v.size, np.nan)
    d, dt = np.diff(v), np.diff(t) / NS
    within, group = group[1:] == group[:-1], group[:-1]
    steps = np.where(within, d, np.nan)
    rates = np.where(within & (dt > 0), d / np.where(dt > 0, dt, 1.0), np.nan)
    left = [np.abs(d - x) for x in _usual(steps, group)] + [np.abs(d - x * dt) for x in _usual(rates, group)]
    return np.r_[np.nan, np.where(within, np.min(left, axis=0), np.nan)]


def _away(v: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Distance of each reading from the line through the WINDOW readings round it: median step, median offset.

    Near the ends of a group the window is shifted, not cut.
    """
    n = v.size
    first, end = np.searchsorted(group, group, "left"), np.searchsorted(group, group, "right")
    begin = np.clip(np.arange(n) - WINDOW // 2, first, np.maximum(end - WINDOW, first))
    at = begin[:, None] + np.arange(WINDOW)[None, :]
    seen = np.where(at < end[:, None], v[np.minimum(at, n - 1)], np.nan)
    short = np.isnan(seen).any(axis=1)
    middle = lambda x: np.where(short, 0.0, np.median(x, axis=1))
    slope, offset = middle(np.diff(seen, axis=1)), at - np.arange(n)[:, None]
    if short.any():
        some = pd.DataFrame(np.diff(seen[short], axis=1)).median(axis=1).fillna(0).to_numpy()
        slope[short] = some
    flat = seen - slope[:, None] * offset
    line = middle(flat)
    if short.any():
        line[short] = pd.DataFrame(flat[short]).median(axis=1).to_numpy()
    return np.abs(v - line)


def _observed(t: np.ndarray, v: np.ndarray, standing: np.ndarray, scale: float, bounds: tuple[float, float], hole_ns: float) -> dict[str, np.ndarray]:
    """What the model looks at, of the readings of one field in order of time: leap, away, outside, same, anew."""
    n = v.size
    outside = (v < bounds[0]) | (v > bounds[1]) | ~np.isfinite(v)
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (standing[1:] != standing[:-1])])
    length = np.diff(np.r_[starts, n])
    same = (np.repeat(length, length) >= STUCK_RUN) & ~standing
    group = np.r_[0, np.cumsum(np.diff(t) > hole_ns)]
    inside = np.flatnonzero(~outside & ~same)
    leap, away = np.full(n, np.nan), np.full(n, np.nan)
    if inside.size > 2:
        leap[inside] = np.where(np.diff(inside, prepend=-2) == 1, _leaps(v[inside], t[inside], group[inside]), np.nan) / scale
        away[inside] = _away(v[inside], group[inside]) / scale
    return {"leap": leap, "away": away, "outside": outside, "same": same, "anew": np.r_[True, group[1:] != group[:-1]]}


def _jump(leap: np.ndarray) -> np.ndarray:
    r = leap / JUMP_SIZE
    return JUMP_SHAPE / JUMP_SIZE * r ** (JUMP_SHAPE - 1) / (1 + r**JUMP_SHAPE) ** 2 + 1e-12


def _parameters(counts: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Transitions, mean normal leap and mean normal distance of a series, from expected counts and the prior."""
    moves = counts[:16].reshape(4, 4) + PRIOR_MOVES * TRANSITION
    leap = (counts[16] + LEAP * PRIOR_READINGS) / (counts[17] + PRIOR_READINGS)
    away = (counts[18] + AWAY * PRIOR_READINGS) / (counts[19] + PRIOR_READINGS)
    return moves / moves.sum(axis=1, keepdims=True), leap, away


def _usual_leap(leap: np.ndarray, mean: float) -> np.ndarray:
    return (1 - JUMPS) * np.exp(-leap / mean) / mean


def _likelihoods(seen: dict[str, np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (n, 4) and moves (n, 4, 4) of a series, given its expected counts so far."""
    transition, mean_leap, mean_away = _parameters(counts)
    known, leap = np.isfinite(seen["leap"]), np.nan_to_num(seen["leap"])
    jump = _jump(leap)
    usual = _usual_leap(leap, mean_leap) + JUMPS * jump
    moves = np.repeat(transition[None], leap.size, axis=0)
    moves[known, NORMAL, NORMAL] *= usual[known]
    moves[known, NORMAL, SPIKE] *= jump[known]
    moves[known, SPIKE, NORMAL] *= jump[known]
    moves[known, SPIKE, SPIKE] *= (usual[known] + jump[known]) / 2
    moves[seen["anew"]] = INITIAL
    y = np.log1p(np.nan_to_num(seen["away"]))
    emissions = np.empty((leap.size, 4))
    emissions[:, NORMAL] = (np.exp(-y / mean_away) / mean_away) ** AWAY_WEIGHT
    far = (np.expm1(y) / JUMP_SIZE) ** JUMP_SHAPE
    emissions[:, SPIKE] = (y**3 * np.exp(-y) / 6) ** AWAY_WEIGHT * far / (1 + far) + 1e-12
    emissions[seen["outside"] | seen["same"], :2] = HARDLY
    emissions[:, STUCK] = np.where(seen["same"], 1.0, HARDLY * 1e-3)
    emissions[:, RANGE] = np.where(seen["outside"], 1.0, HARDLY * 1e-3)
    return emissions, moves


def _expected(seen: dict[str, np.ndarray], counts: np.ndarray, p: np.ndarray, steps: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Expected counts of the home readings: moves, usual leaps and distances of normal readings."""
    _, mean_leap, _ = _parameters(counts)
    moved = home & ~seen["anew"]
    leap = np.nan_to_num(seen["leap"])
    usual = _usual_leap(leap, mean_leap)
    weight = steps[:, NORMAL, NORMAL] * (moved & np.isfinite(seen["leap"])) * usual / (usual + JUMPS * _jump(leap))
    normal = p[:, NORMAL] * (home & np.isfinite(seen["away"]))
    y = np.log1p(np.nan_to_num(seen["away"]))
    return np.r_[steps[moved].sum(axis=0).ravel(), weight @ leap, weight.sum(), normal @ y, normal.sum()]


def _side_by_side(blocks: pd.DataFrame) -> Iterator[tuple[int, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(row, what was seen, counts, state probabilities, move probabilities) of each block."""
    for first in range(0, len(blocks), SIDE_BY_SIDE):
        part = blocks.iloc[first : first + SIDE_BY_SIDE]
        seen, counts = [], []
        for row in part.itertuples(index=False):
            marks = np.asarray(row.marks)
            seen.append({"leap": np.asarray(row.leap, float), "away": np.asarray(row.away, float), "outside": marks & 1 > 0, "same": marks & 2 > 0, "anew": marks & 4 > 0})
            counts.append(np.zeros(COUNTS) if row.counts is None else np.asarray(row.counts, float))
        both = [_likelihoods(s, c) for s, c in zip(seen, counts)]
        for i, (p, steps) in enumerate(posteriors([e for e, _ in both], [m for _, m in both])):
            yield first + i, seen[i], counts[i], p, steps


def flag_readings(readings: DataFrame, source: str, seq: str, time: str, fields: list[str], bounds: dict | None = None, rounds: int | None = None) -> DataFrame:
    """(source, seq, ``field_name``, ``fault``, ``p_fault``) of every implausible reading.

    ``fault`` is spike, stuck or out_of_range, the likeliest state; ``p_fault`` the probability that the
    reading isn't normal, above a half. Null and NaN are missing values: no case, and skipped when neighbours are sought.
    Rows that share (source, seq) are copies of one reading, of which the earliest time counts.
    Readings without a time have no neighbours and take no part. A reading at which the vehicle stands
    (vf and vl both exactly 0) is no case and ends a run of equal values. Empty input gives an empty
    result; other columns are ignored.
    """
    bounds = HARD_BOUNDS | (bounds or {})
    one = [F.min_by(F.nanvl(F.col(f).cast("double"), F.lit(None)), F.col(time)).alias(f) for f in fields]
    plain = (
        readings.where(F.col(time).isNotNull())
        .groupBy(F.col(source).alias("_source"), F.col(seq).alias("_seq"))
        .agg(F.min(time).cast("bigint").alias("_time"), *one)
    )
    types = dict(plain.dtypes)
    standing = F.coalesce((F.col("vf") == 0) & (F.col("vl") == 0), F.lit(False)) if {"vf", "vl"} <= set(fields) else F.lit(False)
    each = F.inline(F.array(*[F.struct(F.lit(f).alias("_field"), F.col(f).alias("_value")) for f in fields]))
    long = plain.select("_source", "_seq", "_time", standing.alias("_standing"), each).where(F.col("_value").isNotNull())
    placed = numbered(long, SERIES, "_time", ["_seq"], "_no", 60 * NS)
    of = lambda no: F.call_function("div", no, F.lit(BLOCK).cast("bigint"))
    homes = F.sequence(of(F.greatest(F.col("_no") - MARGIN, F.lit(0).cast("bigint"))), of(F.col("_no") + MARGIN))
    reading = F.struct("_no", "_time", "_seq", "_value", "_standing")
    known = normal_scales(long, bounds).select(F.col("_source").alias("_of"), F.col("_field").alias("_f"), "hole_ns", "_scale")
    blocks = (
        placed.withColumn("_block", F.explode(homes))
        .groupBy(*SERIES, "_block")
        .agg(F.array_sort(F.collect_list(reading)).alias("_r"))
        .join(known, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_field") == F.col("_f")))
        .select(*SERIES, "_block", "hole_ns", "_scale", *[F.col(f"_r.{c}").alias(c) for c in ("_no", "_time", "_seq", "_value", "_standing")])
    )

    def observe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                _, field, home, hole_ns, scale, no, t, seqs, v, standing = row
                seen = _observed(np.asarray(t), np.asarray(v, float), np.asarray(standing, bool), scale, bounds.get(field, (-np.inf, np.inf)), hole_ns)
                marks = seen["outside"] * 1 + seen["same"] * 2 + seen["anew"] * 4 + (np.asarray(no) // BLOCK == home) * 8 + np.asarray(standing, bool) * 16
                out.append((row[0], field, seqs, seen["leap"].astype(np.float32), seen["away"].astype(np.float32), marks.astype(np.int32)))
            yield pd.DataFrame(out, columns=["_source", "_field", "_seq", "leap", "away", "marks"])

    keyed = f"_source {types['_source']}, _field string"
    seen = checkpointed(blocks.mapInPandas(observe, f"{keyed}, _seq array<{types['_seq']}>, leap array<float>, away array<float>, marks array<int>"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [_expected(s, c, p, steps, np.asarray(pdf["marks"].iloc[i]) & 8 > 0) for i, s, c, p, steps in _side_by_side(pdf)]
            yield pdf[["_source", "_field"]].assign(counts=got)

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, _, _, p, _ in _side_by_side(pdf):
                row, marks = pdf.iloc[i], np.asarray(pdf["marks"].iloc[i])
                at = np.flatnonzero((p[:, NORMAL] < 0.5) & (marks & 8 > 0) & (marks & 16 == 0))
                fault = KINDS[1:][p[at, 1:].argmax(axis=1)]
                yield pd.DataFrame({"_source": row["_source"], "_seq": np.asarray(row["_seq"], object)[at], "_field": row["_field"], "fault": fault, "p_fault": 1.0 - p[at, NORMAL]})

    fitted = seen.withColumn("counts", F.lit(None).cast("array<double>"))
    for _ in range(ROUNDS if rounds is None else rounds):
        sums = F.array(*[F.sum(F.col("counts")[i]) for i in range(COUNTS)]).alias("counts")
        totals = fitted.mapInPandas(count, f"{keyed}, counts array<double>").groupBy(*SERIES).agg(sums)
        totals = totals.select(F.col("_source").alias("_of"), F.col("_field").alias("_f"), "counts")
        fitted = seen.join(totals, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_field") == F.col("_f"))).drop("_of", "_f")
    found = fitted.mapInPandas(decide, f"_source {types['_source']}, _seq {types['_seq']}, _field string, fault string, p_fault double")
    return found.select(F.col("_source").alias(source), F.col("_seq").alias(seq), F.col("_field").alias("field_name"), "fault", "p_fault")
