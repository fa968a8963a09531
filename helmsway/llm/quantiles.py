"""Percentiles of very large columns from mergeable sketches: dyadic Count-sketches.

A value is encoded as a 32-bit integer whose order is that of the values: sign, power of two, and the
next 25 binary digits. For each binary resolution of the codes a sketch counts how many values fall
into each node. Resolutions of no more nodes than a sketch has counters are counted as they are; all
others, up to that of 2**32 nodes, by a signed Count-sketch of DEPTH rows of WIDTH counters. Sketches of
parts (runs, days, partitions) are added to one another; what was added can be taken out again.

A percentile is found by descending the resolutions with the rank wanted. The signed levels are read in
two ways. From the top down, only children of nodes in use can be in use: where one of these is alone in
a counter, the counter tells its number for certain; taking it away leaves others alone, and a brother
of a known node follows from their parent. So long as this reaches every node, the level is known
exactly, which it is up to some 2 WIDTH nodes in use: the node reached then surely holds the percentile
and bounds the error. Below, the median of the rows' counters estimates where in that node it lies.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary digits kept after the first; bits of a code, of which the highest is the sign.
MANTISSA, BITS = 25, 32
HALF = 1 << (BITS - 1)
#: Counters in a row of a sketch, rows, and the finest resolution that is counted as it is.
WIDTH, DEPTH = 512, 3
EXACT = BITS - int(np.log2(WIDTH))
PLAIN = 2 * WIDTH - 1
SIZE = PLAIN + EXACT * DEPTH * WIDTH
#: Odd multipliers of a hash with good mixing (fixed values).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Codes that are gathered before they enter a sketch, and keys that a task holds before it hands them on.
GATHERED, MOST_OPEN = 1 << 16, 64


def encode(values: np.ndarray) -> np.ndarray:
    """Codes of integers, in their order; values of up to 26 binary digits have a code of their own."""
    v = np.abs(np.maximum(values.astype(np.int64), -(2**63 - 1)))
    e = np.maximum(np.frexp(v.astype(np.float64))[1] - 1, 0).astype(np.int64)
    e -= (v >> e) == 0  # frexp rounds large integers up
    e = np.maximum(e, 0)
    digits = np.where(e > MANTISSA, v >> np.maximum(e - MANTISSA, 0), v << np.maximum(MANTISSA - e, 0)) - (1 << MANTISSA)
    code = np.where(v == 0, 0, ((e + 1) << MANTISSA) + digits)
    return HALF + np.where(values < 0, -1 - code, code)


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest integer that could have each code (codes that no integer has lie between their neighbours)."""
    code = np.asarray(code, np.int64) - HALF
    c = np.where(code < 0, -1 - code, code)
    e, digits = (c >> MANTISSA) - 1, (c & ((1 << MANTISSA) - 1)) + (1 << MANTISSA)
    up, down = np.maximum(e - MANTISSA, 0), np.clip(MANTISSA - e, 0, MANTISSA)
    low = np.where(e < 0, 0, np.where(e > MANTISSA, digits << up, -(-digits >> down)))
    high = np.where(e < 0, 0, np.where(e > MANTISSA, ((digits + 1) << up) - 1, digits >> down))
    return np.where(code < 0, -high, low), np.where(code < 0, -low, high)


def _range(node: int, level: int) -> tuple[int, int]:
    """Smallest and largest integer of a node."""
    first, last = decode(np.array([node << level])), decode(np.array([((node + 1) << level) - 1]))
    return int(first[0][0]), int(last[1][0])


def _places(nodes: np.ndarray, level: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counter and sign of each node of a signed level in each row (fixed hash functions)."""
    x = (nodes.astype(np.uint64) + np.uint64(1)) * MIX[0] + np.uint64((level + 1) * int(MIX[1]) % (1 << 64))
    for shift, by in ((30, MIX[1]), (27, MIX[2])):
        x = (x ^ (x >> np.uint64(shift))) * by
    x ^= x >> np.uint64(31)
    bits = np.uint64(int(np.log2(WIDTH)))
    cells = [((x >> (np.uint64(20 * row))) & np.uint64(WIDTH - 1)).astype(np.int64) for row in range(DEPTH)]
    signs = [1 - 2 * ((x >> (np.uint64(20 * row) + bits)) & np.uint64(1)).astype(np.int64) for row in range(DEPTH)]
    return list(zip(cells, signs))


def add(sketch: np.ndarray, codes: np.ndarray, weight: int = 1) -> None:
    """Adds codes to a sketch in place; with weight -1 they are taken out."""
    nodes, counts = np.unique(codes, return_counts=True)
    counts = counts * weight
    at = SIZE
    for level in range(BITS + 1):
        if level:
            nodes = nodes >> 1
            first = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
            nodes, counts = nodes[first], np.add.reduceat(counts, first) if first.size else counts
        if not nodes.size:
            return
        if level < EXACT:
            for cells, signs in _places(nodes, level):
                at -= WIDTH
                sketch[at : at + WIDTH] += np.bincount(cells, counts * signs, WIDTH).astype(np.int64)
        else:
            at -= 1 << (BITS - level)
            sketch[at + nodes] += counts


def _signed(sketch: np.ndarray, level: int) -> list[np.ndarray]:
    """The rows of a signed level, as laid down by ``add``."""
    end = SIZE - level * DEPTH * WIDTH
    return [sketch[end - (row + 1) * WIDTH : end - row * WIDTH] for row in range(DEPTH)]


def total(sketch: np.ndarray) -> int:
    return int(sketch[0])


def _children(sketch: np.ndarray, level: int, parents: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Nodes in use of a signed level and their exact counts, from those of the level above; None if not all can be told."""
    if parents.size > 2 * WIDTH:
        return None
    nodes = np.stack([parents * 2, parents * 2 + 1], axis=1).ravel()
    places = _places(nodes, level)
    left = [row.copy() for row in _signed(sketch, level)]
    counts, open_ = np.zeros(nodes.size, np.int64), np.ones(nodes.size, bool)
    while open_.any():
        at = np.flatnonzero(open_)
        found = np.zeros(nodes.size, bool)
        for row, (cells, signs) in zip(left, places):
            alone = at[np.bincount(cells[at], minlength=WIDTH)[cells[at]] == 1]
            counts[alone] = row[cells[alone]] * signs[alone]
            found[alone] = True
        new = np.flatnonzero(found)
        if not new.size:
            return None
        brothers = (new ^ 1)[~found[new ^ 1] & open_[new ^ 1]]
        counts[brothers] = held[brothers >> 1] - counts[brothers ^ 1]
        new = np.r_[new, brothers]
        open_[new] = False
        for row, (cells, signs) in zip(left, places):
            row -= np.bincount(cells[new], counts[new] * signs[new], WIDTH).astype(np.int64)
    if any(row.any() for row in left):
        return None
    used = counts != 0
    return nodes[used], counts[used]


def known(sketch: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The finest level known exactly, its nodes in use, and their counts."""
    level = EXACT
    counts = sketch[WIDTH - 1 : PLAIN]
    nodes = np.flatnonzero(counts)
    counts = counts[nodes]
    while level and (finer := _children(sketch, level - 1, nodes, counts)) is not None:
        level, (nodes, counts) = level - 1, finer
    return level, nodes, counts


def quantiles(sketch: np.ndarray, percents: tuple[int, ...], coarsest: int = 0) -> list[tuple[float, int, int, int, int]]:
    """(estimate, smallest, largest possible, rank, how many values lie below the smallest) of each percentile; none if empty.

    The rank is nearest-rank: ceil(percent * n / 100). The bounds hold for certain; they are those of
    a node of level ``coarsest`` where a finer one is known.
    """
    n = total(sketch)
    if n <= 0:
        return []
    finest, nodes, counts = known(sketch)
    upto, out = np.cumsum(counts), []
    for percent in percents:
        rank = max(1, -(-percent * n // 100))
        i = int(np.searchsorted(upto, rank))
        node, inside, seen = int(nodes[i]), float(counts[i]), float(upto[i] - counts[i])
        bound = max(finest, coarsest)
        holder = node >> (bound - finest)
        below = int(counts[: np.searchsorted(nodes, holder << (bound - finest))].sum())
        for level in range(finest - 1, -1, -1):
            node *= 2
            guesses = [row[cells[0]] * signs[0] for row, (cells, signs) in zip(_signed(sketch, level), _places(np.array([node]), level))]
            first = min(max(float(np.median(guesses)), 0.0), inside)
            if seen + first < rank:
                seen, inside, node = seen + first, inside - first, node + 1
            else:
                inside = first
        low, high = _range(holder, bound)
        a, b = _range(node, 0)
        out.append((min(max((a + b) / 2, low), high), low, high, rank, below))
    return out


def pack(sketch: np.ndarray) -> bytes:
    """The counters in as few bytes each as they need, compressed."""
    most = int(np.abs(sketch).max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1) or s == 8)
    return bytes([size]) + zlib.compress(sketch.astype(f"<i{size}").tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<i{data[0]}").astype(np.int64)


def sketches(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, ``metric``, ``sketch``): a sketch of each metric's values per key, of one part or more.

    Sketches are built where the rows lie; a key has one or more partial sketches, to be added up by
    ``merge``, and fewest if equal keys follow one another. Nulls are left out; a key without any value of a metric has
    no sketch of it.
    """
    kinds = dict(rows.dtypes)
    names = [f"k{i}" for i in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple, list[np.ndarray]] = {}
        open_: dict[tuple, np.ndarray] = {}
        types: list = []

        def enter(key):
            if codes := waiting.pop(key, None):
                add(open_.setdefault(key, np.zeros(SIZE, np.int64)), np.concatenate(codes))

        def handed_on(closing):
            for key in closing:
                enter(key)
            data = [[*k[0], k[1], pack(open_.pop(k))] for k in closing]
            cols = list(zip(*data))
            arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(cols[-2], pa.string()), pa.array(cols[-1], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, [*names, "metric", "sketch"])

        for batch in batches:
            types = [c.type for c in batch.columns[: len(keys)]]
            pdf = batch.to_pandas()
            for key, at in pdf.groupby(names, dropna=False, sort=False).indices.items():
                key = tuple(None if isinstance(x, float) and np.isnan(x) else x for x in (key if isinstance(key, tuple) else (key,)))
                for i, metric in enumerate(metrics):
                    v = pdf[f"m{i}"].to_numpy()[at]
                    v = v[~pd.isna(v)]
                    if v.size:
                        codes = waiting.setdefault((key, metric), [])
                        codes.append(encode(v.astype(np.int64)))
                        if sum(map(len, codes)) > GATHERED:
                            enter((key, metric))
            every = list(dict.fromkeys([*open_, *waiting]))
            if len(every) > MOST_OPEN:
                yield handed_on(every[: -MOST_OPEN // 2])
        if every := list(dict.fromkeys([*open_, *waiting])):
            yield handed_on(every)

    schema = ", ".join([f"{n} {kinds[k]}" for n, k in zip(names, keys)] + ["metric string", "sketch binary"])
    plain = rows.select(*[F.col(k).alias(n) for n, k in zip(names, keys)], *[F.col(m).cast("bigint").alias(f"m{i}") for i, m in enumerate(metrics)])
    return plain.mapInArrow(run, schema).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "metric", "sketch")


def merge(parts: DataFrame, keys: list[str], fan: int = 32) -> DataFrame:
    """(keys, ``metric``, ``sketch``): the sum of all partial sketches of each key and metric.

    Parts are added up in ``fan`` groups per key first, so no task holds all parts of a key. Parts
    with a column ``sign`` of -1 are taken out. Sums without values are left out.
    """
    cols = [*keys, "metric", "sketch"]
    sign = F.col("sign") if "sign" in parts.columns else F.lit(1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = np.zeros(SIZE, np.int64)
        for data, sign in zip(pdf["sketch"], pdf["_sign"]):
            whole += sign * unpack(data)
        return pdf.iloc[:1].assign(sketch=[pack(whole)], _sign=1, _left=total(whole))

    signed = parts.select(*cols, sign.cast("int").alias("_sign"), F.pmod(F.xxhash64("sketch"), F.lit(fan)).cast("int").alias("_part"), F.lit(1).cast("bigint").alias("_left"))
    some = signed.groupBy(*keys, "metric", "_part").applyInPandas(run, signed.schema)
    return some.groupBy(*keys, "metric").applyInPandas(run, signed.schema).where("_left > 0").select(*cols)


def without(merged: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches ``merged`` with all values of the sketches ``taken`` (of parts of the same data) taken out."""
    return merge(merged.withColumn("sign", F.lit(1)).unionByName(taken.withColumn("sign", F.lit(-1))), keys)


def keep(parts: DataFrame, folder: str, day: str) -> None:
    """Writes sketches as a table with a folder for each ``day``, in place of those that it held of the same days."""
    parts.write.partitionBy(day).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def invert(merged: DataFrame, keys: list[str], percents: tuple[int, ...] = (50, 95, 99), coarsest: int = 0) -> DataFrame:
    """(keys, ``metric, percent, n, rank, estimate, low, high, below``) of each percentile wanted."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples(index=False):
                sketch = unpack(row[-1])
                for p, q in zip(percents, quantiles(sketch, percents, coarsest)):
                    out.append((*row[:-1], p, total(sketch), q[3], q[0], q[1], q[2], q[4]))
            yield pd.DataFrame(out, columns=[*pdf.columns[:-1], "percent", "n", "rank", "estimate", "low", "high", "below"])

    kinds = dict(merged.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", metric string, percent int, n bigint, rank bigint, estimate double, low bigint, high bigint, below bigint"
    return merged.select(*keys, "metric", "sketch").mapInPandas(run, schema)
