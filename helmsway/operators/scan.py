"""Running aggregates over ordered keys in which one key may hold a large share of all rows.

A plain window over a hot key sorts and scans all its rows in one task. Here the order axis is cut
into chunks of fixed length: a small aggregate per (key, chunk) is scanned first, its result enters
each chunk as one extra row, and the scan over the rows is a window over (key, chunk).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has such a column (Spark compares without case)."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def floor_div(value: Column, by: int) -> Column:
    """Exact floor division of a BIGINT column by a positive constant, also below zero."""
    d = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, d), d)


def running(df: DataFrame, keys: list[str], order: str, value: str, out: str, chunk: int, how: str = "sum", strict: bool = False) -> DataFrame:
    """``how`` ("sum", "max" or "min") of ``value`` over all rows of the key up to this row's ``order``.

    Rows with equal ``order`` are peers and see the same result; with ``strict`` only rows of
    smaller ``order`` count. ``order`` is BIGINT; rows where it is null get a null result. Null
    keys form a key of their own. A result over no values is null. ``chunk`` is the length of a
    chunk on the order axis.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    part, seed = fresh("_part", df), fresh("_seed", df)
    rows = df.withColumn(part, floor_div(F.col(order), chunk))
    totals = rows.where(F.col(order).isNotNull()).groupBy(*keys, part).agg(agg(value).alias(value))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        totals.withColumn(value, agg(value).over(before))
        .where(F.col(value).isNotNull())
        .withColumn(order, F.col(part) * F.lit(chunk) - 1)
        .withColumn(seed, F.lit(True))
    )
    seeded = rows.withColumn(seed, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, part).orderBy(order).rangeBetween(Window.unboundedPreceding, -1 if strict else 0)
    result = F.when(F.col(order).isNotNull(), agg(value).over(upto))
    return seeded.withColumn(out, result).where(~F.col(seed)).drop(part, seed)


def numbered(df: DataFrame, keys: list[str], order: str, ties: list[str], out: str, chunk: int) -> DataFrame:
    """Row numbers from 0 within each key by (``order``, ``ties``), without a window over a whole key.

    Rows where ``order`` is null come first, among themselves by ``ties``, as in Spark's order.
    """
    part, count = fresh("_part", df), fresh("_count", df)
    first = -(2**62)
    rows = df.withColumn(part, F.coalesce(floor_div(F.col(order), chunk), F.lit(first)))
    totals = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(count))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    seed = fresh("_seed", df)
    carry = totals.withColumn(count, F.coalesce(F.sum(count).over(before), F.lit(0))).withColumn(seed, F.lit(True))
    seeded = rows.withColumn(seed, F.lit(False)).unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, part).orderBy(F.col(seed).desc(), F.col(order), *[F.col(t) for t in ties])
    whole = inside.rowsBetween(Window.unboundedPreceding, 0)
    offset = F.max(count).over(whole)
    return (
        seeded.withColumn(out, (F.row_number().over(inside) - 2 + offset).cast("bigint"))
        .where(~F.col(seed))
        .drop(part, count, seed)
    )


def in_blocks(df: DataFrame, keys: list[str], order: str, ties: list[str], before: int, chunk: int, size: int = 4096) -> DataFrame:
    """Rows of each key in blocks of ``size`` by (``order``, ``ties``), each block led by the ``before`` rows ahead of it.

    Adds ``_no`` (row number from 0 in the key), ``_block`` and ``_home`` (false for the leading
    copies). A window over (keys, ``_block``) by ``_no`` whose frame reaches back at most ``before`` rows
    is right on the home rows, and no task holds more of a key than its blocks.
    """
    placed = numbered(df, keys, order, ties, "_no", chunk)
    block = F.call_function("div", F.col("_no"), F.lit(size).cast("bigint"))
    homes = F.array_compact(F.array(block, F.when(F.col("_no") - block * size >= size - before, block + 1)))
    return placed.withColumn("_block", F.explode(homes)).withColumn("_home", F.col("_block") == block)
