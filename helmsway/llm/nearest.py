"""Nearest record in time within a tolerance, as a range join on nearest-neighbour intervals.

Every right-hand timestamp owns the interval of instants that are nearest to it: bounded by the
midpoints to its neighbours and by the tolerance. The intervals of one entity don't overlap, so a
left-hand timestamp lies in at most one of them. They are indexed by buckets of time, each interval
in the buckets it touches; the join is then an equality join on (entity, bucket) with a range check,
and a busy entity is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NS = 1_000_000_000


def _bucket(value, length: int):
    d = F.lit(length).cast("bigint")
    return F.call_function("div", value - F.pmod(value, d), d)


def nearest_intervals(right: DataFrame, keys: list[str], time: str, value: str, tolerance_ns: int, chunk_ns: int = 60 * NS) -> DataFrame:
    """(keys, ``at``, ``value``, ``from_ns``, ``to_ns``): the closed interval of instants nearest to each time.

    An instant halfway between two times belongs to the earlier. Of records with the same time the
    one with the smallest value counts. Records without a time take no part. Neighbours are sought
    within chunks of time, which are no shorter than twice the tolerance; records so near a chunk's
    edge stand in both chunks, as a neighbour farther off than that moves no bound.
    """
    reach = 2 * tolerance_ns
    chunk_ns = max(chunk_ns, reach)
    t = F.col("at")
    chunks = F.array_distinct(F.array(_bucket(t, chunk_ns), _bucket(t - reach, chunk_ns), _bucket(t + reach, chunk_ns)))
    inside = Window.partitionBy(*keys, "_chunk").orderBy("at")
    before, after = F.lag("at").over(inside), F.lead("at").over(inside)
    half = lambda step: F.call_function("div", step, F.lit(2).cast("bigint"))
    return (
        right.where(F.col(time).isNotNull())
        .groupBy(*keys, F.col(time).alias("at"))
        .agg(F.min(value).alias("value"))
        .withColumn("_chunk", F.explode(chunks))
        .withColumn("from_ns", F.greatest(t - F.lit(tolerance_ns), before + half(t - before) + 1))
        .withColumn("to_ns", F.least(t + F.lit(tolerance_ns), t + half(after - t)))
        .where(F.col("_chunk") == _bucket(t, chunk_ns))
        .drop("_chunk")
    )


def match_nearest(
    left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, right_value: str, tolerance_ns: int, out: str = "match_value"
) -> DataFrame:
    """Rows of ``left`` with ``out``, the right-hand value nearest in time within the tolerance.

    Rows without a time or without a match give no row; one right-hand record may serve several.
    ``keys`` are columns of both sides; null keys match nothing. Equal rows of ``left`` stay so many.
    """
    width = max(4 * tolerance_ns, NS)
    index = nearest_intervals(right, keys, right_time, right_value, tolerance_ns).select(
        *[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
        F.col("value").alias("_value"),
        F.col("from_ns").alias("_from"),
        F.col("to_ns").alias("_to"),
        F.explode(F.sequence(_bucket(F.col("from_ns"), width), _bucket(F.col("to_ns"), width))).alias("_bucket"),
    )
    # the left row travels as one struct, so that no column of it can clash with the index's
    rows = left.where(F.col(left_time).isNotNull()).select(
        F.struct("*").alias("_row"),
        *[F.col(k).alias(f"_l{i}") for i, k in enumerate(keys)],
        F.col(left_time).alias("_at"),
        _bucket(F.col(left_time), width).alias("_asked"),
    )
    same = [F.col(f"_l{i}") == F.col(f"_r{i}") for i in range(len(keys))] + [F.col("_asked") == F.col("_bucket")]
    joined = rows.join(index, [*same, F.col("_at").between(F.col("_from"), F.col("_to"))])
    kept = [F.col(f"_row.`{c}`") for c in left.columns if c != out]
    return joined.select(*kept, F.col("_value").alias(out))
