"""Overlapping and gapped intervals: a sweep line over boundary events.

Every interval [start, end) is a +1 at its start and a -1 at its end. The prefix sum of these events
in order of time is the number of open intervals: where it falls to 0 a covered period ends, and the
next event opens the next one. The sum is taken in chunks of time, so that an entity with a large
share of all rows is spread over tasks; per chunk one row carries the count so far and one the time
of the first event after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import NS, floor_div, running

CHUNK_NS = 600 * NS


def boundaries(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, ``at``, ``delta``): net change of the open count at each distinct boundary time.

    Rows where a bound is null or 0, or the end is not after the start, are no intervals.
    """
    valid = intervals.where((F.col(start) != 0) & (F.col(end) != 0) & (F.col(end) > F.col(start)))
    ends = F.array(
        F.struct(F.col(start).alias("at"), F.lit(1).cast("bigint").alias("delta")),
        F.struct(F.col(end).alias("at"), F.lit(-1).cast("bigint").alias("delta")),
    )
    return valid.select(*keys, F.inline(ends)).groupBy(*keys, "at").agg(F.sum("delta").alias("delta"))


def swept(intervals: DataFrame, keys: list[str], start: str, end: str, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """(keys, ``at``, ``active``, ``active_before``, ``next_at``) per distinct boundary time.

    ``active`` counts the intervals open from ``at`` on, ``next_at`` is the key's next boundary.
    Null keys are a key of their own.
    """
    events = boundaries(intervals, keys, start, end).withColumn("_part", floor_div(F.col("at"), chunk_ns))
    by_part = Window.partitionBy(*keys).orderBy("_part")
    parts = events.groupBy(*keys, "_part").agg(F.sum("delta").alias("delta"), F.min("at").alias("at"))
    edges = parts.select(
        *keys,
        "_part",
        F.coalesce(F.sum("delta").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_open"),
        F.lead("at").over(by_part).alias("_next"),
    ).select(
        *keys,
        "_part",
        F.inline(
            F.array(
                F.struct((F.col("_part") * F.lit(chunk_ns) - 1).alias("at"), F.col("_open").alias("delta")),
                F.struct(F.col("_next").alias("at"), F.lit(0).cast("bigint").alias("delta")),
            )
        ),
        F.lit(True).alias("_edge"),
    )
    rows = events.withColumn("_edge", F.lit(False)).unionByName(edges.where(F.col("at").isNotNull()))
    inside = Window.partitionBy(*keys, "_part").orderBy("at")
    active = F.sum("delta").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return (
        rows.withColumn("active", active)
        .withColumn("active_before", F.col("active") - F.col("delta"))
        .withColumn("next_at", F.lead("at").over(inside))
        .where(~F.col("_edge"))
        .select(*keys, "at", "active", "active_before", "next_at")
    )


def gaps(swept_rows: DataFrame, keys: list[str], longer_than: int = 0, shorter_than: int | None = None) -> DataFrame:
    """(keys, ``gap_start_ns``, ``gap_end_ns``): zero-count stretches between covered periods."""
    found = swept_rows.where((F.col("active") == 0) & F.col("next_at").isNotNull())
    length = F.col("next_at") - F.col("at")
    found = found.where(length > longer_than)
    if shorter_than is not None:
        found = found.where(length < shorter_than)
    return found.select(*keys, F.col("at").alias("gap_start_ns"), F.col("next_at").alias("gap_end_ns"))


def covered(swept_rows: DataFrame, keys: list[str], chunk_ns: int = CHUNK_NS) -> DataFrame:
    """(keys, ``start_ns``, ``end_ns``, ``max_active``): the continuous covered periods.

    A boundary where the count rises from 0 opens a period. Its number is the running count of
    openings, again scanned in chunks; the period is then the group of boundaries with that number,
    of which only the extremes and the maximum travel.
    """
    opened = swept_rows.withColumn("_opens", ((F.col("active_before") == 0) & (F.col("active") > 0)).cast("bigint"))
    told = running(opened, keys, "at", "_opens", "_period", chunk_ns)
    return (
        told.where((F.col("active") > 0) | (F.col("active_before") > 0))
        .groupBy(*keys, "_period")
        .agg(F.min("at").alias("start_ns"), F.max("at").alias("end_ns"), F.max("active").alias("max_active"))
        .drop("_period")
    )
