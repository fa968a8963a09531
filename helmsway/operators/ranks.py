"""Exact order statistics per group, without sorting a group in one task.

Equal values are counted first, on the map side already; ranks come from running counts taken in
chunks of the value axis, so a group with a large share of all rows is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import floor_div


def nearest_rank(percent: int) -> Column:
    """Rank of a percentile: ceil(percent * n / 100), at least 1."""
    return F.greatest(F.lit(1), F.call_function("div", F.col("n") * percent + 99, F.lit(100).cast("bigint")))


def upper_median_rank() -> Column:
    """Rank of the upper median, n div 2 + 1."""
    return F.call_function("div", F.col("n"), F.lit(2).cast("bigint")) + 1


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], chunk: int = 1 << 20) -> DataFrame:
    """(keys, ``n``, one column per rank): the values of a BIGINT column at the given ranks.

    Ranks are columns of ``n``, the number of values; a rank beyond n gives null. Nulls are left out;
    groups without values give no row; null keys are a group. Only the chunks of the value axis that
    hold a wanted rank are looked at value by value.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    given = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("bigint").alias("_v"))
    counted = given.groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_part", floor_div(F.col("_v"), chunk))
    by_part = Window.partitionBy(*names).orderBy("_part")
    parts = (
        counted.groupBy(*names, "_part").agg(F.sum("_c").alias("_t"))
        .withColumn("_upto", F.sum("_t").over(by_part.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("_t").over(Window.partitionBy(*names)))
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank")) for name, rank in ranks.items()])
    targets = (
        parts.select(*[F.col(k).alias(f"_t{k}") for k in names], F.col("_part").alias("_tpart"), "n", (F.col("_upto") - F.col("_t")).alias("_before"), "_upto", F.inline(wanted))
        .where((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_upto")))
        .drop("_upto")
    )
    on = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in names] + [F.col("_part") == F.col("_tpart")]
    inside = Window.partitionBy(*names, "name").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.join(targets, on).withColumn("_at", F.col("_before") + F.sum("_c").over(inside))
    found = placed.where((F.col("_at") >= F.col("rank")) & (F.col("_at") - F.col("_c") < F.col("rank")))
    picks = [F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks]
    return found.groupBy(*names, "n").agg(*picks).select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "n", *ranks)
