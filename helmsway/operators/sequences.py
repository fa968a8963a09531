"""Numbered streams: neighbours, gaps, dense slots, deadlines of absent slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import NS, fresh, in_blocks, running

#: Numbers that are made from a piece of a run at a time.
PIECE = 2**16

#: Pieces of a run for each task, at most.
SHARES = 16


def with_previous(df: DataFrame, keys: list[str], order: str, out: str, chunk: int) -> DataFrame:
    """Adds the largest ``order`` of the key below this row's; null for the first. Equal rows see the same."""
    copy = f"_{out}_of"
    return running(df.withColumn(copy, F.col(order)), keys, order, copy, out, chunk, how="max", strict=True).drop(copy)


def with_next(df: DataFrame, keys: list[str], order: str, out: str, chunk: int) -> DataFrame:
    """Adds the smallest ``order`` of the key above this row's; null for the last."""
    back = f"_{out}_back"
    return with_previous(df.withColumn(back, -F.col(order)), keys, back, out, chunk).withColumn(out, -F.col(out)).drop(back)


def absent_ranges(df: DataFrame, keys: list[str], seq: str, chunk: int = 100_000) -> DataFrame:
    """(keys, ``first_absent, last_absent, n_absent``): runs of numbers missing between 0 and the largest.

    Numbers are counted from 0, so numbers missing at the start form a run too. Repeated rows and null
    numbers are ignored.
    """
    seen = df.where(F.col(seq) >= 0).select(*keys, seq).distinct()
    back = with_previous(seen, keys, seq, "_prev", chunk).withColumn("_prev", F.coalesce("_prev", F.lit(-1)))
    return back.where(F.col(seq) - F.col("_prev") > 1).select(
        *keys, (F.col("_prev") + 1).alias("first_absent"), (F.col(seq) - 1).alias("last_absent"), (F.col(seq) - F.col("_prev") - 1).alias("n_absent")
    )


def absent_slots(df: DataFrame, keys: list[str], seq: str, chunk: int = 100_000) -> DataFrame:
    """(keys, seq) of every missing number between 0 and the largest: the dense slots less the present."""
    runs = absent_ranges(df, keys, seq, chunk)
    return runs.select(*keys, F.explode(F.sequence("first_absent", "last_absent")).alias(seq))


def slot_deadlines(df: DataFrame, keys: list[str], seq: str, due: str, period_ns: Column, chunk: int = 100_000) -> DataFrame:
    """(keys, seq, ``deadline_ns``) of absent slots, between the deadlines of the present neighbours.

    Linear by number with integer division; before the first present number it goes back from there
    by the period. Of several rows of a number the earliest deadline counts; rows without one are
    absent. ``period_ns`` is an expression on the keys.
    """
    known = df.where(F.col(due).isNotNull() & (F.col(seq) >= 0)).groupBy(*keys, seq).agg(F.min(due).alias("_due"))
    pairs = running(known.withColumn("_pair", F.struct(F.col(seq), F.col("_due"))), keys, seq, "_pair", "_prev", chunk, how="max", strict=True)
    low = F.when(F.col("_prev").isNotNull(), F.struct(F.col(f"_prev.{seq}").alias("no"), F.col("_prev._due").alias("due")))
    runs = pairs.select(
        *keys, low.alias("_a"), F.struct(F.col(seq).alias("no"), F.col("_due").alias("due")).alias("_b"), (F.coalesce(F.col(f"_prev.{seq}"), F.lit(-1)) + 1).alias("_low"), (F.col(seq) - 1).alias("_high")
    )
    return each_number(runs, "_low", "_high", seq).select(*keys, seq, deadline(F.col(seq), "_a", "_b", period_ns).alias("deadline_ns"))


def each_number(runs: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """Each row once for every number from ``low`` to ``high``, which ``out`` replaces; none where ``high`` is below ``low``.

    A run is cut into pieces, which are shared out to all tasks, and these into smaller ones, down to PIECE numbers, so that
    no array is long however long the run, and what a task holds or shuffles doesn't grow with it: rows that a chain of
    explodes makes of one row are all kept by generated code, so a coalesce, which has none, parts each from the next.
    """
    tasks = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = shared_out(runs.where(F.col(low) <= F.col(high)), low, high, tasks)
    for step in (PIECE**3, PIECE**2, PIECE):
        cut = cut.withColumn(low, F.explode(F.sequence(low, high, F.lit(step).cast("bigint"))))
        cut = cut.withColumn(high, F.when(F.col(high) - F.col(low) >= step, F.col(low) + F.lit(step - 1)).otherwise(F.col(high))).coalesce(tasks)
    return cut.withColumn(out, F.explode(F.sequence(low, high))).drop(low, high)


def shared_out(runs: DataFrame, low: str, high: str, tasks: int) -> DataFrame:
    """Runs cut into pieces of PIECE numbers, or longer ones, so that a run has at most SHARES for each of the tasks, to which they go."""
    step = fresh("_step", runs)
    length = F.greatest(F.lit(PIECE).cast("bigint"), F.call_function("div", F.col(high) - F.col(low), F.lit(SHARES * tasks).cast("bigint")) + 1)
    cut = runs.withColumn(step, length).withColumn(low, F.explode(F.sequence(low, high, step)))
    cut = cut.withColumn(high, F.when(F.col(high) - F.col(low) >= F.col(step), F.col(low) + F.col(step) - 1).otherwise(F.col(high)))
    return cut.drop(step).repartition(tasks, low, high)


def deadline(no: Column, a: str, b: str, period: Column) -> Column:
    """Due time of slot ``no`` between the known slots ``a`` and ``b``, structs of (no, due): linear with integer division, or by the period from the only one.

    The product of a due time and a number may exceed a BIGINT: so the quotient is taken before the product, and
    between slots too far apart for that also, decimals count. A time by the period that is no BIGINT is null.
    """
    span, steps, at = F.col(f"{b}.due") - F.col(f"{a}.due"), F.col(f"{b}.no") - F.col(f"{a}.no"), no - F.col(f"{a}.no")
    near = F.call_function("div", span, steps) * at + F.call_function("div", span % steps * at, steps)
    far = F.call_function("div", span.cast("decimal(19,0)") * at.cast("decimal(19,0)"), steps.cast("decimal(19,0)"))
    inside = F.col(f"{a}.due") + F.when(steps < 2**31, near).otherwise(far)
    after = F.try_add(F.col(f"{a}.due"), F.try_multiply(at, period))
    before = F.try_subtract(F.col(f"{b}.due"), F.try_multiply(F.col(f"{b}.no") - no, period))
    return F.coalesce(inside, after, before)


def _known(df: DataFrame, keys: list[str], seq: str, due: str) -> DataFrame:
    """(keys, seq, ``_known``): a key's numbers, once each, with (no, due) where there is a due time."""
    own = df.where(F.col(seq) >= 0).groupBy(*keys, seq).agg(F.min(due).alias(due))
    return own.select(*keys, seq, F.when(F.col(due).isNotNull(), F.struct(F.col(seq).alias("no"), F.col(due).alias("due"))).alias("_known"))


def _between(own: DataFrame, keys: list[str], seq: str, chunk: int) -> DataFrame:
    """Adds ``_a``, the last known slot below, and ``_b``, the first known one from there on."""
    rows = running(own.withColumn("_back", -F.col(seq)), keys, seq, "_known", "_a", chunk, how="max", strict=True)
    return running(rows, keys, "_back", "_known", "_b", chunk, how="min").drop("_back", "_known")


def present_slots(df: DataFrame, keys: list[str], seq: str, due: str, periods: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(keys, seq, due) of the slots of ``all_slots`` that are present; absent ones are not made for it."""
    rows = _between(_known(df, keys, seq, due), keys, seq, chunk).join(periods, keys, "left")
    return rows.select(*keys, seq, deadline(F.col(seq), "_a", "_b", F.col("period_ns")).alias(due))


def all_slots(df: DataFrame, keys: list[str], seq: str, due: str, periods: DataFrame, chunk: int = 100_000, others: DataFrame | None = None) -> DataFrame:
    """(keys, seq, due, ``present``) of every slot from 0 to the key's largest number, or that of its ``others`` (keys, seq).

    A slot is present if it has a row, with or without a due time. Of several rows of a number the
    earliest due time counts; a slot without one gets its deadline as in ``slot_deadlines``, and behind the
    last known one by the period. ``periods`` has (keys, ``period_ns``). A key without any due time has nulls.
    """
    own = _known(df, keys, seq, due)
    rows = with_previous(_between(own, keys, seq, chunk), keys, seq, "_prev", chunk)
    runs = rows.select(*keys, "_a", "_b", (F.coalesce("_prev", F.lit(-1)) + 1).alias("_low"), F.col(seq).alias("_high"), F.col(seq).alias("_own"))
    if others is not None:
        ends = own.groupBy(*keys).agg(F.max("_known").alias("_a"), (F.max(seq) + 1).alias("_low"))
        longest = others.groupBy(*keys).agg(F.max(seq).alias("_high"))
        runs = runs.unionByName(ends.join(longest, keys), allowMissingColumns=True)
    slots = each_number(runs.join(periods, keys, "left"), "_low", "_high", seq)
    return slots.select(*keys, seq, deadline(F.col(seq), "_a", "_b", F.col("period_ns")).alias(due), F.coalesce(F.col(seq) == F.col("_own"), F.lit(False)).alias("present"))


def held_worst(df: DataFrame, keys: list[str], order: str, severity: str, hold: int, worst: int = 2, chunk: int = 100_000) -> DataFrame:
    """Adds ``held``, the state of a lane that holds its worst event, and ``was``, the row before's (null on a key's first row).

    An event (severity 1 to ``worst``; 0 or null is none) as bad as the state or worse sets it and is its
    anchor. The row ``hold`` rows after the last anchor steps the state down to the worst lesser event
    since, which is a new anchor, so that the count starts again; without one the state is 0.

    What holds at a row so depends on at most ``hold`` x ``worst`` rows before it: level by level from the
    worst down, a level's anchors and what they cover follow from windows of ``hold`` rows, in blocks.
    """
    rows = in_blocks(df.withColumn("_sev", F.coalesce(F.col(severity), F.lit(0))), keys, order, [], hold * worst + 1, chunk)
    w = Window.partitionBy(*keys, "_block").orderBy("_no")
    lately, until = w.rowsBetween(-(hold - 1), 0), w.rowsBetween(-hold, -hold)
    rows = rows.withColumn("held", F.lit(0)).withColumn("_covered", F.lit(False)).withColumn("_down", F.lit(0))
    for level in range(worst, 0, -1):
        anchor = ~F.col("_covered") & ((F.col("_sev") == level) | (F.col("_down") == level))
        rows = rows.withColumn("_anchor", anchor.cast("int"))
        rows = rows.withColumn("_near", F.max("_anchor").over(lately) == 1).withColumn("_ended", F.coalesce(F.max("_anchor").over(until) == 1, F.lit(False)))
        lesser = F.max(F.when(F.col("_sev") < level, F.col("_sev")).otherwise(0)).over(lately)
        steps = F.col("_ended") & ~F.col("_near") & ~F.col("_covered")
        rows = rows.withColumn("_down", F.when(steps, lesser).otherwise(F.col("_down")))
        rows = rows.withColumn("held", F.when(~F.col("_covered") & F.col("_near"), level).otherwise(F.col("held")))
        rows = rows.withColumn("_covered", F.col("_covered") | F.col("_near"))
    was = F.lag("held").over(w)
    return rows.withColumn("was", was).where("_home").drop("_no", "_block", "_home", "_sev", "_covered", "_down", "_anchor", "_near", "_ended")


def absent_between(gaps: DataFrame, ranges: DataFrame, keys: list[str], low: str, high: str, out: str, chunk: int = 100_000) -> DataFrame:
    """Adds how many absent numbers of the key lie between ``low`` and ``high`` of each row (distinct), from ``absent_ranges``.

    Absent numbers up to some number are those of all ranges that begin by then, less what of the last
    one lies beyond: two running figures over the ranges, looked up at both ends of a gap.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    same = [F.col(k).alias(n) for k, n in zip(keys, names)]
    ends = F.inline(F.array(F.struct((F.col(high) - 1).alias("_at"), F.lit(1).alias("_sign")), F.struct(F.col(low).alias("_at"), F.lit(-1).alias("_sign"))))
    asked = gaps.withColumn("_row", F.struct(*[F.col(c) for c in gaps.columns])).select(*same, "_row", ends)
    known = ranges.select(*same, F.col("first_absent").alias("_at"), F.col("n_absent").alias("_n"), F.col("last_absent").alias("_last"))
    both = asked.unionByName(known, allowMissingColumns=True)
    both = running(running(both, names, "_at", "_n", "_sum", chunk), names, "_at", "_last", "_most", chunk, how="max").where(F.col("_row").isNotNull())
    upto = F.coalesce(F.col("_sum") - F.greatest(F.col("_most") - F.col("_at"), F.lit(0)), F.lit(0))
    return both.groupBy("_row").agg(F.sum(upto * F.col("_sign")).alias(out)).select("_row.*", out)


def in_order(df: DataFrame, keys: list[str], time: str, ties: list[str], chunk_ns: int = 60 * NS) -> DataFrame:
    """Adds ``no``, the row's number from 0 in its key by (``time``, ``ties``), and ``before``, the time of the row before it."""
    rows = in_blocks(df, keys, time, ties, 1, chunk_ns)
    before = F.lag(time).over(Window.partitionBy(*keys, "_block").orderBy("_no"))
    return rows.withColumn("before", before).where("_home").withColumnRenamed("_no", "no").drop("_block", "_home")


def quiet_streaks(df: DataFrame, keys: list[str], order: str, heard: Column, chunk: int, out: str = "misses") -> DataFrame:
    """Adds how many rows in a row, up to this one, were not ``heard``; 0 where it was. ``order`` is unique per key."""
    flagged = df.withColumn("_one", F.lit(1).cast("bigint")).withColumn("_at", F.when(heard, F.col(order)))
    numbered = running(flagged, keys, order, "_one", "_n", chunk)
    numbered = numbered.withColumn("_n_heard", F.when(heard, F.col("_n")))
    last = running(numbered, keys, order, "_n_heard", "_last", chunk, how="max")
    return last.withColumn(out, F.col("_n") - F.coalesce("_last", F.lit(0))).drop("_one", "_at", "_n", "_n_heard", "_last")


def frame_ranges(df: DataFrame, keys: list[str], first: str, last: str, out: str = "ranges") -> DataFrame:
    """(keys, text like "3-5, 9") of runs of numbers, in order."""
    runs = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(first).alias("a"), F.col(last).alias("b")))).alias("_runs"))
    text = F.transform("_runs", lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat_ws("-", r["a"], r["b"])))
    return runs.select(*keys, F.array_join(text, ", ").alias(out))

