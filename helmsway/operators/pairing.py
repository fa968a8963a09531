"""Pairing of streams by time and by number, with a reason for every element left without a partner.

Rows are never dropped: each pairing is a left join whose result names what became of the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import NS, floor_div


def pair_interval(spans: DataFrame, instants: DataFrame, key: str, wait: bool = True, stale_ns: int = 0, bucket_ns: int = NS) -> DataFrame:
    """Pairs each span with the first instant inside it: (key, seq, ``pair_seq, pair_ns, outcome``).

    ``spans`` has (key, seq, start_ns, end_ns, trigger_ns, arrival_ns), ``instants`` (key, seq, at_ns,
    arrival_ns), one row per element. ``outcome``:

    - ``paired``: start <= at < end, and the instant arrived by the deadline, the span's arrival plus
      its own length (without ``wait`` arrival is not looked at). The earliest such instant counts.
    - ``stale``: else the newest instant before the start, at most ``stale_ns`` before the trigger
      (which is held inside the span).
    - ``pair_late``: an instant lies inside but arrived after the deadline.
    - ``pair_dropped``: none lies inside, though a later one was seen.
    - ``pair_absent``: the key has no instants at all; ``pair_absent_in_source``: none lies inside and
      nothing later was seen.
    - ``no_span``: start, end or arrival is null, or the end isn't after the start.

    The join is an equality join on (key, bucket of time) with a range check.
    """
    valid = (F.col("end_ns") > F.col("start_ns")) & F.col("arrival_ns").isNotNull()
    trigger = F.least(F.greatest(F.coalesce("trigger_ns", "start_ns"), F.col("start_ns")), F.col("end_ns") - 1)
    s = spans.select(
        F.col(key).alias("_key"), F.col("seq").alias("_seq"), "start_ns", "end_ns", trigger.alias("_trigger"), F.col("arrival_ns").alias("_arrival"), F.coalesce(valid, F.lit(False)).alias("_valid")
    )
    reach = F.least(F.col("start_ns"), F.col("_trigger") - F.lit(stale_ns))
    buckets = F.when(F.col("_valid"), F.sequence(floor_div(reach, bucket_ns), floor_div(F.col("end_ns") - 1, bucket_ns)))
    i = instants.where(F.col("at_ns").isNotNull()).select(
        F.col(key).alias("_of"), F.col("seq").alias("pair_seq"), F.col("at_ns").alias("pair_ns"), F.col("arrival_ns").alias("_seen"), floor_div(F.col("at_ns"), bucket_ns).alias("_b")
    )
    asked = s.where(F.col("_valid")).withColumn("_bucket", F.explode(buckets))
    near = asked.join(i, (F.col("_key") == F.col("_of")) & (F.col("_bucket") == F.col("_b")) & F.col("pair_ns").between(reach, F.col("end_ns") - 1))
    inside = F.col("pair_ns") >= F.col("start_ns")
    on_time = F.lit(not wait) | (F.coalesce(F.col("_seen"), F.col("_arrival")) <= F.col("_arrival") + F.col("end_ns") - F.col("start_ns"))
    old = (F.col("pair_ns") < F.col("start_ns")) & (F.col("_trigger") - F.col("pair_ns") <= stale_ns) & F.lit(stale_ns > 0)
    pick = F.struct("pair_ns", "pair_seq")
    best = near.groupBy("_key", "_seq", "start_ns", "end_ns").agg(
        F.min(F.when(inside & on_time, pick)).alias("_paired"), F.max(F.when(old & on_time, pick)).alias("_old"), F.max(inside).alias("_inside")
    )
    last = i.groupBy("_of").agg(F.max("pair_ns").alias("_last"))
    joined = (
        s.alias("s")
        .join(best.alias("b"), (F.col("s._key") == F.col("b._key")) & (F.col("s._seq") == F.col("b._seq")) & (F.col("s.start_ns") == F.col("b.start_ns")) & (F.col("s.end_ns") == F.col("b.end_ns")), "left")
        .join(last, F.col("s._key") == F.col("_of"), "left")
    )
    outcome = (
        F.when(~F.col("_valid"), "no_span")
        .when(F.col("_paired").isNotNull(), "paired")
        .when(F.col("_old").isNotNull(), "stale")
        .when(F.col("_inside"), "pair_late")
        .when(F.col("_last").isNull(), "pair_absent")
        .when(F.col("_last") >= F.col("s.end_ns"), "pair_dropped")
        .otherwise("pair_absent_in_source")
    )
    chosen = F.when(F.col("_valid"), F.coalesce("_paired", "_old"))
    return joined.select(F.col("s._key").alias(key), F.col("s._seq").alias("seq"), chosen["pair_seq"].alias("pair_seq"), chosen["pair_ns"].alias("pair_ns"), outcome.alias("outcome"))


def pair_by_number(left: DataFrame, right: DataFrame, keys: list[str], seq: str, matched: str = "named", dropped: str = "dropped", late: str = "late", off: str = "off") -> DataFrame:
    """(keys, seq, ``outcome``) of each left number: same number on the right, or why there is none.

    ``off``: the right side has nothing of this key; ``dropped``: it has a later number, so this one
    won't come; ``late``: it has none later yet. Both sides count each number once.
    """
    a = left.where(F.col(seq).isNotNull()).select(*keys, seq).distinct()
    b = right.where(F.col(seq).isNotNull()).select(*keys, seq).distinct().withColumn("_there", F.lit(True))
    newest = b.groupBy(*keys).agg(F.max(seq).alias("_newest"))
    outcome = F.when(F.col("_there"), matched).when(F.col("_newest").isNull(), off).when(F.col("_newest") > F.col(seq), dropped).otherwise(late)
    return a.join(b, [*keys, seq], "left").join(newest, keys, "left").select(*keys, seq, outcome.alias("outcome"))


def asof_number(left: DataFrame, right: DataFrame, keys: list[str], seq: str, tolerance: int = 2) -> DataFrame:
    """(keys, seq, ``match_seq, outcome``): the newest right number at most ``tolerance`` below or equal.

    ``compensated`` on the same number, ``stale`` on an earlier one, ``missing`` without one,
    ``unavailable`` if the right side has nothing of the key. Each candidate number is a key of an
    equality join, so nothing is compared pairwise.
    """
    a = left.where(F.col(seq).isNotNull()).select(*keys, seq).distinct()
    b = right.where(F.col(seq).isNotNull()).select(*keys, F.col(seq).alias("match_seq")).distinct()
    asked = a.withColumn("match_seq", F.explode(F.sequence(F.col(seq) - tolerance, F.col(seq))))
    best = asked.join(b, [*keys, "match_seq"]).groupBy(*keys, seq).agg(F.max("match_seq").alias("match_seq"))
    there = b.select(*keys).distinct().withColumn("_there", F.lit(True))
    outcome = (
        F.when(F.col("match_seq") == F.col(seq), "compensated").when(F.col("match_seq").isNotNull(), "stale").when(F.col("_there"), "missing").otherwise("unavailable")
    )
    return a.join(best, [*keys, seq], "left").join(there, keys, "left").select(*keys, seq, "match_seq", outcome.alias("outcome"))


def asof_time(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, tolerance_ns: int, chunk_ns: int = 60 * NS) -> DataFrame:
    """Left rows with ``match_ns, match_value`` of the newest right row at or before ``at``, within the tolerance.

    Both sides lie in one ordered stream per key and chunk of time, in which the last right row is
    carried forward; right rows within the tolerance of a chunk's end stand in the next chunk too.
    Left rows without a time or match keep nulls.
    """
    t = F.col("_t")
    r = right.where(F.col(at).isNotNull()).groupBy(*keys, F.col(at).alias("_t")).agg(F.max(value).alias("_v"))
    homes = F.sequence(floor_div(t, chunk_ns), floor_div(t + F.lit(tolerance_ns), chunk_ns))
    r = r.select(*keys, "_t", F.struct("_t", "_v").alias("_r"), F.explode(homes).alias("_chunk"), F.lit(0).alias("_side"))
    rows = left.select(*keys, F.col(at).alias("_t"), F.struct("*").alias("_row"), floor_div(F.col(at), chunk_ns).alias("_chunk"), F.lit(1).alias("_side"))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(r, allowMissingColumns=True).withColumn("_hit", F.last("_r", ignorenulls=True).over(w)).where(F.col("_side") == 1)
    near = F.col("_hit._t") >= t - F.lit(tolerance_ns)
    kept = [F.col(f"_row.`{c}`") for c in left.columns if c not in ("match_ns", "match_value")]
    return both.select(*kept, F.when(near, F.col("_hit._t")).alias("match_ns"), F.when(near, F.col("_hit._v")).alias("match_value"))
