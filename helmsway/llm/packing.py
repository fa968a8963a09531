"""Filling containers of fixed capacity with items, with the sources mixed in target proportions.

Every source is a queue of items in a fixed pseudo-random order. Deficit round-robin serves the
queues: in each turn a queue's credit grows by its share, it sends items as long as its credit covers
them, and what is left over is carried on. An item is therefore sent in the first turn in which the
queue's whole credit covers all it has sent up to and with that item: at (tokens so far / share), a
prefix sum per queue, taken in chunks. A queue that has ended passes its turns to those that last, so
by turn v all queues together have sent the sum of min(tokens of the queue, share x v): again a prefix
sum, over the turns at which queues end. A window is filled when so many tokens have been sent; the
deficits are carried over windows and partitions alike, without a walk through the queues, and only
the last window is short.

The items of a window are then laid into containers, largest first, each into the fullest container
that still has room. Only an item above the capacity is split: into full containers and a rest.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import running
from helmsway.session import checkpointed

CAPACITY = 4096
#: Containers' worth of tokens in a window.
WINDOW = 512
#: Queue positions are hashes; their range is cut into so many chunks at least, of about so many items each.
LEAST_CHUNKS, CHUNK_ITEMS = 16, 20_000


def _fill(sizes: np.ndarray, capacity: int) -> tuple[list[int], list[int]]:
    """Container and place in it of each size (at most the capacity), best fit in decreasing order."""
    at, offset = [0] * len(sizes), [0] * len(sizes)
    room: list[tuple[int, int]] = []  # (free, container), ascending
    containers = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(room, (size, -1))
        if k < len(room):
            free, c = room.pop(k)
        else:
            free, c, containers = capacity, containers, containers + 1
        at[i], offset[i] = c, capacity - free
        if free > size:
            bisect.insort(room, (free - size, c))
    return at, offset


def _turns(value: Column) -> Column:
    return F.when(value.isNotNull(), F.least(value, F.lit(2.0**60))).cast("bigint")


def _shares(rows: DataFrame, proportions: dict[str, float] | None, power: float) -> DataFrame:
    """(``_of, _all, _late, _share, _ends``) of each source: its tokens, whether it is served after all others, its share, its last turn."""
    own = rows.groupBy(F.col("_source").alias("_of")).agg(F.sum("_size").cast("double").alias("_all")).withColumn("_weight", F.pow("_all", F.lit(power)))
    wanted = F.lit(None).cast("double")
    for name, share in (proportions or {}).items():
        wanted = F.when(F.col("_of").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(wanted)
    own = own.withColumn("_wanted", wanted)
    given = max(sum((proportions or {}).values()), 0.0)
    others = F.sum(F.when(F.col("_wanted").isNull(), F.col("_weight"))).over(Window.partitionBy())  # one row a source
    rest = F.lit(max(0.0, 1.0 - given)) * F.try_divide(F.col("_weight"), others)
    part = F.coalesce("_wanted", rest, F.lit(0.0))
    both = own.withColumn("_part", part).withColumn("_late", F.col("_part") <= 0)
    by = Window.partitionBy("_late")
    share = F.when(F.col("_late"), F.try_divide(F.col("_all"), F.sum("_all").over(by))).otherwise(F.try_divide(F.col("_part"), F.sum("_part").over(by)))
    return both.select("_of", "_all", "_late", share.alias("_share"), _turns(F.try_divide(F.col("_all"), share)).alias("_ends"))


def pack(
    items: DataFrame, item: str, source: str, size: str, capacity: int = CAPACITY, window: int = WINDOW, proportions: dict[str, float] | None = None, power: float = 1.0
) -> DataFrame:
    """(item, source, ``piece, piece_size, window_no, container_id, place``): where each item lies.

    ``piece`` counts the parts of an item from 0, ``place`` is where it begins in its container.
    ``proportions`` are targets by source; sources without one share what is left by size, or by size
    to the ``power`` (below 1 small sources come more often than their size alone would have them). A source's
    share goes to the others when it has ended. Sources for which nothing is left come after the last window of the
    others, by their own sizes. Items of size 0 or null lie in the first container of the window they fall
    into and take no room. A null source is a source of its own. Rows are items: repeated rows are
    packed as often as they occur. Empty input gives an empty result.
    """
    rows = checkpointed(items.select(F.col(item).alias("_item"), F.col(source).alias("_source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("_size")))
    count = rows.count()
    span = 2**63 // max(LEAST_CHUNKS, -(-count // CHUNK_ITEMS))
    room = float(window * capacity)
    shares = _shares(rows, proportions, power)
    queued = rows.withColumn("_order", F.shiftrightunsigned(F.xxhash64("_item", "_source"), 1))
    sent = running(queued, ["_source"], "_order", "_size", "_sent", span)
    turn = F.least(_turns(F.try_divide("_sent", "_share")), F.col("_ends"))
    served = sent.join(shares, F.col("_source").eqNullSafe(F.col("_of")), "left").withColumn("_turn", F.coalesce(turn, F.lit(0).cast("bigint")))
    served = served.select("_item", "_source", "_size", "_order", "_late", "_turn", F.lit(0.0).alias("_ended"), F.lit(0.0).alias("_passed"), F.lit(False).alias("_end"))
    if proportions or power != 1.0:  # else all queues end in the same turn
        ends = shares.where(F.col("_ends").isNotNull()).select("_late", F.col("_ends").alias("_turn"), F.col("_all").alias("_ended"), F.col("_share").alias("_passed"), F.lit(True).alias("_end"))
        served = served.unionByName(ends, allowMissingColumns=True)
        for value in ("_ended", "_passed"):
            served = running(served, ["_late"], "_turn", value, value + "_by", int(room) * 16, strict=True).drop(value).withColumnRenamed(value + "_by", value)
        served = served.where(~F.col("_end"))
    passed = F.coalesce(F.col("_ended"), F.lit(0.0)) + F.col("_turn") * (1 - F.coalesce(F.col("_passed"), F.lit(0.0)))
    served = served.withColumn("_window", F.greatest(F.ceil(passed / room - 1e-9).cast("bigint") - 1, F.lit(0)))
    if proportions:
        last = served.where(~F.col("_late")).agg(F.max("_window")).first()[0]
        served = served.withColumn("_window", F.col("_window") + F.when(F.col("_late"), F.lit(0 if last is None else last + 1)).otherwise(0))
    served = served.select("_item", "_source", "_size", "_window", "_order")

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_order", "_item", "_size"], na_position="first", kind="stable")
        sizes = pdf["_size"].to_numpy()
        full = sizes // capacity * (sizes > capacity)
        rest = sizes - full * capacity
        keep = np.flatnonzero(rest > 0)
        at, place = _fill(rest[keep], capacity)
        own = np.repeat(np.arange(len(pdf)), full)
        first = (max(at) + 1) if len(at) else 0
        row = np.r_[keep, own].astype(np.int64)
        out = pdf.iloc[row][["_item", "_source", "_window"]].copy()
        out["piece"] = np.r_[full[keep], np.arange(len(own)) - np.repeat(np.cumsum(full) - full, full)].astype(np.int32)
        out["piece_size"] = np.r_[rest[keep], np.full(len(own), capacity)].astype(np.int64)
        out["_no"] = np.r_[np.array(at, np.int64), first + np.arange(len(own))].astype(np.int64)
        out["place"] = np.r_[np.array(place, np.int64), np.zeros(len(own), np.int64)].astype(np.int64)
        return out

    kinds = dict(rows.dtypes)
    schema = f"_item {kinds['_item']}, _source {kinds['_source']}, _window bigint, piece int, piece_size bigint, _no bigint, place bigint"
    laid = served.where(F.col("_size") > 0).groupBy("_window").applyInPandas(lay, schema)
    zero = F.lit(0).cast("bigint")
    empty = served.where(F.col("_size") <= 0).select(
        "_item", "_source", "_window", F.lit(0).alias("piece"), zero.alias("piece_size"), zero.alias("_no"), zero.alias("place")
    )
    return laid.unionByName(empty).select(
        F.col("_item").alias(item),
        F.col("_source").alias(source),
        "piece",
        "piece_size",
        F.col("_window").alias("window_no"),
        (F.shiftleft("_window", 32) + F.col("_no")).alias("container_id"),
        "place",
    )


def windows(packed: DataFrame, source: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """(``window_no, containers, tokens, fill, share_error``) of each window.

    ``share_error`` is the largest distance of a source's share of the window's tokens from its
    share of all tokens.
    """
    packed = checkpointed(packed)
    every = int(packed.agg(F.sum("piece_size")).first()[0] or 0)
    by_source = packed.groupBy("window_no", source).agg(F.sum("piece_size").alias("_n"))
    overall = by_source.groupBy(F.col(source).alias("_of")).agg(F.sum("_n").alias("_all"))
    overall = overall.withColumn("_share", F.col("_all") / float(max(every, 1)))
    per = packed.groupBy("window_no").agg(F.count_distinct("container_id").alias("containers"), F.sum("piece_size").alias("tokens"))
    errors = (
        by_source.join(per.select("window_no", "tokens"), "window_no")
        .join(overall, F.col(source).eqNullSafe(F.col("_of")))
        .groupBy("window_no")
        .agg(F.max(F.abs(F.try_divide("_n", "tokens") - F.col("_share"))).alias("share_error"))
    )
    return per.join(errors, "window_no").select(
        "window_no", "containers", "tokens", (F.col("tokens") / (F.col("containers") * capacity)).alias("fill"), F.round("share_error", 6).alias("share_error")
    )


def faults(packed: DataFrame, items: DataFrame, item: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """One row: how many items there are, and how many break a rule of packing (all 0 if ``packed`` is right).

    ``lost``: the pieces aren't exactly the item; ``split``: split without need; ``overfull`` and
    ``overlapping``: containers above the capacity, or whose pieces lie on one another or leave room between.
    Items are counted by their key.
    """
    pieces = packed.groupBy(item).agg(F.sum("piece_size").alias("_packed"), F.count(F.lit(1)).alias("_pieces"), F.max("piece").alias("_last"))
    whole = items.groupBy(F.col(item).alias("_key")).agg(F.max(F.coalesce(F.col(size), F.lit(0))).alias("_size"))
    both = whole.join(pieces, F.col("_key").eqNullSafe(F.col(item)), "full")
    lost = ~((F.col("_packed") == F.col("_size")) & (F.col("_pieces") == F.col("_last") + 1))
    split = (F.col("_pieces") > 1) & (F.col("_size") <= capacity)
    by_item = both.agg(F.count("_size").alias("items"), F.count_if(F.coalesce(lost, F.lit(True))).alias("lost"), F.count_if(split).alias("split"))
    before = Window.partitionBy("container_id").orderBy("place", "piece_size").rowsBetween(Window.unboundedPreceding, -1)
    laid = packed.where(F.col("piece_size") > 0).withColumn("_before", F.coalesce(F.sum("piece_size").over(before), F.lit(0)))
    containers = laid.groupBy("container_id").agg(F.sum("piece_size").alias("_held"), F.max((F.col("place") != F.col("_before")).cast("int")).alias("_off"))
    by_container = containers.agg(F.count_if(F.col("_held") > capacity).alias("overfull"), F.count_if(F.col("_off") > 0).alias("overlapping"))
    both = by_item.unionByName(by_container, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("items", "lost", "split", "overfull", "overlapping")])
