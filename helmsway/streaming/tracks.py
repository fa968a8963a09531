"""Streaming forms of the tracker and of pairing by number, and replay of a table as a stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helmsway.operators.tracker import TRACK_COLUMNS, Tracks, step
from helmsway.session import checkpointed


def follow_stream(dets: DataFrame, drive: str, seq: str, at_ns: str, idx: str) -> DataFrame:
    """The tracker over a stream: (drive, seq, track columns). A drive's sweeps must come whole and in order.

    State per drive is its live tracks, a bounded number.
    """
    kinds = dict(dets.dtypes)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracks = pickle.loads(state.get[0]) if state.exists else Tracks()
        rows = pd.concat(list(frames)).sort_values([seq, idx])
        for n, part in rows.groupby(seq, sort=True):
            found = part[part[idx].notna()]
            if tracks.seq is None or int(n) != tracks.seq + 1:
                tracks = Tracks()  # ids are numbered within an unbroken stretch
            told = pd.DataFrame(step(tracks, int(n), int(part[at_ns].iloc[0]), found[["x", "y", "z"]].to_numpy(np.float64), None))
            told.insert(0, seq, int(n))
            told.insert(0, drive, key[0])
            yield told
        state.update((pickle.dumps(tracks),))

    schema = f"`{drive}` {kinds[drive]}, `{seq}` {kinds[seq]}, {TRACK_COLUMNS}"
    return dets.groupBy(drive).applyInPandasWithState(run, schema, "tracks binary", "append", GroupStateTimeout.NoTimeout)


def pair_stream(left: DataFrame, right: DataFrame, keys: list[str], at: str, wait: str) -> DataFrame:
    """Stream-stream left join on equal keys: left rows with ``right_at``, null once ``wait`` has passed without a partner.

    ``at`` is a TIMESTAMP of both sides. A right row counts if it is at most ``wait`` later than the left.
    """
    a = left.withWatermark(at, wait).select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col(at).alias("left_at"))
    b = right.withWatermark(at, wait).select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col(at).alias("right_at"))
    on = [F.col(f"l_{k}") == F.col(f"r_{k}") for k in keys]
    window = (F.col("right_at") >= F.col("left_at") - F.expr(f"INTERVAL {wait}")) & (F.col("right_at") <= F.col("left_at") + F.expr(f"INTERVAL {wait}"))
    joined = a.join(b, [*on, window], "leftOuter")
    return joined.select(*[F.col(f"l_{k}").alias(k) for k in keys], "left_at", "right_at")


def write_replay(df: DataFrame, folder: str, order: str, parts: int) -> None:
    """Lays a table out in files that a file stream, one file a trigger, replays in order of ``order``.

    A file stream takes files by age, so range partitions are written one after the other.
    """
    ranged = checkpointed(df.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()))
    for part in range(parts):
        ranged.where(F.col("_part") == part).drop("_part").sort(order).coalesce(1).write.mode("append").parquet(folder)


def read_replay(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """The stream of such a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
