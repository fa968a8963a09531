"""Late and out-of-order events: K-slack reordering with provisional and corrected period figures.

A sample waits in the reorder buffer until its lateness bound (``due`` + K) has passed; then all
samples of its period that are in the buffer are released in order of event time to the final,
order-sensitive aggregation. Meanwhile the buffer publishes: as soon as a sample of a later period
arrives, the period gets a provisional value, and each sample that still comes in within its bound
corrects it. A sample after its bound finds the buffer released and is refused as too late.

In batch the buffer is not simulated row by row. A sample's release time and the frontier it met on
arrival (the latest period that had arrived strictly before) follow from running aggregates by
arrival, so one scan gives every sample's fate and hot keys are cut into chunks of arrival time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helmsway.operators.scan import NS, floor_div, running

SLACK_NS = 2 * NS
PERIOD_NS = NS
CHUNK_NS = 60 * NS


def samples_of(rows: DataFrame, keys: list[str], seq: str, event: str, due: str, arrival: str) -> DataFrame:
    """One row per (keys, seq) of rows that have an event time: copies and edges merged.

    The sample arrives with the first of its rows; event time and due time are the smallest given
    ones. Event time null or 0 means that there was no sample.
    """
    return (
        rows.where(F.col(event).isNotNull() & (F.col(event) != 0))
        .groupBy(*keys, seq)
        .agg(F.min(event).alias("event_ns"), F.min(due).alias("due_ns"), F.min(arrival).alias("arrival_ns"))
    )


def kslack(samples: DataFrame, keys: list[str], slack_ns: int = SLACK_NS, period_ns: int = PERIOD_NS, chunk_ns: int = CHUNK_NS) -> DataFrame:
    """Adds ``period, release_ns, frontier, fate`` to samples (``event_ns, due_ns, arrival_ns``).

    - ``period``: floor(event_ns / period_ns).
    - ``release_ns``: when the buffer hands the sample on, due + K; null where due is unknown (the
      sample then waits for the end of its input).
    - ``frontier``: the latest period of the key that arrived strictly earlier, whatever its fate;
      null for the first arrivals.
    - ``fate``: ``too_late`` if arrival > release_ns, else ``corrects`` if frontier > period, else
      ``in_time``. Samples that have no arrival time have no fate (null) and move no frontier.

    Samples that arrive at the same instant do not see one another. Empty input gives empty output.
    Other columns of ``samples`` are kept, but those named as an added column are replaced.
    """
    rows = (
        samples.drop("period", "release_ns", "frontier", "fate")
        .withColumn("period", floor_div(F.col("event_ns"), period_ns))
        .withColumn("release_ns", F.col("due_ns") + F.lit(slack_ns))
    )
    rows = running(rows, keys, "arrival_ns", "period", "frontier", chunk_ns, how="max", strict=True)
    fate = (
        F.when(F.col("arrival_ns").isNull(), F.lit(None).cast("string"))
        .when(F.col("release_ns").isNotNull() & (F.col("arrival_ns") > F.col("release_ns")), "too_late")
        .when(F.col("frontier") > F.col("period"), "corrects")
        .otherwise("in_time")
    )
    return rows.withColumn("fate", fate)


def period_versions(fated: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Figures of every period as published and as closed.

    One row per (keys, period): ``n_provisional`` samples known when it was first published,
    ``n_corrections`` that came in later but within their bound, ``n_final`` of both, ``n_too_late``
    refused; the first and last event time and ``max_step_ns``, the longest step between neighbours
    in event-time order (final, released order); ``closed_ns``, when the last sample's bound passes
    (null when a due time is unknown). Equal event times step by 0. Periods of only refused samples
    are listed with n_final 0. A window never holds more than one period of one key.
    """
    kept = F.col("fate") != "too_late"
    by_event = Window.partitionBy(*keys, "period", kept).orderBy("event_ns", seq)
    stepped = fated.where(F.col("fate").isNotNull()).withColumn("_step", F.when(kept, F.col("event_ns") - F.lag("event_ns").over(by_event)))
    return stepped.groupBy(*keys, "period").agg(
        F.count_if(F.col("fate") == "in_time").alias("n_provisional"),
        F.count_if(F.col("fate") == "corrects").alias("n_corrections"),
        F.count_if(kept).alias("n_final"),
        F.count_if(~kept).alias("n_too_late"),
        F.min(F.when(kept, F.col("event_ns"))).alias("first_event_ns"),
        F.max(F.when(kept, F.col("event_ns"))).alias("last_event_ns"),
        F.max("_step").alias("max_step_ns"),
        F.when(F.count("release_ns") == F.count(F.lit(1)), F.max("release_ns")).alias("closed_ns"),
    )
