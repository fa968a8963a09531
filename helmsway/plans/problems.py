"""Queries of the general problems: p1 late events, p2 implausible readings, p5 covered periods and holes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.operators import intervals, late_events
from helmsway.operators.readings import flag_readings
from helmsway.sources.tables import table

STREAM = ["run_id", "epoch", "stream"]
ORIGIN = ["origin", "entity", "epoch", "stream"]


def _fated(spark: SparkSession, d: str) -> DataFrame:
    evidence = table(spark, d, "evidence")
    samples = late_events.samples_of(evidence, STREAM, "seq", "tov_start_ns", "due_ns", "arrival_ns")
    return late_events.kslack(samples, STREAM)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Samples that correct a published second or come after the cut-off."""
    return _fated(spark, d).where(F.col("fate").isin("too_late", "corrects")).select(*STREAM, "seq", "fate")


def p1_periods(spark: SparkSession, d: str) -> DataFrame:
    """Per second of event time: as first published, corrected and closed."""
    return late_events.period_versions(_fated(spark, d), STREAM, "seq")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings of the vehicle's motion."""
    flags = flag_readings(table(spark, d, "ego"), "drive", "seq", "tov_ns", ["vf", "vl", "yaw_rate"])
    return flags.select("drive", "seq", "field_name")


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    sweeps = table(spark, d, "sweeps").select(
        F.lit("sweeps").alias("origin"),
        F.col("drive").alias("entity"),
        F.lit(0).cast("bigint").alias("epoch"),
        F.lit(1).alias("stream"),
        "tov_start_ns",
        "tov_end_ns",
    )
    samples = table(spark, d, "evidence").select(
        F.lit("evidence").alias("origin"), F.col("run_id").alias("entity"), "epoch", "stream", "tov_start_ns", "tov_end_ns"
    )
    return sweeps.unionByName(samples)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Holes between the covered periods of drives and of streams in runs."""
    swept = intervals.swept(_ranges(spark, d), ORIGIN, "tov_start_ns", "tov_end_ns")
    return intervals.gaps(swept, ORIGIN, longer_than=5_000_000, shorter_than=60_000_000_000)


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    """The continuous covered periods themselves."""
    swept = intervals.swept(_ranges(spark, d), ORIGIN, "tov_start_ns", "tov_end_ns")
    return intervals.covered(swept, ORIGIN).drop("max_active")


QUERIES = {"p1_found": p1_found, "p1_periods": p1_periods, "p2_found": p2_found, "p5_found": p5_found, "p5_periods": p5_periods}

_FATED = """
WITH samples AS (
  SELECT run_id, epoch, stream, seq, min(tov_start_ns) AS event_ns, min(due_ns) AS due_ns, min(arrival_ns) AS arrival_ns
  FROM evidence WHERE tov_start_ns <> 0 GROUP BY ALL
), fronts AS (
  SELECT *, event_ns // 1000000000 AS period,
    max(event_ns // 1000000000) OVER (PARTITION BY run_id, epoch, stream ORDER BY arrival_ns
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frontier
  FROM samples
), fated AS (
  SELECT *, CASE WHEN due_ns IS NOT NULL AND arrival_ns - due_ns > 2000000000 THEN 'too_late'
    WHEN frontier > period THEN 'corrects' ELSE 'in_time' END AS fate
  FROM fronts
)
"""

_RANGES = """
WITH ranges AS (
  SELECT 'sweeps' AS origin, drive AS entity, 0::BIGINT AS epoch, 1 AS stream, tov_start_ns AS s, tov_end_ns AS e FROM sweeps
  UNION ALL
  SELECT 'evidence', run_id, epoch, stream, tov_start_ns, tov_end_ns FROM evidence
), valid AS (
  SELECT DISTINCT * FROM ranges WHERE s <> 0 AND e <> 0 AND e > s
), reach AS (
  SELECT *, max(e) OVER (PARTITION BY origin, entity, epoch, stream ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM valid
)
"""

SQL = {
    "p1_found": _FATED + "SELECT run_id, epoch, stream, seq, fate FROM fated WHERE fate <> 'in_time'",
    "p1_periods": _FATED
    + """, steps AS (
  SELECT *, CASE WHEN fate <> 'too_late' THEN event_ns - lag(event_ns) OVER (
      PARTITION BY run_id, epoch, stream, period, fate <> 'too_late' ORDER BY event_ns, seq) END AS step
  FROM fated
)
SELECT run_id, epoch, stream, period,
  count(*) FILTER (fate = 'in_time') AS n_provisional,
  count(*) FILTER (fate = 'corrects') AS n_corrections,
  count(*) FILTER (fate <> 'too_late') AS n_final,
  count(*) FILTER (fate = 'too_late') AS n_too_late,
  min(event_ns) FILTER (fate <> 'too_late') AS first_event_ns,
  max(event_ns) FILTER (fate <> 'too_late') AS last_event_ns,
  max(step) AS max_step_ns,
  CASE WHEN count(due_ns) = count(*) THEN max(due_ns) + 2000000000 END AS closed_ns
FROM steps GROUP BY run_id, epoch, stream, period
""",
    "p5_found": _RANGES
    + """SELECT DISTINCT origin, entity, epoch, stream, before AS gap_start_ns, s AS gap_end_ns
FROM reach WHERE s - before > 5000000 AND s - before < 60000000000""",
    "p5_periods": _RANGES
    + """, numbered AS (
  SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (
    PARTITION BY origin, entity, epoch, stream ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n
  FROM reach
), periods AS (
  SELECT origin, entity, epoch, stream, n, min(s) AS start_ns, max(e) AS end_ns
  FROM numbered GROUP BY ALL
)
SELECT origin, entity, epoch, stream, start_ns, end_ns FROM periods""",
}
