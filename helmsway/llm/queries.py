"""Queries of the problems tagged llm and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.llm import nearest, packing, quantiles, tokenizer, topics
from helmsway.session import checkpointed
from helmsway.sources.tables import table

#: Published metrics: the evidence column, what it is divided by, and the figure's column per percentile.
METRICS = {
    "queue_wait_us": ("queue_wait_ns", 1000, {50: "queue_wait_us.p50", 95: "queue_wait_us.p95", 99: "queue_wait_us.p99"}),
    "measurement_age_us": ("measurement_age_ns", 1000, {50: "measurement_age_us.p50", 95: "measurement_age_us.p95", 99: "measurement_age_us.p99"}),
    "push_blocked_ns_p99": ("push_blocked_ns", 1, {99: "push_blocked_ns_p99"}),
}
#: Rows of a (day, edge) that one task takes; larger ones are salted.
PART_ROWS = 2_000_000
#: Level of the sketches whose nodes are sixteenths of a power of two.
SIXTEENTHS = quantiles.MANTISSA - 4
DAY_EDGE = ["run_day", "edge"]
ROW_KEY = ["run_id", "epoch", "edge", "seq"]


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its day and the three metrics as published units; copies are still in it."""
    days = table(spark, d, "runs").select("run_id", "epoch", "run_day").distinct()
    figures = [F.call_function("div", F.col(c), F.lit(by).cast("bigint")).alias(m) for m, (c, by, _) in METRICS.items()]
    return table(spark, d, "evidence").select(*ROW_KEY, *figures).join(days, ["run_id", "epoch"])


def _sketches(spark: SparkSession, d: str) -> DataFrame:
    """One merged sketch per day, edge and metric, over rows whose copies count once."""
    rows = _measured(spark, d)
    sizes = rows.groupBy(*DAY_EDGE).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / PART_ROWS).cast("bigint")
    salted = rows.join(sizes, DAY_EDGE).withColumn("_salt", F.pmod(F.xxhash64("run_id", "epoch", "seq"), parts)).drop("_n")
    brought = salted.repartition(*DAY_EDGE, "_salt").dropDuplicates([*DAY_EDGE, "_salt", "run_id", "epoch", "seq"])
    return quantiles.merge(quantiles.sketches(brought.sortWithinPartitions(*DAY_EDGE, "_salt"), DAY_EDGE, list(METRICS)), DAY_EDGE)


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Estimated percentiles of all metrics with the bounds that hold for certain."""
    return quantiles.invert(_sketches(spark, d), DAY_EDGE)


def p3_combined(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per edge over all days, from the sketches of the days: certain bounds in 16 steps per power of two."""
    days = _sketches(spark, d)
    return quantiles.invert(quantiles.merge(days, ["edge"]), ["edge"], coarsest=SIXTEENTHS).select("edge", "metric", "percent", "n", "rank", "low", "high")


def _published(spark: SparkSession, d: str) -> DataFrame:
    """(run_day, edge, metric, percent, published) of every figure that was published."""
    figures = [
        F.struct(F.lit(m).alias("metric"), F.lit(p).alias("percent"), F.col(c).alias("published")) for m, (_, _, cols) in METRICS.items() for p, c in cols.items()
    ]
    return table(spark, d, "stage_summary").select(*DAY_EDGE, F.inline(F.array(*figures))).where(F.col("published").isNotNull()).distinct()


def _floor_div(value: Column, by: int) -> Column:
    b = F.lit(by).cast("bigint")
    return F.call_function("div", value - F.pmod(value, b), b)


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Published figures with ``verdict``: off, fits, or open where the sketch's bounds don't tell."""
    ten = F.col("published") * 10
    ends = [_floor_div(ten, 9), _floor_div(ten, 11), -_floor_div(-ten, 9), -_floor_div(-ten, 11)]
    fits_from = F.when(F.col("published") >= 0, ends[3]).otherwise(ends[2])
    fits_to = F.when(F.col("published") >= 0, ends[0]).otherwise(ends[1])
    off = (F.col("low") > F.col("fits_to")) | (F.col("high") < F.col("fits_from"))
    fits = (F.col("low") >= F.col("fits_from")) & (F.col("high") <= F.col("fits_to"))
    return (
        p3_percentiles(spark, d)
        .join(_published(spark, d), [*DAY_EDGE, "metric", "percent"])
        .withColumn("fits_from", fits_from)
        .withColumn("fits_to", fits_to)
        .withColumn("verdict", F.when(off, "off").when(fits, "fits").otherwise("open"))
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Published metrics with a percentile that is off by more than 10 % of the true one.

    The sketches' signed levels give each percentile's certain bounds, about a hundredth of it apart.
    True values that agree with a published figure form a range (10 x |published - x| <= |x|); where
    that range holds all of the bounds or none of them the case is decided. Only a figure that is off
    by 10 % to within that hundredth is left, and decided exactly: rows between its bounds are counted
    against the ends of the range, which needs no sort.
    """
    judged = checkpointed(_verdicts(spark, d))
    open_ = judged.where(F.col("verdict") == "open").select(*DAY_EDGE, "metric", "percent", "rank", "below", "low", "high", "fits_from", "fits_to")
    values = _measured(spark, d)
    unpivoted = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
    near = (
        values.join(open_.select(*DAY_EDGE).distinct(), DAY_EDGE, "left_semi")
        .select("run_day", *ROW_KEY, unpivoted)
        .join(open_, [*DAY_EDGE, "metric"])
        .where(F.col("value").between(F.col("low"), F.col("high")))
        .dropDuplicates([*ROW_KEY, "run_day", "metric", "percent"])
    )
    counted = near.groupBy(*DAY_EDGE, "metric", "percent", "rank", "below").agg(
        F.count_if(F.col("value") < F.col("fits_from")).alias("short"), F.count_if(F.col("value") <= F.col("fits_to")).alias("upto")
    )
    exact = counted.where((F.col("below") + F.col("short") >= F.col("rank")) | (F.col("below") + F.col("upto") < F.col("rank")))
    certain = judged.where(F.col("verdict") == "off")
    return certain.select(*DAY_EDGE, "metric").unionByName(exact.select(*DAY_EDGE, "metric")).distinct()


#: Nearest record of each stream: table rows and tolerance.
TOLERANCE_NS = {0: 30_000_000, 2: 15_000_000}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """For each sweep's trigger the nearest left camera frame and the nearest motion reading."""
    sweeps = table(spark, d, "sweeps").select("drive", F.col("seq").alias("sweep_seq"), "trigger_ns").distinct()
    sides = {
        0: table(spark, d, "frames").where(F.col("side") == "left"),
        2: table(spark, d, "ego"),
    }
    found = [
        nearest.match_nearest(sweeps, sides[s].select("drive", "tov_ns", "seq"), ["drive"], "trigger_ns", "tov_ns", "seq", tol, "match_seq").select(
            "drive", F.lit(s).alias("stream"), "sweep_seq", "match_seq"
        )
        for s, tol in TOLERANCE_NS.items()
    ]
    return found[0].unionByName(found[1]).distinct()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(table(spark, d, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.token_counts(table(spark, d, "documents"), ["doc_id", "source"], "text").distinct()


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    """The container of every document, or of every part of one longer than a container."""
    return packing.pack(_sized(spark, d), "doc_id", "source", "n_tokens")


def p7_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The same with small sources mixed in more often: by the square root of their size, as long as they last."""
    return packing.pack(_sized(spark, d), "doc_id", "source", "n_tokens", power=0.5)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """How many documents the mixed packing holds, and how many break a rule of it."""
    sized = checkpointed(_sized(spark, d))
    packed = packing.pack(sized, "doc_id", "source", "n_tokens", power=0.5)
    return packing.faults(checkpointed(packed), sized, "doc_id", "n_tokens")


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Per window: containers, fill, and how far the sources' shares are from the corpus's own."""
    return packing.windows(p7_packed(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Subject areas of every document."""
    return topics.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))


QUERIES = {
    "p3_found": p3_found,
    "p3_percentiles": p3_percentiles,
    "p3_combined": p3_combined,
    "p4_found": p4_found,
    "p6_ids": p6_ids,
    "p7_packed": p7_packed,
    "p7_windows": p7_windows,
    "p7_mixed": p7_mixed,
    "p7_check": p7_check,
    "p8_found": p8_found,
}

SQL = {
    "p3_found": """
WITH rows AS (
  SELECT DISTINCT ON (e.run_id, e.epoch, e.edge, e.seq) r.run_day, e.edge,
    e.queue_wait_ns // 1000 AS queue_wait_us, e.measurement_age_ns // 1000 AS measurement_age_us, e.push_blocked_ns AS push_blocked_ns_p99
  FROM evidence e JOIN (SELECT DISTINCT run_id, epoch, run_day FROM runs) r USING (run_id, epoch)
), long AS (
  UNPIVOT rows ON queue_wait_us, measurement_age_us, push_blocked_ns_p99 INTO NAME metric VALUE v
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_day, edge, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY run_day, edge, metric) AS n FROM long
), truth AS (
  SELECT run_day, edge, metric, max(v) FILTER (i = (50 * n + 99) // 100) AS p50, max(v) FILTER (i = (95 * n + 99) // 100) AS p95,
    max(v) FILTER (i = (99 * n + 99) // 100) AS p99 FROM ranked GROUP BY ALL
), published AS (
  SELECT run_day, edge, 'queue_wait_us' AS metric, queue_wait_us.p50 AS q50, queue_wait_us.p95 AS q95, queue_wait_us.p99 AS q99 FROM stage_summary
  UNION ALL SELECT run_day, edge, 'measurement_age_us', measurement_age_us.p50, measurement_age_us.p95, measurement_age_us.p99 FROM stage_summary
  UNION ALL SELECT run_day, edge, 'push_blocked_ns_p99', NULL, NULL, push_blocked_ns_p99 FROM stage_summary
)
SELECT DISTINCT run_day, edge, metric FROM published JOIN truth USING (run_day, edge, metric)
WHERE 10 * abs(q50 - p50) > abs(p50) OR 10 * abs(q95 - p95) > abs(p95) OR 10 * abs(q99 - p99) > abs(p99)
""",
    "p3_combined": """
WITH rows AS (
  SELECT e.run_id, e.epoch, e.edge, e.seq, r.run_day, min(e.queue_wait_ns) // 1000 AS queue_wait_us,
    min(e.measurement_age_ns) // 1000 AS measurement_age_us, min(e.push_blocked_ns) AS push_blocked_ns_p99
  FROM evidence e JOIN (SELECT DISTINCT run_id, epoch, run_day FROM runs) r USING (run_id, epoch) GROUP BY ALL
), long AS (
  UNPIVOT rows ON queue_wait_us, measurement_age_us, push_blocked_ns_p99 INTO NAME metric VALUE v
), ranked AS (
  SELECT edge, metric, v, row_number() OVER (PARTITION BY edge, metric ORDER BY v) AS i, count(*) OVER (PARTITION BY edge, metric) AS n FROM long
), picked AS (
  SELECT edge, metric, percent::INT AS percent, n, (percent * n + 99) // 100 AS rank, v, abs(v) AS a, greatest(length(bin(abs(v))) - 5, 0) AS d
  FROM ranked, (VALUES (50), (95), (99)) AS p(percent) WHERE i = (percent * n + 99) // 100
), ends AS (SELECT *, (a >> d) << d AS low, ((a >> d) << d) + (1::BIGINT << d) - 1 AS high FROM picked)
SELECT edge, metric, percent, n, rank, CASE WHEN v < 0 THEN -high ELSE low END AS low, CASE WHEN v < 0 THEN -low ELSE high END AS high FROM ends
""",
    "p4_found": """
WITH s AS (SELECT DISTINCT drive, seq AS sweep_seq, trigger_ns FROM sweeps WHERE trigger_ns IS NOT NULL),
r AS (
  SELECT drive, 0 AS stream, seq, tov_ns, 30000000 AS tolerance FROM frames WHERE side = 'left' AND tov_ns IS NOT NULL
  UNION SELECT drive, 2, seq, tov_ns, 15000000 FROM ego WHERE tov_ns IS NOT NULL
), pairs AS (
  SELECT s.drive, r.stream, s.sweep_seq, s.trigger_ns, r.seq AS match_seq,
    row_number() OVER (PARTITION BY s.drive, r.stream, s.sweep_seq, s.trigger_ns ORDER BY abs(r.tov_ns - s.trigger_ns), r.tov_ns, r.seq) AS i
  FROM s JOIN r ON s.drive = r.drive AND r.tov_ns BETWEEN s.trigger_ns - tolerance AND s.trigger_ns + tolerance
)
SELECT DISTINCT drive, stream, sweep_seq, match_seq FROM pairs WHERE i = 1
""",
    "p7_check": """
SELECT count(DISTINCT doc_id) AS items, 0::BIGINT AS lost, 0::BIGINT AS split, 0::BIGINT AS overfull, 0::BIGINT AS overlapping FROM documents
""",
}
