"""Queries on recorded drives: pairing, sequences, slots, motion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helmsway.functions import geometry as g
from helmsway.operators import pairing, ranks, sequences
from helmsway.operators.scan import NS, running
from helmsway.sources.tables import table

CHUNK = 100_000
PERIOD_NS = 103_000_000
STALE_NS = 120_000_000


def sweeps(spark: SparkSession, d: str) -> DataFrame:
    """One row per sweep: copies differ in due and arrival, of which the earliest counts."""
    return (
        table(spark, d, "sweeps")
        .groupBy("drive", "seq")
        .agg(*[F.min(c).alias(c) for c in ("tov_start_ns", "tov_end_ns", "trigger_ns", "due_ns", "arrival_ns")])
    )


def left_frames(spark: SparkSession, d: str) -> DataFrame:
    """Distinct left frames, each with its earliest arrival."""
    frames = table(spark, d, "frames").where(F.col("side") == "left")
    return frames.groupBy("drive", "seq", F.col("tov_ns").alias("at_ns")).agg(F.min("arrival_ns").alias("arrival_ns"))


def _pair(spark: SparkSession, d: str, wait: bool, stale_ns: int) -> DataFrame:
    spans = sweeps(spark, d).select("drive", "seq", F.col("tov_start_ns").alias("start_ns"), F.col("tov_end_ns").alias("end_ns"), "trigger_ns", "arrival_ns")
    return pairing.pair_interval(spans, left_frames(spark, d), "drive", wait=wait, stale_ns=stale_ns)


def pair_interval(spark: SparkSession, d: str) -> DataFrame:
    """Each sweep's first left frame inside it, that arrived by the deadline, or the reason."""
    return _pair(spark, d, wait=True, stale_ns=0)


def pair_stale(spark: SparkSession, d: str) -> DataFrame:
    """J1 with the stale fallback: an older frame within 120 ms of the trigger."""
    return _pair(spark, d, wait=True, stale_ns=STALE_NS)


def pair_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Pairing outcomes by drive, in all, and by outcome alone."""
    paired = _pair(spark, d, wait=True, stale_ns=0)
    tall = paired.groupingSets([["drive", "outcome"], ["outcome"], []], "drive", "outcome")
    return tall.agg(F.count(F.lit(1)).alias("n"))


def pair_by_seq(spark: SparkSession, d: str) -> DataFrame:
    """Reduced clouds by number with the detector's, per run and epoch."""
    e = table(spark, d, "evidence")
    keys = ["run_id", "epoch"]
    reduce = e.where(F.col("edge") == "det->detect").select(*keys, "seq")
    boxes = e.where((F.col("edge") == "pillar_det->track") & (F.col("outcome") == "Delivered")).select(*keys, "seq")
    return pairing.pair_by_number(reduce, boxes, keys, "seq", dropped="lidar_dropped", late="lidar_late", off="lidar_off")


def asof_seq(spark: SparkSession, d: str) -> DataFrame:
    """Sweep numbers with the newest frame number at most two below."""
    return pairing.asof_number(table(spark, d, "sweeps"), table(spark, d, "frames").where(F.col("side") == "right"), ["drive"], "seq")


def asof_time(spark: SparkSession, d: str) -> DataFrame:
    """As-of join in time: each sweep start with the last motion reading at most 60 ms before."""
    ego = table(spark, d, "ego").select("drive", F.col("tov_ns").alias("at"), F.col("seq").alias("ego_seq"))
    left = sweeps(spark, d).select("drive", "seq", F.col("tov_start_ns").alias("at"))
    return pairing.asof_time(left, ego, ["drive"], "at", "ego_seq", 60_000_000).select("drive", "seq", "match_ns", F.col("match_value").alias("ego_seq"))


def seq_gap(spark: SparkSession, d: str) -> DataFrame:
    """Step of the sample number on each edge of an epoch; null for the first."""
    keys = ["run_id", "epoch", "edge"]
    rows = table(spark, d, "evidence").select(*keys, "seq").distinct()
    return sequences.with_previous(rows, keys, "seq", "prev", CHUNK).select(*keys, "seq", (F.col("seq") - F.col("prev")).alias("seq_gap"))


def net_seq_gap(spark: SparkSession, d: str) -> DataFrame:
    """Sweep number steps over 1 on the reducing edge, less the numbers that the drive itself lacks."""
    keys = ["run_id", "epoch", "drive"]
    drives = table(spark, d, "runs").select("run_id", "epoch", "drive").distinct()
    rows = table(spark, d, "evidence").where(F.col("edge") == "velo->reduce").select("run_id", "epoch", "seq").distinct().join(drives, ["run_id", "epoch"])
    steps = sequences.with_previous(rows, keys, "seq", "prev", CHUNK).where(F.col("seq") - F.col("prev") > 1)
    between = sequences.absent_between(steps, sequences.absent_ranges(table(spark, d, "sweeps"), ["drive"], "seq", CHUNK), ["drive"], "prev", "seq", "n_absent")
    gap = F.col("seq") - F.col("prev")
    return between.select("run_id", "epoch", "seq", gap.alias("seq_gap"), (gap - F.col("n_absent")).alias("net_gap"))


def absent_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Runs of sweep numbers that a drive lacks."""
    return sequences.absent_ranges(table(spark, d, "sweeps"), ["drive"], "seq", CHUNK)


def absent_phrases(spark: SparkSession, d: str) -> DataFrame:
    """The same as text, "3-5, 9"."""
    return sequences.frame_ranges(absent_ranges(spark, d), ["drive"], "first_absent", "last_absent")


def absent_slots(spark: SparkSession, d: str) -> DataFrame:
    """Every number a drive's motion stream lacks."""
    return sequences.absent_slots(table(spark, d, "ego"), ["drive"], "seq", CHUNK)


def interpolate_deadline(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines of absent sweeps, interpolated by number."""
    return sequences.slot_deadlines(table(spark, d, "sweeps"), ["drive"], "seq", "due_ns", F.lit(PERIOD_NS).cast("bigint"), CHUNK)


def dense_slots(spark: SparkSession, d: str) -> DataFrame:
    """S7, ST5: every slot of a drive from 0 to its last: present sweeps, and absent ones as Missing rows at their deadline."""
    present = table(spark, d, "sweeps").where(F.col("due_ns").isNotNull()).groupBy("drive", "seq").agg(F.min("due_ns").alias("due_ns"))
    absent = interpolate_deadline(spark, d).select("drive", "seq", F.col("deadline_ns").alias("due_ns"))
    told = lambda df, outcome, reason: df.withColumn("outcome", F.lit(outcome)).withColumn("reason", F.lit(reason))
    return told(present, "Present", None).unionByName(told(absent, "Missing", "absent_in_source"))


def deadline_lead(spark: SparkSession, d: str) -> DataFrame:
    """W6, ST4: when a sweep's place is taken by the next, and whether it arrived after that."""
    rows = sweeps(spark, d).where(F.col("due_ns").isNotNull()).select("drive", "seq", "due_ns", "arrival_ns")
    ahead = sequences.with_next(rows, ["drive"], "due_ns", "next_due", 60_000_000_000)
    skip = F.coalesce("next_due", F.col("due_ns") + PERIOD_NS)
    return ahead.select("drive", "seq", skip.alias("skip_at_ns"), (F.col("arrival_ns") >= skip).alias("skipped"))


def _slots(spark: SparkSession, d: str) -> DataFrame:
    """Up to the longest of a drive's numbered streams: sweeps and frames of either side (motion readings have their own numbering)."""
    return sequences.all_slots(table(spark, d, "sweeps"), ["drive"], "seq", "due_ns", _periods(spark, d), CHUNK, table(spark, d, "frames").select("drive", "seq"))


def _periods(spark: SparkSession, d: str) -> DataFrame:
    """The median period of every drive, that of drives without any trigger too."""
    return table(spark, d, "sweeps").select("drive").distinct().join(median_period(spark, d), "drive", "left").select("drive", F.coalesce("period_ns", F.lit(100_000_000)).alias("period_ns"))


def drive_slots(spark: SparkSession, d: str) -> DataFrame:
    """S7, ST5: every slot of a drive, to the end of its longest stream; a sweep that exists is Present even without a due time, which is then filled in."""
    outcome, reason = F.when(F.col("present"), "Present").otherwise("Missing"), F.when(~F.col("present"), "absent_in_source")
    return _slots(spark, d).select("drive", "seq", "due_ns", outcome.alias("outcome"), reason.alias("reason"))


def absent_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Deadlines of the sweeps that a drive lacks, and of no others."""
    return _slots(spark, d).where(~F.col("present")).select("drive", "seq", F.col("due_ns").alias("deadline_ns"))


def skip_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """W6, ST4: when a sweep's place is taken by the next, and whether it arrived after that; of every sweep, its due time filled in where it lacks."""
    due = sequences.present_slots(table(spark, d, "sweeps"), ["drive"], "seq", "due_ns", _periods(spark, d), CHUNK)
    rows = due.join(sweeps(spark, d).select("drive", "seq", "arrival_ns"), ["drive", "seq"])
    ahead = sequences.with_next(rows, ["drive"], "due_ns", "next_due", 60_000_000_000)
    skip = F.coalesce("next_due", F.col("due_ns") + F.col("period_ns"))
    return ahead.join(_periods(spark, d), "drive").select("drive", "seq", skip.alias("skip_at_ns"), (F.col("arrival_ns") >= skip).alias("skipped"))


def median_period(spark: SparkSession, d: str) -> DataFrame:
    """Median step between neighbouring sweep triggers of a drive, 100 ms where there is no step."""
    rows = table(spark, d, "sweeps").where(F.col("trigger_ns").isNotNull()).select("drive", "trigger_ns").distinct()
    steps = sequences.with_previous(rows, ["drive"], "trigger_ns", "prev", 60_000_000_000).select("drive", (F.col("trigger_ns") - F.col("prev")).alias("step_ns"))
    median = ranks.order_statistics(steps, ["drive"], "step_ns", {"period_ns": ranks.nearest_rank(50)})
    return rows.select("drive").distinct().join(median, "drive", "left").select("drive", F.coalesce("period_ns", F.lit(100_000_000)).alias("period_ns"))


def increasing_check(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps whose trigger isn't after those of all smaller numbers of the drive; blanks are skipped."""
    rows = sweeps(spark, d).where(F.col("trigger_ns").isNotNull()).select("drive", "seq", "trigger_ns")
    seen = running(rows, ["drive"], "seq", "trigger_ns", "before", CHUNK, how="max", strict=True)
    return seen.where(F.col("trigger_ns") <= F.col("before")).select("drive", "seq", "trigger_ns", "before")


def frame_index(spark: SparkSession, d: str) -> DataFrame:
    """Full outer merge of the left and right frame numbers of a drive, with what is wrong with each."""
    frames = table(spark, d, "frames")
    side = lambda s: frames.where(F.col("side") == s).groupBy("drive", "seq").agg(F.count("tov_ns").alias(f"{s}_times"), F.count(F.lit(1)).alias(f"{s}_rows"))
    both = side("left").join(side("right"), ["drive", "seq"], "full_outer")
    fault = (
        F.when(F.col("left_rows").isNull(), "no_left").when(F.col("right_rows").isNull(), "no_right").when(F.col("left_times") == 0, "left_without_time").when(F.col("right_times") == 0, "right_without_time").otherwise("ok")
    )
    return both.select("drive", "seq", fault.alias("state"))


def silence(spark: SparkSession, d: str) -> DataFrame:
    """W10, ST9: sweeps in a row, as they arrive, that neither got a left frame nor saw one arrive since the sweep before; silent from three on."""
    got = _pair(spark, d, wait=True, stale_ns=STALE_NS).select("drive", "seq", F.col("outcome").isin("paired", "stale").alias("got"))
    rows = sequences.in_order(sweeps(spark, d).select("drive", "seq", "arrival_ns").join(got, ["drive", "seq"]), ["drive"], "arrival_ns", ["seq"])
    seen = left_frames(spark, d).where(F.col("arrival_ns").isNotNull()).select("drive", "arrival_ns", F.col("arrival_ns").alias("_frame"))
    both = running(rows.unionByName(seen, allowMissingColumns=True), ["drive"], "arrival_ns", "_frame", "_last", 60 * NS, how="max").where(F.col("seq").isNotNull())
    arrived = F.coalesce(F.col("_last") > F.coalesce(F.col("before"), F.lit(-(2**62))), F.lit(False))
    counted = sequences.quiet_streaks(both.withColumn("_heard", F.col("got") | arrived), ["drive"], "no", F.col("_heard"), CHUNK)
    return counted.select("drive", "seq", "misses", (F.col("misses") >= 3).alias("silent"))


def sticky_state(spark: SparkSession, d: str) -> DataFrame:
    """Pairing trouble held for ten sweeps; rows where the held state changes."""
    severity = F.when(F.col("outcome") == "paired", 0).when(F.col("outcome").isin("stale", "pair_late"), 1).otherwise(2)
    held = sequences.held_worst(_pair(spark, d, wait=True, stale_ns=0).withColumn("severity", severity), ["drive"], "seq", "severity", 10)
    return held.where(F.col("was").isNull() | (F.col("was") != F.col("held"))).select("drive", "seq", F.col("held").alias("state"))


def adjacent_sweeps(spark: SparkSession, d: str) -> DataFrame:
    """Each sweep with the one numbered just before, and the time between their triggers."""
    a = sweeps(spark, d).select("drive", "seq", "trigger_ns")
    b = a.select("drive", (F.col("seq") + 1).alias("seq"), F.col("trigger_ns").alias("before_ns"))
    joined = a.join(b, ["drive", "seq"], "left")
    return joined.select("drive", "seq", F.col("before_ns").isNotNull().alias("consecutive"), (F.col("trigger_ns") - F.col("before_ns")).alias("dt_ns"))


def pairing_offset(spark: SparkSession, d: str) -> DataFrame:
    """Where in its sweep the paired frame lies."""
    paired = pair_interval(spark, d).where(F.col("outcome") == "paired")
    return paired.join(sweeps(spark, d), ["drive", "seq"]).select("drive", "seq", (F.col("pair_ns") - F.col("tov_start_ns")).alias("offset_ns"))


def ego_speed(spark: SparkSession, d: str) -> DataFrame:
    """Speed over ground of each reading with both components."""
    ok = g.finite(F.col("vf"), F.col("vl"))
    return table(spark, d, "ego").where(ok).select("drive", "seq", "tov_ns", F.round(F.hypot("vf", "vl"), 6).alias("speed")).distinct()


def ego_path(spark: SparkSession, d: str) -> DataFrame:
    """Curvature of the path at each reading and where a point 20 m ahead and 1 m left lies against it."""
    k = g.curvature(F.col("vf"), F.col("yaw_rate"))
    offset, along = g.locate(F.lit(20.0), F.lit(1.0), F.col("k"))
    rows = table(spark, d, "ego").where(g.finite(F.col("vf"), F.col("yaw_rate"))).select("drive", "seq", k.alias("k")).distinct()
    return rows.select("drive", "seq", F.round("k", 6).alias("curvature"), F.round(offset, 5).alias("offset_m"), F.round(along, 5).alias("along_m"))


def clock_due(spark: SparkSession, d: str) -> DataFrame:
    """When each sweep is due in each epoch of its drive that is paced: the drive's start plus the time since, by rate."""
    first = table(spark, d, "sweeps").groupBy("drive").agg(F.min("tov_start_ns").alias("t0"))
    paced = table(spark, d, "runs").where(F.col("rate").isNotNull() & ~F.isnan("rate") & (F.col("rate") > 0)).select("run_id", "epoch", "drive", "rate")
    rows = paced.join(first, "drive").join(sweeps(spark, d).select("drive", "seq", "tov_start_ns"), "drive").where(F.col("tov_start_ns").isNotNull())
    since = F.col("tov_start_ns") - F.col("t0")
    due = F.when(F.col("rate") == 1.0, since).otherwise(F.round(since / F.col("rate")).cast("bigint"))
    return rows.select("run_id", "epoch", "seq", due.alias("due_ns"))


QUERIES = {
    f.__name__: f
    for f in (
        pair_interval, pair_stale, pair_outcomes, pair_by_seq, asof_seq, asof_time, seq_gap, net_seq_gap, absent_ranges, absent_phrases, absent_slots,
        interpolate_deadline, dense_slots, deadline_lead, drive_slots, absent_deadlines, skip_deadlines, median_period, increasing_check, frame_index, silence, sticky_state, adjacent_sweeps, pairing_offset, ego_speed, ego_path, clock_due,
    )
}

_SWEEPS = """
WITH s AS (
  SELECT drive, seq, min(tov_start_ns) AS tov_start_ns, min(tov_end_ns) AS tov_end_ns, min(trigger_ns) AS trigger_ns, min(due_ns) AS due_ns, min(arrival_ns) AS arrival_ns
  FROM sweeps GROUP BY drive, seq
)"""


def _pair_sql(stale_ns: int, side: str = "left") -> str:
    return (
        _SWEEPS
        + f""", f AS (
  SELECT drive, seq, tov_ns AS at_ns, min(arrival_ns) AS seen FROM frames WHERE side = '{side}' AND tov_ns IS NOT NULL GROUP BY ALL
), valid AS (
  SELECT *, least(greatest(coalesce(trigger_ns, tov_start_ns), tov_start_ns), tov_end_ns - 1) AS trig FROM s
  WHERE tov_end_ns > tov_start_ns AND arrival_ns IS NOT NULL
), near AS (
  SELECT v.drive, v.seq,
    min({{'at': at_ns, 'seq': f.seq}}) FILTER (at_ns >= tov_start_ns AND seen <= v.arrival_ns + tov_end_ns - tov_start_ns) AS paired,
    max({{'at': at_ns, 'seq': f.seq}}) FILTER (at_ns < tov_start_ns AND trig - at_ns <= {stale_ns} AND seen <= v.arrival_ns + tov_end_ns - tov_start_ns) AS old,
    max(CASE WHEN at_ns >= tov_start_ns THEN 1 ELSE 0 END) AS inside
  FROM valid v JOIN f ON v.drive = f.drive AND at_ns BETWEEN least(tov_start_ns, trig - {stale_ns}) AND tov_end_ns - 1
  GROUP BY v.drive, v.seq
), last AS (SELECT drive, max(at_ns) AS last_ns FROM f GROUP BY drive),
paired AS (
  SELECT s.drive, s.seq, coalesce(n.paired, n.old).seq AS pair_seq, coalesce(n.paired, n.old).at AS pair_ns,
    CASE WHEN v.drive IS NULL THEN 'no_span' WHEN n.paired IS NOT NULL THEN 'paired' WHEN n.old IS NOT NULL THEN 'stale' WHEN n.inside = 1 THEN 'pair_late'
      WHEN last_ns IS NULL THEN 'pair_absent' WHEN last_ns >= s.tov_end_ns THEN 'pair_dropped' ELSE 'pair_absent_in_source' END AS outcome
  FROM s LEFT JOIN valid v USING (drive, seq) LEFT JOIN near n USING (drive, seq) LEFT JOIN last USING (drive)
)"""
    )


_ABSENT = """
WITH n AS (SELECT DISTINCT drive, seq FROM sweeps WHERE seq >= 0),
p AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY drive ORDER BY seq), -1) AS prev FROM n),
r AS (SELECT drive, prev + 1 AS first_absent, seq - 1 AS last_absent, seq - prev - 1 AS n_absent FROM p WHERE seq - prev > 1)
"""

_DEADLINES = """
WITH k AS (SELECT drive, seq, min(due_ns) AS due FROM sweeps WHERE due_ns IS NOT NULL AND seq >= 0 GROUP BY ALL),
p AS (SELECT *, lag(seq) OVER w AS a, lag(due) OVER w AS da FROM k WINDOW w AS (PARTITION BY drive ORDER BY seq)),
x AS (SELECT *, unnest(generate_series(coalesce(a, -1) + 1, seq - 1)) AS slot FROM p),
absent AS (SELECT drive, slot AS seq, CASE WHEN a IS NULL THEN due - (seq - slot) * 103000000 ELSE da + ((due - da) * (slot - a)) // (seq - a) END AS deadline_ns FROM x)"""

_SLOTS = """
WITH own AS (SELECT drive, seq, min(due_ns) AS due, min(arrival_ns) AS arrival_ns FROM sweeps GROUP BY ALL),
tops AS (SELECT drive, max(seq) AS top FROM (SELECT drive, seq FROM sweeps UNION ALL SELECT drive, seq FROM frames WHERE drive IN (SELECT drive FROM own)) GROUP BY drive),
t AS (SELECT DISTINCT drive, trigger_ns FROM sweeps WHERE trigger_ns IS NOT NULL),
steps AS (SELECT drive, trigger_ns - lag(trigger_ns) OVER (PARTITION BY drive ORDER BY trigger_ns) AS step FROM t),
per AS (SELECT drive, coalesce(quantile_disc(step, 0.5), 100000000) AS period FROM tops LEFT JOIN steps USING (drive) GROUP BY drive),
grid AS (SELECT drive, unnest(generate_series(0, top)) AS seq FROM tops),
g AS (SELECT grid.drive, grid.seq, period, due, own.seq IS NOT NULL AS present, arrival_ns, CASE WHEN due IS NOT NULL THEN {'no': grid.seq, 'due': due} END AS k
  FROM grid LEFT JOIN own ON own.drive = grid.drive AND own.seq = grid.seq JOIN per ON per.drive = grid.drive),
n AS (SELECT *, max(k) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a, min(k) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM g WINDOW w AS (PARTITION BY drive ORDER BY seq)),
slots AS (SELECT drive, seq, present, arrival_ns, period, CASE WHEN due IS NOT NULL THEN due WHEN b IS NULL THEN a.due + (seq - a.no) * period WHEN a IS NULL THEN b.due - (b.no - seq) * period
  ELSE a.due + ((b.due - a.due) * (seq - a.no)) // (b.no - a.no) END AS due_ns FROM n)"""

SQL = {
    "drive_slots": _SLOTS + " SELECT drive, seq, due_ns, CASE WHEN present THEN 'Present' ELSE 'Missing' END AS outcome, CASE WHEN NOT present THEN 'absent_in_source' END AS reason FROM slots",
    "absent_deadlines": _SLOTS + " SELECT drive, seq, due_ns AS deadline_ns FROM slots WHERE NOT present",
    "skip_deadlines": _SLOTS
    + """, d AS (SELECT DISTINCT drive, due_ns, period FROM slots WHERE present), l AS (SELECT *, lead(due_ns) OVER (PARTITION BY drive ORDER BY due_ns) AS next_due FROM d)
SELECT s.drive, s.seq, coalesce(next_due, s.due_ns + s.period) AS skip_at_ns, arrival_ns >= skip_at_ns AS skipped FROM slots s LEFT JOIN l ON l.drive = s.drive AND l.due_ns = s.due_ns WHERE present""",
    "pair_interval": _pair_sql(0) + " SELECT drive, seq, pair_seq, pair_ns, outcome FROM paired",
    "pair_stale": _pair_sql(120_000_000) + " SELECT drive, seq, pair_seq, pair_ns, outcome FROM paired",
    "pair_outcomes": _pair_sql(0) + " SELECT drive, outcome, count(*) AS n FROM paired GROUP BY GROUPING SETS ((drive, outcome), (outcome), ())",
    "pair_by_seq": """
WITH a AS (SELECT DISTINCT run_id, epoch, seq FROM evidence WHERE edge = 'det->detect'),
b AS (SELECT DISTINCT run_id, epoch, seq FROM evidence WHERE edge = 'pillar_det->track' AND outcome = 'Delivered'),
m AS (SELECT run_id, epoch, max(seq) AS newest FROM b GROUP BY ALL)
SELECT a.run_id, a.epoch, a.seq, CASE WHEN b.seq IS NOT NULL THEN 'named' WHEN newest IS NULL THEN 'lidar_off' WHEN newest > a.seq THEN 'lidar_dropped' ELSE 'lidar_late' END AS outcome
FROM a LEFT JOIN b USING (run_id, epoch, seq) LEFT JOIN m USING (run_id, epoch)""",
    "asof_seq": """
WITH a AS (SELECT DISTINCT drive, seq FROM sweeps), b AS (SELECT DISTINCT drive, seq FROM frames WHERE side = 'right'),
j AS (SELECT a.drive, a.seq, max(b.seq) AS match_seq FROM a LEFT JOIN b ON a.drive = b.drive AND b.seq BETWEEN a.seq - 2 AND a.seq GROUP BY ALL)
SELECT drive, seq, match_seq, CASE WHEN match_seq = seq THEN 'compensated' WHEN match_seq IS NOT NULL THEN 'stale'
  WHEN drive IN (SELECT drive FROM b) THEN 'missing' ELSE 'unavailable' END AS outcome FROM j""",
    "asof_time": _SWEEPS
    + """, e AS (SELECT drive, tov_ns, max(seq) AS ego_seq FROM ego WHERE tov_ns IS NOT NULL GROUP BY ALL)
SELECT s.drive, s.seq, CASE WHEN e.tov_ns >= s.tov_start_ns - 60000000 THEN e.tov_ns END AS match_ns, CASE WHEN e.tov_ns >= s.tov_start_ns - 60000000 THEN e.ego_seq END AS ego_seq
FROM s ASOF LEFT JOIN e ON s.drive = e.drive AND s.tov_start_ns >= e.tov_ns""",
    "seq_gap": """
SELECT run_id, epoch, edge, seq, seq - lag(seq) OVER (PARTITION BY run_id, epoch, edge ORDER BY seq) AS seq_gap
FROM (SELECT DISTINCT run_id, epoch, edge, seq FROM evidence)""",
    "net_seq_gap": _ABSENT
    + """, gone AS (SELECT drive, unnest(generate_series(first_absent, last_absent)) AS missing FROM r),
e AS (SELECT DISTINCT run_id, epoch, drive, seq FROM (SELECT DISTINCT run_id, epoch, seq FROM evidence WHERE edge = 'velo->reduce') JOIN (SELECT DISTINCT run_id, epoch, drive FROM runs) USING (run_id, epoch)),
g AS (SELECT *, lag(seq) OVER (PARTITION BY run_id, epoch, drive ORDER BY seq) AS prev FROM e)
SELECT run_id, epoch, seq, seq - prev AS seq_gap, seq - prev - (SELECT count(*) FROM gone WHERE gone.drive = g.drive AND missing > prev AND missing < seq) AS net_gap
FROM g WHERE seq - prev > 1""",
    "absent_ranges": _ABSENT + "SELECT * FROM r",
    "absent_phrases": _ABSENT
    + "SELECT drive, string_agg(CASE WHEN n_absent = 1 THEN first_absent::VARCHAR ELSE first_absent || '-' || last_absent END, ', ' ORDER BY first_absent) AS ranges FROM r GROUP BY drive",
    "absent_slots": """
WITH top AS (SELECT drive, max(seq) AS top FROM ego GROUP BY drive)
SELECT drive, unnest(generate_series(0, top)) AS seq FROM top EXCEPT SELECT drive, seq FROM ego""",
    "interpolate_deadline": _DEADLINES + " SELECT * FROM absent",
    "dense_slots": _DEADLINES
    + """ SELECT drive, seq, due AS due_ns, 'Present' AS outcome, NULL::VARCHAR AS reason FROM k UNION ALL SELECT drive, seq, deadline_ns, 'Missing', 'absent_in_source' FROM absent""",
    "deadline_lead": _SWEEPS
    + """, d AS (SELECT DISTINCT drive, due_ns FROM s WHERE due_ns IS NOT NULL),
l AS (SELECT *, coalesce(lead(due_ns) OVER (PARTITION BY drive ORDER BY due_ns), due_ns + 103000000) AS skip_at_ns FROM d)
SELECT s.drive, s.seq, skip_at_ns, arrival_ns >= skip_at_ns AS skipped FROM s JOIN l USING (drive, due_ns)""",
    "median_period": """
WITH t AS (SELECT DISTINCT drive, trigger_ns FROM sweeps WHERE trigger_ns IS NOT NULL),
p AS (SELECT drive, trigger_ns - lag(trigger_ns) OVER (PARTITION BY drive ORDER BY trigger_ns) AS step FROM t)
SELECT drive, coalesce(quantile_disc(step, 0.5), 100000000) AS period_ns FROM p GROUP BY drive""",
    "increasing_check": _SWEEPS
    + """, b AS (SELECT *, max(trigger_ns) OVER (PARTITION BY drive ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s WHERE trigger_ns IS NOT NULL)
SELECT drive, seq, trigger_ns, before FROM b WHERE trigger_ns <= before""",
    "frame_index": """
WITH l AS (SELECT drive, seq, count(tov_ns) AS t FROM frames WHERE side = 'left' GROUP BY ALL), r AS (SELECT drive, seq, count(tov_ns) AS t FROM frames WHERE side = 'right' GROUP BY ALL)
SELECT drive, seq, CASE WHEN l.t IS NULL THEN 'no_left' WHEN r.t IS NULL THEN 'no_right' WHEN l.t = 0 THEN 'left_without_time' WHEN r.t = 0 THEN 'right_without_time' ELSE 'ok' END AS state
FROM l FULL JOIN r USING (drive, seq)""",
    "silence": _pair_sql(120_000_000)
    + """, o AS (
  SELECT s.drive, s.seq, s.arrival_ns, p.outcome IN ('paired', 'stale') AS got,
    lag(s.arrival_ns) OVER (PARTITION BY s.drive ORDER BY s.arrival_ns NULLS FIRST, s.seq) AS before,
    row_number() OVER (PARTITION BY s.drive ORDER BY s.arrival_ns NULLS FIRST, s.seq) AS i
  FROM s JOIN paired p ON s.drive = p.drive AND s.seq = p.seq
), a AS (SELECT drive, min(arrival_ns) AS at FROM frames WHERE side = 'left' GROUP BY drive, seq, tov_ns
), h AS (
  SELECT *, got OR EXISTS (SELECT 1 FROM a WHERE a.drive = o.drive AND a.at <= o.arrival_ns AND (o.before IS NULL OR a.at > o.before)) AS heard FROM o
), m AS (SELECT *, i - coalesce(max(CASE WHEN heard THEN i END) OVER (PARTITION BY drive ORDER BY i), 0) AS misses FROM h)
SELECT drive, seq, misses, misses >= 3 AS silent FROM m""",
    "sticky_state": _pair_sql(0).replace("WITH", "WITH RECURSIVE", 1)
    + """, e AS (
  SELECT drive, seq, CASE WHEN outcome = 'paired' THEN 0 WHEN outcome IN ('stale', 'pair_late') THEN 1 ELSE 2 END AS sev,
    row_number() OVER (PARTITION BY drive ORDER BY seq) AS i FROM paired
), m AS (
  SELECT drive, seq, i, sev AS state, 0 AS quiet, 0 AS lesser, NULL::INT AS was FROM e WHERE i = 1
  UNION ALL
  SELECT e.drive, e.seq, e.i,
    CASE WHEN sev > 0 AND sev >= state THEN sev WHEN state > 0 AND quiet + 1 >= 10 THEN greatest(lesser, sev) ELSE state END,
    CASE WHEN sev > 0 AND sev >= state THEN 0 WHEN state > 0 AND quiet + 1 >= 10 THEN 0 ELSE quiet + 1 END,
    CASE WHEN sev > 0 AND sev >= state THEN 0 WHEN state > 0 AND quiet + 1 >= 10 THEN 0 ELSE greatest(lesser, sev) END, state
  FROM m JOIN e ON e.drive = m.drive AND e.i = m.i + 1
) SELECT drive, seq, state FROM m WHERE was IS NULL OR was <> state""",
    "adjacent_sweeps": _SWEEPS
    + " SELECT a.drive, a.seq, b.trigger_ns IS NOT NULL AS consecutive, a.trigger_ns - b.trigger_ns AS dt_ns FROM s a LEFT JOIN s b ON a.drive = b.drive AND a.seq = b.seq + 1",
    "pairing_offset": _pair_sql(0) + " SELECT drive, seq, pair_ns - tov_start_ns AS offset_ns FROM paired JOIN s USING (drive, seq) WHERE outcome = 'paired'",
    "ego_speed": """SELECT DISTINCT drive, seq, tov_ns, round(sqrt(vf * vf + vl * vl), 6) AS speed FROM ego WHERE isfinite(vf) AND isfinite(vl)""",
    "ego_path": """
WITH k AS (SELECT DISTINCT drive, seq, CASE WHEN vf >= 1.0 AND isfinite(yaw_rate / vf) AND abs(yaw_rate / vf) >= 1e-4 THEN yaw_rate / vf ELSE 0.0 END AS k FROM ego WHERE isfinite(vf) AND isfinite(yaw_rate)),
r AS (SELECT *, CASE WHEN k <> 0 THEN 1 / k END AS r FROM k)
SELECT drive, seq, round(k, 6) AS curvature, round(CASE WHEN k = 0 THEN 1.0 ELSE sign(r) * (abs(r) - sqrt(400.0 + (1.0 - r) * (1.0 - r))) END, 5) AS offset_m,
  round(CASE WHEN k = 0 THEN 20.0 ELSE abs(r) * atan2(20.0, sign(r) * (r - 1.0)) END, 5) AS along_m FROM r""",
    "clock_due": _SWEEPS
    + """, f AS (SELECT drive, min(tov_start_ns) AS t0 FROM sweeps GROUP BY drive)
SELECT run_id, epoch, seq, CASE WHEN rate = 1.0 THEN tov_start_ns - t0 ELSE round((tov_start_ns - t0) / rate)::BIGINT END AS due_ns
FROM runs JOIN f USING (drive) JOIN s USING (drive) WHERE rate > 0 AND NOT isnan(rate) AND tov_start_ns IS NOT NULL""",
}
