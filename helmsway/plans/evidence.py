"""Queries on the evidence of replay runs: accounting, order of admission, checks between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helmsway.operators import ranks
from helmsway.operators.scan import numbered
from helmsway.sources.tables import table

EPOCH = ["run_id", "epoch"]
OUTCOMES = {"delivered": "Delivered", "dropped_oldest": "DroppedOldest", "dropped_newest": "DroppedNewest", "timeout_rows": "Timeout", "missing": "Missing"}
#: Names of the streams by number.
STREAMS = {0: "cam0", 1: "lidar", 2: "oxts", 3: "lidar_det", 4: "cam_det", 5: "ego", 6: "tracks", 7: "lidar_obj", 8: "cam1", 9: "cam1_det", 10: "pillar_det"}

#: The stream that an edge carries, and the one that the stage behind it produces.
EDGES = {
    "cam0->camdet": (0, 4), "cam0->proc": (0, None), "cam0->rerun": (0, None), "cam1->camdet": (8, 9), "cam1_det->track": (9, None), "cam_det->track": (4, None),
    "det->cloud": (3, None), "det->detect": (3, 7), "obj->sink": (7, None), "obj->track": (7, 6), "oxts->track": (2, None), "pillar_det->track": (10, None),
    "state->sink": (5, None), "track->state": (6, 5), "velo->cloud": (1, None), "velo->pillars": (1, 10), "velo->reduce": (1, 3),
}


def rows_once(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with copies of a row (same epoch, edge and number) taken once, as first arrived."""
    e = table(spark, d, "evidence")
    measured = ["stream", "outcome", "reason", "arrival_ns", "dequeued_ns", "proc_end_ns", "queue_wait_ns", "measurement_age_ns", "payload_bytes", "push_blocked_ns"]
    first = F.min_by(F.struct(*measured), F.struct("arrival_ns", "arrival_seq"))
    return e.groupBy(*EPOCH, "edge", "seq").agg(first.alias("_row")).select(*EPOCH, "edge", "seq", "_row.*")


def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    """A10: per edge the rows by outcome and the exact percentiles of queue wait and age in microseconds."""
    rows = rows_once(spark, d)
    counts = rows.groupBy("edge").agg(*[F.count_if(F.col("outcome") == o).alias(n) for n, o in OUTCOMES.items()], F.round(F.avg("payload_bytes"), 3).alias("mean_bytes"))
    micros = [F.struct(F.lit(m).alias("metric"), F.call_function("div", F.col(c), F.lit(1000).cast("bigint")).alias("us")) for m, c in (("wait", "queue_wait_ns"), ("age", "measurement_age_ns"))]
    wanted = {f"p{p}": ranks.nearest_rank(p) for p in (50, 95, 99)} | {"max": F.col("n")}
    stats = ranks.order_statistics(rows.select("edge", F.inline(F.array(*micros))), ["edge", "metric"], "us", wanted)
    wide = stats.groupBy("edge").agg(*[F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"{m}_{k}_us") for m in ("wait", "age") for k in wanted])
    return counts.join(wide, "edge", "left")


def steady_age(spark: SparkSession, d: str) -> DataFrame:
    """median age per edge over rows taken off the queue before the epoch's last arrival on the edge."""
    rows = rows_once(spark, d)
    last = rows.groupBy(*EPOCH, "edge").agg(F.max("arrival_ns").alias("last_ns"))
    steady = rows.join(last, [*EPOCH, "edge"]).where(F.col("dequeued_ns") < F.col("last_ns"))
    return ranks.order_statistics(steady, ["edge"], "measurement_age_ns", {"median_ns": ranks.upper_median_rank()}, chunk=1 << 26)


def upper_median(spark: SparkSession, d: str) -> DataFrame:
    """A5: upper median of the bytes of a sample per stream."""
    return ranks.order_statistics(rows_once(spark, d), ["stream"], "payload_bytes", {"median_bytes": ranks.upper_median_rank()})


def conservation(spark: SparkSession, d: str) -> DataFrame:
    """Per epoch and edge, that outcomes add up to rows and delivered rows were taken off the queue."""
    rows = rows_once(spark, d)
    tallies = {n: F.count_if(F.col("outcome") == o) for n, o in OUTCOMES.items()}
    got = rows.groupBy(*EPOCH, "edge").agg(F.count(F.lit(1)).alias("rows"), *[t.alias(n) for n, t in tallies.items()], F.count_if((F.col("outcome") == "Delivered") & F.col("dequeued_ns").isNull()).alias("lost"))
    total = sum((F.col(n) for n in OUTCOMES), F.lit(0))
    return got.select(*EPOCH, "edge", "rows", (total == F.col("rows")).alias("adds_up"), (F.col("lost") == 0).alias("all_taken"))


def invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per epoch, sums that must agree, as ``counted`` and ``expected``.

    driver: admitted and missing samples of a sensor against what its drive holds; rows: samples on an edge
    against those admitted to its stream; settled: delivered and dropped ones against the same; stage:
    samples produced against those delivered to the stage (its errors leave no row in evidence).
    """
    rows = rows_once(spark, d)
    gone = F.col("outcome") == "Missing"
    samples = rows.groupBy(*EPOCH, "stream", "seq").agg(F.max(gone).alias("gone")).groupBy(*EPOCH, "stream").agg(F.count_if(~F.col("gone")).alias("admitted"), F.count(F.lit(1)).alias("known"))
    edges = rows.groupBy(*EPOCH, "edge").agg(
        F.count_if(~gone).alias("passed"), F.count_if(F.col("outcome") == "Delivered").alias("delivered"), F.count_if(F.col("outcome").isin("DroppedOldest", "DroppedNewest", "Timeout")).alias("dropped")
    )
    fixed = F.broadcast(spark.createDataFrame([(k, a, b) for k, (a, b) in EDGES.items()], "edge string, stream int, makes int"))
    produced = samples.select(*EPOCH, F.col("stream").alias("makes"), F.col("admitted").alias("produced"))
    on = samples.join(fixed, "stream").join(edges, [*EPOCH, "edge"], "left").join(produced, [*EPOCH, "makes"], "left").fillna(0, ["passed", "delivered", "dropped", "produced"])
    check = lambda kind, got, want: F.struct(F.concat_ws(" ", F.lit(kind), "edge").alias("name"), got.alias("counted"), want.alias("expected"))
    checks = F.array(check("rows", F.col("passed"), F.col("admitted")), check("settled", F.col("delivered") + F.col("dropped"), F.col("admitted")), F.when(F.col("makes").isNotNull(), check("stage", F.col("produced"), F.col("delivered"))))
    along = on.select(*EPOCH, F.inline(F.array_compact(checks)))
    held = lambda t, where, stream: table(spark, d, t).where(where).groupBy("drive").agg(F.count_distinct("seq").alias("expected")).withColumn("stream", F.lit(stream))
    holds = held("frames", F.col("side") == "left", 0).unionByName(held("sweeps", F.lit(True), 1)).unionByName(held("ego", F.lit(True), 2)).unionByName(held("frames", F.col("side") == "right", 8))
    drivers = table(spark, d, "runs").select(*EPOCH, "drive").distinct().join(holds, "drive").join(samples, [*EPOCH, "stream"], "left")
    sensors = drivers.select(*EPOCH, F.concat_ws(" ", F.lit("driver"), "stream").alias("name"), F.coalesce("known", F.lit(0)).alias("counted"), "expected")
    return along.unionByName(sensors).withColumn("ok", F.col("counted") == F.col("expected"))


def never_reached(spark: SparkSession, d: str) -> DataFrame:
    """Sweeps of an epoch that didn't reach the tracker, and the parts that explain them."""
    rows = rows_once(spark, d)
    on = lambda edge, outcome: F.count_if((F.col("edge") == edge) & F.col("outcome").isin(*outcome))
    lost = ("DroppedOldest", "DroppedNewest", "Timeout", "Missing")
    parts = rows.groupBy(*EPOCH).agg(
        F.count_if(F.col("edge") == "velo->reduce").alias("sweeps"),
        on("obj->track", ("Delivered",)).alias("reached"),
        on("velo->reduce", lost).alias("lost_reduce"),
        on("det->detect", lost).alias("lost_detect"),
        on("obj->track", lost).alias("lost_track"),
    )
    explained = F.col("lost_reduce") + F.col("lost_detect") + F.col("lost_track")
    return parts.withColumn("balance", F.col("sweeps") - F.col("reached") - explained)


def admission_order(spark: SparkSession, d: str) -> DataFrame:
    """U1, ST2: dense order of admission of an epoch's samples over all streams."""
    samples = table(spark, d, "evidence").groupBy(*EPOCH, "stream", "seq").agg(F.min("arrival_ns").alias("arrival_ns"))
    return numbered(samples, EPOCH, "arrival_ns", ["stream", "seq"], "place", 60_000_000_000)


def parent_check(spark: SparkSession, d: str) -> DataFrame:
    """Per epoch, the detector's inputs that the reducer never delivered."""
    e = table(spark, d, "evidence")
    made = e.where((F.col("edge") == "velo->reduce") & (F.col("outcome") == "Delivered")).select(*EPOCH, "seq").distinct().withColumn("_there", F.lit(True))
    used = e.where(F.col("edge") == "det->detect").select(*EPOCH, "seq").distinct()
    joined = used.join(made, [*EPOCH, "seq"], "left")
    return joined.groupBy(*EPOCH).agg(F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("_there").isNull()).alias("orphans"))


def orphans(spark: SparkSession, d: str) -> DataFrame:
    """U4: samples on the answer's edge that no track sample stands behind."""
    e = table(spark, d, "evidence")
    take = lambda edge: e.where(F.col("edge") == edge).select(*EPOCH, "seq").distinct()
    return take("state->sink").exceptAll(take("track->state"))


def gap_frames_used(spark: SparkSession, d: str) -> DataFrame:
    """Dropped sweeps of the reducing edge that another edge of the sweep did deliver."""
    e = table(spark, d, "evidence").where(F.col("stream") == 1)
    gone = e.where((F.col("edge") == "velo->reduce") & (F.col("outcome") != "Delivered")).select(*EPOCH, "seq").distinct()
    seen = e.where((F.col("edge") != "velo->reduce") & (F.col("outcome") == "Delivered")).select(*EPOCH, "seq")
    return gone.join(seen, [*EPOCH, "seq"], "left_semi")


def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Rows by outcome and by reason in one pass, with their place by count and name."""
    rows = rows_once(spark, d).select("outcome", F.coalesce(F.nullif("reason", F.lit("")), F.lit("none")).alias("reason"))
    tally = rows.groupingSets([["outcome"], ["reason"]], "outcome", "reason").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(F.col("outcome").isNull()).orderBy(F.col("n").desc(), F.coalesce("outcome", "reason"))
    return tally.withColumn("place", F.row_number().over(w))


def stream_names(spark: SparkSession, d: str) -> DataFrame:
    """Rows and bytes per stream, with its name from a fixed small table."""
    names = spark.createDataFrame(list(STREAMS.items()), "stream int, name string")
    per = table(spark, d, "evidence").groupBy("stream").agg(F.count(F.lit(1)).alias("rows"), F.sum("payload_bytes").alias("bytes"))
    return per.join(F.broadcast(names), "stream", "left")


def drive_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Every drive with what it holds, as columns and as one JSON text."""
    count = lambda t, where, name: table(spark, d, t).where(where).groupBy("drive").agg(F.countDistinct("seq").alias(name))
    parts = [count("sweeps", F.lit(True), "sweeps"), count("frames", F.col("side") == "left", "left_frames"), count("frames", F.col("side") == "right", "right_frames"), count("ego", F.lit(True), "readings")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "drive", "full_outer")
    out = out.fillna(0)
    return out.withColumn("json", F.to_json(F.struct("drive", "sweeps", "left_frames", "right_frames", "readings")))


def copy_check(spark: SparkSession, d: str) -> DataFrame:
    """Rows that occur more than once on an edge, and whether their content hashes agree but for arrival."""
    e = table(spark, d, "evidence")
    content = F.xxhash64("stream", "tov_start_ns", "tov_end_ns", "outcome", "payload_bytes", "storage_id")
    per = e.groupBy(*EPOCH, "edge", "seq").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct(content).alias("contents"))
    return per.where(F.col("copies") > 1).select(*EPOCH, "edge", "seq", "copies", (F.col("contents") == 1).alias("alike"))


def slowest_answer(spark: SparkSession, d: str) -> DataFrame:
    """Per epoch the answer with the largest age, the first of equals, with its whole row."""
    rows = rows_once(spark, d).where((F.col("edge") == "state->sink") & F.col("measurement_age_ns").isNotNull())
    best = rows.groupBy(*EPOCH).agg(F.min_by(F.struct("seq", "measurement_age_ns", "queue_wait_ns"), F.struct(-F.col("measurement_age_ns"), F.col("seq"))).alias("_b"))
    return best.select(*EPOCH, "_b.*")


def chain_shrink(spark: SparkSession, d: str) -> DataFrame:
    """Bytes per epoch along the chain from sweep to answer and their ratio."""
    rows = rows_once(spark, d)
    of = lambda edge: F.sum(F.when(F.col("edge") == edge, F.col("payload_bytes")))
    per = rows.groupBy(*EPOCH).agg(of("velo->reduce").alias("sweep_bytes"), of("det->detect").alias("cloud_bytes"), of("state->sink").alias("answer_bytes"))
    return per.withColumn("shrink", F.round(F.try_divide("answer_bytes", "sweep_bytes"), 9))


def health_events(spark: SparkSession, d: str) -> DataFrame:
    """A row per trouble on an edge: what kind, from outcome and reason."""
    kind = (
        F.when(F.col("outcome").isin("DroppedOldest", "DroppedNewest"), "shed").when(F.col("outcome") == "Timeout", "blocked").when(F.col("reason") == "deadline_skipped", "skipped").when(F.col("outcome") == "Missing", "error")
    )
    return rows_once(spark, d).select(*EPOCH, "edge", "seq", kind.alias("kind")).where(F.col("kind").isNotNull())


def age_words(spark: SparkSession, d: str) -> DataFrame:
    """T4: mean age of answers per run as people write it."""
    mean = rows_once(spark, d).where(F.col("edge") == "state->sink").groupBy("run_id").agg((F.sum("measurement_age_ns") / F.count("measurement_age_ns") / 1e6).alias("ms"))
    words = F.when(F.col("ms").isNull(), "unknown").when(F.col("ms") >= 1000, F.concat(F.round(F.col("ms") / 1000, 0).cast("bigint").cast("string"), F.lit(" s"))).otherwise(
        F.concat(F.round("ms", 0).cast("bigint").cast("string"), F.lit(" ms"))
    )
    return mean.select("run_id", words.alias("age"))


QUERIES = {
    f.__name__: f
    for f in (
        stage_summary, steady_age, upper_median, conservation, invariants, never_reached, admission_order, parent_check, orphans, gap_frames_used, class_histogram,
        stream_names, drive_catalogue, copy_check, slowest_answer, chain_shrink, health_events, age_words,
    )
}

_ROWS = """
WITH e AS (
  SELECT run_id, epoch, edge, seq, unnest(min_by({'stream': stream, 'outcome': outcome, 'reason': reason, 'arrival_ns': arrival_ns, 'dequeued_ns': dequeued_ns,
    'queue_wait_ns': queue_wait_ns, 'measurement_age_ns': measurement_age_ns, 'payload_bytes': payload_bytes}, {'a': arrival_ns, 's': arrival_seq}))
  FROM evidence GROUP BY run_id, epoch, edge, seq
)"""
_LOST = "('DroppedOldest', 'DroppedNewest', 'Timeout', 'Missing')"

SQL = {
    "invariants": _ROWS
    + ", edges AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {'NULL' if b is None else b})" for k, (a, b) in EDGES.items()) + ") v(edge, stream, makes)),\n"
    + """s AS (SELECT run_id, epoch, stream, count(DISTINCT seq) AS known, count(DISTINCT seq) - count(DISTINCT seq) FILTER (outcome = 'Missing') AS admitted FROM e GROUP BY ALL),
x AS (SELECT s.run_id, s.epoch, edges.edge, makes, admitted, (SELECT count(*) FROM e WHERE e.run_id = s.run_id AND e.epoch = s.epoch AND e.edge = edges.edge AND outcome <> 'Missing') AS passed,
  (SELECT count(*) FROM e WHERE e.run_id = s.run_id AND e.epoch = s.epoch AND e.edge = edges.edge AND outcome = 'Delivered') AS delivered,
  (SELECT count(*) FROM e WHERE e.run_id = s.run_id AND e.epoch = s.epoch AND e.edge = edges.edge AND outcome IN ('Delivered', 'DroppedOldest', 'DroppedNewest', 'Timeout')) AS settled
  FROM s JOIN edges ON s.stream = edges.stream),
h AS (SELECT drive, CASE side WHEN 'left' THEN 0 ELSE 8 END AS stream, count(DISTINCT seq) AS n FROM frames GROUP BY ALL UNION ALL SELECT drive, 1, count(DISTINCT seq) FROM sweeps GROUP BY ALL
  UNION ALL SELECT drive, 2, count(DISTINCT seq) FROM ego GROUP BY ALL),
c AS (SELECT run_id, epoch, 'rows ' || edge AS name, passed AS counted, admitted AS expected FROM x UNION ALL SELECT run_id, epoch, 'settled ' || edge, settled, admitted FROM x
  UNION ALL SELECT x.run_id, x.epoch, 'stage ' || edge, coalesce(s.admitted, 0), delivered FROM x LEFT JOIN s ON s.run_id = x.run_id AND s.epoch = x.epoch AND s.stream = x.makes WHERE makes IS NOT NULL
  UNION ALL SELECT r.run_id, r.epoch, 'driver ' || h.stream, coalesce(known, 0), n FROM (SELECT DISTINCT run_id, epoch, drive FROM runs) r JOIN h ON h.drive = r.drive
    LEFT JOIN s ON s.run_id = r.run_id AND s.epoch = r.epoch AND s.stream = h.stream)
SELECT *, counted = expected AS ok FROM c""",
    "stage_summary": _ROWS
    + """
SELECT edge, count(*) FILTER (outcome = 'Delivered') AS delivered, count(*) FILTER (outcome = 'DroppedOldest') AS dropped_oldest, count(*) FILTER (outcome = 'DroppedNewest') AS dropped_newest,
  count(*) FILTER (outcome = 'Timeout') AS timeout_rows, count(*) FILTER (outcome = 'Missing') AS missing, round(avg(payload_bytes), 3) AS mean_bytes,
  quantile_disc(queue_wait_ns // 1000, 0.5) AS wait_p50_us, quantile_disc(queue_wait_ns // 1000, 0.95) AS wait_p95_us, quantile_disc(queue_wait_ns // 1000, 0.99) AS wait_p99_us, max(queue_wait_ns // 1000) AS wait_max_us,
  quantile_disc(measurement_age_ns // 1000, 0.5) AS age_p50_us, quantile_disc(measurement_age_ns // 1000, 0.95) AS age_p95_us, quantile_disc(measurement_age_ns // 1000, 0.99) AS age_p99_us, max(measurement_age_ns // 1000) AS age_max_us
FROM e GROUP BY edge""",
    "steady_age": _ROWS
    + """, l AS (SELECT *, max(arrival_ns) OVER (PARTITION BY run_id, epoch, edge) AS last_ns FROM e),
r AS (SELECT edge, measurement_age_ns AS v, row_number() OVER (PARTITION BY edge ORDER BY measurement_age_ns) AS i, count(*) OVER (PARTITION BY edge) AS n FROM l WHERE dequeued_ns < last_ns AND measurement_age_ns IS NOT NULL)
SELECT edge, n, v AS median_ns FROM r WHERE i = n // 2 + 1""",
    "upper_median": _ROWS
    + """, r AS (SELECT stream, payload_bytes AS v, row_number() OVER (PARTITION BY stream ORDER BY payload_bytes) AS i, count(*) OVER (PARTITION BY stream) AS n FROM e WHERE payload_bytes IS NOT NULL)
SELECT stream, n, v AS median_bytes FROM r WHERE i = n // 2 + 1""",
    "conservation": _ROWS
    + """
SELECT run_id, epoch, edge, count(*) AS rows, count(*) FILTER (outcome IN ('Delivered', 'DroppedOldest', 'DroppedNewest', 'Timeout', 'Missing')) = count(*) AS adds_up,
  count(*) FILTER (outcome = 'Delivered' AND dequeued_ns IS NULL) = 0 AS all_taken FROM e GROUP BY run_id, epoch, edge""",
    "never_reached": _ROWS
    + f""", c AS (SELECT run_id, epoch, count(*) FILTER (edge = 'velo->reduce') AS sweeps, count(*) FILTER (edge = 'obj->track' AND outcome = 'Delivered') AS reached,
  count(*) FILTER (edge = 'velo->reduce' AND outcome IN {_LOST}) AS lost_reduce, count(*) FILTER (edge = 'det->detect' AND outcome IN {_LOST}) AS lost_detect,
  count(*) FILTER (edge = 'obj->track' AND outcome IN {_LOST}) AS lost_track FROM e GROUP BY run_id, epoch)
SELECT *, sweeps - reached - lost_reduce - lost_detect - lost_track AS balance FROM c""",
    "admission_order": """
WITH s AS (SELECT run_id, epoch, stream, seq, min(arrival_ns) AS arrival_ns FROM evidence GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY arrival_ns, stream, seq) - 1 AS place FROM s""",
    "parent_check": """
WITH m AS (SELECT DISTINCT run_id, epoch, seq FROM evidence WHERE edge = 'velo->reduce' AND outcome = 'Delivered'), u AS (SELECT DISTINCT run_id, epoch, seq FROM evidence WHERE edge = 'det->detect')
SELECT u.run_id, u.epoch, count(*) AS inputs, count(*) FILTER (m.seq IS NULL) AS orphans FROM u LEFT JOIN m USING (run_id, epoch, seq) GROUP BY ALL""",
    "orphans": "SELECT run_id, epoch, seq FROM evidence WHERE edge = 'state->sink' EXCEPT SELECT run_id, epoch, seq FROM evidence WHERE edge = 'track->state'",
    "gap_frames_used": """
SELECT run_id, epoch, seq FROM evidence WHERE edge = 'velo->reduce' AND outcome <> 'Delivered'
INTERSECT SELECT run_id, epoch, seq FROM evidence WHERE stream = 1 AND edge <> 'velo->reduce' AND outcome = 'Delivered'""",
    "class_histogram": _ROWS
    + """, t AS (SELECT outcome, coalesce(nullif(reason, ''), 'none') AS reason FROM e), g AS (SELECT outcome, reason, count(*) AS n FROM t GROUP BY GROUPING SETS ((outcome), (reason)))
SELECT *, row_number() OVER (PARTITION BY outcome IS NULL ORDER BY n DESC, coalesce(outcome, reason)) AS place FROM g""",
    "stream_names": "SELECT stream, count(*) AS rows, sum(payload_bytes)::BIGINT AS bytes, CASE stream " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in STREAMS.items()) + " END AS name FROM evidence GROUP BY stream",
    "drive_catalogue": """
WITH s AS (SELECT drive, count(DISTINCT seq) AS sweeps FROM sweeps GROUP BY 1), l AS (SELECT drive, count(DISTINCT seq) AS left_frames FROM frames WHERE side = 'left' GROUP BY 1),
r AS (SELECT drive, count(DISTINCT seq) AS right_frames FROM frames WHERE side = 'right' GROUP BY 1), e AS (SELECT drive, count(DISTINCT seq) AS readings FROM ego GROUP BY 1),
a AS (SELECT drive, coalesce(sweeps, 0) AS sweeps, coalesce(left_frames, 0) AS left_frames, coalesce(right_frames, 0) AS right_frames, coalesce(readings, 0) AS readings
  FROM s FULL JOIN l USING (drive) FULL JOIN r USING (drive) FULL JOIN e USING (drive))
SELECT *, '{"drive":"' || drive || '","sweeps":' || sweeps || ',"left_frames":' || left_frames || ',"right_frames":' || right_frames || ',"readings":' || readings || '}' AS json FROM a""",
    "copy_check": """
WITH c AS (SELECT run_id, epoch, edge, seq, count(*) AS copies, count(DISTINCT {'a': stream, 'b': tov_start_ns, 'c': tov_end_ns, 'd': outcome, 'e': payload_bytes, 'f': storage_id}) AS contents FROM evidence GROUP BY ALL)
SELECT run_id, epoch, edge, seq, copies, contents = 1 AS alike FROM c WHERE copies > 1""",
    "slowest_answer": _ROWS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY run_id, epoch ORDER BY measurement_age_ns DESC, seq) AS i FROM e WHERE edge = 'state->sink' AND measurement_age_ns IS NOT NULL)
SELECT run_id, epoch, seq, measurement_age_ns, queue_wait_ns FROM r WHERE i = 1""",
    "chain_shrink": _ROWS
    + """, c AS (SELECT run_id, epoch, sum(payload_bytes) FILTER (edge = 'velo->reduce')::BIGINT AS sweep_bytes, sum(payload_bytes) FILTER (edge = 'det->detect')::BIGINT AS cloud_bytes,
  sum(payload_bytes) FILTER (edge = 'state->sink')::BIGINT AS answer_bytes FROM e GROUP BY run_id, epoch)
SELECT *, round(answer_bytes / nullif(sweep_bytes, 0), 9) AS shrink FROM c""",
    "health_events": _ROWS
    + """, k AS (SELECT run_id, epoch, edge, seq, CASE WHEN outcome IN ('DroppedOldest', 'DroppedNewest') THEN 'shed' WHEN outcome = 'Timeout' THEN 'blocked' WHEN reason = 'deadline_skipped' THEN 'skipped' WHEN outcome = 'Missing' THEN 'error' END AS kind FROM e)
SELECT * FROM k WHERE kind IS NOT NULL""",
    "age_words": _ROWS
    + """, m AS (SELECT run_id, sum(measurement_age_ns) / count(measurement_age_ns) / 1e6 AS ms FROM e WHERE edge = 'state->sink' GROUP BY run_id)
SELECT run_id, CASE WHEN ms IS NULL OR isnan(ms) THEN 'unknown' WHEN ms >= 1000 THEN round(ms / 1000)::BIGINT || ' s' ELSE round(ms)::BIGINT || ' ms' END AS age FROM m""",
}
