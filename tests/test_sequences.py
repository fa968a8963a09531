"""Slots, deadlines and lanes by hand."""

import random
import threading

from conftest import SMALL
from pyspark.sql import functions as F

from helmsway.operators import sequences
from helmsway.plans import streams

ROWS = [("d", 1, 100), ("d", 1, 90), ("d", 2, None), ("d", 4, 150), ("d", 5, None), ("n", 1, None)]


def slots(spark, others=None):
    df = spark.createDataFrame(ROWS, "drive string, seq bigint, due bigint")
    periods = spark.createDataFrame([("d", 10), ("n", 10)], "drive string, period_ns bigint")
    return {(r["drive"], r["seq"]): (r["due"], r["present"]) for r in sequences.all_slots(df, ["drive"], "seq", "due", periods, 3, others).collect()}


def test_sweeps_without_a_due_time_are_present(spark):
    assert slots(spark) == {
        ("d", 0): (80, False), ("d", 1): (90, True), ("d", 2): (110, True), ("d", 3): (130, False), ("d", 4): (150, True), ("d", 5): (160, True),
        ("n", 0): (None, False), ("n", 1): (None, True),
    }


def test_slots_reach_to_the_end_of_the_longest_stream(spark):
    others = spark.createDataFrame([("d", 7), ("n", 0), ("other", 9)], "drive string, seq bigint")
    assert slots(spark, others) == slots(spark) | {("d", 6): (170, False), ("d", 7): (180, False)}


def test_period_is_the_drives_own(spark, tmp_path):
    times = "tov_start_ns bigint, tov_end_ns bigint, trigger_ns bigint, due_ns bigint, arrival_ns bigint"
    sweeps = [(d, i, i * p, i * p + p, i * p, i * p, i * p) for d, p in (("a", 97), ("b", 110)) for i in (1, 2, 3)]
    spark.createDataFrame(sweeps, f"drive string, seq bigint, {times}").write.parquet(f"{tmp_path}/sweeps.parquet")
    spark.createDataFrame([("a", 4), ("b", 2)], "drive string, seq bigint").write.parquet(f"{tmp_path}/frames.parquet")
    assert {tuple(r) for r in streams.absent_deadlines(spark, str(tmp_path)).collect()} == {("a", 0, 0), ("b", 0, 0), ("a", 4, 4 * 97)}
    assert {r["drive"]: r["skip_at_ns"] for r in streams.skip_deadlines(spark, str(tmp_path)).where("seq = 3").collect()} == {"a": 4 * 97, "b": 4 * 110}


def test_every_sweep_has_a_row(spark):
    here = {tuple(r) for r in streams.sweeps(spark, SMALL).select("drive", "seq").collect()}
    present = {(r["drive"], r["seq"]) for r in streams.drive_slots(spark, SMALL).where("outcome = 'Present'").collect()}
    assert present == here == {tuple(r) for r in streams.skip_deadlines(spark, SMALL).select("drive", "seq").collect()}
    assert not here & {tuple(r) for r in streams.absent_deadlines(spark, SMALL).select("drive", "seq").collect()}


FAR = 2**33  # Numbers lie further apart than an array is long


def recorded(spark, folder, sweeps, frames):
    """A drive's tables, of sweeps (seq, due_ns) that arrive 5 ns late, and frames."""
    times = "tov_start_ns bigint, tov_end_ns bigint, trigger_ns bigint, due_ns bigint, arrival_ns bigint"
    rows = [("d", no, 100 * i, 100 * i + 100, 100 * i, due, None if due is None else due + 5) for i, (no, due) in enumerate(sweeps)]
    spark.createDataFrame(rows, f"drive string, seq bigint, {times}").write.parquet(f"{folder}/sweeps.parquet")
    spark.createDataFrame([("d", no) for no in frames], "drive string, seq bigint").write.parquet(f"{folder}/frames.parquet")
    return str(folder)


def interpolated(no, a, b):
    (n, start), (m, end) = a, b
    return start + abs((end - start) * (no - n)) // (m - n) * (1 if end >= start else -1)


def test_runs_of_any_length_are_told_number_by_number(spark, monkeypatch):
    monkeypatch.setattr(sequences, "PIECE", 3)
    runs = [(i, low, low + n - 1) for i, (low, n) in enumerate([(0, 1), (5, 0), (7, 3), (10, 4), (0, 27), (3, 28), (100, 200), (9, -3)])]
    got = sequences.each_number(spark.createDataFrame(runs, "run int, low bigint, high bigint"), "low", "high", "no").collect()
    assert sorted(map(tuple, got)) == [(i, no) for i, low, high in runs for no in range(low, high + 1)]


def test_deadlines_between_far_slots_are_exact(spark):
    for a, b in (((0, 0), (10, 15 * 10**17)), ((3, 15 * 10**17), (10, -7)), ((7, 1), (2**31 + 9, 9 * 10**18)), ((1, 9 * 10**18), (2**62, 5)), ((0, -5), (2**60, 4))):
        numbers = sorted({a[0] + 1, a[0] + 2, (a[0] + b[0]) // 2, b[0] - 1, b[0]})
        df = spark.createDataFrame([(no, a, b, 10) for no in numbers], "no bigint, a struct<no bigint, due bigint>, b struct<no bigint, due bigint>, period bigint")
        got = [r[0] for r in df.select(sequences.deadline(df["no"], "a", "b", df["period"])).collect()]
        assert got == [interpolated(no, a, b) for no in numbers], (a, b)


def test_deadlines_by_the_period_that_are_no_bigint_are_null(spark):
    df = spark.createDataFrame([(5, (3, 100), None, 10), (2**62, (3, 100), None, 10), (5, None, (7, 100), 10), (0, None, (2**62, 100), 10)], "no bigint, a struct<no bigint, due bigint>, b struct<no bigint, due bigint>, period bigint")
    assert [r[0] for r in df.select(sequences.deadline(df["no"], "a", "b", df["period"])).collect()] == [120, None, 80, None]


def test_absent_deadlines_over_a_long_run(spark, tmp_path):
    d = recorded(spark, tmp_path, [(0, 0), (FAR, 9 * 10**18)], [3])
    got = {r["seq"]: r["deadline_ns"] for r in streams.absent_deadlines(spark, d).limit(50).collect()}
    assert len(got) == 50 and all(0 < no < FAR and due == interpolated(no, (0, 0), (FAR, 9 * 10**18)) for no, due in got.items())


def test_drive_slots_over_long_runs(spark, tmp_path):
    d = recorded(spark, tmp_path, [(0, 0), (1, None), (FAR, 9 * 10**18)], [2 * FAR])
    got = {r["seq"]: tuple(r)[2:] for r in streams.drive_slots(spark, d).limit(50).collect()}
    due = lambda no: interpolated(no, (0, 0), (FAR, 9 * 10**18)) if no <= FAR else None if 9 * 10**18 + (no - FAR) * 100 >= 2**63 else 9 * 10**18 + (no - FAR) * 100
    assert len(got) == 50
    assert got == {no: (due(no), *(("Present", None) if no in (0, 1, FAR) else ("Missing", "absent_in_source"))) for no in got}


def promptly(spark, df, n, seconds=90):
    """The first ``n`` rows; an error if they don't come in so many seconds."""
    stop = threading.Timer(seconds, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        return df.limit(n).collect()
    finally:
        stop.cancel()


def test_runs_are_shared_out_in_few_pieces(spark, monkeypatch):
    monkeypatch.setattr(sequences, "PIECE", 3)
    runs = [(i, low, low + n - 1) for i, (low, n) in enumerate([(0, 1), (5, 0), (7, 3), (10, 4), (0, 27), (3, 28), (100, 500), (9, -3)])]
    df = spark.createDataFrame([*runs, (8, 0, 2**63 - 1), (9, 2**62, 2**63 - 1)], "run int, low bigint, high bigint")
    pieces = sequences.shared_out(df.where("low <= high"), "low", "high", 4)
    told = {r[0]: tuple(r)[1:] for r in pieces.groupBy("run").agg(F.min("low"), F.max("high"), F.count("*")).collect()}
    assert all(n <= 4 * sequences.SHARES + 1 for *_, n in told.values()) and told[8][:2] == (0, 2**63 - 1) and told[9][:2] == (2**62, 2**63 - 1)
    got = sequences.each_number(df.where("run < 8"), "low", "high", "no").collect()
    assert sorted(map(tuple, got)) == [(i, no) for i, low, high in runs for no in range(low, high + 1)]


def test_drive_slots_come_at_once_however_far_apart(spark, tmp_path):
    far = 2**52
    d = recorded(spark, tmp_path, [(0, 0), (1, None), (far, 9 * 10**18)], [3])
    got = {r["seq"]: tuple(r)[2:] for r in promptly(spark, streams.drive_slots(spark, d), 50)}
    told = lambda no: ("Present", None) if no in (0, 1, far) else ("Missing", "absent_in_source")
    assert len(got) == 50 and got == {no: (interpolated(no, (0, 0), (far, 9 * 10**18)), *told(no)) for no in got}


def test_skip_deadlines_make_no_absent_slots(spark, tmp_path):
    far = 2**50
    d = recorded(spark, tmp_path, [(0, 10), (1, 30), (far, 10**15), (far + 1, None), (2 * far, 10**15 + 7 * far), (2 * far + 1, None)], [5 * far])
    end = 10**15 + 7 * far
    assert {r["seq"]: (r["skip_at_ns"], r["skipped"]) for r in streams.skip_deadlines(spark, d).collect()} == {
        0: (30, False), 1: (10**15, False), far: (10**15 + 7, False), far + 1: (end, None), 2 * far: (end + 100, False), 2 * far + 1: (end + 200, None),
    }


def test_dense_slots_over_a_long_run(spark, tmp_path):
    d = recorded(spark, tmp_path, [(0, 0), (1, None), (FAR, 9 * 10**18)], [3])
    got = {r["seq"]: tuple(r)[2:] for r in streams.dense_slots(spark, d).where("seq > 0").limit(50).collect()}
    told = lambda no: (9 * 10**18, "Present", None) if no == FAR else (interpolated(no, (0, 0), (FAR, 9 * 10**18)), "Missing", "absent_in_source")
    assert len(got) == 50 and got == {no: told(no) for no in got}


def test_interpolated_deadlines_over_a_long_run(spark, tmp_path):
    d = recorded(spark, tmp_path, [(2, 0), (FAR, 9 * 10**18)], [3])
    got = {r["seq"]: r["deadline_ns"] for r in streams.interpolate_deadline(spark, d).limit(50).collect()}
    told = lambda no: -(2 - no) * streams.PERIOD_NS if no < 2 else interpolated(no, (2, 0), (FAR, 9 * 10**18))
    assert len(got) == 50 and got == {no: told(no) for no in got} and not {2, FAR} & set(got)


def test_interpolated_deadlines_come_at_once_however_far_apart(spark, tmp_path):
    far = 2**52
    d = recorded(spark, tmp_path, [(0, 0), (far, 9 * 10**18)], [3])
    got = {r["seq"]: r["deadline_ns"] for r in promptly(spark, streams.interpolate_deadline(spark, d), 50)}
    assert len(got) == 50 and got == {no: interpolated(no, (0, 0), (far, 9 * 10**18)) for no in got} and not {0, far} & set(got)


def fold(events, hold):
    """The lane row by row: holds the worst, steps down after so many quiet rows, and starts the count again."""
    state, quiet, lesser, out = 0, 0, 0, []
    for e in events:
        if e and e >= state:
            state, quiet, lesser = e, 0, 0
        else:
            lesser, quiet = max(lesser, e), quiet + 1
            if state and quiet >= hold:
                state, quiet, lesser = lesser, 0, 0
        out.append(state)
    return out


def test_a_lane_holds_its_worst_and_counts_again(spark, monkeypatch):
    from helmsway.operators import scan

    r = random.Random(1)
    lanes = {"a": [2, 1] + [0] * 28, "b": [r.choice([0] * 12 + [1, 2]) for _ in range(400)], "c": [r.choice([0] * 6 + [1, 1, 2, 3]) for _ in range(300)], "d": [0]}
    rows = [(k, i, s) for k, v in lanes.items() for i, s in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, i bigint, s int")
    assert fold(lanes["a"], 10)[9:21] == [2] + [1] * 10 + [0]
    for size in (4096, 64):
        monkeypatch.setattr(scan.in_blocks, "__defaults__", (size,))
        for k, hold in (("a", 10), ("b", 10), ("c", 4), ("d", 10)):
            got = sequences.held_worst(df.where(f"k = '{k}'"), ["k"], "i", "s", hold, worst=3).orderBy("i").collect()
            want = fold(lanes[k], hold)
            assert [x["held"] for x in got] == want and [x["was"] for x in got] == [None, *want[:-1]]
