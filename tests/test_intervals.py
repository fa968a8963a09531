import random

from helmsway.operators import intervals

COLUMNS = "k string, s bigint, e bigint"


def brute(rows):
    """Covered periods of each key, merged where they touch."""
    out = {}
    for k in {r[0] for r in rows}:
        merged = []
        for s, e in sorted((s, e) for key, s, e in rows if key == k and s and e and e > s):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out[k] = merged
    return out


def case(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(200):
        s = r.randrange(1, 3000)
        rows.append((r.choice(["a", "a", None]), r.choice([None, 0, s, s, s, s, s]), r.choice([None, s - 1, s, s + r.randrange(30), s + r.randrange(30), s + r.randrange(200)])))
    return rows + rows[:20]


def test_against_brute_force(spark):
    for seed in range(3):
        rows = case(seed)
        swept = intervals.swept(spark.createDataFrame(rows, COLUMNS), ["k"], "s", "e", chunk_ns=97).cache()
        want = brute(rows)
        periods = {}
        for r in intervals.covered(swept, ["k"], chunk_ns=97).collect():
            periods.setdefault(r["k"], []).append([r["start_ns"], r["end_ns"]])
        assert {k: sorted(v) for k, v in periods.items()} == {k: v for k, v in want.items() if v}
        holes = {(r["k"], r["gap_start_ns"], r["gap_end_ns"]) for r in intervals.gaps(swept, ["k"]).collect()}
        assert holes == {(k, a[1], b[0]) for k, v in want.items() for a, b in zip(v, v[1:])}


def test_limits_are_strict(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 7, 8), ("a", 14, 15)], COLUMNS)
    swept = intervals.swept(df, ["k"], "s", "e")
    assert [(r[1], r[2]) for r in intervals.gaps(swept, ["k"], longer_than=5).collect()] == [(8, 14)]
    assert [(r[1], r[2]) for r in intervals.gaps(swept, ["k"], shorter_than=6).collect()] == [(2, 7)]


def test_nested_and_touching_leave_no_hole(spark):
    df = spark.createDataFrame([("a", 1, 10), ("a", 2, 3), ("a", 10, 12), ("a", 10, 12)], COLUMNS)
    swept = intervals.swept(df, ["k"], "s", "e").cache()
    assert intervals.gaps(swept, ["k"]).count() == 0
    assert [(r["start_ns"], r["end_ns"], r["max_active"]) for r in intervals.covered(swept, ["k"]).collect()] == [(1, 12, 2)]


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert intervals.covered(intervals.swept(empty, ["k"], "s", "e"), ["k"]).count() == 0
    df = spark.createDataFrame([("a", 1, 2, 5, 6), ("a", 4, 5, 5, 6)], COLUMNS + ", at bigint, delta bigint")
    assert intervals.gaps(intervals.swept(df, ["k"], "s", "e"), ["k"]).collect() == [("a", 2, 4)]
