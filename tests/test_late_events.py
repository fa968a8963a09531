import random

from helmsway.operators import late_events as le

S = le.NS
COLUMNS = "k string, seq bigint, event_ns bigint, due_ns bigint, arrival_ns bigint"


def samples(n=400, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        event = 5 * S + r.randrange(20 * S)
        due = event + r.randrange(S // 10)
        arrival = due + int(r.expovariate(1.2) * S) // 10**8 * 10**8
        out.append((r.choice(["a", "a", "a", None]), i, event, None if r.random() < 0.1 else due, None if r.random() < 0.02 else arrival))
    return out


def brute(rows):
    fates = {}
    for k, seq, event, due, arrival in rows:
        if arrival is None:
            fates[seq] = None
            continue
        later = any(l == k and a is not None and a < arrival and e // S > event // S for l, _, e, _, a in rows)
        fates[seq] = "too_late" if due is not None and arrival - due > 2 * S else "corrects" if later else "in_time"
    return fates


def test_fates_equal_brute_force(spark):
    rows = samples()
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["seq"]: r["fate"] for r in le.kslack(df, ["k"], chunk_ns=3 * S).collect()}
    want = brute(rows)
    assert got == want and set(want.values()) == {"too_late", "corrects", "in_time", None}


def test_samples_merge_copies_and_skip_missing(spark):
    rows = [("a", 1, 5 * S, 1, 30), ("a", 1, 5 * S, 1, 20), ("a", 2, 0, 1, 5), ("a", 3, None, 1, 5), ("a", 4, 6 * S, None, None)]
    df = spark.createDataFrame(rows, "k string, seq bigint, tov bigint, due bigint, arr bigint").selectExpr("*", "'x' AS fate", "1 AS event_ns")
    got = le.samples_of(df, ["k"], "seq", "tov", "due", "arr").orderBy("seq").collect()
    assert [(r["seq"], r["event_ns"], r["arrival_ns"]) for r in got] == [(1, 5 * S, 20), (4, 6 * S, None)]


def test_periods_add_up(spark):
    rows = samples(seed=9)
    fated = le.kslack(spark.createDataFrame(rows, COLUMNS), ["k"])
    periods = le.period_versions(fated, ["k"], "seq").collect()
    assert sum(p["n_final"] + p["n_too_late"] for p in periods) == sum(r[4] is not None for r in rows)
    assert all(p["n_final"] == p["n_provisional"] + p["n_corrections"] for p in periods)
    for p in periods:
        kept = sorted(r.event_ns for r in fated.where("fate <> 'too_late'").collect() if r.k == p["k"] and r.period == p["period"]) if p["n_final"] > 1 else []
        if kept:
            assert p["max_step_ns"] == max(b - a for a, b in zip(kept, kept[1:])) and p["first_event_ns"] == kept[0]
            break


def test_equal_arrivals_do_not_see_one_another(spark):
    df = spark.createDataFrame([("a", 1, 9 * S, None, 100), ("a", 2, 5 * S, None, 100), ("a", 3, 5 * S, None, 101)], COLUMNS)
    assert {r["seq"]: r["fate"] for r in le.kslack(df, ["k"]).collect()} == {1: "in_time", 2: "in_time", 3: "corrects"}


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert le.period_versions(le.kslack(empty, ["k"]), ["k"], "seq").count() == 0
    df = spark.createDataFrame([("a", 1, S, 1, 1, "p", 7, 8)], COLUMNS + ", fate string, period int, _part int")
    assert le.kslack(df, ["k"]).select("fate", "_part").collect() == [("in_time", 8)]


def streamed(spark, tmp_path, rows, parts=4):
    """Rows of the streaming form; the input ends with a heartbeat."""
    from helmsway.streaming.late_events import kslack_stream
    from helmsway.streaming.tracks import read_replay, write_replay

    end = max(r[4] for r in rows) + 3600 * S
    beats = [("beat", None, None, None, end), ("beat", None, None, None, end + S)]
    df = spark.createDataFrame(rows, COLUMNS)
    write_replay(df, str(tmp_path / "in"), "arrival_ns", parts)
    query = None
    for n, more in enumerate((None, beats[:1], beats[1:])):
        if more:
            spark.createDataFrame(more, COLUMNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = kslack_stream(read_replay(spark, str(tmp_path / "in"), df.schema), ["k"])
        sink = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
        query = sink.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).toPandas()
    return out[out.k.isna() | (out.k != "beat")]


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = [r for r in samples(seed=5) if r[4] is not None]
    df = spark.createDataFrame(rows, COLUMNS)
    copies = [(*r[:4], r[4] + S) for r in rows[::7]]
    out = streamed(spark, tmp_path, rows + copies)
    fated = le.kslack(df, ["k"])
    told = out[out.kind == "sample"]
    assert len(told) == len(rows) and dict(zip(told.seq.astype(int), told.fate)) == {r["seq"]: r["fate"] for r in fated.collect()}
    final = {(r["k"], r["period"]): (r["n_final"], r["first_event_ns"], r["last_event_ns"], r["max_step_ns"]) for r in le.period_versions(fated, ["k"], "seq").collect() if r["n_final"]}
    closed = {}
    for r in out[out.kind == "closed"].itertuples():
        key = (None if r.k != r.k else r.k, int(r.period))
        if key not in closed or closed[key][0] < r.n:
            closed[key] = tuple(None if x != x else int(x) for x in (r.n, r.first_event_ns, r.last_event_ns, r.max_step_ns))
    assert closed == final
    published = out[out.kind == "published"].groupby(["k", "period"], dropna=False).n.max()
    assert len(published) and all(n <= final[(None if k != k or k is None else k, int(p))][0] for (k, p), n in published.items())


def test_the_first_arrival_of_copies_counts_in_a_stream(spark, tmp_path):
    rows = [("a", 1, 5 * S, 5 * S, 6 * S), ("a", 1, 5 * S, 5 * S, 30 * S), ("a", 2, 9 * S, 9 * S, 9 * S), ("a", 3, 5 * S, 5 * S, 40 * S)]
    out = streamed(spark, tmp_path, rows, 2)
    assert {(int(r.seq), r.fate) for r in out[out.kind == "sample"].itertuples()} == {(1, "in_time"), (2, "in_time"), (3, "too_late")}
    assert {(int(r.period), int(r.n)) for r in out[out.kind == "closed"].itertuples()} == {(5, 1), (9, 1)}
