import itertools

import numpy as np

from helmsway.functions.hmm import posteriors
from helmsway.operators import readings

COLUMNS = "drive string, seq bigint, tov_ns bigint, vf double, vl double, yaw_rate double, scale double"


def series(n=600, seed=1):
    r = np.random.default_rng(seed)
    vf = 10 + np.cumsum(r.normal(0, 0.02, n)) + r.normal(0, 0.02, n)
    return vf, r.normal(0, 0.02, n), r.normal(0, 0.004, n)


def rows_of(vf, vl, yaw, drive="d"):
    return [(drive, i, 1_000_000_000 + i * 50_000_000, float(a), float(b), float(c), 0.0) for i, (a, b, c) in enumerate(zip(vf, vl, yaw))]


def flagged(spark, rows, **kw):
    df = spark.createDataFrame(rows, COLUMNS)
    return {(r["seq"], r["field_name"]): r["fault"] for r in readings.flag_readings(df, "drive", "seq", "tov_ns", ["vf", "vl", "yaw_rate"], **kw).collect()}


def test_forward_backward_in_chunks_equals_one_pass():
    r = np.random.default_rng(0)
    e = np.exp(r.normal(0, 1, (1000, 4)))
    m = np.repeat(readings.TRANSITION[None], 1000, axis=0) * np.exp(r.normal(0, 0.5, (1000, 4, 4)))
    m[[0, 400]] = readings.INITIAL
    many = posteriors([e[:0], e, e[:7]], [m[:0], m, m[:7]])
    p, steps = many[1]
    q, moves = posteriors([e], [m], chunk=2000)[0]
    assert [len(x[0]) for x in many] == [0, 1000, 7] and np.abs(p - q).max() < 1e-6 and np.abs(steps - moves).max() < 1e-6
    assert np.allclose(p.sum(axis=1), 1) and np.allclose(steps.sum(axis=1), p)


def test_forward_backward_equals_the_sum_over_all_paths():
    r = np.random.default_rng(1)
    e, m = r.random((5, 4)), r.random((5, 4, 4))
    m[0] = readings.INITIAL
    paths = {s: readings.INITIAL[s[0]] * np.prod([e[i, s[i]] for i in range(5)]) * np.prod([m[i, s[i - 1], s[i]] for i in range(1, 5)]) for s in itertools.product(range(4), repeat=5)}
    p = posteriors([e], [m])[0][0]
    for i in range(5):
        want = np.array([sum(x for s, x in paths.items() if s[i] == k) for k in range(4)]) / sum(paths.values())
        assert np.allclose(p[i], want)


def test_faults_are_found_and_true_readings_are_not(spark):
    vf, vl, yaw = series()
    vf[100] += 4
    vf[200:206] -= 6
    vl[300:312] = vl[300]
    yaw[400] = -327.68
    yaw[500:] += 0.5 * np.minimum(np.arange(100), 20) / 20  # builds up
    got = flagged(spark, rows_of(vf, vl, yaw))
    want = {(100, "vf"): "spike", (400, "yaw_rate"): "out_of_range"} | {(i, "vf"): "spike" for i in range(200, 206)} | {(i, "vl"): "stuck" for i in range(300, 312)}
    assert got == want


def test_nulls_nan_copies_and_missing_times(spark):
    vf, vl, yaw = series(seed=2)
    rows = rows_of(vf, vl, yaw)
    rows[50] = (*rows[50][:3], None, float("nan"), rows[50][5], 0.0)
    rows[60] = (*rows[60][:2], None, 1e6, *rows[60][4:])
    rows[70] = (*rows[70][:3], rows[70][3] + 5, *rows[70][4:])
    assert flagged(spark, rows + rows[65:75]) == {(70, "vf"): "spike"}


def test_standing_still_is_no_case(spark):
    n = 300
    vf, vl, yaw = series(n)
    vf[100:160], vl[100:160] = 0.0, 0.0
    vl[130] = 5.0  # a fault of one field makes no case of the other
    got = flagged(spark, rows_of(vf, vl, yaw))
    assert {k for k in got if 100 <= k[0] < 160} == {(130, "vl")}


def test_seven_equal_readings_are_no_case_eight_are(spark):
    vf, vl, yaw = series(seed=4)
    vl[50:57] = vl[50]
    yaw[90:98] = yaw[90]
    assert set(flagged(spark, rows_of(vf, vl, yaw))) == {(i, "yaw_rate") for i in range(90, 98)}


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    vf, vl, yaw = series(seed=6)
    for i in (62, 64, 127, 128, 300):
        vf[i] += 5
    vl[120:135] = vl[120]
    rows = rows_of(vf, vl, yaw)
    whole = flagged(spark, rows)
    monkeypatch.setattr(readings, "BLOCK", 128)
    assert flagged(spark, rows) == whole and len(whole) == 20


def test_leap_without_return_and_hole_in_time(spark):
    vf, vl, yaw = series(seed=7)
    vf[300:] += 8
    rows = [(*r[:2], r[2] + (10_000_000_000 if r[1] >= 300 else 0), *r[3:]) for r in rows_of(vf, vl, yaw)]
    assert flagged(spark, rows) == {}


def test_spikes_next_to_one_another(spark):
    vf, vl, yaw = series(seed=8)
    vf[100], vf[101] = vf[100] + 20, vf[101] - 30
    vf[200:210] += 7
    vf[210:218] -= 9
    vl[300] += 2
    vl[302] += 2
    assert set(flagged(spark, rows_of(vf, vl, yaw))) == {(i, "vf") for i in (100, 101, *range(200, 218))} | {(300, "vl"), (302, "vl")}


def test_long_standstill_in_any_blocks(spark, monkeypatch):
    n = 9000
    vf, vl, _ = series(n, seed=9)
    vf[:5000], vl[:5000] = 0.0, 0.0
    rows = rows_of(vf, vl, np.zeros(n))
    for block in (1024, 4096, 20_000):
        monkeypatch.setattr(readings, "BLOCK", block)
        assert set(flagged(spark, rows)) == {(i, "yaw_rate") for i in range(5000, n)}


def test_a_mostly_missing_field_in_any_blocks(spark, monkeypatch):
    vf, vl, yaw = series(3000, seed=10)
    vl[np.random.default_rng(3).random(3000) < 0.93] = np.nan
    at = np.flatnonzero(np.isfinite(vl))
    vl[at[[40, 41, 100]]] += 3
    rows = rows_of(vf, vl, yaw)
    whole = flagged(spark, rows)
    monkeypatch.setattr(readings, "BLOCK", 330)
    assert flagged(spark, rows) == whole == {(int(i), "vl"): "spike" for i in at[[40, 41, 100]]}


def test_the_model_decides():
    vf, _, _ = series(seed=11)
    vf[[100, 101, 200]] += 5
    seen = readings._observed(np.arange(600) * 50_000_000, vf, np.zeros(600, bool), 0.02, (-60.0, 100.0), 10**9)
    e, m = readings._likelihoods(seen, np.zeros(readings.COUNTS))
    p = posteriors([e], [m])[0][0]
    assert np.flatnonzero(p[:, readings.NORMAL] < 0.5).tolist() == [100, 101, 200]
    blind = posteriors([np.ones_like(e)], [np.where(seen["anew"][:, None, None], readings.INITIAL, readings.TRANSITION)])[0][0]
    assert (blind[:, readings.NORMAL] > 0.5).all()


def test_each_source_is_judged_by_its_own_normal(spark):
    vf, vl, yaw = series(seed=12)
    r = np.random.default_rng(13)
    rough = vf + r.normal(0, 1, vf.size)
    vf[300] += 1.5
    rough[300] = (rough[299] + rough[301]) / 2 + 1.5
    got = flagged(spark, rows_of(vf, vl, yaw, "smooth"))
    assert set(got) == {(300, "vf")} and flagged(spark, rows_of(rough, vl, yaw, "rough")) == {}


def test_empty_and_single(spark):
    assert flagged(spark, []) == {}
    assert flagged(spark, [("d", 1, 5, 1.0, None, 1e6, 0.0)]) == {(1, "yaw_rate"): "out_of_range"}
    assert flagged(spark, [(None, None, 5, 500.0, 0.0, 0.0, 0.0)]) == {(None, "vf"): "out_of_range"}
