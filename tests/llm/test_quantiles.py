import numpy as np
import pytest
from conftest import SMALL
from oracle import same

from helmsway.llm import queries
from helmsway.llm import quantiles as Q


def exact(v, p):
    v = np.sort(v)
    return int(v[max(1, -(-p * len(v) // 100)) - 1])


@pytest.mark.parametrize("kind", ["lognormal", "uniform", "ties", "negative", "huge", "small"])
def test_estimates_lie_in_certain_bounds(kind):
    r = np.random.default_rng(1)
    v = {
        "lognormal": r.lognormal(9, 2, 200_000), "uniform": r.integers(0, 10**9, 200_000), "ties": r.choice([0, 5, 5, 900], 50_000),
        "negative": r.normal(0, 10_000, 100_000), "huge": r.integers(2**61, 2**62, 1000), "small": np.array([3]),
    }[kind].astype(np.int64)
    sketch = np.zeros(Q.SIZE, np.int64)
    for part in np.array_split(v, 7):
        Q.add(sketch, Q.encode(part))
    for p in (1, 50, 95, 99, 100):
        estimate, low, high, rank, below = Q.quantiles(sketch, (p,))[0]
        true = exact(v, p)
        assert low <= true <= high and below == (v < low).sum() and rank == max(1, -(-p * len(v) // 100))
        assert low <= estimate <= high
        assert (high - low) <= 0.02 * abs(true) + 1 and abs(estimate - true) <= 0.02 * abs(true) + 1


def test_merging_and_taking_out():
    r = np.random.default_rng(2)
    a, b = r.integers(0, 10**6, 5000), r.integers(0, 10**6, 3000)
    one, two, both = (np.zeros(Q.SIZE, np.int64) for _ in range(3))
    Q.add(one, Q.encode(a))
    Q.add(two, Q.encode(b))
    Q.add(both, Q.encode(np.r_[a, b]))
    assert (one + two == both).all()
    Q.add(both, Q.encode(b), weight=-1)
    assert (both == one).all() and (Q.unpack(Q.pack(one)) == one).all()
    assert Q.quantiles(np.zeros(Q.SIZE, np.int64), (50,)) == []


def test_codes_keep_the_order():
    v = np.unique(np.r_[np.arange(-5000, 5000), [2**k + d for k in range(12, 62) for d in (-1, 0, 1)], [-(2**k) for k in range(12, 62)], [2**63 - 1]]).astype(np.int64)
    c = Q.encode(v)
    assert (np.diff(c) >= 0).all() and c.min() >= 0 and c.max() < 1 << Q.BITS
    low, high = Q.decode(c)
    assert ((low <= v) & (v <= high)).all()


def test_bounds_and_estimates_come_from_the_signed_levels():
    v = np.random.default_rng(3).lognormal(10, 1.5, 300_000).astype(np.int64)
    sketch = np.zeros(Q.SIZE, np.int64)
    Q.add(sketch, Q.encode(v))
    bare = sketch.copy()
    bare[Q.PLAIN :] = 0
    for p, with_, none in zip((50, 95, 99), Q.quantiles(sketch, (50, 95, 99)), Q.quantiles(bare, (50, 95, 99))):
        true = exact(v, p)
        assert abs(with_[0] / true - 1) < 0.01 and with_[2] - with_[1] < 0.02 * true < 0.1 * true < none[2] - none[1]
    assert Q.known(sketch)[0] < Q.EXACT == Q.known(bare)[0] and Q.SIZE < 1e-5 * 2**Q.BITS


def test_more_nodes_than_a_level_can_tell_are_estimated():
    v = np.random.default_rng(4).integers(2**20, 2**62, 3_000) >> np.random.default_rng(5).integers(0, 40, 3_000)
    sketch = np.zeros(Q.SIZE, np.int64)
    Q.add(sketch, Q.encode(v))
    level, nodes, counts = Q.known(sketch)
    assert 0 < level < Q.EXACT and counts.sum() == len(v) and (counts > 0).all()
    assert dict(zip(nodes.tolist(), counts.tolist())) == dict(zip(*(x.tolist() for x in np.unique(Q.encode(v) >> level, return_counts=True))))


def test_days_are_kept_combined_and_taken_out(spark, tmp_path):
    r = np.random.default_rng(6)
    rows = [(f"d{i % 5}", "x", int(r.integers(1, 10**6))) for i in range(2000)]
    df = spark.createDataFrame(rows, "day string, edge string, v bigint")
    folder = str(tmp_path / "sketches")
    Q.keep(Q.merge(Q.sketches(df, ["day", "edge"], ["v"]), ["day", "edge"]), folder, "day")
    Q.keep(Q.merge(Q.sketches(df.where("day = 'd1'"), ["day", "edge"], ["v"]), ["day", "edge"]), folder, "day")
    days = spark.read.parquet(folder)
    assert days.count() == 5
    whole = Q.merge(days, ["edge"])
    rest = Q.without(whole, days.where("day = 'd2'").drop("day"), ["edge"])
    for merged, kept in ((whole, rows), (rest, [x for x in rows if x[0] != "d2"])):
        for got in Q.invert(merged, ["edge"], (50, 99)).collect():
            assert got["n"] == len(kept) and got["low"] <= exact([x[2] for x in kept], got["percent"]) <= got["high"]
    assert Q.without(whole, whole, ["edge"]).count() == 0


def test_frames_with_nulls_and_clashing_names(spark):
    rows = [("a", 1, None, 5, "x"), ("a", 3, None, 5, "x"), (None, 7, 2, 5, "x"), (None, None, None, 5, "x")]
    df = spark.createDataFrame(rows, "day string, v bigint, w bigint, k0 int, metric string")
    got = Q.invert(Q.merge(Q.sketches(df, ["day"], ["v", "w"]), ["day"]), ["day"], (50,)).collect()
    assert {(r["day"], r["metric"], r["n"], round(r["estimate"])) for r in got} == {("a", "v", 2, 1), (None, "v", 1, 7), (None, "w", 1, 2)}
    assert Q.invert(Q.merge(Q.sketches(df.limit(0), ["day"], ["v"]), ["day"]), ["day"]).count() == 0


def test_salted_parts_give_the_same(spark, monkeypatch):
    whole = queries.p3_percentiles(spark, SMALL).toPandas()
    monkeypatch.setattr(queries, "PART_ROWS", 7)
    assert same(queries.p3_percentiles(spark, SMALL).toPandas(), whole) == ""


def test_found(spark, duck):
    got = queries.p3_found(spark, SMALL).toPandas()
    assert len(got) and same(got, duck.sql(queries.SQL["p3_found"]).df()) == ""


def test_the_sketch_decides_nearly_all_figures(spark):
    medium = "/root/testdata/sf0.01"
    verdicts = {r["verdict"]: r["count"] for r in queries._verdicts(spark, medium).groupBy("verdict").count().collect()}
    assert verdicts.get("open", 0) <= 0.1 * sum(verdicts.values()) and verdicts["off"] > 5


def test_combined_days(spark, duck):
    got = queries.p3_combined(spark, SMALL).toPandas()
    assert len(got) and same(got, duck.sql(queries.SQL["p3_combined"]).df()) == ""
