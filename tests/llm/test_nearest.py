import random

from conftest import SMALL
from oracle import same

from helmsway.llm import nearest, queries


def brute(left, right, tol):
    out = []
    for k, i, t in left:
        near = sorted((abs(t - r), r, s) for key, s, r in right if key == k and k is not None and t is not None and r is not None and abs(t - r) <= tol)
        if near:
            out.append((k, i, near[0][2]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        tol = r.choice([3, 10, 40])
        pick = lambda n: r.choice([None, *[r.randrange(-200, 800)] * 12])
        left = [(r.choice(["a", "a", "b", None]), i, pick(0)) for i in range(150)]
        right = [(r.choice(["a", "a", "b", None]), i, pick(0)) for i in range(120)]
        right += right[:20]
        l = spark.createDataFrame(left, "drive string, i bigint, t bigint").selectExpr("*", "1 AS _bucket", "2 AS _value", "3 AS m")
        rr = spark.createDataFrame(right, "drive string, s bigint, t bigint").selectExpr("*", "1 AS at", "5 AS value")
        got = nearest.match_nearest(l, rr, ["drive"], "t", "t", "s", tol, "m")
        assert sorted(((x["drive"], x["i"], x["m"]) for x in got.collect()), key=repr) == brute(left, right, tol)


def test_intervals_do_not_depend_on_chunks(spark):
    r = random.Random(5)
    df = spark.createDataFrame([("a", i, r.randrange(10_000)) for i in range(300)], "k string, s bigint, t bigint")
    one = nearest.nearest_intervals(df, ["k"], "t", "s", 30, chunk_ns=10**9).toPandas()
    assert same(nearest.nearest_intervals(df, ["k"], "t", "s", 30, chunk_ns=100).toPandas(), one) == ""


def test_wide_tolerances_match_once(spark):
    l = spark.createDataFrame([("a", 1, 110 * nearest.NS)], "k string, i int, t bigint")
    rr = spark.createDataFrame([("a", 70, 70 * nearest.NS), ("a", 130, 130 * nearest.NS)], "k string, s int, t bigint")
    assert [(x["i"], x["m"]) for x in nearest.match_nearest(l, rr, ["k"], "t", "t", "s", 50 * nearest.NS, "m").collect()] == [(1, 130)]
    r = random.Random(8)
    left = [("a", i, r.randrange(900) * nearest.NS) for i in range(60)]
    right = [("a", i, r.randrange(900) * nearest.NS) for i in range(25)]
    l, rr = spark.createDataFrame(left, "drive string, i bigint, t bigint"), spark.createDataFrame(right, "drive string, s bigint, t bigint")
    for tol in (29, 31, 45, 200):
        got = nearest.match_nearest(l, rr, ["drive"], "t", "t", "s", tol * nearest.NS, "m")
        assert sorted(((x["drive"], x["i"], x["m"]) for x in got.collect()), key=repr) == brute(left, right, tol * nearest.NS)


def test_tie_goes_to_the_earlier_and_the_bound_counts(spark):
    l = spark.createDataFrame([("a", 1, 100), ("a", 2, 130), ("a", 3, 131)], "k string, i int, t bigint")
    r = spark.createDataFrame([("a", 9, 90), ("a", 8, 110)], "k string, s int, t bigint")
    assert {(x["i"], x["m"]) for x in nearest.match_nearest(l, r, ["k"], "t", "t", "s", 20, "m").collect()} == {(1, 9), (2, 8)}


def test_empty(spark):
    df = spark.createDataFrame([], "k string, i int, t bigint")
    assert nearest.match_nearest(df, df, ["k"], "t", "t", "i", 20, "m").count() == 0


def test_found(spark, duck):
    got = queries.p4_found(spark, SMALL).toPandas()
    assert len(got) and same(got, duck.sql(queries.SQL["p4_found"]).df()) == ""
