import random

import pytest

from helmsway.operators import scan


def frame(spark, n=300, seed=0):
    r = random.Random(seed)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(-50, 50)]), r.choice([None, *range(10)]), i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o bigint, v bigint, _part int")


@pytest.mark.parametrize("how,fn", [("sum", sum), ("max", max), ("min", min)])
@pytest.mark.parametrize("strict", [True, False])
def test_running_equals_brute_force(spark, how, fn, strict):
    rows, df = frame(spark)
    got = {r["_part"]: r["out"] for r in scan.running(df, ["k"], "o", "v", "out", chunk=7, how=how, strict=strict).collect()}
    assert len(got) == len(rows)
    for k, o, v, i in rows:
        seen = [w for l, p, w, _ in rows if l == k and w is not None and p is not None and o is not None and (p < o or p == o and not strict)]
        assert got[i] == (fn(seen) if seen else None)


def test_numbered(spark):
    rows, df = frame(spark, seed=1)
    got = {r["_part"]: r["no"] for r in scan.numbered(df, ["k"], "o", ["_part"], "no", chunk=7).collect()}
    for key in ("a", "b", None):
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        assert [got[r[3]] for r in mine] == list(range(len(mine)))


def test_blocks_see_the_rows_before(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").alias("o"))
    w = Window.partitionBy("k", "_block").orderBy("_no").rowsBetween(-3, 0)
    got = scan.in_blocks(df, ["k"], "o", [], 3, chunk=100, size=16).withColumn("n", F.sum("o").over(w)).where("_home")
    assert {r["o"]: r["n"] for r in got.collect()} == {i: sum(range(max(0, i - 3), i + 1)) for i in range(1000)}


def test_floor_div_below_zero(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(-7,), (7,), (-10,), (None,)], "v bigint")
    assert [r[0] for r in df.select(scan.floor_div(F.col("v"), 5)).collect()] == [-2, 1, -2, None]


def test_empty(spark):
    df = spark.createDataFrame([], "k string, o bigint, v bigint")
    assert scan.running(df, ["k"], "o", "v", "out", 10).count() == 0
    assert scan.numbered(df, ["k"], "o", [], "no", 10).count() == 0
