import random

from pyspark.sql import functions as F

from helmsway.llm import packing

COLUMNS = "doc_id bigint, source string, n_tokens bigint"


def items(n=3000, seed=1):
    r = random.Random(seed)
    weights = [("a", 6), ("b", 3), (None, 1)]
    return [(i, r.choices([w[0] for w in weights], [w[1] for w in weights])[0], r.choice([0, None, int(r.expovariate(1 / 300)), int(r.expovariate(1 / 300)), 10_000 if r.random() < 0.01 else 50])) for i in range(n)]


def check(rows, packed, capacity):
    want = {i: (s, n or 0) for i, s, n in rows}
    got, load = {}, {}
    for p in packed:
        assert p["source"] == want[p["doc_id"]][0] and 0 <= p["place"] and p["place"] + p["piece_size"] <= capacity
        got.setdefault(p["doc_id"], []).append((p["piece"], p["piece_size"]))
        load.setdefault(p["container_id"], []).append((p["place"], p["place"] + p["piece_size"]))
    assert {i: sum(n for _, n in v) for i, v in got.items()} == {i: n for i, (_, n) in want.items()}
    for i, v in got.items():
        assert [k for k, _ in sorted(v)] == list(range(len(v))) and (len(v) == 1 or want[i][1] > capacity)
    for spans in load.values():
        spans = sorted(s for s in spans if s[1] > s[0])
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    return load


def test_every_item_lies_somewhere_and_little_is_unused(spark):
    rows = items()
    packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1024, window=64).collect()
    load = check(rows, packed, 1024)
    used = sum(b - a for spans in load.values() for a, b in spans)
    assert used / (1024 * len(load)) > 0.98


def test_windows_keep_the_mixture(spark):
    rows = [r for r in items(8000, 2) if (r[2] or 0) < 2000]
    packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1024, window=128)
    w = packing.windows(packed, capacity=1024).orderBy("window_no").collect()
    assert len(w) > 5 and max(r["share_error"] for r in w[:-1]) < 0.03


def test_given_proportions_rule_while_queues_last(spark):
    rows = [(i, "a" if i % 2 else "b", 100) for i in range(4000)]
    packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1000, window=20, proportions={"a": 0.8, "b": 0.2})
    first = packed.where("window_no < 5").groupBy("source").agg(F.sum("piece_size").alias("n")).collect()
    share = {r["source"]: r["n"] for r in first}
    assert abs(share["a"] / (share["a"] + share["b"]) - 0.8) < 0.02
    check(rows, packed.collect(), 1000)


def test_partitioning_does_not_matter(spark):
    df = spark.createDataFrame(items(500, 3), COLUMNS)
    a = packing.pack(df, "doc_id", "source", "n_tokens", capacity=1024, window=16).toPandas()
    b = packing.pack(df.repartition(7), "doc_id", "source", "n_tokens", capacity=1024, window=16).toPandas()
    by = ["doc_id", "piece"]
    assert a.sort_values(by).reset_index(drop=True).equals(b.sort_values(by).reset_index(drop=True))


def test_edges(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert packing.pack(empty, "doc_id", "source", "n_tokens").count() == 0
    only = spark.createDataFrame([(1, None, 0), (2, "a", None)], COLUMNS)
    assert {(r["doc_id"], r["container_id"]) for r in packing.pack(only, "doc_id", "source", "n_tokens").collect()} == {(1, 0), (2, 0)}
    one = spark.createDataFrame([(1, "a", 4096 * 3), (2, "a", 4096), (3, "a", 4097)], COLUMNS)
    packed = packing.pack(one, "doc_id", "source", "n_tokens").collect()
    assert len(packed) == 6 and len({r["container_id"] for r in packed}) == 6
    twice = spark.createDataFrame([(1, "a", 10, 5), (1, "a", 10, 5)], COLUMNS + ", place int")
    assert packing.pack(twice, "doc_id", "source", "n_tokens").count() == 2


def test_a_source_left_out_of_the_proportions_comes_last_in_windows_of_its_own(spark):
    rows = items()
    packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1024, window=64, proportions={"a": 0.8, "b": 0.2}).collect()
    check(rows, packed, 1024)
    tokens = {}
    for p in packed:
        key = p["source"] is None, p["window_no"]
        tokens[key] = tokens.get(key, 0) + p["piece_size"]
    late, others = {w: n for (l, w), n in tokens.items() if l}, {w for l, w in tokens if not l}
    assert min(late) == max(others) + 1 and all(n <= 64 * 1024 + 10_000 for n in late.values())
    everything = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=256, window=8, proportions={"a": 1.0}).groupBy("window_no").sum("piece_size").collect()
    assert max(r[1] for r in everything) <= 8 * 256 + 2 * 10_000


def tokens_by_window(packed, source=None):
    out = {}
    for p in packed:
        if source is None or p["source"] == source:
            out[p["window_no"]] = out.get(p["window_no"], 0) + p["piece_size"]
    return out


def test_windows_stay_full_when_a_queue_has_ended(spark):
    rows = [(i, "a" if i % 2 else "b" if i % 4 else "c", 100) for i in range(4000)]
    for proportions, power in (({"a": 0.8, "b": 0.15, "c": 0.05}, 1.0), ({"a": 0.9}, 1.0), (None, 0.3)):
        packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1000, window=20, proportions=proportions, power=power).collect()
        check(rows, packed, 1000)
        load = tokens_by_window(packed)
        assert len(load) == 20 and all(abs(n - 20_000) <= 300 for w, n in load.items())
    first = tokens_by_window(packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1000, window=20, proportions={"a": 0.8, "b": 0.15, "c": 0.05}).collect(), "b")
    # a lasts for 200,000 / 0.8 tokens, then b and c share in the ratio of 3 to 1
    assert all(abs(first[w] - 3000) <= 200 for w in range(12)) and all(abs(first[w] - 15_000) <= 200 for w in range(13, 16))


def test_small_sources_come_more_often_by_a_power(spark):
    rows = [(i, "a" if i % 10 else "b", 100) for i in range(10_000)]
    packed = packing.pack(spark.createDataFrame(rows, COLUMNS), "doc_id", "source", "n_tokens", capacity=1000, window=20, power=0.5).collect()
    assert all(abs(tokens_by_window(packed, "b")[w] - 5000) <= 200 for w in range(10))


def test_faults_are_counted(spark):
    rows = items(300, 4)
    df = spark.createDataFrame(rows, COLUMNS)
    packed = packing.pack(df, "doc_id", "source", "n_tokens", capacity=1024, window=16)
    count = lambda p: packing.faults(p, df, "doc_id", "n_tokens", 1024).first()
    assert tuple(count(packed)) == (300, 0, 0, 0, 0)
    assert count(packed.where("doc_id <> 5"))["lost"] == 1
    assert count(packed.withColumn("container_id", F.lit(1)))["overfull"] == 1
    assert count(packed.withColumn("place", F.lit(0)))["overlapping"] > 0
    assert tuple(packing.faults(packed.limit(0), df.limit(0), "doc_id", "n_tokens").first()) == (0, 0, 0, 0, 0)
