"""Joins by time against plain loops, sessions of a stream against those of a table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate as E
from lodestar.operators import temporal as W
from lodestar.sources import sinks
from lodestar.streaming import sessions as X

DAY = datetime(2024, 1, 1)


@pytest.mark.parametrize("seconds", [60, 86_400])
def test_as_of(spark, seconds):
    rng = random.Random(seconds)
    side = lambda n, first: [(first + i, rng.choice([1, 1, 1, 2, None]), None if rng.random() < 0.05 else DAY + timedelta(seconds=rng.randrange(0, 4000, 7)), float(i)) for i in range(n)]
    left, right = side(120, 0), side(80, 1000)
    left += left[:2]
    schema = "id long, k long, t timestamp_ntz, v double"
    got = W.as_of(spark.createDataFrame(left, schema).withColumn("__x", F.lit(1)), spark.createDataFrame(right, schema), "k", "t", "id", ["v"], seconds).collect()
    want = []
    for i, k, t, v in left:
        best = max(((rt, ri, rv) for ri, rk, rt, rv in right if rk == k and t and rt and rt < t), default=(None, None, None))
        want.append((i, k, t, v, 1, best[1], best[0], best[2]))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    none = spark.createDataFrame([], schema)
    assert W.as_of(none, spark.createDataFrame(right, schema), "k", "t", "id", ["v"]).count() == 0
    assert {r.as_of_id for r in W.as_of(spark.createDataFrame(left, schema), none, "k", "t", "id", ["v"]).collect()} == {None}


def test_overlapping(spark):
    rng = random.Random(9)
    spans = lambda n: [(i, rng.choice([1, 1, 2, None]), s := rng.randrange(-500, 500), None if rng.random() < 0.05 else s + rng.choice([0, 0, 1, 3, 10, 90, 700, -4])) for i in range(n)]
    a, b = spans(90), spans(90)
    frames = [spark.createDataFrame(x, f"id{t} long, k long, s{t} long, e{t} long") for x, t in ((a, "a"), (b, "b"))]
    got = W.overlapping(*frames, "k", F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")).select("ida", "idb").collect()
    ok = lambda s, e: e is not None and s <= e
    want = [(x[0], y[0]) for x in a for y in b if x[1] is not None and x[1] == y[1] and ok(*x[2:]) and ok(*y[2:]) and x[2] <= y[3] and y[2] <= x[3]]
    assert sorted(map(tuple, got)) == sorted(want)
    assert W.overlapping(frames[0].limit(0), frames[1].limit(0), "k", F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")).count() == 0


def test_sessions_of_a_stream_that_is_stopped_and_restarted(spark, tmp_path):
    rng = random.Random(4)
    schema = "id long, u long, t timestamp_ntz, v double"
    rows = [(i, rng.randrange(5), DAY + timedelta(minutes=m), 1.0) for i, m in enumerate(sorted(rng.randrange(3000) for _ in range(300)))]
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def arrive(part):
        part = part[:]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)

    arrive(rows[:150])
    first = X.stream_sessions(spark, folder, schema, out, check, "u", "t", "v", late="1 hour")[1]
    arrive(rows[150:])
    second = X.stream_sessions(spark, folder, schema, out, check, "u", "t", "v", late="1 hour")[1]
    late = [(1000, 1, DAY, 1.0), (1001, 2, DAY, 1.0)]
    end = [(2000, 99, DAY + timedelta(days=30), 0.0)]
    arrive(late + end)
    third = X.stream_sessions(spark, folder, schema, out, check, "u", "t", "v", late="1 hour")[1]
    arrive([(2001, 99, DAY + timedelta(days=60), 0.0)])
    X.stream_sessions(spark, folder, schema, out, check, "u", "t", "v", late="1 hour")
    want = X.sessions(spark.createDataFrame(rows, schema), "u", "t", "v").collect()
    got = spark.read.parquet(out).filter("u <> 99").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert (first, second, third) == (0, 0, 2)


def test_lists_have_a_limit(spark):
    df = spark.createDataFrame([(1, 2), (1, 1), (2, 3)], "k int, v int")
    assert {r.k: r.l for r in E.lists(df, ["k"], "v", "l", 2).collect()} == {1: [1, 2], 2: [3]}
    with pytest.raises(ValueError, match="2 values"):
        E.lists(df, ["k"], "v", "l", 1)


def test_a_failing_swap_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path, real = str(tmp_path / "t"), sinks._file_system
    sinks.replace(spark.range(3), path)

    class Refuses:
        def __init__(self, fs):
            self.fs = fs

        def exists(self, p):
            return self.fs.exists(p)

        def rename(self, a, b):
            return False if b.getName() == "t" and not a.getName().endswith("-old") else self.fs.rename(a, b)

    monkeypatch.setattr(sinks, "_file_system", lambda s, p: (lambda x: (x[0], Refuses(x[1])))(real(s, p)))
    with pytest.raises(OSError, match="renamed"):
        sinks.replace(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("bucket", [1, 300, 86_400])
def test_sliding_frames(spark, bucket):
    rng = random.Random(bucket)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None]), None if rng.random() < 0.05 else DAY + timedelta(seconds=rng.randrange(0, 4000, 50)), rng.randrange(100)) for i in range(300)]
    rows += rows[:3]
    df = spark.createDataFrame(rows, "id long, k string, t timestamp_ntz, v long")
    got = W.sliding(df, "k", "t", 200, bucket, n=F.count(F.lit(1)), total=F.sum("v")).collect()
    want = []
    for i, k, t, v in rows:
        near = [y for _, j, u, y in rows if j == k and ((t is None and u is None) or (t and u and timedelta(0) <= t - u <= timedelta(seconds=200)))]
        want.append((i, k, t, v, len(near), sum(near)))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert W.sliding(df.filter("id < 0"), "k", "t", 200, n=F.count(F.lit(1))).count() == 0
