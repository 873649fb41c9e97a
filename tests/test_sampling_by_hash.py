"""Samples through a bound on the hash hold the rows that ranking everything gives."""

import hashlib
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarryline.operators import sampling


def digest(key, seed):
    return hashlib.md5(f"{key}:{seed}".encode()).hexdigest()


def rows_of(n):
    return [(i, "ab"[i % 7 == 0] if i % 11 else None, i % 5 if i % 3 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "target"), [(4000, 60), (4000, 3999), (50, 500), (0, 5), (300, 1)])
def test_stratified_rows(spark, n, target):
    data = [r for r in rows_of(n) if r[1]]
    frame = spark.createDataFrame(data, "id int, stratum string, unit int")
    sizes = defaultdict(int)
    for _, s, _ in data:
        sizes[s] += 1
    marked = []
    for s, size in sizes.items():
        quota = round(size * float(target) / len(data))
        own = sorted((digest(i, 3), i) for i, t, _ in data if t == s)
        marked += [(k >= quota, d, i) for k, (d, i) in enumerate(own)]
    got = [r.id for r in sampling.stratified(frame, "id", "stratum", target, 3).collect()]
    assert sorted(got) == sorted(i for _, _, i in sorted(marked)[:target])


@pytest.mark.parametrize("target", [1, 12, 700])
def test_rows_per_unit(spark, target):
    data = [r for r in rows_of(3000) if r[1] and r[2] is not None]
    frame = spark.createDataFrame(data, "id int, stratum string, unit int")
    targets = spark.createDataFrame([("a", target), ("b", target + 3), ("z", 4)], "stratum string, n int")
    want = []
    for s, goal in (("a", target), ("b", target + 3)):
        units = {u for _, t, u in data if t == s}
        floor, marked = math.floor(goal / len(units)), []
        for u in units:
            own = sorted((digest(i, 5), i) for i, t, v in data if (t, v) == (s, u))
            marked += [(k >= floor, d, i) for k, (d, i) in enumerate(own)]
        want += [i for _, _, i in sorted(marked)[:goal]]
    got = [r.id for r in sampling.quota_per_unit(frame, "id", "unit", "stratum", targets, "n", 5).collect()]
    assert sorted(got) == sorted(want)


def test_a_group_that_is_short_goes_on_whole(spark):
    # All places of group b are high, so its bound finds none of them.
    data = [(i, "a", i * 1000.0) for i in range(500)] + [(i, "b", sampling.PLACES - i) for i in range(1, 500)] + [(0, None, 5.0)]
    frame = spark.createDataFrame(data, "id int, g string, place double")
    wants = frame.groupBy("g").agg(F.count("*").alias("__n")).withColumn("__want", F.lit(3))
    got = sampling.first_by_hash(frame, "place", [(["g"], wants)])
    assert got.columns == frame.columns
    counts = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert counts["b"] == 499 and counts["a"] >= 3 and counts[None] == 1
    whole = sampling.first_by_hash(frame.filter("g = 'b'"), "place", [([], frame.filter("g = 'b'").agg(F.count("*").alias("__n")).withColumn("__want", F.lit(2)))])
    assert whole.count() == 499


def test_few_rows_go_on(spark):
    frame = spark.range(100_000).withColumn("place", sampling.place_of(sampling.draw("id", 1)))
    wants = frame.agg(F.count("*").alias("__n")).withColumn("__want", F.lit(100))
    got = sampling.first_by_hash(frame, "place", [([], wants)])
    assert 100 <= got.count() < 300
    assert {r.id for r in got.orderBy("place").limit(100).collect()} == {r.id for r in frame.orderBy("place").limit(100).collect()}
