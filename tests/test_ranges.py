"""Range joins of every ordered type against all pairs, and how many pairs they compare."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactum.operators import ranges
from pactum.operators.ranges import between_join, in_leaves
from pactum.plans.relationships import join_tables

MAKE = {
    "int": lambda k: k, "double": lambda k: k / 7, "decimal(12,3)": lambda k: Decimal(k) / 8, "string": lambda k: f"{k % 37:02}é{k}",
    "date": lambda k: dt.date(2000, 1, 1) + dt.timedelta(days=k), "timestamp": lambda k: dt.datetime(2000, 1, 1) + dt.timedelta(seconds=k), "binary": lambda k: bytes([k % 256, k // 256]),
}


@pytest.mark.parametrize("kind", MAKE)
def test_every_ordered_type_equals_all_pairs(spark, kind):
    rng, make = random.Random(1), MAKE[kind]
    points = [(k, make(rng.randrange(900)) if rng.random() > 0.05 else None) for k in range(400)]
    bands = []
    for k in range(60):
        a, b = sorted((make(rng.randrange(900)), make(rng.randrange(900))))
        bands.append((k, *((b, a) if k % 10 == 0 else (a, None) if k % 10 == 1 else (a, b))))
    left, right = spark.createDataFrame(points, f"i int, x {kind}").repartition(3), spark.createDataFrame(bands, f"j int, lo {kind}, hi {kind}")
    expected = sorted((i, j) for i, x in points for j, lo, hi in bands if None not in (x, lo, hi) and lo <= x < hi)
    conditions = [left["x"] >= right["lo"], left["x"] < right["hi"]]
    for leaf, fan in ((1000, 8), (40, 64), (4, 5)):  # no tree, one level, several
        found = between_join(left, left["x"], right, right["lo"], right["hi"], conditions, leaf, fan).select("i", "j")
        assert sorted(map(tuple, found.collect())) == expected
    joined = join_tables("p.x >= b.lo AND p.x < b.hi", {"p": left, "b": right}).select("p.i", "b.j")
    assert sorted(map(tuple, joined.collect())) == expected


def compared(spark, n):
    """Pairs that meet in a leaf, of n points with n bands of constant length, and the pairs that match."""
    points = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("x"))
    bands = spark.range(n).select(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)).alias("lo")).withColumn("hi", F.col("lo") + F.lit(4 * (1 << 30) // n))
    placed, cut = in_leaves(points, points["x"], bands, bands["lo"], bands["hi"], n, leaf=64, fan=16)
    return placed.join(cut, F.col("__path__") == F.col("__path_of__")).count(), placed.groupBy("__path__").count().agg(F.max("count"), F.count("*")).first()


def test_comparisons_grow_with_the_bands_not_with_the_product(spark):
    small, (largest, leaves) = compared(spark, 4000)
    large, (largest4, leaves4) = compared(spark, 16000)
    assert large < 4 * small * 1.5 and small < 4000 * 64 * 4
    assert largest4 < 64 * 8 and leaves4 > 2.5 * leaves and largest < 64 * 8


def test_frequent_values_and_wide_bands(spark):
    points = spark.createDataFrame([(k, 5 if k % 2 else k) for k in range(600)], "i int, x int")
    bands = spark.createDataFrame([(0, 0, 1000), (1, 5, 5), (2, 6, 4), (3, -9, -1), (4, 599, 700)], "j int, lo int, hi int")
    found = between_join(points, points["x"], bands, bands["lo"], bands["hi"], [points["x"] >= bands["lo"], points["x"] <= bands["hi"]], 16, 8).groupBy("j").count().collect()
    assert dict(map(tuple, found)) == {0: 600, 1: 300}


def test_empty_sides(spark):
    points, bands = spark.createDataFrame([], "x string"), spark.createDataFrame([("a", "b")], "lo string, hi string")
    assert join_tables("p.x >= b.lo AND p.x < b.hi", {"p": points, "b": bands}).collect() == []
    assert join_tables("p.x >= b.lo AND p.x < b.hi", {"p": spark.createDataFrame([("a",)], "x string"), "b": bands.limit(0)}).collect() == []


@pytest.mark.parametrize("kind", ["int", "string", "double"])
def test_joins_that_are_dealt_out_equal_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(ranges, "MOST_TASKS", 12)
    rng, make = random.Random(2), MAKE[kind]
    points = [(k, None if k % 20 == 0 else make(500 if k % 2 else rng.randrange(900))) for k in range(500)]
    bands = [(k, *((make(0), make(899)) if k % 3 == 0 else sorted((make(rng.randrange(900)), make(rng.randrange(900)))))) for k in range(150)]
    left, right = spark.createDataFrame(points, f"i int, x {kind}").repartition(3), spark.createDataFrame(bands, f"j int, lo {kind}, hi {kind}")
    expected = sorted((i, j) for i, x in points for j, lo, hi in bands if x is not None and lo <= x < hi)
    for leaf, fan, block in ((1000, 8, 16), (16, 5, 5)):
        found = between_join(left, left["x"], right, right["lo"], right["hi"], [left["x"] >= right["lo"], left["x"] < right["hi"]], leaf, fan, block)
        assert found.columns == ["i", "x", "j", "lo", "hi"] and sorted(map(tuple, found.select("i", "j").collect())) == expected


@pytest.mark.parametrize("hot", [False, True])
def test_many_pairs_of_few_rows_are_dealt_over_many_tasks(spark, hot):
    points = spark.range(4000).select("id", (F.lit(7) if hot else F.pmod(F.xxhash64("id"), F.lit(1000))).alias("x"))
    bands = spark.range(1000).select(F.col("id").alias("j"), F.lit(0).alias("lo"), F.lit(999).alias("hi"))
    found = between_join(points, points["x"], bands, bands["lo"], bands["hi"], [points["x"] >= bands["lo"], points["x"] <= bands["hi"]], block=128)
    tasks = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(tasks) == 4_000_000 and max(tasks) < 4_000_000 / 12 and len(tasks) > 50
