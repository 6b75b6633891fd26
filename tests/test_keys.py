"""Keys and references counted as bits against plain Python."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.operators import keys

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def count(df, *columns):
    return keys.duplicate_count(df, [F.col(c) for c in columns]).first()["duplicates"]


def plain(rows):
    held = Counter(r for r in rows if None not in r)
    return sum(n - 1 for n in held.values())


def shaped(df, *columns):
    return keys.dense(df, keys.whole(df, [F.col(c) for c in columns]))


@pytest.mark.parametrize("span", [40, 1000, 1 << 40, None])
def test_duplicates_of_whole_numbers(spark, span):
    rng = random.Random(7)
    low, high = (-span, span) if span else (LEAST, MOST)
    values = [(None if rng.random() < 0.05 else rng.randint(low, high),) for _ in range(700)]
    values += values[:50] + [(low,), (high,), (high,)]
    df = spark.createDataFrame(values, "x long").repartition(5)
    assert count(df, "x") == plain(values)


def test_keys_of_several_parts_and_dates(spark):
    rng = random.Random(8)
    rows = [(rng.randint(-3, 40), rng.randint(0, 6), dt.date(2020, 1, 1) + dt.timedelta(days=rng.randrange(5))) for _ in range(900)] + [(None, 1, None), (1, None, None), (1, None, None)]
    df = spark.createDataFrame(rows, "a int, b short, d date").repartition(4)
    assert shaped(df, "a", "b", "d") is not None
    assert count(df, "a", "b", "d") == plain(rows) and count(df, "a", "b") == plain([r[:2] for r in rows]) and count(df, "d") == plain([r[2:] for r in rows])


def test_empty_and_null_keys(spark):
    for rows in ([], [(None,), (None,)]):
        df = spark.createDataFrame(rows, "x long")
        assert shaped(df, "x") is None and count(df, "x") == 0


def test_dense_keys_are_sent_as_words_and_sparse_ones_are_not(spark):
    clustered = spark.range(0, 3_000_000, 1, 4)
    sparse = clustered.select(F.xxhash64("id").alias("id"))
    assert shaped(clustered, "id") is not None and shaped(sparse, "id") is None
    plan = keys.duplicate_count(clustered, [F.col("id")])
    assert plan.first()["duplicates"] == 0 and "bit_or" in plan._jdf.queryExecution().toString()
    spaced = clustered.select((F.col("id") * 1000 + F.spark_partition_id() * (1 << 50)).alias("id"))
    assert shaped(spaced, "id") is None  # more words than keys


@pytest.mark.parametrize(("child", "parent"), [
    ([1, 2, 3, None, 3], [1, 2, 3]), ([1, 5, 5, 70, None], [1, 2, 70]), ([], [1]), ([1, 1, None], []), ([LEAST, MOST, 0, 7], [LEAST, 7]), ([64, 63, 65, 128, -1], [64, 65, None]),
    (list(range(-500, 500, 3)), list(range(-500, 500, 2))),
])
@pytest.mark.parametrize("kinds", [("long", "long"), ("int", "long"), ("long", "short")])
def test_references(spark, child, parent, kinds):
    limits = {"long": MOST, "int": (1 << 31) - 1, "short": (1 << 15) - 1}
    child = [x for x in child if x is None or -limits[kinds[0]] - 1 <= x <= limits[kinds[0]]]
    parent = [x for x in parent if x is None or -limits[kinds[1]] - 1 <= x <= limits[kinds[1]]]
    c = spark.createDataFrame([(k, x) for k, x in enumerate(child)], f"{keys.ROW} long, x {kinds[0]}").repartition(3)
    p = spark.createDataFrame([(x,) for x in parent], f"y {kinds[1]}").repartition(2)
    given = (c, F.col("x"), c.schema["x"].dataType, p, F.col("y"), p.schema["y"].dataType)
    expected = sorted(k for k, x in enumerate(child) if x is not None and x not in set(parent))
    assert sorted(r[keys.ROW] for r in keys.orphans(*given, [F.col("x").alias("a.b")]).collect()) == expected
    assert keys.orphan_count(*given).first()["orphans"] == len(expected)


def test_references_that_hold_shuffle_bits_only(spark, tmp_path):
    """At most a fifth of the bytes that the keys would take."""
    spark.range(0, 400_000, 1, 4).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "p"))
    spark.range(0, 400_000, 1, 4).select(F.col("id").alias("k")).write.parquet(str(tmp_path / "c"))
    child, parent = spark.read.parquet(str(tmp_path / "c")), spark.read.parquet(str(tmp_path / "p"))
    shape = keys._dense_reference(child, F.col("k"), T.LongType(), parent, F.col("k"), T.LongType())
    words = keys._compared_words(shape, child, F.col("k"), parent, F.col("k"))
    assert words.count() * 3 * 8 * 5 < 800_000 * 8 and words.where(f"{keys._BITS} <> 0").count() == 0
