"""Catalogue queries over whole tables, compared with their SQL."""

import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pactum.operators import profiling, sketches
from pactum.plans import catalogue

SF = "/root/testdata/sf0.001"


def both(spark, name, *tables):
    """The rows of a query and of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = Counter(map(tuple, catalogue.queries()[name](spark, SF).collect()))
    return got, Counter(con.sql(catalogue.oracle_sql()[name]).fetchall())


def test_joins_take_every_row(spark):
    lines = catalogue.table(spark, SF, "lineitem").count()
    for name in ("join_equality", "join_equality_whole"):
        got, want = both(spark, name, "lineitem", "orders")
        assert got == want and sum(got.values()) == lines


@pytest.mark.parametrize("name", ["join_bounds", "join_range", "profile_samples", "profile_histogram_rule", "profile_nested", "validate_meta_undocumented"])
def test_queries_equal_their_sql(spark, name):
    got, want = both(spark, name, "lineitem", "orders", "part", "customer", "supplier", "embeddings")
    assert got == want and got


def test_a_range_join_does_not_compare_all_pairs(spark):
    plan = catalogue.queries()["join_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_trim_has_something_to_remove(spark):
    got, want = both(spark, "expr_unicode_trim_padded", "documents")
    assert got == want
    plain = {r["doc_id"]: r["text"] for r in catalogue.table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert {i: t for i, t in got} == {i: None if t is None else t.strip() for i, t in plain.items()} and len(plain) > 0


def test_frequent_counts_are_exact_beyond_what_summaries_hold(spark, tmp_path):
    """More suppliers than a summary holds, with counts so alike that dropping any shows."""
    con = duckdb.connect()
    con.sql("CREATE TABLE lineitem AS SELECT (i * 7919) % 9001 AS l_suppkey FROM range(40000) r(i)")
    con.sql("CREATE TABLE part AS SELECT CAST(i % 50 AS INTEGER) AS p_size, 'T' || i % 7 AS p_type FROM range(500) r(i)")
    for t in ("lineitem", "part"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = Counter(map(tuple, catalogue.queries()["profile_frequent_counts"](spark, str(tmp_path)).collect()))
    assert got == Counter(con.sql(catalogue.oracle_sql()["profile_frequent_counts"]).fetchall())


def test_exact_frequent_values_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(sketches, "TRACKED", 20)
    frame = spark.range(6000).select(F.when(F.col("id") % 11 > 0, F.pmod(F.xxhash64("id"), F.lit(700))).alias("k"))
    day, start = dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)
    columns = {
        "number": (F.col("k"), lambda k: k), "text": (F.concat(F.lit("v"), F.col("k")), lambda k: f"v{k}"), "bytes": (F.concat(F.lit("v"), F.col("k")).cast("binary"), lambda k: f"v{k}"),
        "date": (F.date_from_unix_date(F.col("k").cast("int")), lambda k: day + dt.timedelta(days=k)), "instant": (F.timestamp_micros("k"), lambda k: start + dt.timedelta(microseconds=k)),
        "clock": (F.timestamp_micros("k").cast("timestamp_ntz"), lambda k: start + dt.timedelta(microseconds=k)),
    }
    keys = Counter(r["k"] for r in frame.collect() if r["k"] is not None)
    found = profiling.profile(frame, {n: c for n, (c, _) in columns.items()}, exact_top=True)
    for n, (_, make) in columns.items():
        want = sorted(((make(k), c, 0) for k, c in keys.items()), key=lambda r: (-r[1], r[0]))[: profiling.TOP_VALUES]
        assert found[n].top == want, n
