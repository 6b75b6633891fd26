"""Mergeable summaries against plain counting, however the rows are split."""

import datetime as dt
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactum.operators import sketches
from pactum.operators.profiling import bins_for, footer_ranges, profile
from pactum.operators.sketches import Frequent, Pool, Registers, Summary


def summed(kind, parts, **how):
    """One summary per part, in batches of a few values, merged."""
    out = Summary(kind, **how)
    for part in parts:
        one = Summary(kind, **how)
        for a in range(0, len(part), 7):
            one.add(part.slice(a, 7))
        out.merge(one)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(st.none(), st.integers(-20, 20)), max_size=40), min_size=1, max_size=5))
def test_few_values_are_counted_exactly(parts):
    s = summed("integer", [pa.array(p, pa.int64()) for p in parts])
    held = [x for p in parts for x in p if x is not None]
    expected = sorted(Counter(held).items(), key=lambda r: (-r[1], r[0]))
    assert s.frequent.top(50) == [(v, n, 0) for v, n in expected] and s.frequent.floor == 0
    assert (s.rows, s.nulls, s.low, s.high) == (sum(map(len, parts)), sum(x is None for p in parts for x in p), min(held, default=None), max(held, default=None))
    assert s.registers.estimate() == len(expected) and sorted(s.pool.values.tolist()) == sorted(set(held))


@pytest.mark.parametrize("kind", ["integer", "text"])
def test_errors_bound_the_true_counts(monkeypatch, kind):
    monkeypatch.setattr(sketches, "TRACKED", 20)
    rng = random.Random(6)
    values = [min(int(rng.paretovariate(0.6)), 5000) for _ in range(6000)] + [-1] * 900  # a frequent value that comes late
    values = [f"v{v}" for v in values] if kind == "text" else values
    true = Counter(values)
    kinds = pa.string() if kind == "text" else pa.int64()
    s = summed(kind, [pa.array(values[a : a + 1500], kinds) for a in range(0, len(values), 1500)]).frequent
    assert s.floor > 0 and len(s.values) <= 80
    for v, n, e in s.top(100):
        assert n - e <= true[v] <= n
    held = set(s.values.tolist())
    assert all(n <= s.floor for v, n in true.items() if v not in held)
    assert true.most_common(1)[0][0] == s.top(1)[0][0] and ("v-1" if kind == "text" else -1) in [v for v, *_ in s.top(3)]


def test_the_pool_holds_the_least_hashes_whatever_the_order(monkeypatch):
    monkeypatch.setattr(sketches, "POOL", 16)
    values = np.arange(1000)
    h = sketches.hashes(values)
    expected = values[np.argsort(h)[:16]]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(np.repeat(values, 3))
        pool = Pool(np.empty(0, np.uint64), np.empty(0, np.int64))
        for part in np.array_split(order, 9):
            pool = pool.take(sketches.hashes(part), part)
        assert pool.values.tolist() == expected.tolist()


@pytest.mark.parametrize("n", [0, 1, 50, 3000, 200_000])
def test_distinct_counts_are_about_right(n):
    one, two = Registers(), Registers()
    one.add(sketches.hashes(np.arange(0, n)))
    two.add(sketches.hashes(np.array([f"x{k}" for k in range(n // 10)], object)))
    assert abs(one.estimate() - n) <= max(1, 0.03 * n)
    one.merge(two)
    assert abs(one.estimate() - n - n // 10) <= max(1, 0.03 * n)


@pytest.mark.parametrize(("kind", "low", "high"), [("integer", -7, 93), ("integer", 5, 5), ("float", -1.5, 8.25), ("date", 10_000, 10_900)])
def test_bins_are_closed_on_the_right(kind, low, high):
    bins = bins_for(kind, low, high, 5000, 20)
    x = np.linspace(low, high, 301) if kind == "float" else np.arange(low, high + 1)
    edges = [low + k * bins.width for k in range(bins.count)] + [max(high, low + bins.count * bins.width)]
    for value, at in zip(x.tolist(), bins.numbers(x).tolist(), strict=True):
        assert (at == 0 or value > edges[at] - 1e-9) and value <= edges[at + 1] + 1e-9


def test_non_finite_values_and_bytes_that_are_no_text():
    s = summed("float", [pa.array([1.0, float("nan"), None, float("inf")]), pa.array([float("-inf"), -0.0, 0.0])])
    assert (s.nans, s.positive, s.negative, s.nulls, s.low, s.high, sorted(s.pool.values.tolist())) == (1, 1, 1, 1, 0.0, 1.0, [0.0, 1.0])
    assert summed("text", [pa.array([b"ok"]), pa.array([b"\xff"])]).invalid and not summed("text", [pa.array([b"ok"])]).invalid


def jobs_of(spark, name, run):
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    found = run()
    n = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    return found, n


def test_ranges_from_footers_save_a_pass_and_change_no_bin(spark, tmp_path):
    from pactum.sources.footers import read_footers

    df = spark.range(5000).selectExpr("id % 700 AS whole", "CASE WHEN id % 9 > 0 THEN id / 7D END AS part", "date_add(DATE '2020-01-01', CAST(id % 400 AS INT)) AS day", "TIMESTAMP_NTZ '2020-01-01' + make_interval(0, 0, 0, 0, 0, 0, id) AS at")
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    columns = {c: F.col(c) for c in table.columns}
    footers = read_footers(spark, str(tmp_path / "t"))
    ranges = footer_ranges(footers, columns)
    assert {"whole", "part", "day"} <= set(ranges)
    blind, twice = jobs_of(spark, "blind", lambda: profile(table, columns))
    told, once = jobs_of(spark, "told", lambda: profile(table, columns, ranges=ranges, rows=footers.rows))
    if set(ranges) == set(columns):
        assert once < twice
    assert blind == told and sum(b.count for b in told["part"].bins) == 5000 - told["part"].nulls
    assert told["day"].bins[0].low == dt.date(2020, 1, 1) and told["at"].low == dt.datetime(2020, 1, 1)


def test_summaries_of_empty_tables_and_columns_of_nulls(spark):
    df = spark.createDataFrame([(None, None)], "a int, b string")
    for rows in (df, df.limit(0)):
        p = profile(rows, {c: F.col(c) for c in rows.columns})
        assert [(x.nulls, x.distinct, x.top, x.samples, x.bins, x.low) for x in p.values()] == [(rows.count(), 0, [], [], [], None)] * 2
