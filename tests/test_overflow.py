"""Overflow of whole numbers against Python's, and that rows that overflow cost no more than others."""

import itertools
import time

from pyspark.sql import functions as F

from pactum.functions import compiling
from pactum.plans import catalogue

MIN, MAX = -(1 << 63), (1 << 63) - 1
EDGES = [None, MIN, MIN + 1, MIN + 2, MIN // 2 - 1, MIN // 2, -3037000500, -3037000499, -3, -2, -1, 0, 1, 2, 3, 3037000499, 3037000500, MAX // 2, MAX // 2 + 1, MAX // 3, MAX - 2, MAX - 1, MAX]


def exact(op, x, y):
    """The value and the fault of an operator."""
    if x is None or y is None:
        return None, 0
    out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return (out, 0) if MIN <= out <= MAX else (None, compiling.OVERFLOW)


def compiled(df, text):
    c = compiling.compile_row(catalogue.checked(text, catalogue.scope_of(df), boolean=False), df.schema, catalogue.NOW)
    return c.value, F.lit(0) if c.fault is None else c.fault


def test_operators_at_the_edges(spark):
    df = spark.createDataFrame(list(itertools.product(EDGES, EDGES)), "x long, y long")
    for op in "+-*":
        rows = df.select("x", "y", *compiled(df, f"x {op} y")).collect()
        assert [(x, y, v, f) for x, y, v, f in rows] == [(x, y, *exact(op, x, y)) for x, y, *_ in rows] and len(rows) == len(EDGES) ** 2
    rows = df.select("x", *compiled(df, "-x"), *compiled(df, "ABS(x)")).collect()
    for x, negative, fault, size, fault_of_size in rows:
        assert (negative, fault) == exact("-", 0, x) and (size, fault_of_size) == (exact("-", 0, x) if x is not None and x < 0 else (x, 0))


def test_operands_that_are_operators(spark):
    df = spark.createDataFrame([(x, y, z) for x in EDGES[::2] for y in EDGES[1::2] for z in EDGES[::3]], "x long, y long, z long")
    for one, two in itertools.product("+-*", "+-*"):
        rows = df.select("x", "y", "z", *compiled(df, f"(x {one} y) {two} z"), *compiled(df, f"x {one} (y {two} z)")).collect()
        for x, y, z, left, left_fault, right, right_fault in rows:
            for value, fault, (inner, lost), outer in ((left, left_fault, exact(one, x, y), lambda i: exact(two, i, z)), (right, right_fault, exact(two, y, z), lambda i: exact(one, x, i))):  # noqa: B023 - used at once
                assert (value, fault) == ((None, lost) if lost else outer(inner)), (one, two, x, y, z)


def test_rows_that_overflow_take_no_longer(spark):
    def seconds(text):
        df = spark.range(200_000).withColumn("x", F.col("id") + 10)
        value, fault = compiled(df, text)
        best = 1e9
        for _ in range(3):
            start = time.time()
            n = df.where(fault == compiling.OVERFLOW).count()
            best = min(best, time.time() - start)
        return best, n

    few, none = seconds("x * 1000000")
    for text in ("x * 1000000000000000000", "x + 9223372036854775800", "-9223372036854775800 - x"):
        many, every = seconds(text)
        assert (none, every) == (0, 200_000) and many < 6 * few + 0.5
