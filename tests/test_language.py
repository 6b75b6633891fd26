"""The rule language: parsing, checking, compiling against a row interpreter."""

import datetime as dt
import math

import pytest

from pactum.functions import checking, compiling, interpreting, syntax
from pactum.functions.checking import Declared, Scope

NOW = dt.datetime(2024, 1, 1)
SCOPE = Scope(
    [
        Declared("a", "number"), Declared("b", "number"), Declared("x", "number"), Declared("s", "string"), Declared("p", "string"), Declared("d", "date"), Declared("t", "datetime"),
        Declared("f", "boolean"), Declared("u", None), Declared("addr", "struct", (Declared("zip", "string"),)), Declared("tags", "list"),
    ],
    {"big": syntax.parse("a > 10"), "worst": syntax.parse("MAX(a)")},
)


def codes(text):
    try:
        return {f.code for f in checking.check(syntax.parse(text), SCOPE).findings}
    except syntax.SyntaxProblem:
        return {"S19"}


@pytest.mark.parametrize("text", ["a < b < 3", "a ==1", "'open", "``", "a +", "CASE a WHEN 1 THEN 2 END = 2", "99999999999999999999 > a", "a NOT 3", "COLUMNS() > 1", "a IN ()"])
def test_syntax_problems(text):
    assert codes(text) == {"S19"}


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("zz > 1", "S20"), ("addr.nope = 'x'", "S20"), ("COLUMNS([a, zz]) > 1", "S20"), ("LENGTH(a) > 1", "S21"), ("LENGTH('a', 'b') = 1", "S21"), ("NOPE(a) = 1", "S21"), ("a", "S21"),
        ("s > a", "S21"), ("d - d > 1", "S21"), ("d = 'soon'", "S21"), ("s SIMILAR TO '(?=x)'", "S21"), ("SUM(s) > 1", "S21"), ("a + interval(1, days) > NOW()", "S21"), ("tags = 'x'", "S21"), ("a.b = 1", "S21"),
        ("COLUMNS('^zz') > 1", "S22"), ("u > 5", "S23"), ("AVG(MIN(a)) > 1", "S30"), ("MAX(worst) > 1", "S30"), ("COLUMNS(*) IS NULL AND COLUMNS(*) IS NULL", "S21"), ("d + interval(1, months) > d", "S21"),
    ],
)
def test_findings(text, code):
    assert code in codes(text)


@pytest.mark.parametrize("text", ["u IS NOT NULL", "COUNT(addr) > 1", "COLUMNS(*) IS NOT NULL", "d >= '2000-01-01'", "d < NOW()", "a <= 2 * MIN(b)", "big OR s LIKE 'x%'", "f", "NULL = a", "addr.zip LIKE '1%'", "COUNT(tags) = ROW_COUNT()"])
def test_well_formed(text):
    assert codes(text) == set()


def test_precedence_and_spans():
    tree = syntax.parse("NOT a = 1 AND b = 2 OR f")
    assert isinstance(tree, syntax.Logic) and tree.op == "OR"
    assert isinstance(tree.left, syntax.Logic) and isinstance(tree.left.left, syntax.Not)
    neg = syntax.parse("-a * 2")
    assert isinstance(neg, syntax.Arithmetic) and isinstance(neg.left, syntax.Negative)
    assert (tree.right.start, tree.right.end) == (23, 24)
    with pytest.raises(syntax.SyntaxProblem) as e:
        syntax.parse("a > ?")
    assert (e.value.start, e.value.end) == (4, 5)


def test_shapes_and_references():
    typed = checking.check(syntax.parse("a <= 2 * MIN(b)"), SCOPE)
    assert typed.shape == checking.ROW and typed.columns == [("a",), ("b",)]
    assert checking.check(syntax.parse("MAX(a) * 2 > 1"), SCOPE).shape == checking.AGG
    assert checking.check(syntax.parse("1 < 2"), SCOPE).shape == checking.CONST
    assert checking.check(syntax.parse("big"), SCOPE).definitions == ["big"]
    assert checking.check(syntax.parse("COLUMNS('^[ab]$') > 0"), SCOPE).selected == ["a", "b"]


ROWS = [
    (1, 5, 1.5, "ab", "a.", dt.date(2020, 1, 2), dt.datetime(2020, 1, 2, 3), True),
    (0, 0, math.nan, "a\nb", "a%", None, dt.datetime(1999, 12, 31, 23, 59, 59), False),
    (-7, None, -0.0, None, None, dt.date(1999, 1, 1), None, None),
    ((1 << 63) - 1, 3, math.inf, " x ", "_x_", dt.date(2000, 1, 1), dt.datetime(2000, 1, 1), True),
    (-(1 << 63), -1, -math.inf, "É ", "(", dt.date(1970, 1, 1), dt.datetime(1970, 1, 1), False),
    (49, 49, 0.49999999999999994, "", "", dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 12), None),
    (7, -3, 1.005, "a\\b", "a\\b", dt.date(1900, 1, 1), dt.datetime(2262, 1, 1), True),
]
SCHEMA = "a long, b long, x double, s string, p string, d date, t timestamp_ntz, f boolean"
EXPRESSIONS = [
    "a + b", "a - b", "a * b", "a / b", "x / a", "-a", "-x", "a + x", "ABS(a)", "ABS(x)", "FLOOR(x)", "CEIL(x)", "ROUND(x)", "ROUND(x, 2)", "ROUND(a, -1)", "ROUND(a, 400)", "ROUND(a, -400)", "ROUND(x, b)",
    "MOD(a, 3)", "MOD(a, -3)", "MOD(a, b)", "MOD(b, a) = 0", "MOD(a, 2.5)", "MOD(x, 2)", "MOD(a, b) IS NULL", "1 + MOD(a, b)",
    "x > 1", "x < 1", "x = x", "x <> x", "x = NAN", "a = x", "a >= b", "s < 'b'", "x BETWEEN 0 AND 1", "x NOT BETWEEN 0 AND 1", "5 BETWEEN 10 AND b", "a BETWEEN b AND 100",
    "a IN (1, b)", "a NOT IN (1, b)", "x IN (NAN, 1.5)", "s IN ('ab', p)", "a IS NULL", "b IS NOT NULL",
    "f AND b > 0", "f OR b > 0", "NOT f", "b > 0 AND a + 1 > 0", "a + 1 > 0 OR TRUE", "TRUE OR a + 1 > 0", "FALSE AND a + 1 > 0", "b > 0 OR a - 1 < 0",
    "s LIKE 'a%'", "s LIKE '%b'", "s LIKE 'a_b'", "s LIKE 'a%b'", "s LIKE ''", "s NOT LIKE '%x%'", "s LIKE p", "s SIMILAR TO 'a.*'", "s SIMILAR TO '[ab]+'", "s SIMILAR TO p", "s NOT SIMILAR TO p",
    "LENGTH(s)", "LOWER(s)", "UPPER(s)", "TRIM(s)", "STARTS_WITH(s, 'a')", "ENDS_WITH(s, p)", "IS_NAN(x)", "IS_FINITE(x)", "IS_INFINITE(x)", "IS_NAN(a)",
    "d >= '2000-01-01'", "d = t", "t < d", "t >= '2000-01-01T00:00:00Z'", "d + interval(12, hours)", "t - interval(b, weeks)", "d + interval(a, days)", "t + interval(x, seconds)", "d < NOW()",
    "CASE WHEN a > 0 THEN a ELSE x END", "CASE WHEN f THEN a + 1 WHEN b > 0 THEN 2 END", "CASE WHEN a + 1 > 0 THEN 1 ELSE 2 END", "a + 1 + b", "(a + 1) * 0 = 0",
]


def same(x, y):
    if isinstance(x, float) and isinstance(y, (int, float)) and not isinstance(y, bool):
        return (math.isnan(x) and math.isnan(y)) or x == float(y)
    return x == y and isinstance(x, bool) == isinstance(y, bool)


@pytest.fixture(scope="module")
def evaluated(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    columns = []
    for k, text in enumerate(EXPRESSIONS):
        c = compiling.compile_row(checking.check(syntax.parse(text), SCOPE, boolean=False), df.schema, NOW)
        columns += [compiling.F.lit(None).alias(f"v{k}") if c.kind == "null" else compiling._plain(c).value.alias(f"v{k}"), (c.fault if c.fault is not None else compiling.F.lit(0)).alias(f"f{k}")]
    return df.select(*columns).collect()


@pytest.mark.parametrize("k", range(len(EXPRESSIONS)), ids=EXPRESSIONS)
def test_compiled_agrees_with_interpreter(evaluated, k):
    typed = checking.check(syntax.parse(EXPRESSIONS[k]), SCOPE, boolean=False)
    assert typed.ok, typed.findings
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for row, got in zip(ROWS, evaluated, strict=True):
        want, fault = interpreting.evaluate(typed.tree, dict(zip(names, row, strict=True)), NOW)
        assert (got[f"f{k}"] or 0) == fault, row
        if not fault:
            assert same(got[f"v{k}"], want), (row, got[f"v{k}"], want)
