"""The engine's operators as queries over the driver's tables, with their SQL equivalents.

Keys of the result are business columns; offending rows are compared as sets.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checking, compiling, syntax
from ..operators import assertions, columns, keys, profiling
from ..sources.footers import read_footers
from ..sources.parquet import ROW, read_table, with_rows

NOW = dt.datetime(2024, 6, 1)
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def language_type(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    simple = {T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.ArrayType: "list", T.StructType: "struct"}
    return next((k for c, k in simple.items() if isinstance(t, c)), "string")


def scope_of(df: DataFrame, definitions: dict[str, str] | None = None) -> checking.Scope:
    scope = checking.Scope([checking.Declared(f.name, language_type(f.dataType)) for f in df.schema.fields if f.name != ROW])
    scope.definitions = {k: syntax.parse(v) for k, v in (definitions or {}).items()}
    return scope


def checked(text: str, scope: checking.Scope, boolean: bool = True) -> checking.Typed:
    typed = checking.check(syntax.parse(text), scope, boolean)
    if not typed.ok:
        raise ValueError([f.message for f in typed.findings])
    return typed


def violations(df: DataFrame, text: str, definitions: dict[str, str] | None = None) -> DataFrame:
    """The rows for which an assertion is false."""
    scope = scope_of(df, definitions)
    prepared = assertions.prepare(checked(text, scope), scope, df.schema, NOW)
    folded = assertions.fold_all(df, [prepared], NOW)
    held = folded.onto(df)
    return held.where(assertions.judge(prepared, df.schema, NOW, folded).violated).select(*df.columns)


def value_of(df: DataFrame, text: str, kind: str | None = None) -> F.Column:
    """The value of a row-level expression as a column; datetimes as timestamps."""
    c = compiling.compile_row(checked(text, scope_of(df), boolean=False), df.schema, NOW)
    out = compiling._plain(c)  # noqa: SLF001
    if out.kind == "datetime":
        return F.timestamp_micros(out.value).cast("timestamp_ntz")
    return out.value if kind is None else out.value.cast(kind)


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def rule(name: str, source: str, text: str, shown: tuple[str, ...], predicate: str, definitions: dict[str, str] | None = None) -> None:
    """A query of the violating rows of an assertion; ``predicate`` is the SQL that is false for them."""

    def run(spark, sf_dir):
        return violations(table(spark, sf_dir, source), text, definitions).select(*shown)

    query(name, f"SELECT {', '.join(shown)} FROM {source} WHERE ({predicate}) IS FALSE")(run)


def value(name: str, source: str, shown: tuple[str, ...], **parts: tuple[str, str]) -> None:
    """A query of keys and values: each part is (rule language, SQL)."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return df.select(*shown, *[value_of(df, text).alias(n) for n, (text, _) in parts.items()])

    query(name, f"SELECT {', '.join([*shown, *(f'{sql} AS {n}' for n, (_, sql) in parts.items())])} FROM {source}")(run)


# ----------------------------------------------------------- expressions

rule("expr_between_violations", "lineitem", "l_discount BETWEEN 0 AND 0.05", LINE, "l_discount BETWEEN 0 AND CAST(0.05 AS DOUBLE)")
rule(
    "expr_between_null", "lineitem", "l_quantity NOT BETWEEN 10 AND CASE WHEN l_linenumber > 3 THEN 20 END", LINE,
    "CASE WHEN l_linenumber > 3 THEN l_quantity NOT BETWEEN 10 AND 20 END",
)
rule("expr_nan_compare", "lineitem", "(l_linenumber - 1) / (l_linenumber - 1) >= 1", LINE, "l_linenumber <> 1")
rule("expr_nan_not_equal", "lineitem", "(l_linenumber - 1) / (l_linenumber - 1) <> NAN AND l_quantity < 30", LINE, "l_quantity < 30")
rule("expr_logic_3vl", "lineitem", "NOT (l_returnflag = 'R') OR CASE WHEN l_linenumber > 2 THEN l_quantity > 25 END", LINE, "NOT (l_returnflag = 'R') OR CASE WHEN l_linenumber > 2 THEN l_quantity > 25 END")
rule("expr_in_null", "lineitem", "l_linenumber NOT IN (1, 2, CASE WHEN l_returnflag = 'A' THEN 3 END)", LINE, "l_linenumber NOT IN (1, 2, CASE WHEN l_returnflag = 'A' THEN 3 END)")
rule("expr_in_expressions", "lineitem", "l_linenumber + 1 IN (l_suppkey, 3, 5)", LINE, "l_linenumber + 1 IN (l_suppkey, 3, 5)")
rule("expr_case", "orders", "CASE WHEN o_orderstatus = 'F' THEN o_totalprice < 200000 WHEN o_orderstatus = 'O' THEN o_totalprice > 50000 END", ("o_orderkey", "o_custkey"), "CASE WHEN o_orderstatus = 'F' THEN o_totalprice < 200000 WHEN o_orderstatus = 'O' THEN o_totalprice > 50000 END")
rule("expr_null_tests", "orders", "CASE WHEN o_orderstatus = 'P' THEN o_custkey END IS NULL", ("o_orderkey",), "o_orderstatus <> 'P'")
rule("expr_like_exact", "part", "p_brand NOT LIKE 'Brand#11'", ("p_partkey", "p_brand"), "p_brand <> 'Brand#11'")
rule("expr_like_prefix", "customer", "NOT c_mktsegment LIKE 'B%'", ("c_custkey", "c_mktsegment"), "NOT starts_with(c_mktsegment, 'B')")
rule("expr_like_suffix", "customer", "NOT c_mktsegment LIKE '%Y'", ("c_custkey", "c_mktsegment"), "NOT ends_with(c_mktsegment, 'Y')")
rule("expr_like_regex", "customer", "NOT c_mktsegment LIKE '_U%D_NG'", ("c_custkey", "c_mktsegment"), "c_mktsegment NOT LIKE '_U%D_NG'")
rule("expr_like_computed", "events", "NOT props LIKE CASE WHEN event_type = 'click' THEN '%' ELSE 'zz%' END", ("event_id",), "NOT (event_type = 'click')")
rule("expr_similar_to", "customer", "NOT c_name SIMILAR TO 'Customer#0+[1-4]\\d*'", ("c_custkey", "c_name"), "NOT regexp_full_match(c_name, 'Customer#0+[1-4]\\d*')")
rule("expr_similar_to_computed", "customer", "NOT c_mktsegment SIMILAR TO CASE WHEN c_custkey > 100 THEN 'B.*' ELSE '[A-H].*' END", ("c_custkey", "c_mktsegment"), "NOT CASE WHEN c_custkey > 100 THEN regexp_full_match(c_mktsegment, 'B.*') ELSE regexp_full_match(c_mktsegment, '[A-H].*') END")
rule("expr_date_shift", "lineitem", "l_shipdate + interval(2, weeks) < '1996-01-01T12:00:00Z'", LINE, "l_shipdate + INTERVAL 14 DAY < TIMESTAMP '1996-01-01 12:00:00'")
rule("expr_now", "orders", "o_orderdate < NOW() - interval(10000, days)", ("o_orderkey",), "o_orderdate < TIMESTAMP '2024-06-01 00:00:00' - INTERVAL 10000 DAY")
rule("expr_precedence", "lineitem", "NOT l_linenumber > 2 AND l_quantity + 2 * 5 > 20 OR l_tax = 0.02", LINE, "((NOT (l_linenumber > 2)) AND (l_quantity + (2 * 5) > 20)) OR l_tax = CAST(0.02 AS DOUBLE)")
rule("expr_columns_regex", "lineitem", "COLUMNS('^l_(tax|discount)$') < 0.08", LINE, "l_tax < CAST(0.08 AS DOUBLE) AND l_discount < CAST(0.08 AS DOUBLE)")
rule("expr_columns_list", "lineitem", "COLUMNS([l_orderkey, l_partkey]) > 100", LINE, "l_orderkey > 100 AND l_partkey > 100")
rule("expr_columns_all", "nation", "COLUMNS(*) IS NOT NULL AND n_nationkey < 20", ("n_nationkey", "n_name"), "n_nationkey < 20")
rule("expr_quoted_names", "nation", "`n_nationkey` < 20", ("n_nationkey",), "n_nationkey < 20")

value("expr_arithmetic", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), a=("l_quantity * l_extendedprice - l_tax", "l_quantity * l_extendedprice - l_tax"), b=("-l_orderkey * 3 + l_linenumber", "-l_orderkey * 3 + l_linenumber"), c=("l_orderkey / l_linenumber", "CAST(l_orderkey AS DOUBLE) / l_linenumber"))
value("expr_arith_div_nonfinite", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), fin=("IS_FINITE((l_linenumber - 2) / (l_linenumber - 1))", "l_linenumber <> 1"), inf=("IS_INFINITE((l_linenumber - 2) / (l_linenumber - 1))", "l_linenumber = 1"), nan=("IS_NAN((l_linenumber - 1) / (l_linenumber - 1))", "l_linenumber = 1"))
value("expr_string_funcs", "part", ("p_partkey",), n=("LENGTH(p_name)", "length(p_name)"), lo=("LOWER(p_brand)", "lower(p_brand)"), up=("UPPER(p_name)", "upper(p_name)"), t=("TRIM(p_name)", "trim(p_name)"), s=("STARTS_WITH(p_name, 'a')", "starts_with(p_name, 'a')"), e=("ENDS_WITH(p_name, 'e')", "ends_with(p_name, 'e')"))
value("expr_unicode_length", "documents", ("doc_id",), n=("LENGTH(text)", "length(text)"), s=("STARTS_WITH(UPPER(lang), 'E')", "starts_with(upper(lang), 'E')"))
value("expr_numeric_funcs", "supplier", ("s_suppkey",), a=("ABS(s_acctbal)", "abs(s_acctbal)"), f=("FLOOR(s_acctbal)", "CAST(floor(s_acctbal) AS DOUBLE)"), c=("CEIL(s_acctbal)", "CAST(ceil(s_acctbal) AS DOUBLE)"), r=("ROUND(s_acctbal)", "round(s_acctbal)"), i=("ABS(-s_suppkey)", "abs(-s_suppkey)"))
value("expr_round_digits", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), r=("ROUND(l_extendedprice, -2)", "round(l_extendedprice / 100) * 100"), z=("ROUND(l_quantity, 400)", "l_quantity"))
value("expr_mod_floored", "lineitem", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), a=("MOD(l_orderkey - 500, 7)", "mod(mod(l_orderkey - 500, 7) + 7, 7)"), b=("MOD(l_orderkey, -7)", "-mod(mod(-l_orderkey, 7) + 7, 7)"), c=("MOD(l_orderkey, l_linenumber)", "CAST(mod(l_orderkey, l_linenumber) AS DOUBLE)"))
value("expr_datetime", "orders", ("o_orderkey",), a=("o_orderdate + interval(36, hours)", "o_orderdate + INTERVAL 36 HOUR"), b=("o_orderdate - interval(90, seconds)", "o_orderdate - INTERVAL 90 SECOND"))


@query(
    "expr_unicode_trim",
    "SELECT doc_id, regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') AS t FROM documents WHERE regexp_replace(text, '^[\\s]+|[\\s]+$', '', 'g') <> text",
)
def _unicode_trim(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    trimmed = value_of(df, "TRIM(text)")
    return df.where(trimmed != F.col("text")).select("doc_id", trimmed.alias("t"))


#: White space of several kinds, put around texts that have none at their ends.
PADDING = "\t\n \u0085\u00a0\u1680\u2003\u2028\u202f\u3000"


@query("expr_unicode_trim_padded", f"SELECT doc_id, trim('{PADDING}' || text || '{PADDING}', '{PADDING}') AS t FROM documents")
def _unicode_trim_padded(spark, sf_dir):
    """Every row; ``expr_unicode_trim`` shows changed texts only, and its tables have none."""
    df = table(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit(PADDING), "text", F.lit(PADDING)))
    return df.select("doc_id", value_of(df, "TRIM(text)").alias("t"))


# ------------------------------------------------------------ definitions

DEFINITIONS = {"bulk": "l_quantity > 20", "total": "SUM(l_quantity)", "price": "l_extendedprice * (1 - l_discount)", "dear": "price > 30000"}
rule("def_filter", "lineitem", "NOT bulk OR l_tax > 0.01", LINE, "NOT (l_quantity > 20) OR l_tax > CAST(0.01 AS DOUBLE)", DEFINITIONS)
rule("def_derived", "lineitem", "price < 50000", LINE, "l_extendedprice * (1 - l_discount) < 50000", DEFINITIONS)
rule("def_nested", "lineitem", "NOT dear OR bulk", LINE, "NOT (l_extendedprice * (1 - l_discount) > 30000) OR l_quantity > 20", DEFINITIONS)
rule("def_metric", "lineitem", "l_quantity * 50000 < total", LINE, "l_quantity * 50000 < (SELECT sum(l_quantity) FROM lineitem)", DEFINITIONS)

# -------------------------------------------------------------- aggregates


@query(
    "agg_all",
    """SELECT min(o_totalprice) AS lo, max(o_orderdate) AS hi, CAST(sum(o_custkey) AS BIGINT) AS total, avg(o_orderkey) AS mean, count(o_orderstatus) AS n,
    count(*) AS rows_, count(DISTINCT o_custkey) AS customers, bool_or(o_totalprice > 400000) AS some, bool_and(o_totalprice > 0) AS every,
    sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS filled, min(o_orderpriority) AS first_priority FROM orders""",
)
def _agg_all(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    wanted = {
        "lo": "MIN(o_totalprice)", "hi": "MAX(o_orderdate)", "total": "SUM(o_custkey)", "mean": "AVG(o_orderkey)", "n": "COUNT(o_orderstatus)",
        "rows_": "ROW_COUNT()", "customers": "COUNT_DISTINCT(o_custkey)", "some": "ANY(o_totalprice > 400000)", "every": "ALL(o_totalprice > 0)",
        "filled": "SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)", "first_priority": "MIN(o_orderpriority)",
    }
    scope = scope_of(df)
    prepared = [assertions.prepare(checked(text, scope, boolean=False), scope, df.schema, NOW) for text in wanted.values()]
    folded = assertions.fold_all(df, prepared, NOW)
    out = []
    for name, p in zip(wanted, prepared, strict=True):
        c = compiling.compile_row(p.instances[0], df.schema, NOW, folded.values)
        out.append((F.timestamp_micros(c.value).cast("timestamp_ntz") if c.kind == "datetime" else c.value).alias(name))
    return folded.alone(spark).select(*out)


@query(
    "agg_empty",
    "SELECT CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS BIGINT) AS total, CAST(NULL AS DOUBLE) AS mean, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS rows_, CAST(0 AS BIGINT) AS d, CAST(NULL AS BOOLEAN) AS some",
)
def _agg_empty(spark, sf_dir):
    df = table(spark, sf_dir, "orders").where("o_orderkey < 0")
    wanted = {"lo": "MIN(o_totalprice)", "total": "SUM(o_custkey)", "mean": "AVG(o_orderkey)", "n": "COUNT(o_orderstatus)", "rows_": "ROW_COUNT()", "d": "COUNT_DISTINCT(o_custkey)", "some": "ANY(o_totalprice > 0)"}
    scope = scope_of(df)
    prepared = [assertions.prepare(checked(text, scope, boolean=False), scope, df.schema, NOW) for text in wanted.values()]
    folded = assertions.fold_all(df, prepared, NOW)
    return folded.alone(spark).select(*[compiling.compile_row(p.instances[0], df.schema, NOW, folded.values).value.alias(n) for n, p in zip(wanted, prepared, strict=True)])


rule("agg_mixed_grain", "lineitem", "l_extendedprice <= 60 * MIN(l_extendedprice)", LINE, "l_extendedprice <= 60 * (SELECT min(l_extendedprice) FROM lineitem)")
rule("agg_mixed_distinct", "lineitem", "l_suppkey * 2 < COUNT_DISTINCT(l_suppkey)", LINE, "l_suppkey * 2 < (SELECT count(DISTINCT l_suppkey) FROM lineitem)")

FUSED = [
    ("l_quantity < 40", "l_quantity < 40"), ("l_discount BETWEEN 0 AND 0.05", "l_discount BETWEEN 0 AND CAST(0.05 AS DOUBLE)"), ("l_tax <= 0.07", "l_tax <= CAST(0.07 AS DOUBLE)"),
    ("l_returnflag IN ('A', 'N')", "l_returnflag IN ('A', 'N')"), ("l_linestatus LIKE 'O%'", "l_linestatus LIKE 'O%'"), ("l_extendedprice > 1000", "l_extendedprice > 1000"),
    ("l_quantity * 1000 < l_extendedprice", "l_quantity * 1000 < l_extendedprice"), ("MOD(l_orderkey, 2) = 0", "l_orderkey % 2 = 0"), ("l_quantity <= 40 * MIN(l_quantity)", "l_quantity <= 40 * (SELECT min(l_quantity) FROM lineitem)"),
    ("l_shipdate < '1996-01-01'", "l_shipdate < TIMESTAMP '1996-01-01'"),
]


def fused(df: DataFrame) -> DataFrame:
    """Ten assertions over one table in one pass: (rule, violations)."""
    scope = scope_of(df)
    prepared = [assertions.prepare(checked(text, scope), scope, df.schema, NOW) for text, _ in FUSED]
    folded = assertions.fold_all(df, prepared, NOW)
    counts = [F.count_if(assertions.judge(p, df.schema, NOW, folded).violated).alias(f"n{k}") for k, p in enumerate(prepared)]
    pairs = [F.struct(F.lit(text).alias("rule"), F.col(f"n{k}").alias("violations")) for k, (text, _) in enumerate(FUSED)]
    return folded.onto(df).agg(*counts).select(F.explode(F.array(*pairs)).alias("r")).select("r.rule", "r.violations")


query("assertions_fused", " UNION ALL ".join(f"SELECT '{text.replace(chr(39), chr(39) * 2)}' AS rule, count(*) FILTER (WHERE ({sql}) IS FALSE) AS violations FROM lineitem" for text, sql in FUSED))(lambda spark, sf_dir: fused(table(spark, sf_dir, "lineitem")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(table(spark, sf_dir, "lineitem"))


@query("violations_overflow", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey > 9")
def _overflow(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    c = compiling.compile_row(checked("l_orderkey * 1000000000000000000 > 0", scope_of(df)), df.schema, NOW)
    return df.where(c.fault == compiling.OVERFLOW).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("bad_pattern_rows", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _bad_pattern(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    c = compiling.compile_row(checked("c_name SIMILAR TO CASE WHEN c_mktsegment = 'BUILDING' THEN '(' ELSE '.*' END", scope_of(df)), df.schema, NOW)
    return df.where(c.fault == compiling.BAD_PATTERN).select("c_custkey")


# ------------------------------------------------------------ data checks


@query(
    "d01_nulls",
    "SELECT count(*) FILTER (WHERE l_returnflag = 'R') AS flag_nulls, count(*) FILTER (WHERE l_quantity IS NULL) AS quantity_nulls, count(*) AS rows_ FROM lineitem",
)
def _nulls(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("flag", F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")))
    return df.agg(columns.count_where(F.col("flag").isNull()).alias("flag_nulls"), columns.count_where(F.col("l_quantity").isNull()).alias("quantity_nulls"), F.count(F.lit(1)).alias("rows_"))


@query("d04_enum_outside", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY l_returnflag")
def _enum(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.where(columns.outside(F.col("l_returnflag"), ["A", "N"])).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "d04_nested",
    """SELECT CAST(sum(n) AS BIGINT) AS outside_values, count(*) FILTER (WHERE n > 0) AS failed_rows FROM (
    SELECT len(list_filter(list_concat([lang], [source]), lambda x: x NOT IN ('en', 'de', 'src1', 'src2'))) AS n FROM documents)""",
)
def _enum_nested(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select(F.array(F.struct(F.array("lang", "source").alias("tags"))).alias("groups"))
    n = columns.outside_values(F.col("groups"), [None, "tags", None], ["en", "de", "src1", "src2"])
    return df.agg(F.sum(n).alias("outside_values"), columns.count_where(n > 0).alias("failed_rows"))


def _known(spark, sf_dir, name, *columns):
    """What the footers tell of the ranges of keys, as a validation asks them."""
    footers = read_footers(spark, f"{sf_dir}/{name}.parquet")
    return [keys.known_range(footers, c) for c in columns]


@query("d02_unique_column", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)")
def _unique(spark, sf_dir):
    return keys.duplicate_count(with_rows(table(spark, sf_dir, "orders"), ["o_custkey"]), [F.col("o_custkey")], _known(spark, sf_dir, "orders", "o_custkey"))


@query("d02_unique_key", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey)")
def _unique_key(spark, sf_dir):
    return keys.duplicate_count(with_rows(table(spark, sf_dir, "orders"), ["o_orderkey"]), [F.col("o_orderkey")], _known(spark, sf_dir, "orders", "o_orderkey"))


@query("d02_composite_key", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def _composite(spark, sf_dir):
    return keys.duplicate_count(with_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]), [F.col("l_orderkey"), F.col("l_linenumber")], _known(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber"))


@query(
    "d02_duplicate_rows",
    "SELECT l_orderkey, l_linenumber, row_ FROM (SELECT l_orderkey, l_linenumber, file_row_number + 1 AS row_, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY file_row_number) AS k FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM lineitem)) WHERE k > 1",
)
def _duplicate_rows(spark, sf_dir):
    df = with_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    pair = [F.col("l_orderkey"), F.col("l_linenumber")]
    return keys.duplicate_rows(df, pair, pair).select("l_orderkey", "l_linenumber", F.col(ROW).alias("row_"))


@query("d02_null_exempt", "SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey, o_orderstatus)")
def _unique_null(spark, sf_dir):
    df = with_rows(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"])
    return keys.duplicate_count(df, [F.col("o_custkey"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus"))])


def _orphans(spark, sf_dir, child, key, parent, target, carry, cast=None, change=None):
    c, p = with_rows(table(spark, sf_dir, child), list(dict.fromkeys([key, *carry]))), table(spark, sf_dir, parent)
    k, kind = F.col(key), c.schema[key].dataType
    if cast is not None:
        k, kind = k.cast(cast), cast
    known = (None, None) if change or cast else (*_known(spark, sf_dir, child, key), *_known(spark, sf_dir, parent, target))
    k = k if change is None else change(k)
    return keys.orphans(c, k, kind, p, F.col(target), p.schema[target].dataType, [F.col(x) for x in carry], known).drop(ROW)


query("d05_fk_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(lambda s, d: _orphans(s, d, "documents", "doc_id", "labels", "doc_id", ["doc_id"]))
query("d05_fk_clean", "SELECT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")(lambda s, d: _orphans(s, d, "lineitem", "l_orderkey", "orders", "o_orderkey", ["l_orderkey"]))
query("d05_fk_integer_widths", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber NOT IN (SELECT r_regionkey FROM region)")(
    lambda s, d: _orphans(s, d, "lineitem", "l_linenumber", "region", "r_regionkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
)
query("d05_fk_cross_type", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE CAST(l_quantity AS DOUBLE) NOT IN (SELECT CAST(s_suppkey AS DOUBLE) FROM supplier)")(
    lambda s, d: _orphans(s, d, "lineitem", "l_quantity", "supplier", "s_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
)
query("d05_fk_cross_type_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(floor(o_totalprice / 100) AS DOUBLE) NOT IN (SELECT CAST(c_custkey AS DOUBLE) FROM customer)")(
    lambda s, d: _orphans(s, d, "orders", "o_totalprice", "customer", "c_custkey", ["o_orderkey", "o_custkey"], change=lambda c: F.floor(c / 100).cast("double"))
)
query("d05_fk_no_common_type", "SELECT c_custkey FROM customer")(lambda s, d: _orphans(s, d, "customer", "c_mktsegment", "orders", "o_orderkey", ["c_custkey"]))
query("d05_fk_null_exempt", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM labels)")(
    lambda s, d: keys.orphans(
        with_rows(table(s, d, "documents"), ["doc_id", "lang"]), F.when(F.col("lang") == "en", F.col("doc_id")), T.LongType(), table(s, d, "labels"), F.col("doc_id"), T.LongType(), [F.col("doc_id")]
    ).drop(ROW)
)


@query("scan_row_numbers", "SELECT o_orderkey, row_number() OVER () AS row_ FROM orders")
def _row_numbers(spark, sf_dir):
    return with_rows(table(spark, sf_dir, "orders"), ["o_orderkey"]).select("o_orderkey", F.col(ROW).alias("row_"))


@query("scan_nested_struct", "SELECT doc_id, lang, length(text) AS n FROM documents WHERE length(text) > 100")
def _struct_access(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "text").alias("body"))
    scope = checking.Scope([checking.Declared("doc_id", "number"), checking.Declared("body", "struct", (checking.Declared("lang", "string"), checking.Declared("text", "string")))])
    length = compiling.compile_row(checked("LENGTH(body.text)", scope, boolean=False), df.schema, NOW).value
    keep = compiling.compile_row(checked("LENGTH(body.text) > 100", scope), df.schema, NOW).value
    return df.where(keep).select("doc_id", F.col("body.lang").alias("lang"), length.alias("n"))


# -------------------------------------------------------------- profiles


def _profile_frame(spark, found: dict) -> DataFrame:
    rows = [(n, p.rows, p.nulls, None if p.low is None else str(p.low), None if p.high is None else str(p.high), p.distinct if not p.approximate else None) for n, p in found.items()]
    return spark.createDataFrame(rows, "name string, rows_ long, nulls long, low string, high string, distinct_ long")


@query(
    "profile_integers",
    """SELECT 'n_nationkey' AS name, count(*) AS rows_, count(*) - count(n_nationkey) AS nulls, CAST(min(n_nationkey) AS VARCHAR) AS low, CAST(max(n_nationkey) AS VARCHAR) AS high, count(DISTINCT n_nationkey) AS distinct_ FROM nation
    UNION ALL SELECT 'n_regionkey', count(*), count(*) - count(n_regionkey), CAST(min(n_regionkey) AS VARCHAR), CAST(max(n_regionkey) AS VARCHAR), count(DISTINCT n_regionkey) FROM nation
    UNION ALL SELECT 'n_name', count(*), count(*) - count(n_name), min(n_name), max(n_name), count(DISTINCT n_name) FROM nation""",
)
def _profile_integers(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return _profile_frame(spark, profiling.profile(df, {c: F.col(c) for c in ("n_nationkey", "n_regionkey", "n_name")}))


@query("profile_numeric", "SELECT min(l_extendedprice) AS low, max(l_extendedprice) AS high, count(*) - count(l_extendedprice) AS nulls, CAST(0 AS BIGINT) AS nans FROM lineitem")
def _profile_numeric(spark, sf_dir):
    p = profiling.profile(table(spark, sf_dir, "lineitem").select("l_extendedprice"), {"x": F.col("l_extendedprice")})["x"]
    return spark.createDataFrame([(p.low, p.high, p.nulls, p.nans)], "low double, high double, nulls long, nans long")


@query("profile_temporal", "SELECT min(o_orderdate) AS low, max(o_orderdate) AS high, count(*) - count(o_orderdate) AS nulls FROM orders")
def _profile_temporal(spark, sf_dir):
    p = profiling.profile(table(spark, sf_dir, "orders").select("o_orderdate"), {"x": F.col("o_orderdate")})["x"]
    return spark.createDataFrame([(p.low, p.high, p.nulls)], "low timestamp_ntz, high timestamp_ntz, nulls long")


@query("profile_text", "SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 20")
def _profile_text(spark, sf_dir):
    p = profiling.profile(table(spark, sf_dir, "part").select("p_brand"), {"x": F.col("p_brand")})["x"]
    return spark.createDataFrame([x[:2] for x in p.top], "value string, n long")


@query("profile_boolean", "SELECT l_returnflag = 'R' AS value, count(*) AS n FROM lineitem GROUP BY 1")
def _profile_boolean(spark, sf_dir):
    p = profiling.profile(table(spark, sf_dir, "lineitem").select("l_returnflag"), {"x": F.col("l_returnflag") == "R"})["x"]
    return spark.createDataFrame([x[:2] for x in p.top], "value boolean, n long")


def _bins(spark, sf_dir, name, column):
    """The filled bins of a column's profile; its table has rows for at least 20 bins from sf0.01 on, so 20 are asked for."""
    footers = read_footers(spark, f"{sf_dir}/{name}.parquet")
    ranges = profiling.footer_ranges(footers, [column])
    p = profiling.profile(table(spark, sf_dir, name).select(column), {column: F.col(column)}, 20, None, ranges, max(footers.rows, 10**6) if footers else None)[column]
    return spark.createDataFrame([(k, b.count) for k, b in enumerate(p.bins) if b.count], "bin int, n long")


@query(
    "profile_histogram",
    """WITH e AS (SELECT CAST(min(l_quantity) AS DOUBLE) AS lo, CAST(max(l_quantity) AS DOUBLE) AS hi FROM lineitem)
    SELECT CAST(least(greatest(ceil((l_quantity - lo) / ((hi - lo) / 20)) - 1, 0), 19) AS INTEGER) AS bin, count(*) AS n FROM lineitem, e GROUP BY 1""",
)
def _histogram(spark, sf_dir):
    """The bins of a profile whose range the footers tell before."""
    return _bins(spark, sf_dir, "lineitem", "l_quantity")


@query(
    "profile_histogram_integers",
    """WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part), w AS (SELECT lo, hi, greatest(1, CAST(ceil((hi - lo) / 20.0) AS INTEGER)) AS width FROM e)
    SELECT CAST(greatest(CAST(ceil((p_size - lo) / CAST(width AS DOUBLE)) AS INTEGER) - 1, 0) AS INTEGER) AS bin, count(*) AS n FROM part, w GROUP BY 1""",
)
def _histogram_integers(spark, sf_dir):
    return _bins(spark, sf_dir, "part", "p_size")


@query(
    "profile_non_finite",
    "SELECT count(*) FILTER (WHERE l_linenumber = 1 AND l_quantity = 1) AS nans, count(*) FILTER (WHERE l_linenumber = 1 AND l_quantity > 1) AS positive, CAST(0 AS BIGINT) AS negative FROM lineitem",
)
def _non_finite(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    x = value_of(df, "(l_quantity - 1) / (l_linenumber - 1)")
    p = profiling.profile(df.select(x.alias("x")), {"x": F.col("x")}, values=set())["x"]
    return spark.createDataFrame([(p.nans, p.positive_infinities, p.negative_infinities)], "nans long, positive long, negative long")


@query("export_profile_nested", "SELECT min(x) AS low, max(x) AS high, count(*) AS n FROM (SELECT unnest(embedding) AS x FROM embeddings)")
def _profile_nested(spark, sf_dir):
    """The ends of the histogram of a list's elements, and how many are in it."""
    elements, x = profiling.element_column(table(spark, sf_dir, "embeddings"), F.col("embedding"), [None])
    bins = profiling.profile(elements, {"x": x})["x"].bins
    return spark.createDataFrame([(bins[0].low, bins[-1].high, sum(b.count for b in bins))], "low float, high float, n long")


@query("profile_samples", "SELECT DISTINCT p_name AS value FROM part")
def _samples(spark, sf_dir):
    """All values: ``part`` has fewer distinct names than the pool may hold."""
    p = profiling.profile(table(spark, sf_dir, "part").select("p_name"), {"x": F.col("p_name")}, samples=profiling.SAMPLE_POOL)["x"]
    return spark.createDataFrame([(v,) for v in p.samples], "value string")


@query(
    "profile_frequent_counts",
    """SELECT 'p_size' AS name, CAST(p_size AS VARCHAR) AS value, n, CAST(0 AS BIGINT) AS error FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_size LIMIT 20)
    UNION ALL SELECT 'p_type', p_type, n, 0 FROM (SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type LIMIT 20)
    UNION ALL SELECT 'l_suppkey', CAST(l_suppkey AS VARCHAR), n, 0 FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 20)""",
)
def _frequent_counts(spark, sf_dir):
    """Frequent values of texts and numbers with their errors: 0, since what the summaries could not hold is counted again."""
    rows = []
    for name, columns in (("part", ("p_size", "p_type")), ("lineitem", ("l_suppkey",))):
        for c, p in profiling.profile(table(spark, sf_dir, name).select(*columns), {c: F.col(c) for c in columns}, exact_top=True).items():
            rows += [(c, str(v), n, e) for v, n, e in p.top]
    return spark.createDataFrame(rows, "name string, value string, n long, error long")


@query(
    "profile_sample_spread",
    """WITH v AS (SELECT p_size AS value, row_number() OVER (ORDER BY p_size) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT p_size FROM part)), i AS (SELECT unnest(range(20)) AS i)
    SELECT DISTINCT value FROM v, i WHERE n <= 20 OR pos = CAST(round_even(i * (n - 1) / 19.0, 0) AS BIGINT)""",
)
def _sample_spread(spark, sf_dir):
    """Samples are spread evenly over the sorted distinct values, of which there are more than samples here."""
    p = profiling.profile(table(spark, sf_dir, "part").select("p_size"), {"x": F.col("p_size")})["x"]
    return spark.createDataFrame([(v,) for v in p.samples], "value int")


@query(
    "profile_histogram_rule",
    """WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi, greatest(5, least(50, CAST(round(cbrt(2 * count(*))) AS INTEGER))) AS wanted FROM part),
    w AS (SELECT lo, hi, greatest(1, CAST(ceil((hi - lo) / CAST(wanted AS DOUBLE)) AS INTEGER)) AS width FROM e),
    b AS (SELECT unnest(generate_series(0, CAST(ceil((hi - lo) / CAST(width AS DOUBLE)) AS INTEGER) - 1)) AS bin FROM w),
    h AS (SELECT greatest(CAST(ceil((p_size - lo) / CAST(width AS DOUBLE)) AS INTEGER) - 1, 0) AS bin, count(*) AS n FROM part, w GROUP BY 1)
    SELECT CAST(b.bin AS INTEGER) AS bin, CAST(coalesce(h.n, 0) AS BIGINT) AS n FROM b LEFT JOIN h ON b.bin = h.bin""",
)
def _histogram_rule(spark, sf_dir):
    """The bins of a whole profile, empty ones included; their number follows from the number of rows."""
    p = profiling.profile(table(spark, sf_dir, "part").select("p_size"), {"x": F.col("p_size")}, most_bins=50)["x"]
    return spark.createDataFrame([(k, b.count) for k, b in enumerate(p.bins)], "bin int, n long")


@query(
    "profile_nested",
    "SELECT count(*) AS rows_, count(*) - count(x) AS nulls, min(x) AS low, max(x) AS high, count(*) AS binned FROM (SELECT unnest(embedding) AS x FROM embeddings)",
)
def _nested_profile(spark, sf_dir):
    """The profile of a list's elements."""
    elements, x = profiling.element_column(table(spark, sf_dir, "embeddings"), F.col("embedding"), [None])
    p = profiling.profile(elements, {"x": x})["x"]
    return spark.createDataFrame([(p.rows, p.nulls, p.low, p.high, sum(b.count for b in p.bins))], "rows_ long, nulls long, low float, high float, binned long")


# --------------------------------------------------------- whole dictionaries

DICTIONARY = """
$version: "0.1.0"
$learn_more: https://example.org/dictionaries
tables:
  - name: lineitem
    source: {{parquet: {dir}/lineitem.parquet}}
    columns:
      - {{name: l_orderkey, type: number(id), examples: [1], constraints: [primary_key, foreign_key]}}
      - {{name: l_linenumber, type: number(id), examples: [1], constraints: [primary_key]}}
      - {{name: l_returnflag, type: enum, values: [A, N], constraints: [required]}}
      - {{name: l_quantity, type: number(quantity), range: [0, 100], constraints: [{{assert: l_quantity < 40}}]}}
    constraints:
      - assert: l_quantity <= 40 * MIN(l_quantity)
      - assert: AVG(l_quantity) < 10
  - name: orders
    source: {{parquet: {dir}/orders.parquet}}
    columns:
      - {{name: o_orderkey, type: number(id), examples: [1], constraints: [primary_key]}}
      - {{name: o_custkey, type: number(id), examples: [1], constraints: [unique]}}
relationships:
  - {{join: lineitem.l_orderkey = orders.o_orderkey, cardinality: many-to-one}}
"""


@query(
    "validate_data",
    """SELECT 'D02' AS code, 'l_orderkey,l_linenumber' AS columns, CAST(sum(n - 1) AS BIGINT) AS count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
    UNION ALL SELECT 'D04', 'l_returnflag', count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')
    UNION ALL SELECT 'D07', 'l_quantity', count(*) FROM lineitem WHERE l_quantity >= 40
    UNION ALL SELECT 'D07', 'l_quantity', count(*) FROM lineitem WHERE l_quantity > 40 * (SELECT min(l_quantity) FROM lineitem)
    UNION ALL SELECT 'D07', 'l_quantity', NULL
    UNION ALL SELECT 'D02', 'o_custkey', CAST(sum(n - 1) AS BIGINT) FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)""",
)
def _validate_data(spark, sf_dir):
    from .validate import problems_frame, validate

    run = validate(spark, text=DICTIONARY.format(dir=sf_dir), now=NOW)
    return problems_frame(spark, run).where("severity = 'error'").select("code", "columns", "count")


@query(
    "validate_data_rows",
    """WITH l AS (SELECT *, row_number() OVER () AS r FROM lineitem), o AS (SELECT *, row_number() OVER () AS r FROM orders),
    f AS (
        SELECT 'D02' AS code, 'l_orderkey,l_linenumber' AS columns, r AS row_, concat_ws(',', 'l_linenumber=' || l_linenumber, 'l_orderkey=' || l_orderkey) AS shown
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY r) AS again FROM l) WHERE again > 1
        UNION ALL SELECT 'D02', 'o_custkey', r, 'o_custkey=' || o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY r) AS again FROM o) WHERE again > 1
        UNION ALL SELECT 'D04', 'l_returnflag', r, 'l_returnflag=' || l_returnflag FROM l WHERE l_returnflag NOT IN ('A', 'N')
        UNION ALL SELECT 'D07', 'l_quantity', r, 'l_quantity=' || CAST(l_quantity AS INTEGER) FROM l WHERE l_quantity >= 40
    )
    SELECT code, columns, row_, shown FROM f QUALIFY row_number() OVER (PARTITION BY code, columns ORDER BY row_) <= 5""",
)
def _validate_data_rows(spark, sf_dir):
    """The offending rows that a validation reports, with the values that it shows."""
    from .validate import validate

    run = validate(spark, text=DICTIONARY.format(dir=sf_dir), now=NOW)
    rows = []
    for p in run.problems:
        more = dict(p.extra)
        if p.severity == "error" and more.get("rows") and more.get("assertion") in (None, "l_quantity < 40"):
            rows += [(p.code, ",".join(p.columns), r, ",".join(f"{k}={v[k]}" for k in sorted(v))) for r, v in zip(more["rows"], more["values"], strict=True)]
    return spark.createDataFrame(rows, "code string, columns string, row_ long, shown string")


@query(
    "validate_meta_undocumented",
    """SELECT 'M03' AS code, 'lineitem' AS "table", column_name AS columns FROM (DESCRIBE lineitem) WHERE column_name NOT IN ('l_orderkey', 'l_linenumber', 'l_returnflag', 'l_quantity')
    UNION ALL SELECT 'M03', 'orders', column_name FROM (DESCRIBE orders) WHERE column_name NOT IN ('o_orderkey', 'o_custkey')""",
)
def _validate_meta(spark, sf_dir):
    from .validate import problems_frame, validate

    return problems_frame(spark, validate(spark, text=DICTIONARY.format(dir=sf_dir), level="meta", now=NOW)).select("code", "table", "columns")


# ------------------------------------------------------ relationship joins


@query("join_equality", "SELECT l_orderkey, l_linenumber, l_quantity, l_suppkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _join_equality(spark, sf_dir):
    from .relationships import join_tables

    frames = {name: table(spark, sf_dir, name) for name in ("lineitem", "orders")}
    return join_tables("lineitem.l_orderkey = orders.o_orderkey", frames).select("lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_quantity", "lineitem.l_suppkey", "orders.o_orderpriority")


@query("join_equality_whole", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _join_equality_whole(spark, sf_dir):
    """As ``join_equality``, with the keys of part and customer."""
    from .relationships import join_tables

    frames = {name: table(spark, sf_dir, name) for name in ("lineitem", "orders")}
    return join_tables("lineitem.l_orderkey = orders.o_orderkey", frames).select("lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_partkey", "lineitem.l_suppkey", "orders.o_custkey")


@query("join_self_alias", "SELECT a.s_suppkey AS left_key, b.s_suppkey AS right_key FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def _join_self(spark, sf_dir):
    from .relationships import join_tables

    frames = {"supplier": table(spark, sf_dir, "supplier")}
    joined = join_tables("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", frames, {"a": "supplier", "b": "supplier"})
    return joined.select(F.col("a.s_suppkey").alias("left_key"), F.col("b.s_suppkey").alias("right_key"))


@query(
    "join_bounds",
    "SELECT l_orderkey, l_linenumber, l_quantity, p_partkey, p_size FROM lineitem JOIN part ON l_partkey = p_partkey AND l_quantity >= p_size AND l_linenumber <= p_size",
)
def _join_bounds(spark, sf_dir):
    """An equality and two bounds: the bounds are the equality join's residual condition."""
    from .relationships import join_tables

    frames = {name: table(spark, sf_dir, name) for name in ("lineitem", "part")}
    joined = join_tables("lineitem.l_partkey = part.p_partkey AND lineitem.l_quantity >= part.p_size AND lineitem.l_linenumber <= part.p_size", frames)
    return joined.select("lineitem.l_orderkey", "lineitem.l_linenumber", "lineitem.l_quantity", "part.p_partkey", "part.p_size")


@query(
    "join_range",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal >= s_acctbal AND c_acctbal < s_acctbal + 50",
)
def _join_range(spark, sf_dir):
    """Bounds alone: customers whose balance is within 50 above a supplier's."""
    from .relationships import join_tables

    bands = table(spark, sf_dir, "supplier").withColumn("upto", F.col("s_acctbal") + 50)
    joined = join_tables("customer.c_acctbal >= band.s_acctbal AND customer.c_acctbal < band.upto", {"customer": table(spark, sf_dir, "customer"), "band": bands})
    return joined.select("customer.c_custkey", "band.s_suppkey")


@query(
    "join_range_text",
    "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_name >= 'Customer#' || substr(s_name, 10) AND c_name < 'Customer#' || lpad(CAST(s_suppkey + 20 AS VARCHAR), 9, '0')",
)
def _join_range_text(spark, sf_dir):
    """Bounds that are texts."""
    from .relationships import join_tables

    first = F.concat(F.lit("Customer#"), F.substring("s_name", 10, 9))
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", first.alias("first"), F.concat(F.lit("Customer#"), F.lpad((F.col("s_suppkey") + 20).cast("string"), 9, "0")).alias("upto"))
    joined = join_tables("customer.c_name >= band.first AND customer.c_name < band.upto", {"customer": table(spark, sf_dir, "customer"), "band": bands})
    return joined.select("customer.c_custkey", "band.s_suppkey")


@query(
    "join_range_dates",
    "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON CAST(o_orderdate AS DATE) >= DATE '1992-01-01' + CAST(c_custkey AS INTEGER) AND CAST(o_orderdate AS DATE) <= DATE '1992-01-03' + CAST(c_custkey AS INTEGER)",
)
def _join_range_dates(spark, sf_dir):
    """Bounds that are dates: orders of the three days from a customer's own."""
    from .relationships import join_tables

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    day = F.col("c_custkey").cast("int")
    bands = table(spark, sf_dir, "customer").select("c_custkey", F.date_add(F.lit("1992-01-01").cast("date"), day).alias("first"), F.date_add(F.lit("1992-01-03").cast("date"), day).alias("last"))
    joined = join_tables("orders.day >= offer.first AND orders.day <= offer.last", {"orders": orders, "offer": bands})
    return joined.select("orders.o_orderkey", "offer.c_custkey")


@query(
    "join_range_decimals",
    "SELECT l_orderkey, l_linenumber, s_suppkey FROM lineitem JOIN supplier ON CAST(l_extendedprice AS DECIMAL(12,2)) > CAST(s_acctbal AS DECIMAL(12,2)) AND CAST(l_extendedprice AS DECIMAL(12,2)) <= CAST(s_acctbal AS DECIMAL(12,2)) + 25",
)
def _join_range_decimals(spark, sf_dir):
    """Bounds that are decimals, over whole lineitem."""
    from .relationships import join_tables

    points = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("price"))
    balance = F.col("s_acctbal").cast("decimal(12,2)")
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", balance.alias("above"), (balance + F.lit(25).cast("decimal(12,2)")).alias("upto"))
    joined = join_tables("lineitem.price > band.above AND lineitem.price <= band.upto", {"lineitem": points, "band": bands})
    return joined.select("lineitem.l_orderkey", "lineitem.l_linenumber", "band.s_suppkey")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
