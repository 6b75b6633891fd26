"""Checked expressions to Spark columns.

Every node compiles to a value and, where arithmetic or a pattern from the data
can fail, a *fault*: an integer column, 0 for none, ``OVERFLOW`` or
``BAD_PATTERN``. Faults are data, never exceptions: integer arithmetic uses the
``try_*`` functions, so evaluation order does not matter, and ``AND``, ``OR``
and ``CASE`` let through only the faults of operands that a left-to-right
reading would have evaluated. Spark's ``try_*`` functions throw and catch an
exception for each row that overflows, which takes far longer than the rest of
the row, so they see only operands that :func:`fits` lets pass.

Plain Spark operators are wrapped where they differ from the language: NaN in
comparisons, nulls in ``BETWEEN``, zero divisors, floored ``MOD``, rounding by
binary scaling, Unicode ``TRIM``.

Only built-in functions are used, except for ``SIMILAR TO`` with a pattern from
the data (an Arrow-batched function, because a bad pattern must not stop the
query). Datetimes are microseconds since 1970 in UTC; the session's time zone
must be UTC.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import syntax as s
from .checking import AGGREGATES, UNITS, Typed, regex_problem

OVERFLOW, BAD_PATTERN = 1, 2
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
DAY = 86_400_000_000
EPOCH = dt.datetime(1970, 1, 1)
#: Decimals with more digits than this can't be read as floats without loss.
DECIMAL_DIGITS = 15


class Unreadable(ValueError):
    """A column's stored type can't be read as its declared type."""

    def __init__(self, path: tuple[str, ...], reason: str):
        super().__init__(reason)
        self.path = path


@dataclass
class Compiled:
    value: Column
    kind: str  # int, float, boolean, string, date, datetime, interval, null, other
    fault: Column | None = None
    nan: Column | None = None  # an int that is a NaN here: MOD by zero


def micros(value: dt.datetime) -> int:
    return (value - EPOCH) // dt.timedelta(microseconds=1)


def kind_of(data_type: T.DataType, path: tuple[str, ...]) -> str:
    """How the values of a stored type are held."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(data_type, T.DecimalType):
        if data_type.precision > DECIMAL_DIGITS:
            raise Unreadable(path, f"{data_type.simpleString()} has more than {DECIMAL_DIGITS} digits")
        return "float"
    simple = {T.StringType: "string", T.BinaryType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "datetime", T.TimestampNTZType: "datetime"}
    return next((k for t, k in simple.items() if isinstance(data_type, t)), "other")


def column_ref(path: tuple[str, ...]) -> Column:
    out = F.col("`" + path[0].replace("`", "``") + "`")
    for name in path[1:]:
        out = out.getField(name)
    return out


def field_type(schema: T.StructType, path: tuple[str, ...]) -> T.DataType | None:
    kind: T.DataType = schema
    for name in path:
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        kind = kind[name].dataType
    return kind


def read_column(schema: T.StructType, path: tuple[str, ...]) -> Compiled:
    data_type = field_type(schema, path)
    if data_type is None:
        raise Unreadable(path, "the column is not in the data")
    kind, value = kind_of(data_type, path), column_ref(path)
    if kind == "int":
        value = value.cast("bigint")
    elif kind == "float":
        value = value.cast("double")
    elif kind == "string":
        value = value.cast("string")
    elif kind == "datetime":
        value = F.unix_micros(value.cast("timestamp"))
    return Compiled(value, kind)


def like_regex(pattern: str) -> str:
    body = "".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern)
    return f"(?s)\\A{body}\\z"


def _faults(*parts: Column | None) -> Column | None:
    """The first fault of operands in order."""
    held = [p for p in parts if p is not None]
    if not held:
        return None
    out = held[-1]
    for p in reversed(held[:-1]):
        out = F.when(p != 0, p).otherwise(out)
    return out


def as_float(c: Compiled) -> Column:
    if c.kind != "int":
        return c.value.cast("double") if c.kind == "null" else c.value
    value = c.value.cast("double")
    return value if c.nan is None else F.when(c.nan, F.lit(float("nan"))).otherwise(value)


def _plain(c: Compiled) -> Compiled:
    """An int that may be a NaN as a float; anything else as it is."""
    return c if c.nan is None else Compiled(as_float(c), "float", c.fault)


def as_micros(c: Compiled) -> Column:
    return F.unix_date(c.value).cast("bigint") * F.lit(DAY) if c.kind == "date" else c.value


#: Products of 64-bit numbers as floats: what is below may fit, for rounding moves it by less than the excess over 2**63.
PRODUCT = 2.0**63 + 2.0**13


def fits(op: str, a: Column, b: Column) -> Column:
    """Whether a sum, difference or product of two longs is one; null for a null operand.

    Exact for sums and differences; products that are too large by less than 1
    in 2**50 pass. Nothing in it can overflow, whatever is evaluated, and ``a``
    is named once, so that chains of operators do not grow faster than they did.
    """
    if op == "*":
        return F.abs(a.cast("double") * b.cast("double")) <= F.lit(PRODUCT)
    zero, negative = F.lit(0).cast("bigint"), F.shiftright(b, 63)  # -1 where b is negative, else 0
    room = F.lit(LONG_MAX).cast("bigint") - F.greatest(b, zero) + F.least(b, zero)
    # a <= room on the side that b moves it to; the other side is mirrored by ~x, which is -x - 1
    return a.bitwiseXOR(negative if op == "+" else F.bitwise_not(negative)) <= room


def attempt(op: str, a: Column, b: Column) -> tuple[Column, Column | None]:
    """A sum, difference or product of two longs, null if it overflows; and whether it does, where that takes less than to ask for the null."""
    fit = fits(op, a, b)
    return F.when(fit, {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b)), None if op == "*" else ~fit


def _size(n: s.Node) -> int:
    return 1 + sum(map(_size, n.children()))


def _any_null(*values: Column) -> Column:
    out = values[0].isNull()
    for v in values[1:]:
        out = out | v.isNull()
    return out


@F.pandas_udf(T.IntegerType())
def _similar(subject, pattern):
    """1 match, 0 none, 2 bad pattern, null for a null operand.

    Patterns from the data obey the same rules as those in a contract, and each
    distinct one of a batch is checked and compiled once.
    """
    import pandas as pd

    out = pd.Series(pd.NA, index=subject.index, dtype="Int32")
    known = subject.notna() & pattern.notna()
    for p, texts in subject[known].groupby(pattern[known], sort=False):
        if regex_problem(p) is not None:
            out[texts.index] = 2
        else:
            whole = re.compile(p, re.ASCII).fullmatch
            out[texts.index] = [int(whole(t) is not None) for t in texts]
    return out


class Compiler:
    """``aggregates`` maps aggregate nodes (by identity) to compiled values."""

    def __init__(self, schema: T.StructType, now: dt.datetime, aggregates: dict[int, Compiled] | None = None):
        self.schema, self.now, self.aggregates = schema, now, aggregates or {}

    def __call__(self, node: s.Node) -> Compiled:
        if id(node) in self.aggregates:
            return self.aggregates[id(node)]
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def on_literal(self, n: s.Literal) -> Compiled:
        if n.kind == "null":
            return Compiled(F.lit(None), "null")
        if n.kind == "int":
            return Compiled(F.lit(n.value).cast("bigint"), "int")
        if n.kind == "float":
            return Compiled(F.lit(n.value).cast("double"), "float")
        if n.kind == "datetime":
            value = n.value if isinstance(n.value, dt.datetime) else dt.datetime.combine(n.value, dt.time())
            return Compiled(F.lit(micros(value)).cast("bigint"), "datetime")
        return Compiled(F.lit(n.value), n.kind)

    def on_column(self, n: s.Column) -> Compiled:
        return read_column(self.schema, n.path)

    def stored(self, n: s.Node) -> Compiled:
        """A bare column as it is stored, for what asks only whether it is null."""
        if isinstance(n, s.Column) and field_type(self.schema, n.path) is not None:
            return Compiled(column_ref(n.path), "other")
        return self(n)

    def on_negative(self, n: s.Negative) -> Compiled:
        c = _plain(self(n.operand))
        if c.kind == "int":
            return self.overflowing(*attempt("-", F.lit(0).cast("bigint"), c.value), c)
        return Compiled(-as_float(c), "float", c.fault)

    def overflowing(self, value: Column, lost: Column | None, *operands: Compiled) -> Compiled:
        if lost is None:
            lost = value.isNull() & ~_any_null(*(c.value for c in operands))
        return Compiled(value, "int", _faults(*(c.fault for c in operands), F.when(lost, OVERFLOW).otherwise(0)))

    def on_arithmetic(self, n: s.Arithmetic) -> Compiled:
        a, b = self(n.left), self(n.right)
        if "interval" in (a.kind, b.kind):
            if a.kind == "interval":
                a, b = b, a
            out = self.overflowing(*attempt(n.op, as_micros(a).cast("bigint"), b.value), a, b)
            return Compiled(out.value, "datetime", out.fault)
        a, b = _plain(a), _plain(b)
        fault = _faults(a.fault, b.fault)
        if n.op != "/" and a.kind == b.kind == "int":
            # The optimizer would regroup a chain of sums or products, and other partial results can overflow; ``attempt`` keeps them apart.
            larger = n.op != "-" and _size(n.right) > _size(n.left)
            return self.overflowing(*attempt(n.op, *((b.value, a.value) if larger else (a.value, b.value))), a, b)
        x, y = as_float(a), as_float(b)
        if n.op == "/":
            return Compiled(F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(F.try_divide(x, y)), "float", fault)
        return Compiled({"+": x + y, "-": x - y, "*": x * y}[n.op], "float", fault)

    def compared(self, op: str, a: Compiled, b: Compiled) -> Column:
        if "null" in (a.kind, b.kind):
            return F.lit(None).cast("boolean")
        nans = []
        if a.kind in ("int", "float") and b.kind in ("int", "float"):
            if a.kind == b.kind == "int":
                x, y = a.value, b.value
                nans = [c.nan for c in (a, b) if c.nan is not None]
            else:
                x, y = as_float(a), as_float(b)
                nans = [F.isnan(v) for c, v in ((a, x), (b, y)) if c.kind == "float" or c.nan is not None]
        elif "datetime" in (a.kind, b.kind) and {a.kind, b.kind} <= {"date", "datetime"}:
            x, y = as_micros(a), as_micros(b)
        elif a.kind == b.kind:
            x, y = a.value, b.value
        else:
            x, y = a.value.cast("string"), b.value.cast("string")
        result = {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
        if not nans:
            return result
        nan = nans[0]
        for other in nans[1:]:
            nan = nan | other
        return F.when(_any_null(x, y), F.lit(None)).when(nan, F.lit(op == "<>")).otherwise(result)

    def on_compare(self, n: s.Compare) -> Compiled:
        a, b = self(n.left), self(n.right)
        return Compiled(self.compared(n.op, a, b), "boolean", _faults(a.fault, b.fault))

    def on_isnull(self, n: s.IsNull) -> Compiled:
        c = self.stored(n.operand)
        value = c.value.isNotNull() if n.negated else c.value.isNull()
        if c.nan is not None:
            value = F.when(c.nan, F.lit(n.negated)).otherwise(value)
        return Compiled(value, "boolean", c.fault)

    def on_between(self, n: s.Between) -> Compiled:
        x, lo, hi = self(n.operand), self(n.low), self(n.high)
        inside = self.compared("<=", lo, x) & self.compared("<=", x, hi)
        value = F.when(_any_null(x.value, lo.value, hi.value), F.lit(None)).otherwise(~inside if n.negated else inside)
        return Compiled(value.cast("boolean"), "boolean", _faults(x.fault, lo.fault, hi.fault))

    def on_member(self, n: s.Member) -> Compiled:
        x, items = self(n.operand), [self(i) for i in n.items]
        out = self.compared("=", x, items[0])
        for i in items[1:]:
            out = out | self.compared("=", x, i)
        return Compiled(~out if n.negated else out, "boolean", _faults(x.fault, *(i.fault for i in items)))

    def on_not(self, n: s.Not) -> Compiled:
        c = self(n.operand)
        return Compiled(~c.value.cast("boolean"), "boolean", c.fault)

    def on_logic(self, n: s.Logic) -> Compiled:
        a, b = self(n.left), self(n.right)
        x, y = a.value.cast("boolean"), b.value.cast("boolean")
        decisive = n.op == "OR"
        fault = b.fault
        if fault is not None:
            fault = F.when(x.eqNullSafe(F.lit(decisive)), 0).otherwise(fault)
        return Compiled(x | y if decisive else x & y, "boolean", _faults(a.fault, fault))

    def on_match(self, n: s.Match) -> Compiled:
        x, p = self(n.operand), self(n.pattern)
        fault = _faults(x.fault, p.fault)
        text = x.value.cast("string")
        literal = n.pattern.value if isinstance(n.pattern, s.Literal) and n.pattern.kind == "string" else None
        if n.how == "LIKE":
            if literal is None:
                escaped = F.regexp_replace(p.value.cast("string"), r"([\\^$.|?*+()\[\]{}])", r"\\$1")
                regex = F.concat(F.lit("(?s)\\A"), F.replace(F.replace(escaped, F.lit("%"), F.lit(".*")), F.lit("_"), F.lit(".")), F.lit("\\z"))
                value = F.rlike(text, regex)
            else:
                value = self.like(text, literal)
        elif literal is not None:
            value = F.rlike(text, F.lit(f"(?d)\\A(?:{literal})\\z"))
        else:
            code = _similar(text, p.value.cast("string"))
            value = F.when(code != 2, code == 1)
            fault = _faults(fault, F.when(code == 2, BAD_PATTERN).otherwise(0))
        return Compiled(~value if n.negated else value, "boolean", fault)

    def like(self, text: Column, pattern: str) -> Column:
        if "%" not in pattern and "_" not in pattern:
            return text == F.lit(pattern)
        body = pattern.strip("%")
        if "%" not in body and "_" not in body:
            if pattern == body + "%":
                return F.startswith(text, F.lit(body))
            if pattern == "%" + body:
                return F.endswith(text, F.lit(body))
            if pattern == "%" + body + "%":
                return F.contains(text, F.lit(body))
        return F.rlike(text, F.lit(like_regex(pattern)))

    def on_case(self, n: s.Case) -> Compiled:
        tests = [self(c) for c, _ in n.branches]
        results = [_plain(self(r)) for _, r in n.branches]
        last = _plain(self(n.otherwise)) if n.otherwise else Compiled(F.lit(None), "null")
        kinds = {r.kind for r in [*results, last]} - {"null"}
        if kinds <= {"int"} or len(kinds) <= 1:
            kind = kinds.pop() if kinds else "null"
            cast = lambda c: c.value
        elif kinds <= {"int", "float"}:
            kind, cast = "float", as_float
        elif kinds <= {"date", "datetime"}:
            kind, cast = "datetime", lambda c: as_micros(c).cast("bigint")
        else:
            kind, cast = "string", lambda c: c.value.cast("string")
        value, fault = cast(last), last.fault
        fault = F.lit(0) if fault is None else fault
        faulty = last.fault is not None
        for t, r in zip(reversed(tests), reversed(results), strict=True):
            taken = t.value.cast("boolean")
            value = F.when(taken, cast(r)).otherwise(value)
            below = F.when(taken, F.lit(0) if r.fault is None else r.fault).otherwise(fault)
            fault = below if t.fault is None else F.when(t.fault != 0, t.fault).otherwise(below)
            faulty |= t.fault is not None or r.fault is not None
        return Compiled(value, kind, fault if faulty else None)

    def on_interval(self, n: s.Interval) -> Compiled:
        c, unit = _plain(self(n.amount)), UNITS[n.unit] * 1_000_000
        if c.kind == "float":
            whole = F.when(F.abs(c.value) < 2.0**63, F.when(c.value < 0, F.ceil(c.value)).otherwise(F.floor(c.value)))
            c = Compiled(whole.cast("bigint"), "int", _faults(c.fault, F.when(c.value.isNotNull() & whole.isNull(), OVERFLOW).otherwise(0)))
        out = self.overflowing(*attempt("*", c.value, F.lit(unit).cast("bigint")), c)
        return Compiled(out.value, "interval", out.fault)

    def on_call(self, n: s.Call) -> Compiled:
        if n.name in AGGREGATES:
            raise ValueError(f"aggregate {n.name} was not folded")
        if n.name == "NOW":
            return Compiled(F.lit(micros(self.now)).cast("bigint"), "datetime")
        args = [self(a) for a in n.arguments]
        return getattr(self, "fn_" + n.name.lower())(*args, fault=_faults(*(a.fault for a in args)), node=n)

    def fn_length(self, x, fault, node):
        return Compiled(F.char_length(x.value.cast("string")).cast("bigint"), "int", fault)

    def fn_lower(self, x, fault, node):
        return Compiled(F.lower(x.value.cast("string")), "string", fault)

    def fn_upper(self, x, fault, node):
        return Compiled(F.upper(x.value.cast("string")), "string", fault)

    def fn_trim(self, x, fault, node):
        return Compiled(F.regexp_replace(x.value.cast("string"), r"(?U)\A\s+|\s+\z", ""), "string", fault)

    def fn_starts_with(self, x, p, fault, node):
        return Compiled(F.startswith(x.value.cast("string"), p.value.cast("string")), "boolean", fault)

    def fn_ends_with(self, x, p, fault, node):
        return Compiled(F.endswith(x.value.cast("string"), p.value.cast("string")), "boolean", fault)

    def fn_abs(self, x, fault, node):
        x = _plain(x)
        if x.kind == "int":
            out = self.overflowing(F.abs(F.when(x.value != LONG_MIN, x.value)), None, Compiled(x.value, "int"))
            return Compiled(out.value, "int", _faults(fault, out.fault))
        return Compiled(F.abs(as_float(x)), "float", fault)

    def _whole(self, x, how, fault):
        v = as_float(x)
        return Compiled(F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(how(v).cast("double")), "float", fault)

    def fn_floor(self, x, fault, node):
        return self._whole(x, F.floor, fault)

    def fn_ceil(self, x, fault, node):
        return self._whole(x, F.ceil, fault)

    def fn_round(self, x, *digits, fault, node):
        v = as_float(x)
        if digits:
            d = as_float(digits[0])
            whole = F.when(d < 0, F.ceil(F.greatest(d, F.lit(-400.0)))).otherwise(F.floor(F.least(d, F.lit(400.0))))
            factor = F.when(d.isNotNull(), F.pow(F.lit(10.0), whole.cast("double")))
        else:
            factor = F.lit(1.0)
        scaled = v * factor
        size = F.abs(scaled)
        below = F.when(size >= 2.0**52, size).otherwise(F.floor(size).cast("double"))
        rounded = F.signum(scaled) * (below + F.when(size - below >= 0.5, 1.0).otherwise(0.0))
        value = (
            F.when(_any_null(v, factor), F.lit(None))
            .when(factor == 0, F.signum(v) * 0.0)
            .when(F.isnan(scaled) | (size == float("inf")), v)
            .otherwise(F.try_divide(rounded, factor))
        )
        return Compiled(value.cast("double"), "float", fault)

    def fn_mod(self, x, y, fault, node):
        x, y = _plain(x), _plain(y)
        if x.kind == y.kind == "int":
            divisor = F.when(y.value != 0, y.value)
            rest = F.when(y.value == -1, F.when(x.value.isNotNull(), F.lit(0).cast("bigint"))).otherwise(F.try_mod(x.value, divisor))
            value = F.when((rest != 0) & ((rest < 0) != (y.value < 0)), rest + y.value).otherwise(rest)
            divided_by = node.arguments[1].operand if isinstance(node.arguments[1], s.Negative) else node.arguments[1]
            if isinstance(divided_by, s.Literal) and divided_by.value:
                return Compiled(value, "int", fault)
            nan = x.value.isNotNull() & y.value.eqNullSafe(F.lit(0).cast("bigint"))
            # a NaN must not look like a null to what only asks for nullness
            return Compiled(F.when(nan, F.lit(0).cast("bigint")).otherwise(value), "int", fault, nan)
        a, b = as_float(x), as_float(y)
        rest = F.try_mod(a, F.when(b != 0, b))
        value = F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)
        return Compiled(F.when(_any_null(a, b), F.lit(None)).when((b == 0) | F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(value).cast("double"), "float", fault)

    def _test(self, x, whether, fault):
        v = as_float(x)
        return Compiled(F.when(v.isNotNull(), whether(v)), "boolean", fault)

    def fn_is_nan(self, x, fault, node):
        return self._test(x, F.isnan, fault)

    def fn_is_infinite(self, x, fault, node):
        return self._test(x, lambda v: F.abs(v) == float("inf"), fault)

    def fn_is_finite(self, x, fault, node):
        return self._test(x, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")), fault)


def aggregate_nodes(tree: s.Node) -> list[s.Call]:
    """Topmost aggregate calls, in order."""
    if isinstance(tree, s.Call) and tree.name in AGGREGATES:
        return [tree]
    return [x for child in tree.children() for x in aggregate_nodes(child)]


@dataclass
class Fold:
    """One aggregate as Spark aggregates: ``value`` and, if it can fail, ``fault``."""

    kind: str
    value: Column
    fault: Column | None
    distinct: Column | None = None  # what to count the distinct values of, instead of ``value``


def fold(node: s.Call, schema: T.StructType, now: dt.datetime) -> Fold:
    if node.name == "ROW_COUNT":
        return Fold("int", F.count(F.lit(1)), None)
    argument = node.arguments[0]
    c = Compiler(schema, now).stored(argument) if node.name == "COUNT" else Compiler(schema, now)(argument)
    plain = _plain(c)
    fault = None if c.fault is None else F.max(c.fault)
    if node.name == "COUNT":
        return Fold("int", F.count(c.value), fault)
    if node.name == "COUNT_DISTINCT":
        return Fold("int", F.lit(None), fault, distinct=plain.value)
    if node.name in ("MIN", "MAX"):
        return Fold(plain.kind, (F.min if node.name == "MIN" else F.max)(plain.value), fault)
    if node.name in ("ANY", "ALL"):
        return Fold("boolean", (F.bool_or if node.name == "ANY" else F.bool_and)(c.value.cast("boolean")), fault)
    if node.name == "AVG":
        return Fold("float", F.avg(as_float(c)), fault)
    if plain.kind == "int":
        total = F.try_sum(plain.value)
        lost = F.when((F.count(plain.value) > 0) & total.isNull(), OVERFLOW).otherwise(0)
        return Fold("int", total, lost if fault is None else F.when(F.coalesce(fault, F.lit(0)) != 0, fault).otherwise(lost))
    return Fold("float", F.sum(as_float(c)), fault)


def compile_row(typed: Typed, schema: T.StructType, now: dt.datetime, aggregates: dict[int, Compiled] | None = None) -> Compiled:
    return Compiler(schema, now, aggregates)(typed.tree)
