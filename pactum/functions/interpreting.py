"""A plain row interpreter of checked expressions: the oracle that compiled columns are tested against.

It follows the prose of the language, one row at a time, with Python's exact
integers. Values are Python values; datetimes are microseconds in UTC.
"""

from __future__ import annotations

import datetime as dt
import math
import re

from . import syntax as s
from .checking import UNITS
from .compiling import BAD_PATTERN, DAY, OVERFLOW, micros


class _Fault(Exception):
    def __init__(self, code: int):
        self.code = code


def _long(x: int) -> int:
    if not -(1 << 63) <= x < 1 << 63:
        raise _Fault(OVERFLOW)
    return x


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _divide(x: float, y: float) -> float:
    if y:
        return x / y
    if x == 0 or math.isnan(x):
        return math.nan
    return math.copysign(math.inf, x) * math.copysign(1, y)


def _compare(op: str, a, b):
    if a is None or b is None:
        return None
    if _number(a) and _number(b):
        if isinstance(a, float) or isinstance(b, float):
            a, b = float(a), float(b)
        if math.isnan(a) or math.isnan(b):
            return op == "<>"
    if isinstance(a, dt.date):
        a = (a - dt.date(1970, 1, 1)).days * DAY
    if isinstance(b, dt.date):
        b = (b - dt.date(1970, 1, 1)).days * DAY
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _round(x: float, digits: float) -> float:
    digits = math.trunc(max(-400.0, min(400.0, digits)))
    factor = 10.0**digits if digits <= 308 else math.inf
    scaled = x * factor
    if factor == 0:
        return math.copysign(0.0, x) if x == x else x
    if math.isnan(scaled) or math.isinf(scaled):
        return x
    size = abs(scaled)
    below = size if size >= 2.0**52 else math.floor(size)
    return math.copysign(below + (1 if size - below >= 0.5 else 0), scaled) / factor


def _mod(x, y):
    if y == 0:
        return math.nan
    if isinstance(x, int) and isinstance(y, int):
        return x % y
    x, y = float(x), float(y)
    if math.isnan(x) or math.isnan(y) or math.isinf(x):
        return math.nan
    rest = math.fmod(x, y)
    return rest + y if rest and (rest < 0) != (y < 0) else rest


def _like(text: str, pattern: str) -> bool:
    return re.fullmatch("".join({"%": ".*", "_": "."}.get(c) or re.escape(c) for c in pattern), text, re.S) is not None


def evaluate(tree: s.Node, row: dict, now: dt.datetime) -> tuple[object, int]:
    """(value, fault) of a row-level expression; the value is None under a fault."""
    try:
        return _Row(row, now).of(tree), 0
    except _Fault as e:
        return None, e.code


class _Row:
    def __init__(self, row: dict, now: dt.datetime):
        self.row, self.now = row, now

    def of(self, n: s.Node):
        return getattr(self, type(n).__name__.lower())(n)

    def literal(self, n):
        if n.kind == "datetime":
            return micros(n.value if isinstance(n.value, dt.datetime) else dt.datetime.combine(n.value, dt.time()))
        return n.value

    def column(self, n):
        value = self.row.get(n.path[0])
        for name in n.path[1:]:
            value = None if value is None else value[name]
        return micros(value) if isinstance(value, dt.datetime) else value

    def negative(self, n):
        x = self.of(n.operand)
        return None if x is None else -x if isinstance(x, float) else _long(-x)

    def arithmetic(self, n):
        a, b = self.of(n.left), self.of(n.right)
        if a is None or b is None:
            return None
        if isinstance(n.left, s.Interval) or isinstance(n.right, s.Interval):
            a, b = (b, a) if isinstance(n.left, s.Interval) else (a, b)
            if isinstance(a, dt.date):
                a = (a - dt.date(1970, 1, 1)).days * DAY
            return _long(a + b if n.op == "+" else a - b)
        if n.op == "/":
            return _divide(float(a), float(b))
        if isinstance(a, int) and isinstance(b, int):
            return _long({"+": a + b, "-": a - b, "*": a * b}[n.op])
        a, b = float(a), float(b)
        return {"+": a + b, "-": a - b, "*": a * b}[n.op]

    def compare(self, n):
        return _compare(n.op, self.of(n.left), self.of(n.right))

    def isnull(self, n):
        return (self.of(n.operand) is None) != n.negated

    def between(self, n):
        x, lo, hi = self.of(n.operand), self.of(n.low), self.of(n.high)
        if x is None or lo is None or hi is None:
            return None
        return (_compare("<=", lo, x) and _compare("<=", x, hi)) != n.negated

    def member(self, n):
        x = self.of(n.operand)
        found = [_compare("=", x, self.of(i)) for i in n.items]
        out = True if True in found else None if None in found else False
        return None if out is None else out != n.negated

    def match(self, n):
        x, p = self.of(n.operand), self.of(n.pattern)
        if x is None or p is None:
            return None
        if n.how == "LIKE":
            return _like(x, p) != n.negated
        try:
            return (re.fullmatch(p, x, re.ASCII) is not None) != n.negated
        except re.error:
            raise _Fault(BAD_PATTERN) from None

    def not_(self, n):
        x = self.of(n.operand)
        return None if x is None else not x

    def logic(self, n):
        decisive = n.op == "OR"
        a = self.of(n.left)
        if a is decisive:
            return decisive
        b = self.of(n.right)
        return decisive if b is decisive else None if a is None or b is None else not decisive

    def case(self, n):
        for condition, result in n.branches:
            if self.of(condition):
                return self.of(result)
        return self.of(n.otherwise) if n.otherwise else None

    def interval(self, n):
        x = self.of(n.amount)
        if x is None:
            return None
        if isinstance(x, float):
            if not math.isfinite(x) or abs(x) >= 2.0**63:
                raise _Fault(OVERFLOW)
            x = math.trunc(x)
        return _long(x * UNITS[n.unit] * 1_000_000)

    def call(self, n):
        if n.name == "NOW":
            return micros(self.now)
        x = [self.of(a) for a in n.arguments]
        if None in x:
            return None
        return {
            "LENGTH": lambda v: len(v), "LOWER": str.lower, "UPPER": str.upper, "TRIM": str.strip, "STARTS_WITH": str.startswith, "ENDS_WITH": str.endswith,
            "ABS": lambda v: abs(v) if isinstance(v, float) else _long(abs(v)),
            "FLOOR": lambda v: float(math.floor(v)) if math.isfinite(v) else v, "CEIL": lambda v: float(math.ceil(v)) if math.isfinite(v) else v,
            "ROUND": lambda v, d=0: _round(float(v), float(d)), "MOD": _mod,
            "IS_NAN": lambda v: math.isnan(v), "IS_INFINITE": lambda v: math.isinf(v), "IS_FINITE": lambda v: math.isfinite(v),
        }[n.name](*x)


setattr(_Row, "not", _Row.not_)
