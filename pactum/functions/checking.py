"""Names, types and shapes of expressions, before any data is read.

:func:`check` resolves a tree against one table and returns a *typed* tree:
definitions are inlined (as fresh nodes, so node identity stays unique),
string literals that meet a temporal operand are constants, and every node
has a type and a shape. Findings carry the catalogue's codes.
"""

from __future__ import annotations

import copy
import datetime as dt
import re
from dataclasses import dataclass, field

from . import syntax as s

SCALARS = ("number", "string", "boolean", "date", "datetime", "interval")
ORDERED = ("number", "string", "date", "datetime")
UNITS = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86_400, "weeks": 604_800}
ANY, UNTYPED, NESTED = "any", "untyped", "nested"
CONST, AGG, ROW = 0, 1, 2
SHAPES = ("const", "agg", "row")

#: Argument types and result of each scalar function; a tuple of alternatives by arity.
SCALAR_FUNCTIONS = {
    "LENGTH": ((("string",), "number"),),
    "LOWER": ((("string",), "string"),),
    "UPPER": ((("string",), "string"),),
    "TRIM": ((("string",), "string"),),
    "STARTS_WITH": ((("string", "string"), "boolean"),),
    "ENDS_WITH": ((("string", "string"), "boolean"),),
    "ABS": ((("number",), "number"),),
    "FLOOR": ((("number",), "number"),),
    "CEIL": ((("number",), "number"),),
    "ROUND": ((("number",), "number"), (("number", "number"), "number")),
    "MOD": ((("number", "number"), "number"),),
    "IS_FINITE": ((("number",), "boolean"),),
    "IS_INFINITE": ((("number",), "boolean"),),
    "IS_NAN": ((("number",), "boolean"),),
    "NOW": (((), "datetime"),),
}
#: Class of the argument and result of each aggregate; "same" returns the argument's type.
AGGREGATES = {
    "MIN": ("ordered", "same"), "MAX": ("ordered", "same"), "SUM": ("numeric", "number"), "AVG": ("numeric", "number"),
    "COUNT": ("anything", "number"), "ROW_COUNT": (None, "number"), "COUNT_DISTINCT": ("ordered", "number"), "ANY": ("boolean", "boolean"), "ALL": ("boolean", "boolean"),
}
#: Constructs of other regular-expression dialects that the language does not have.
_NOT_RE2 = re.compile(r"\(\?(?:[=!]|<[=!]|>|\()|\\[1-9]|[*+?}]\+|\\[GZ]|\(\?P[=>]|\\k<")


@dataclass(frozen=True)
class Finding:
    code: str
    message: str
    start: int
    end: int
    severity: str = "error"


@dataclass(frozen=True)
class Declared:
    """A column or field as the dictionary declares it: ``type`` is a language type, ``struct``, ``list`` or None."""

    name: str
    type: str | None
    fields: tuple[Declared, ...] = ()


@dataclass
class Scope:
    """What an expression of a table can name."""

    columns: list[Declared]
    definitions: dict[str, s.Node] = field(default_factory=dict)

    def column(self, name: str) -> Declared | None:
        return next((c for c in self.columns if c.name == name), None)


@dataclass
class Typed:
    """The result of checking one expression."""

    tree: s.Node
    type: str
    shape: int
    findings: list[Finding]
    columns: list[tuple[str, ...]]
    definitions: list[str]
    types: dict[int, str]
    shapes: dict[int, int]
    selected: list[str] | None = None

    @property
    def ok(self) -> bool:
        return not any(f.severity == "error" for f in self.findings)


def regex_problem(pattern: str) -> str | None:
    if m := _NOT_RE2.search(pattern):
        return f"`{m[0]}` is not supported in patterns"
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def parse_temporal(text: str, kind: str) -> dt.date | dt.datetime | None:
    """An ISO 8601 date or datetime; offsets are converted to UTC, zoneless ones are taken as UTC."""
    try:
        if kind == "date":
            return dt.date.fromisoformat(text) if re.fullmatch(r"\d{4}-\d\d-\d\d", text) else None
        if not re.fullmatch(r"\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d(?:\.\d{1,9})?)?(?:Z|[+-]\d\d:?\d\d)?)?", text):
            return None
        value = dt.datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text))
        return value.astimezone(dt.UTC).replace(tzinfo=None) if value.tzinfo else value
    except ValueError:
        return None


class _Checker:
    def __init__(self, scope: Scope, now_selection: list[str] | None = None):
        self.scope = scope
        self.findings: list[Finding] = []
        self.columns: list[tuple[str, ...]] = []
        self.definitions: list[str] = []
        self.types: dict[int, str] = {}
        self.shapes: dict[int, int] = {}
        self.keep: list[s.Node] = []  # nodes whose ids are keys above must stay alive
        self.selection: s.Selection | None = None
        self.selected: list[str] | None = None
        self.inside: list[s.Node] = []  # definitions being inlined: their findings point at the reference

    def report(self, code: str, message: str, node: s.Node, severity: str = "error") -> None:
        at = self.inside[0] if self.inside else node
        found = Finding(code, message, at.start, at.end, severity)
        if found not in self.findings:
            self.findings.append(found)

    def put(self, node: s.Node, kind: str, shape: int) -> str:
        self.types[id(node)], self.shapes[id(node)] = kind, shape
        self.keep.append(node)
        return kind

    def shape(self, *nodes: s.Node | None) -> int:
        return max([self.shapes[id(n)] for n in nodes if n is not None], default=CONST)

    def want(self, node: s.Node, kinds: tuple[str, ...], what: str) -> None:
        kind = self.types[id(node)]
        if kind in (ANY, *kinds) or kind == "null":
            return
        if kind == UNTYPED:
            self.report("S23", f"{what} needs a type, but a column it uses has none", node)
        elif kind == NESTED:
            self.report("S21", f"{what} can't be applied to a list or struct", node)
        else:
            self.report("S21", f"{what} expects {' or '.join(kinds)}, not {kind}", node)

    def temporal(self, node: s.Node, other: str) -> s.Node:
        """A string literal next to a temporal operand becomes a constant of its type."""
        if isinstance(node, s.Literal) and node.kind == "string" and other in ("date", "datetime"):
            for kind in (other, "date" if other == "datetime" else "datetime"):
                value = parse_temporal(node.value, kind)
                if value is not None:
                    out = s.Literal(kind, value, start=node.start, end=node.end)
                    self.put(out, kind, CONST)
                    return out
            self.report("S21", f"`{node.value}` is not a valid {other}", node)
            out = s.Literal("null", None, start=node.start, end=node.end)
            self.put(out, ANY, CONST)
            return out
        return node

    def comparable(self, a: s.Node, b: s.Node, what: str) -> None:
        x, y = self.types[id(a)], self.types[id(b)]
        for node, kind in ((a, x), (b, y)):
            if kind in (UNTYPED, NESTED, "interval"):
                self.want(node, ORDERED + ("boolean",), what)
                return
        loose = {ANY, "null"}
        if x in loose or y in loose or x == y or {x, y} == {"date", "datetime"}:
            return
        self.report("S21", f"{what} can't compare {x} with {y}", b)

    def ordered(self, node: s.Node, what: str) -> None:
        self.want(node, ORDERED, what)

    def visit(self, node: s.Node) -> s.Node:
        return getattr(self, "on_" + type(node).__name__.lower())(node)

    def on_literal(self, n: s.Literal) -> s.Node:
        kind = {"int": "number", "float": "number", "null": "null"}.get(n.kind, n.kind)
        self.put(n, kind, CONST)
        return n

    def declared_type(self, declared: Declared) -> str:
        return UNTYPED if declared.type is None else NESTED if declared.type in ("struct", "list") else declared.type

    def on_column(self, n: s.Column) -> s.Node:
        found = self.scope.column(n.path[0])
        if found is None:
            if len(n.path) == 1 and n.path[0] in self.scope.definitions:
                if n.path[0] not in self.definitions and not self.inside:
                    self.definitions.append(n.path[0])
                body = copy.deepcopy(self.scope.definitions[n.path[0]])  # fresh nodes: identity stays unique
                self.inside.append(n)
                out = self.visit(body)
                self.inside.pop()
                return out
            self.report("S20", f"unknown column `{n.path[0]}`", n)
            self.put(n, ANY, ROW)
            return n
        for name in n.path[1:]:
            if found.type != "struct":
                self.report("S21", f"`{found.name}` is not a struct, so it has no field `{name}`", n)
                self.put(n, ANY, ROW)
                return n
            inner = next((f for f in found.fields if f.name == name), None)
            if inner is None:
                self.report("S20", f"unknown field `{name}` of `{found.name}`", n)
                self.put(n, ANY, ROW)
                return n
            found = inner
        if n.path not in self.columns:
            self.columns.append(n.path)
        self.put(n, self.declared_type(found), ROW)
        return n

    def on_selection(self, n: s.Selection) -> s.Node:
        if self.selection is not None:
            self.report("S21", "an expression may have only one COLUMNS(...)", n)
            self.put(n, ANY, ROW)
            return n
        self.selection = n
        if n.how == "all":
            names = [c.name for c in self.scope.columns]
        elif n.how == "regex":
            problem = regex_problem(n.pattern)
            if problem:
                self.report("S21", f"malformed pattern: {problem}", n)
                names = []
            else:
                names = [c.name for c in self.scope.columns if re.search(n.pattern, c.name)]
                if not names:
                    self.report("S22", f"COLUMNS('{n.pattern}') matches no columns", n, "warning")
        else:
            names = []
            for name, *_ in n.names:
                if self.scope.column(name) is None:
                    self.report("S20", f"unknown column `{name}`", n)
                else:
                    names.append(name)
        self.selected = names
        kinds = {self.declared_type(self.scope.column(x)) for x in names}
        for x in names:
            if (x,) not in self.columns:
                self.columns.append((x,))
        self.put(n, kinds.pop() if len(kinds) == 1 else ANY, ROW)
        return n

    def on_negative(self, n: s.Negative) -> s.Node:
        n.operand = self.visit(n.operand)
        self.want(n.operand, ("number",), "unary `-`")
        self.put(n, "number", self.shape(n.operand))
        return n

    def on_not(self, n: s.Not) -> s.Node:
        n.operand = self.visit(n.operand)
        self.want(n.operand, ("boolean",), "`NOT`")
        self.put(n, "boolean", self.shape(n.operand))
        return n

    def on_arithmetic(self, n: s.Arithmetic) -> s.Node:
        n.left, n.right = self.visit(n.left), self.visit(n.right)
        x, y = self.types[id(n.left)], self.types[id(n.right)]
        shape = self.shape(n.left, n.right)
        if "interval" in (x, y) and n.op in "+-":
            other = n.left if y == "interval" else n.right
            if n.op == "-" and x == "interval":
                self.report("S21", "an interval can only be subtracted from a date or datetime", n)
            kind = self.types[id(other)]
            if kind == "interval":
                self.report("S21", "intervals can't be added to each other", n)
            elif isinstance(other, s.Literal) and other.kind == "string":
                self.report("S21", f"`{n.op}` expects date or datetime, not string", other)
            else:
                self.want(other, ("date", "datetime"), f"`{n.op}`")
            self.put(n, "datetime", shape)
            return n
        for side in (n.left, n.right):
            self.want(side, ("number",), f"`{n.op}`")
        self.put(n, "number", shape)
        return n

    def on_compare(self, n: s.Compare) -> s.Node:
        n.left, n.right = self.visit(n.left), self.visit(n.right)
        n.left, n.right = self.temporal(n.left, self.types[id(n.right)]), self.temporal(n.right, self.types[id(n.left)])
        self.comparable(n.left, n.right, f"`{n.op}`")
        if n.op not in ("=", "<>"):
            for side in (n.left, n.right):
                if self.types[id(side)] == "boolean":
                    self.report("S21", f"`{n.op}` can't order booleans", side)
        self.put(n, "boolean", self.shape(n.left, n.right))
        return n

    def on_logic(self, n: s.Logic) -> s.Node:
        n.left, n.right = self.visit(n.left), self.visit(n.right)
        for side in (n.left, n.right):
            self.want(side, ("boolean",), f"`{n.op}`")
        self.put(n, "boolean", self.shape(n.left, n.right))
        return n

    def on_isnull(self, n: s.IsNull) -> s.Node:
        n.operand = self.visit(n.operand)
        self.put(n, "boolean", self.shape(n.operand))
        return n

    def on_between(self, n: s.Between) -> s.Node:
        n.operand, n.low, n.high = self.visit(n.operand), self.visit(n.low), self.visit(n.high)
        kind = self.types[id(n.operand)]
        n.low, n.high = self.temporal(n.low, kind), self.temporal(n.high, kind)
        if isinstance(n.operand, s.Literal):
            n.operand = self.temporal(n.operand, self.types[id(n.low)])
        for bound in (n.low, n.high):
            self.comparable(n.operand, bound, "`BETWEEN`")
        if self.types[id(n.operand)] == "boolean":
            self.report("S21", "`BETWEEN` can't order booleans", n.operand)
        self.put(n, "boolean", self.shape(n.operand, n.low, n.high))
        return n

    def on_member(self, n: s.Member) -> s.Node:
        n.operand = self.visit(n.operand)
        kind = self.types[id(n.operand)]
        n.items = [self.temporal(self.visit(i), kind) for i in n.items]
        for i in n.items:
            self.comparable(n.operand, i, "`IN`")
        self.put(n, "boolean", self.shape(n.operand, *n.items))
        return n

    def on_match(self, n: s.Match) -> s.Node:
        n.operand, n.pattern = self.visit(n.operand), self.visit(n.pattern)
        for side in (n.operand, n.pattern):
            self.want(side, ("string",), f"`{n.how}`")
        if n.how == "SIMILAR TO" and isinstance(n.pattern, s.Literal) and n.pattern.kind == "string":
            problem = regex_problem(n.pattern.value)
            if problem:
                self.report("S21", f"malformed pattern: {problem}", n.pattern)
        self.put(n, "boolean", self.shape(n.operand, n.pattern))
        return n

    def on_case(self, n: s.Case) -> s.Node:
        n.branches = [(self.visit(c), self.visit(r)) for c, r in n.branches]
        n.otherwise = self.visit(n.otherwise) if n.otherwise else None
        for c, _ in n.branches:
            self.want(c, ("boolean",), "`WHEN`")
        results = [r for _, r in n.branches] + ([n.otherwise] if n.otherwise else [])
        kinds = {self.types[id(r)] for r in results} - {"null"}
        self.put(n, kinds.pop() if len(kinds) == 1 else "null" if not kinds else ANY, self.shape(*n.children()))
        return n

    def on_interval(self, n: s.Interval) -> s.Node:
        n.amount = self.visit(n.amount)
        self.want(n.amount, ("number",), "`interval`")
        if n.unit not in UNITS:
            self.report("S21", f"unknown unit `{n.unit}`", n)
            n.unit = "seconds"
        self.put(n, "interval", self.shape(n.amount))
        return n

    def on_call(self, n: s.Call) -> s.Node:
        n.arguments = [self.visit(a) for a in n.arguments]
        if n.name in AGGREGATES:
            return self.aggregate(n)
        forms = SCALAR_FUNCTIONS.get(n.name)
        shape = self.shape(*n.arguments)
        if forms is None:
            self.report("S21", f"unknown function `{n.name}`", n)
            self.put(n, ANY, shape)
            return n
        form = next((f for f in forms if len(f[0]) == len(n.arguments)), None)
        if form is None:
            self.report("S21", f"`{n.name}` takes {' or '.join(str(len(f[0])) for f in forms)} argument(s), not {len(n.arguments)}", n)
        else:
            for a, kind in zip(n.arguments, form[0], strict=True):
                self.want(a, (kind,), f"`{n.name}`")
        self.put(n, forms[0][1], shape)
        return n

    def aggregate(self, n: s.Call) -> s.Node:
        wanted, result = AGGREGATES[n.name]
        count = 0 if wanted is None else 1
        if len(n.arguments) != count:
            self.report("S21", f"`{n.name}` takes {count} argument(s), not {len(n.arguments)}", n)
            self.put(n, ANY if result == "same" else result, AGG)
            return n
        for a in n.arguments:
            if any(isinstance(x, s.Call) and x.name in AGGREGATES for x in s.walk(a)):
                self.report("S30", f"`{n.name}` can't take another aggregate", a)
            if wanted == "ordered":
                self.ordered(a, f"`{n.name}`")
            elif wanted == "numeric":
                self.want(a, ("number",), f"`{n.name}`")
            elif wanted == "boolean":
                self.want(a, ("boolean",), f"`{n.name}`")
        self.put(n, self.types[id(n.arguments[0])] if result == "same" else result, AGG)
        return n


def check(tree: s.Node, scope: Scope, boolean: bool = True) -> Typed:
    """Resolve and type ``tree`` (which is copied); assertions must be ``boolean``."""
    checker = _Checker(scope)
    tree = checker.visit(copy.deepcopy(tree))
    kind, shape = checker.types[id(tree)], checker.shapes[id(tree)]
    if checker.selection is not None and checker.selected:
        # every selected column must fit, whatever the others are
        for name in checker.selected:
            one = _Checker(scope)
            one.visit(instantiate(tree, name))
            for f in one.findings:
                if f not in checker.findings:
                    checker.findings.append(f)
            if boolean and isinstance(tree, s.Selection):
                one_kind = one.declared_type(scope.column(name))
                if one_kind not in ("boolean", ANY):
                    checker.report("S23" if one_kind == UNTYPED else "S21", f"selected column `{name}` is not boolean", tree)
    elif boolean and kind not in ("boolean", ANY, "null"):
        checker.report("S23" if kind == UNTYPED else "S21", f"an assertion must be boolean, not {kind}", tree)
    out = Typed(tree, kind, shape, checker.findings, checker.columns, checker.definitions, checker.types, checker.shapes, checker.selected)
    out._nodes = checker.keep  # noqa: SLF001
    return out


def instantiate(tree: s.Node, name: str) -> s.Node:
    """A copy of ``tree`` with its selection replaced by one column."""

    def visit(n: s.Node) -> s.Node:
        if isinstance(n, s.Selection):
            return s.Column((name,), start=n.start, end=n.end)
        out = copy.copy(n)
        for k, v in vars(n).items():
            if isinstance(v, s.Node):
                setattr(out, k, visit(v))
            elif isinstance(v, list) and v and isinstance(v[0], s.Node):
                setattr(out, k, [visit(x) for x in v])
            elif isinstance(v, list) and v and isinstance(v[0], tuple):
                setattr(out, k, [tuple(visit(x) for x in pair) for pair in v])
        return out

    return visit(tree)


def instances(typed: Typed, scope: Scope) -> list[Typed]:
    """One checked expression per selected column, in order; the expression itself if it selects none."""
    if typed.selected is None:
        return [typed]
    return [check(instantiate(typed.tree, name), scope, boolean=False) for name in typed.selected]
