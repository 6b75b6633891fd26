"""Text of the rule language to a tree.

The tree is plain data; nothing here knows about tables or types. Positions
are character offsets into the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

RESERVED = frozenset("AND OR NOT IS NULL BETWEEN IN LIKE SIMILAR TO WHEN THEN ELSE END TRUE FALSE INF NAN CASE COLUMNS NOW INTERVAL".split())
COMPARISONS = ("=", "!=", "<>", "<=", ">=", "<", ">")
LONG_MAX = (1 << 63) - 1


class SyntaxProblem(ValueError):
    def __init__(self, message: str, start: int, end: int):
        super().__init__(message)
        self.start, self.end = start, end


@dataclass(eq=False)
class Node:
    start: int = field(default=0, kw_only=True)
    end: int = field(default=0, kw_only=True)

    def children(self) -> list[Node]:
        return []


@dataclass(eq=False)
class Literal(Node):
    """``kind`` is int, float, string, boolean or null; date and datetime come from checking."""

    kind: str
    value: object


@dataclass(eq=False)
class Column(Node):
    path: tuple[str, ...]


@dataclass(eq=False)
class Selection(Node):
    """``COLUMNS(...)``: ``how`` is all, regex or names."""

    how: str
    pattern: str = ""
    names: tuple[tuple[str, int, int], ...] = ()


@dataclass(eq=False)
class Negative(Node):
    operand: Node

    def children(self):
        return [self.operand]


@dataclass(eq=False)
class Not(Node):
    operand: Node

    def children(self):
        return [self.operand]


@dataclass(eq=False)
class Arithmetic(Node):
    op: str
    left: Node
    right: Node

    def children(self):
        return [self.left, self.right]


@dataclass(eq=False)
class Compare(Node):
    op: str
    left: Node
    right: Node

    def children(self):
        return [self.left, self.right]


@dataclass(eq=False)
class Logic(Node):
    op: str
    left: Node
    right: Node

    def children(self):
        return [self.left, self.right]


@dataclass(eq=False)
class IsNull(Node):
    operand: Node
    negated: bool

    def children(self):
        return [self.operand]


@dataclass(eq=False)
class Between(Node):
    operand: Node
    low: Node
    high: Node
    negated: bool

    def children(self):
        return [self.operand, self.low, self.high]


@dataclass(eq=False)
class Member(Node):
    operand: Node
    items: list[Node]
    negated: bool

    def children(self):
        return [self.operand, *self.items]


@dataclass(eq=False)
class Match(Node):
    """``how`` is LIKE or SIMILAR TO."""

    how: str
    operand: Node
    pattern: Node
    negated: bool

    def children(self):
        return [self.operand, self.pattern]


@dataclass(eq=False)
class Case(Node):
    branches: list[tuple[Node, Node]]
    otherwise: Node | None

    def children(self):
        return [x for pair in self.branches for x in pair] + ([self.otherwise] if self.otherwise else [])


@dataclass(eq=False)
class Call(Node):
    name: str
    arguments: list[Node]

    def children(self):
        return self.arguments


@dataclass(eq=False)
class Interval(Node):
    amount: Node
    unit: str

    def children(self):
        return [self.amount]


def walk(node: Node):
    yield node
    for child in node.children():
        yield from walk(child)


_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)"
    r"|(?P<string>'(?:[^']|'')*')|(?P<quoted>`(?:[^`]|``)+`)|(?P<mark><=|>=|<>|!=|==|[-+*/=<>(),.\[\]])"
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            what = {"'": "unterminated string", "`": "a quoted name without text or without its closing quote"}.get(text[at], f"unexpected character `{text[at]}`")
            raise SyntaxProblem(what, at, len(text) if text[at] in "'`" else at + 1)
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at, m.end()))
        at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


class _Parser:
    def __init__(self, text: str):
        self.tokens = tokens(text)
        self.at = 0

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def step(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def word(self, *words: str) -> bool:
        """Take these words if they come next."""
        if all(self.tokens[min(self.at + k, len(self.tokens) - 1)].upper == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def mark(self, text: str) -> bool:
        if self.now.kind == "mark" and self.now.text == text:
            self.at += 1
            return True
        return False

    def fail(self, wanted: str):
        t = self.now
        raise SyntaxProblem(f"expected {wanted}, found {'the end' if t.kind == 'end' else f'`{t.text}`'}", t.start, t.end)

    def need(self, text: str) -> Token:
        if not self.mark(text):
            self.fail(f"`{text}`")
        return self.tokens[self.at - 1]

    def made(self, node: Node, start: int) -> Node:
        node.start, node.end = start, self.tokens[self.at - 1].end
        return node

    def chain(self, below, words: tuple[str, ...], make) -> Node:
        start = self.now.start
        left = below()
        while self.now.upper in words or (self.now.kind == "mark" and self.now.text in words):
            op = self.step()
            left = self.made(make(op.upper or op.text, left, below()), start)
        return left

    def expression(self) -> Node:
        return self.chain(lambda: self.chain(self.negation, ("AND",), Logic), ("OR",), Logic)

    def negation(self) -> Node:
        start = self.now.start
        if self.word("NOT"):
            return self.made(Not(self.negation()), start)
        return self.predicate()

    def predicate(self) -> Node:
        start = self.now.start
        left = self.additive()
        if self.now.kind == "mark" and self.now.text == "==":
            self.fail("`=`")
        if self.now.kind == "mark" and self.now.text in COMPARISONS:
            op = self.step().text
            return self.made(Compare("<>" if op == "!=" else op, left, self.additive()), start)
        if self.word("IS"):
            negated = self.word("NOT")
            if not self.word("NULL"):
                self.fail("`NULL`")
            return self.made(IsNull(left, negated), start)
        negated = self.word("NOT")
        if self.word("BETWEEN"):
            low = self.additive()
            if not self.word("AND"):
                self.fail("`AND`")
            return self.made(Between(left, low, self.additive(), negated), start)
        if self.word("IN"):
            self.need("(")
            items = [self.expression()]
            while self.mark(","):
                items.append(self.expression())
            self.need(")")
            return self.made(Member(left, items, negated), start)
        if self.word("LIKE"):
            return self.made(Match("LIKE", left, self.additive(), negated), start)
        if self.word("SIMILAR", "TO"):
            return self.made(Match("SIMILAR TO", left, self.additive(), negated), start)
        if negated:
            self.fail("`BETWEEN`, `IN`, `LIKE` or `SIMILAR TO`")
        return left

    def additive(self) -> Node:
        return self.chain(lambda: self.chain(self.unary, ("*", "/"), Arithmetic), ("+", "-"), Arithmetic)

    def unary(self) -> Node:
        start = self.now.start
        if self.mark("-"):
            return self.made(Negative(self.unary()), start)
        return self.primary()

    def primary(self) -> Node:
        t, start = self.now, self.now.start
        following = self.tokens[min(self.at + 1, len(self.tokens) - 1)]
        call = following.kind == "mark" and following.text == "("
        if self.mark("("):
            inner = self.expression()
            self.need(")")
            return inner
        if t.kind == "number":
            self.step()
            if t.text.isdigit():
                if int(t.text) > LONG_MAX:
                    raise SyntaxProblem("integer is too large", t.start, t.end)
                return self.made(Literal("int", int(t.text)), start)
            return self.made(Literal("float", float(t.text)), start)
        if t.kind == "string":
            self.step()
            return self.made(Literal("string", t.text[1:-1].replace("''", "'")), start)
        if t.upper in ("TRUE", "FALSE", "NULL", "INF", "NAN"):
            self.step()
            kind, value = {"TRUE": ("boolean", True), "FALSE": ("boolean", False), "NULL": ("null", None), "INF": ("float", float("inf")), "NAN": ("float", float("nan"))}[t.upper]
            return self.made(Literal(kind, value), start)
        if self.word("CASE"):
            return self.case(start)
        if t.upper == "COLUMNS" and call:
            return self.selection(start)
        if t.upper == "INTERVAL" and call:
            self.at += 2
            amount = self.expression()
            self.need(",")
            unit = self.step()
            if unit.kind != "word":
                self.at -= 1
                self.fail("a unit")
            self.need(")")
            return self.made(Interval(amount, unit.text.lower()), start)
        if t.kind == "word" and call and (t.upper not in RESERVED or t.upper == "NOW"):
            self.at += 2
            arguments = []
            if not self.mark(")"):
                arguments.append(self.expression())
                while self.mark(","):
                    arguments.append(self.expression())
                self.need(")")
            return self.made(Call(t.upper, arguments), start)
        if t.kind == "quoted" or (t.kind == "word" and t.upper not in RESERVED):
            path = [self.name()[0]]
            while self.mark("."):
                path.append(self.name()[0])
            return self.made(Column(tuple(path)), start)
        self.fail("an expression")

    def name(self) -> tuple[str, int, int]:
        t = self.now
        if t.kind == "quoted":
            self.step()
            return t.text[1:-1].replace("``", "`"), t.start, t.end
        if t.kind == "word" and t.upper not in RESERVED:
            self.step()
            return t.text, t.start, t.end
        self.fail("a column name")

    def case(self, start: int) -> Node:
        branches = []
        while self.word("WHEN"):
            condition = self.expression()
            if not self.word("THEN"):
                self.fail("`THEN`")
            branches.append((condition, self.expression()))
        if not branches:
            self.fail("`WHEN`")
        otherwise = self.expression() if self.word("ELSE") else None
        if not self.word("END"):
            self.fail("`END`")
        return self.made(Case(branches, otherwise), start)

    def selection(self, start: int) -> Node:
        self.at += 2
        if self.mark("*"):
            node: Node = Selection("all")
        elif self.now.kind == "string":
            node = Selection("regex", self.step().text[1:-1].replace("''", "'"))
        elif self.mark("["):
            names = [self.name()]
            while self.mark(","):
                names.append(self.name())
            self.need("]")
            node = Selection("names", names=tuple(names))
        else:
            self.fail("`*`, a pattern or a list of names")
        self.need(")")
        return self.made(node, start)


def parse(text: str) -> Node:
    """The tree of an expression; raises :class:`SyntaxProblem`."""
    parser = _Parser(text)
    node = parser.expression()
    if parser.now.kind != "end":
        parser.fail("an operator or the end")
    return node


def quoted(name: str) -> str:
    """A name as the language writes it, in backticks where it must be."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.upper() not in RESERVED:
        return name
    return "`" + name.replace("`", "``") + "`"
