"""Contracts in YAML: document, shape, model.

The document is read with positions (lines and columns from 0, in characters).
Its shape is checked whole (codes ``S60`` to ``S69``) before it becomes the
model that everything else works on.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

try:
    import yaml
except ImportError:  # pragma: no cover - the engine works without dictionaries as files
    yaml = None

Span = tuple[int, int, int, int]

_NULL = re.compile(r"(?:~|null|Null|NULL|)\Z")
_BOOL = re.compile(r"(?:true|True|TRUE|false|False|FALSE)\Z")
_INT = re.compile(r"[-+]?\d+\Z")
_FLOAT = re.compile(r"[-+]?(?:\.\d+|\d+(?:\.\d*)?)(?:[eE][-+]?\d+)?\Z")
_INF = re.compile(r"([-+]?)\.(?:inf|Inf|INF)\Z")
_NAN = re.compile(r"\.(?:nan|NaN|NAN)\Z")


@dataclass
class Value:
    """A node of the document: scalars are Python values, lists hold Values, maps hold (key Value, Value) by key."""

    data: object
    span: Span

    @property
    def kind(self) -> str:
        d = self.data
        if d is None:
            return "null"
        if isinstance(d, bool):
            return "boolean"
        return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(d)]

    def get(self, key: str) -> Value | None:
        found = self.data.get(key) if isinstance(self.data, dict) else None
        return found[1] if found else None

    def key(self, key: str) -> Value:
        return self.data[key][0]

    def plain(self):
        if isinstance(self.data, list):
            return [v.plain() for v in self.data]
        if isinstance(self.data, dict):
            return {k: v.plain() for k, (_, v) in self.data.items()}
        return self.data


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    severity: str = "error"
    kind: str = "spec"
    expected: str | None = None
    hint: str | None = None
    table: str | None = None
    columns: tuple[str, ...] = ()
    location: Span | None = None
    context: tuple[Span, ...] = ()
    step: int | None = None
    extra: tuple[tuple[str, object], ...] = ()
    suggestion: tuple[str, str, Span] | None = None


class NotReadable(ValueError):
    """The file is no YAML document."""


def _scalar(text: str, style) -> object:
    if style in ("'", '"', "|", ">"):
        return text
    if _NULL.match(text):
        return None
    if _BOOL.match(text):
        return text[0] in "tT"
    if _INT.match(text):
        return int(text)
    if _FLOAT.match(text):
        return float(text)
    if m := _INF.match(text):
        return float("-inf" if m[1] == "-" else "inf")
    return float("nan") if _NAN.match(text) else text


def read_document(text: str) -> tuple[Value, list[Problem]]:
    """The document with positions, and its duplicate keys."""
    if yaml is None:
        raise NotReadable("no YAML reader is installed")
    try:
        root = yaml.compose(text, Loader=yaml.SafeLoader)
    except yaml.YAMLError as e:
        raise NotReadable(str(e)) from e
    problems: list[Problem] = []

    def convert(node) -> Value:
        a, b = node.start_mark, node.end_mark
        span = (a.line, a.column, b.line, b.column)
        if isinstance(node, yaml.ScalarNode):
            data = _scalar(node.value, node.style)
            return Value(None if data == "" else data, span)
        if isinstance(node, yaml.SequenceNode):
            return Value([convert(v) for v in node.value], span)
        out: dict = {}
        for k, v in node.value:
            key = convert(k)
            name = k.value if isinstance(k, yaml.ScalarNode) else str(key.plain())
            if name in out:
                problems.append(Problem("S65", f"key `{name}` appears twice", kind="schema", expected="A mapping's keys must be unique.", location=key.span))
                continue
            out[name] = (key, convert(v))
        return Value(out, span)

    if root is None:
        return Value({}, (0, 0, 0, 0)), problems
    return convert(root), problems


# ------------------------------------------------------------------- structure
# A shape is a type name, ("any of", shapes), ("one of", values), ("list", shape, length), ("map", shape) or
# ("object", required keys, shapes by key, least number of keys).

_PROSE = {"description": "string", "details": "string", "todo": "string"}
_SCALAR = ("any of", ("string", "number", "boolean"))
_NAME = ("any of", ("string", "null"))
_DATA = {
    "units": "string", "time_zone": "string", "type": "string",
    "values": ("any of", (("list", _SCALAR, None), ("map", "string"))),
    "range": ("list", ("any of", ("number", "string")), 2),
    "examples": ("list", "any", None),
}
_FIELD: tuple = ("object", ("name",), {"name": _NAME, **_PROSE, **_DATA})
_FIELD[2]["fields"] = ("list", _FIELD, None)
_ASSERT = ("object", ("assert",), {"assert": "string", "description": "string"})
_COLUMN = ("object", ("name",), {
    "name": _NAME, "label": "string", **_PROSE, **_DATA, "display": ("one of", ("restricted",)), "fields": ("list", _FIELD, None),
    "constraints": ("list", ("any of", (("one of", ("primary_key", "foreign_key", "required", "unique")), _ASSERT)), None),
})
_TABLE = ("object", ("name", "columns"), {
    "name": _NAME, "label": "string", **_PROSE, "origin": "string", "source": ("object", (), {"parquet": "string"}, 1),
    "columns": ("list", _COLUMN, None), "constraints": ("list", _ASSERT, None),
    "definitions": ("list", ("object", ("name", "expr"), {"name": _NAME, "expr": "string", "label": "string", **_PROSE}), None),
})
_RELATIONSHIP = ("object", ("cardinality", "join"), {
    "description": "string", "todo": "string", "cardinality": ("one of", ("one-to-one", "one-to-many", "many-to-one")),
    "join": "string", "conflicts": ("list", "string", None), "aliases": ("map", "string"),
})
DOCUMENT = ("object", (), {
    "$version": "string", "$learn_more": "string", "name": "string", "label": "string", **_PROSE, "origin": "string",
    "tables": ("list", _TABLE, None), "relationships": ("list", _RELATIONSHIP, None), "glossary": ("map", "string"),
    "version": ("object", (), {"number": ("any of", ("string", "number")), "date": "string", "hash": "string"}),
})


def structural_problems(value: Value, shape=DOCUMENT) -> list[Problem]:
    """Everything about the document's shape, each at its place."""
    found: list[Problem] = []

    def report(code: str, v: Value, message: str, expected: str) -> None:
        found.append(Problem(code, message, kind="schema", expected=expected, location=v.span))

    def described(shape) -> str:
        if isinstance(shape, str):
            return shape
        return {"any of": lambda: " or ".join(described(x) for x in shape[1]), "one of": lambda: " or ".join(f"`{x}`" for x in shape[1])}.get(shape[0], lambda: {"list": "array"}.get(shape[0], "object"))()

    def fits(v: Value, shape) -> bool:
        if shape == "any":
            return True
        if isinstance(shape, str):
            return v.kind == shape
        if shape[0] == "any of":
            return any(fits(v, x) for x in shape[1])
        if shape[0] == "one of":
            return v.kind == "string"
        return v.kind == ("array" if shape[0] == "list" else "object")

    def visit(v: Value, shape) -> None:
        if not fits(v, shape):
            report("S61", v, f"found {v.kind}", f"The value must be {described(shape)}.")
            return
        if isinstance(shape, str):
            return
        if shape[0] == "any of":
            visit(v, next(x for x in shape[1] if fits(v, x)))
        elif shape[0] == "one of":
            if v.data not in shape[1]:
                report("S62", v, f"`{v.data}` is not allowed", f"The value must be {described(shape)}.")
        elif shape[0] == "list":
            if shape[2] is not None and len(v.data) != shape[2]:
                report("S69", v, f"has {len(v.data)} items", f"The list must have {shape[2]} items.")
            for x in v.data:
                visit(x, shape[1])
        elif shape[0] == "map":
            for _, x in v.data.values():
                visit(x, shape[1])
        else:
            for key, (k, x) in v.data.items():
                if key in shape[2]:
                    visit(x, shape[2][key])
                else:
                    report("S64", k, f"unknown key `{key}`", "Only keys of the specification are allowed.")
            for key in shape[1]:
                if key not in v.data:
                    report("S60", v, f"key `{key}` is missing", f"The mapping must have `{', '.join(shape[1])}`.")
            if len(shape) > 3 and len(v.data) < shape[3]:
                report("S63", v, "is empty", f"The mapping must have at least {shape[3]} entry.")

    visit(value, shape)
    return found


# ----------------------------------------------------------------------- model


@dataclass
class Assertion:
    text: str
    description: str | None
    span: Span | None
    column: str | None = None


@dataclass
class Column:
    name: str
    type: str | None
    node: Value
    span: Span
    fields: list[Column] = field(default_factory=list)
    values: list | None = None
    value_labels: dict | None = None
    restricted: bool = False
    constraints: dict[str, Span] = field(default_factory=dict)
    assertions: list[Assertion] = field(default_factory=list)

    def text(self, key: str):
        v = self.node.get(key)
        return None if v is None else v.plain()

    @property
    def element(self) -> tuple[int, str | None]:
        """Number of list layers, and the innermost type."""
        kind, depth = self.type, 0
        while kind and (m := re.fullmatch(r"list\((.*)\)", kind)):
            kind, depth = m[1], depth + 1
        return depth, kind

    @property
    def required(self) -> bool:
        return bool({"required", "primary_key"} & set(self.constraints))


@dataclass
class Definition:
    name: str
    text: str
    node: Value
    span: Span


@dataclass
class Table:
    name: str
    node: Value
    span: Span
    columns: list[Column]
    source: str | None
    source_span: Span | None
    assertions: list[Assertion]
    definitions: list[Definition]

    def column(self, name: str) -> Column | None:
        return next((c for c in self.columns if c.name == name), None)

    def text(self, key: str):
        v = self.node.get(key)
        return None if v is None else v.plain()

    @property
    def primary_key(self) -> list[Column]:
        return [c for c in self.columns if "primary_key" in c.constraints]


@dataclass
class Relationship:
    node: Value
    join: str
    cardinality: str
    aliases: dict[str, str]
    conflicts: list[str]
    span: Span
    pairs: list[tuple[tuple[str, str], str, tuple[str, str]]] = field(default_factory=list)
    error: str | None = None

    def table_of(self, name: str) -> str:
        return self.aliases.get(name, name)

    def resolved(self) -> list[tuple[tuple[str, str], str, tuple[str, str]]]:
        return [((self.table_of(a[0]), a[1]), op, (self.table_of(b[0]), b[1])) for a, op, b in self.pairs]


@dataclass
class Dictionary:
    document: Value
    tables: list[Table]
    relationships: list[Relationship]
    path: str | None = None

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)

    def source_path(self, table: Table) -> str:
        """Relative paths are relative to the dictionary's folder; URIs and absolute paths stand."""
        if "://" in table.source or os.path.isabs(table.source) or not self.path:
            return table.source
        return os.path.join(os.path.dirname(self.path), table.source)


_JOIN_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*|`(?:[^`]|``)+`)|(?P<mark>==|<=|>=|[=<>.]))")


def parse_join(text: str) -> list[tuple[tuple[str, str], str, tuple[str, str]]]:
    """A conjunction of ``table.column op table.column``; raises ValueError."""
    items, at = [], 0
    while at < len(text.rstrip()):
        m = _JOIN_TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}")
        items.append(m["name"] or m["mark"])
        at = m.end()
    pairs, k = [], 0

    def name() -> str:
        nonlocal k
        if k >= len(items) or not re.match(r"[A-Za-z_`]", items[k]):
            raise ValueError("a name is expected")
        k += 1
        return items[k - 1][1:-1].replace("``", "`") if items[k - 1][0] == "`" else items[k - 1]

    def side() -> tuple[str, str]:
        nonlocal k
        table = name()
        if k >= len(items) or items[k] != ".":
            raise ValueError("`.` is expected")
        k += 1
        return table, name()

    while True:
        left = side()
        if k >= len(items) or items[k] not in ("=", "==", "<", "<=", ">", ">="):
            raise ValueError("a comparison is expected")
        op = "=" if items[k] == "==" else items[k]
        k += 1
        pairs.append((left, op, side()))
        if k == len(items):
            return pairs
        if items[k].upper() != "AND":
            raise ValueError("`AND` is expected")
        k += 1


def _assertions(node: Value | None, column: str | None = None) -> list[Assertion]:
    out = []
    for v in node.data if node else ():
        if isinstance(v.data, dict) and v.get("assert"):
            text, d = v.get("assert"), v.get("description")
            out.append(Assertion(text.data, d.data if d else None, text.span, column))
    return out


def _column(v: Value) -> Column:
    name, kind = v.get("name"), v.get("type")
    values = v.get("values")
    fields = v.get("fields")
    constraints = v.get("constraints")
    display = v.get("display")
    return Column(
        name.data or "", kind.data if kind else None, v, name.span,
        [_column(x) for x in fields.data] if fields else [],
        None if values is None else [x.data for x in values.data] if isinstance(values.data, list) else [key.data for key, _ in values.data.values()],
        {k: x.data for k, (_, x) in values.data.items()} if values is not None and isinstance(values.data, dict) else None,
        display is not None and display.data == "restricted",
        {x.data: x.span for x in constraints.data if isinstance(x.data, str)} if constraints else {},
        _assertions(constraints, name.data),
    )


def build_model(document: Value, path: str | None = None) -> Dictionary:
    """The typed model of a document whose shape is right."""
    tables = []
    listed = document.get("tables")
    for v in listed.data if listed else ():
        source = v.get("source")
        parquet = source.get("parquet") if source else None
        definitions = v.get("definitions")
        tables.append(Table(
            v.get("name").data or "", v, v.get("name").span, [_column(c) for c in v.get("columns").data],
            parquet.data if parquet else None, parquet.span if parquet else None, _assertions(v.get("constraints")),
            [Definition(d.get("name").data or "", d.get("expr").data, d, d.get("expr").span) for d in definitions.data] if definitions else [],
        ))
    relationships = []
    listed = document.get("relationships")
    for v in listed.data if listed else ():
        aliases, conflicts = v.get("aliases"), v.get("conflicts")
        r = Relationship(v, v.get("join").data, v.get("cardinality").data, {k: x.data for k, (_, x) in aliases.data.items()} if aliases else {}, [x.data for x in conflicts.data] if conflicts else [], v.get("join").span)
        try:
            r.pairs = parse_join(r.join)
        except ValueError as e:
            r.error = str(e)
        relationships.append(r)
    return Dictionary(document, tables, relationships, path)


#: The file that is looked for in a folder.
DEFAULT_NAME = "contract.yaml"


def locate(path: str | None) -> str:
    """A dictionary file, a folder that has one, or the current folder."""
    path = path or "."
    return os.path.join(path, DEFAULT_NAME) if os.path.isdir(path) else path


def load_text(text: str, path: str | None = None) -> tuple[Dictionary | None, list[Problem]]:
    document, problems = read_document(text)
    problems += structural_problems(document)
    if any(p.severity == "error" for p in problems):
        return None, sorted(problems, key=lambda p: p.location or (0, 0, 0, 0))
    return build_model(document, path), problems


def load(path: str | None = None) -> tuple[Dictionary | None, list[Problem]]:
    path = locate(path)
    with open(path, encoding="utf-8") as f:
        return load_text(f.read(), path)
