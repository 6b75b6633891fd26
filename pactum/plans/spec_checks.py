"""Semantic checks of a dictionary (``S01`` to ``S34``); no data is read."""

from __future__ import annotations

import datetime as dt
import math
import re

from ..functions import checking, syntax
from ..sources.dictionary import Column, Dictionary, Problem, Span, Table, Value

SPEC_VERSION = (0, 1, 0)
LEARN_MORE = "https://"
SCALAR_TYPES = ("string", "number", "number(id)", "number(ordinal)", "number(quantity)", "boolean", "date", "datetime", "enum", "struct")
#: The areas of the time-zone database.
AREAS = frozenset("Africa America Antarctica Arctic Asia Atlantic Australia Europe Indian Pacific Etc".split())
RANGED = ("number(ordinal)", "number(quantity)", "date", "datetime")


def valid_type(kind: str) -> bool:
    m = re.fullmatch(r"list\((.*)\)", kind)
    return valid_type(m[1]) if m else kind in SCALAR_TYPES


def language_type(c: Column) -> str | None:
    if c.type is None:
        return None
    if c.type.startswith("list("):
        return "list"
    return "string" if c.type == "enum" else "number" if c.type.startswith("number") else c.type


def declared(c: Column) -> checking.Declared:
    return checking.Declared(c.name, language_type(c), tuple(declared(f) for f in c.fields))


def scope_of(table: Table) -> checking.Scope:
    """The table's columns and its definitions that parse."""
    scope = checking.Scope([declared(c) for c in table.columns])
    for d in table.definitions:
        try:
            scope.definitions[d.name] = syntax.parse(d.text)
        except syntax.SyntaxProblem:
            pass
    for name in circular(scope):
        del scope.definitions[name]
    return scope


def circular(scope: checking.Scope) -> list[str]:
    """Definitions whose references lead back to themselves."""
    uses = {n: {x.path[0] for x in syntax.walk(t) if isinstance(x, syntax.Column) and len(x.path) == 1} & set(scope.definitions) for n, t in scope.definitions.items()}

    def reaches(start: str) -> bool:
        seen, work = set(), list(uses[start])
        while work:
            n = work.pop()
            if n == start:
                return True
            if n not in seen:
                seen.add(n)
                work += uses[n]
        return False

    return [n for n in uses if reaches(n)]


class _Checks:
    def __init__(self, dictionary: Dictionary):
        self.d = dictionary
        self.found: list[Problem] = []

    def report(self, code: str, message: str, expected: str, location: Span | None, table: Table | None = None, column: str | None = None, severity: str = "error", context: tuple[Span, ...] = (), hint: str | None = None, suggestion=None) -> None:
        if table is not None and table.span not in context and location != table.span:
            context = (table.span, *context)
        self.found.append(Problem(code, message, severity, "spec", expected, hint, table.name if table else None, (column,) if column else (), location, context, suggestion=suggestion))

    def run(self) -> list[Problem]:
        self.document()
        seen: dict[str, int] = {}
        for t in self.d.tables:
            self.name(t.name, "table", t.span, None)
            if t.name and t.name in seen:
                self.report("S10", f"table `{t.name}` appears more than once", "Table names must be unique.", t.span)
            seen[t.name] = 1
            self.table(t)
        for r in self.d.relationships:
            self.relationship(r)
        self.foreign_keys()
        self.todos(self.d.document)
        self.found.sort(key=lambda p: p.location or (0, 0, 0, 0))
        return self.found

    def document(self) -> None:
        doc = self.d.document
        version = doc.get("$version")
        if version is None:
            self.report("S18", "`$version` is missing", "A dictionary must state the specification's version.", (0, 0, 0, 0), suggestion=("add the version", '$version: "0.1.0"\n', (0, 0, 0, 0)))
        else:
            m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:[-+].*)?", str(version.data))
            number = tuple(map(int, m.groups())) if m else None
            if number is None or number < (0, 1, 0) or number > SPEC_VERSION:
                self.report("S32", f"version `{version.data}` is not supported", "`$version` must be a version from 0.1.0 to 0.1.0.", version.span)
        if doc.get("$learn_more") is None:
            self.report("S09", "`$learn_more` is missing", "A dictionary should say where readers can learn about the format.", None, severity="warning")
        v = doc.get("version")
        if v is not None:
            if len(v.data) != 1:
                self.report("S17", f"has {len(v.data)} keys", "`version` must give exactly one of `number`, `date` or `hash`.", v.span)
            elif (n := v.get("number")) is not None and not re.fullmatch(r"\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?", str(n.data)):
                self.report("S17", f"`{n.data}` is not a version number", "A version number must be MAJOR.MINOR.PATCH.", n.span)
            elif (n := v.get("date")) is not None and checking.parse_temporal(str(n.data), "date") is None:
                self.report("S17", f"`{n.data}` is not a date", "A version's date must be an ISO 8601 date.", n.span)
        if len(self.d.tables) == 1:
            t = self.d.tables[0]
            for key in ("label", "description", "details"):
                if t.node.get(key) is not None:
                    self.report("S16", f"`{key}` is on the only table", "A dictionary of one table describes it at the top level.", t.node.key(key).span, t, severity="warning")

    def name(self, name: str, what: str, span: Span, table: Table | None) -> None:
        if not name:
            self.report("S11", f"a {what} has an empty name", f"A {what}'s name must not be empty.", span, table)

    def table(self, t: Table) -> None:
        self.columns(t, t.columns, ())
        names = {c.name for c in t.columns}
        defined: set[str] = set()
        for d in t.definitions:
            at = d.node.get("name").span
            self.name(d.name, "definition", at, t)
            if d.name in defined:
                self.report("S10", f"definition `{d.name}` appears more than once", "Names within a table must be unique.", at, t)
            if d.name and d.name in names:
                self.report("S33", f"definition `{d.name}` has the name of a column", "Definitions and columns share one namespace.", at, t)
            defined.add(d.name)
        scope = checking.Scope([declared(c) for c in t.columns])
        for d in t.definitions:
            try:
                scope.definitions[d.name] = syntax.parse(d.text)
            except syntax.SyntaxProblem as e:
                self.report("S19", str(e), "An expression must be well formed.", d.span, t)
        loops = circular(scope)
        for n in loops:
            d = next(x for x in t.definitions if x.name == n)
            self.report("S34", f"definition `{n}` leads back to itself", "Definitions must not refer to themselves.", d.span, t)
            del scope.definitions[n]
        for d in t.definitions:
            if d.name in scope.definitions:
                self.findings(checking.check(scope.definitions[d.name], scope, boolean=False), d.span, t, None, skip=set(loops))
        for a in t.assertions + [a for c in t.columns for a in c.assertions]:
            try:
                tree = syntax.parse(a.text)
            except syntax.SyntaxProblem as e:
                self.report("S19", str(e), "An expression must be well formed.", a.span, t, a.column)
                continue
            self.findings(checking.check(tree, scope), a.span, t, a.column, skip=set(loops))

    def findings(self, typed: checking.Typed, span: Span, t: Table, column: str | None, skip: set[str]) -> None:
        for f in typed.findings:
            if f.code == "S20" and any(f"`{n}`" in f.message for n in skip):
                continue
            at = (span[0], span[1] + f.start, span[0], span[1] + f.end) if span[0] == span[2] else span
            self.report(f.code, f.message, "An expression must be well typed.", at, t, column, f.severity)

    def columns(self, t: Table, columns: list[Column], above: tuple[str, ...]) -> None:
        seen: set[str] = set()
        for c in columns:
            path = ".".join((*above, c.name))
            if not c.name:
                self.name("", "column", c.span, t)
            elif c.name in seen:
                self.report("S10", f"column `{path}` appears more than once", "Names within a table must be unique.", c.span, t, path)
            seen.add(c.name)
            self.column(t, c, path)
            self.columns(t, c.fields, (*above, c.name))

    def column(self, t: Table, c: Column, path: str) -> None:
        put = lambda code, message, expected, v, severity="error": self.report(code, message, expected, v.span if isinstance(v, Value) else v, t, path, severity, (c.span,))
        kind = c.node.get("type")
        if c.type is not None and not valid_type(c.type):
            put("S28", f"`{c.type}` is not a type", "A column's type must be one of the specification's.", kind)
            return
        depth, inner = c.element
        if c.node.get("units") is not None and inner != "number(quantity)":
            put("S08", f"`units` on a column of type {c.type}", "Only `number(quantity)` has units.", c.node.key("units"))
        zone = c.node.get("time_zone")
        if zone is not None:
            if inner != "datetime":
                put("S14", f"`time_zone` on a column of type {c.type}", "Only `datetime` has a time zone.", c.node.key("time_zone"))
            elif not (zone.data in ("naive", "UTC") or re.fullmatch(r"[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+", str(zone.data)) and zone.data.split("/")[0] in AREAS):
                put("S15", f"`{zone.data}` is not a time zone", "A time zone must be `naive`, `UTC` or Area/Location.", zone)
        if depth or inner == "struct":
            for k in ("primary_key", "foreign_key", "unique"):
                if k in c.constraints:
                    put("S29", f"`{k}` on a {'list' if depth else 'struct'} column", "Lists and structs can't be keys or unique.", c.constraints[k])
        if c.type is None:
            return
        self.representation(c, inner, put)

    def representation(self, c: Column, inner: str | None, put) -> None:
        has = {k: c.node.get(k) for k in ("values", "range", "examples", "fields")}
        held = {k for k, v in has.items() if v is not None}
        if inner == "struct":
            wanted, allowed = "fields", {"fields"}
        elif inner == "enum":
            wanted, allowed = "values", {"values"}
        elif inner == "boolean":
            wanted, allowed = None, set()
        elif inner in RANGED:
            wanted, allowed = "range", {"range", "examples"}
        else:
            wanted, allowed = "examples", {"examples"} if inner == "string" else {"examples", "range"}
        for k in sorted(held - allowed):
            put("S07", f"`{k}` on a column of type {c.type}", f"A column of type {c.type} takes {' and '.join(f'`{x}`' for x in sorted(allowed)) or 'none of these keys'}.", c.node.key(k))
        if wanted and wanted not in held and not (c.restricted and wanted == "examples"):
            put("S07", f"`{wanted}` is missing", f"A column of type {c.type} must have `{wanted}`.", c.span)
        if inner == "enum" and has["values"] is not None:
            values = has["values"]
            if not values.data:
                put("S24", "`values` is empty", "An enum must permit at least one value.", values)
            keys = values.data if isinstance(values.data, list) else [k for k, _ in values.data.values()]
            for v in keys:
                if v.kind != "string":
                    put("S24", f"`{v.plain()}` is not a string", "An enum's values must be strings.", v)
        zoned = c.node.get("time_zone")
        for k in ("range", "examples"):
            if k in held & allowed:
                for v in has[k].data:
                    problem = self.value_problem(v, inner, zoned is not None, k)
                    if problem:
                        put("S12", problem, f"A value of a column of type {c.type} must match the type.", v)
        if "range" in held & allowed and len(has["range"].data) == 2:
            low, high = (bound(v, inner) for v in has["range"].data)
            if low is not None and high is not None and low > high:
                put("S13", f"starts at `{has['range'].data[0].plain()}`, above its end `{has['range'].data[1].plain()}`", "A range goes from its lower to its upper end.", has["range"])

    def value_problem(self, v: Value, inner: str | None, zoned: bool, key: str) -> str | None:
        if v.data is None:
            return "null is not a value"
        if isinstance(v.data, list):
            return next((p for x in v.data if (p := self.value_problem(x, inner, zoned, key))), None)
        if inner and inner.startswith("number"):
            if v.kind != "number":
                return f"`{v.data}` is not a number"
            return "NaN is not a bound" if key == "range" and isinstance(v.data, float) and math.isnan(v.data) else None
        if inner == "string":
            return None if v.kind == "string" else f"`{v.data}` is not a string"
        if inner in ("date", "datetime"):
            if key == "range" and isinstance(v.data, float) and math.isinf(v.data):
                return None
            text = v.data if isinstance(v.data, str) else ""
            if checking.parse_temporal(text, inner) is None:
                return f"`{v.data}` is not a {inner}"
            if inner == "datetime" and bool(re.search(r"(?:Z|[+-]\d\d:?\d\d)$", text)) == zoned:
                return f"`{v.data}` {'has' if zoned else 'lacks'} an offset"
        return None

    def relationship(self, r) -> None:
        put = lambda code, message, expected, span, severity="error": self.report(code, message, expected, span, severity=severity)
        if r.error:
            put("S04", f"can't be parsed: {r.error}", "A join must be a conjunction of comparisons of columns.", r.span)
            return
        names = list(dict.fromkeys(n for a, _, b in r.pairs for n in (a[0], b[0])))
        if len(names) > 2:
            put("S04", f"refers to {len(names)} tables", "A join must be between two tables.", r.span)
            return
        aliases = r.node.get("aliases")
        for name, target in r.aliases.items():
            if self.d.table(name) is not None:
                put("S26", f"alias `{name}` is also a table", "An alias must not have the name of a table.", aliases.key(name).span)
            if self.d.table(target) is None:
                put("S02", f"unknown table `{target}`", "An alias must name a table of the dictionary.", aliases.get(name).span)
            if name not in names:
                put("S27", f"alias `{name}` is not used", "An alias should be used by its join.", aliases.key(name).span, "warning")
        if len(names) < 2 or (r.table_of(names[0]) == r.table_of(names[1]) and not all(n in r.aliases for n in names)):
            put("S25", "both sides are the same rows", "A self-join must name each side with an alias.", r.span)
            return
        for n in names:
            if n not in r.aliases and self.d.table(n) is None:
                put("S02", f"unknown table `{n}`", "A join must use tables of the dictionary.", r.span)
        tables = [self.d.table(r.table_of(n)) for n in names]
        if None in tables:
            return
        known = True
        for a, _, b in r.pairs:
            for n, column in (a, b):
                if self.d.table(r.table_of(n)).column(column) is None:
                    put("S03", f"unknown column `{n}.{column}`", "A join must use columns of its tables.", r.span)
                    known = False
        for k, name in enumerate(r.conflicts):
            if not all(t.column(name) for t in tables):
                put("S05", f"`{name}` is not on both sides", "A conflict must be a column of both tables.", r.node.get("conflicts").data[k].span)
        if not known or any(op != "=" for _, op, _ in r.pairs):
            return
        one = {"one-to-one": (True, True), "one-to-many": (True, False), "many-to-one": (False, True)}[r.cardinality]
        for side, must in zip(names, one, strict=True):
            t = self.d.table(r.table_of(side))
            columns = [c for a, _, b in r.pairs for n, c in (a, b) if n == side]
            key = {c.name for c in t.primary_key}
            single = any("unique" in t.column(c).constraints for c in columns) or (key and key <= set(columns))
            if must and not single:
                put("S06", f"`{side}` is on the one side, but its columns are neither a primary key nor unique", "The one side's columns must be a key.", r.node.get("cardinality").span)

    def foreign_keys(self) -> None:
        for t in self.d.tables:
            for c in t.columns:
                if "foreign_key" in c.constraints and reference_of(self.d, t, c) is None:
                    self.report("S01", f"`{c.name}` refers to no primary key", "A foreign key must have a relationship with a primary key.", c.constraints["foreign_key"], t, c.name, context=(c.span,))

    def todos(self, v: Value) -> None:
        if isinstance(v.data, list):
            for x in v.data:
                self.todos(x)
        elif isinstance(v.data, dict):
            for key, (k, x) in v.data.items():
                if key == "todo" and isinstance(x.data, str):
                    self.report("S31", "a todo remains", "Finish the work and delete the note.", k.span, severity="warning")
                elif key not in ("glossary", "aliases", "values"):
                    self.todos(x)


def bound(v: Value, inner: str | None):
    """A range bound as something to compare; None if it can't be."""
    if isinstance(v.data, bool) or v.data is None:
        return None
    if inner in ("date", "datetime"):
        if isinstance(v.data, float) and math.isinf(v.data):
            return dt.datetime.max if v.data > 0 else dt.datetime.min
        value = checking.parse_temporal(v.data, inner) if isinstance(v.data, str) else None
        return dt.datetime.combine(value, dt.time()) if isinstance(value, dt.date) and not isinstance(value, dt.datetime) else value
    return None if not isinstance(v.data, (int, float)) or v.data != v.data else v.data


def reference_of(d: Dictionary, table: Table, column: Column) -> tuple[Table, Column] | None:
    """The primary-key column that a foreign key points at, by the relationships."""
    for r in d.relationships:
        for a, op, b in r.resolved() if not r.error else ():
            if op != "=":
                continue
            for own, other in ((a, b), (b, a)):
                if own == (table.name, column.name):
                    target = d.table(other[0])
                    found = target.column(other[1]) if target else None
                    if found is not None and "primary_key" in found.constraints and (target is not table or found is not column):
                        return target, found
    return None


def check_spec(d: Dictionary) -> list[Problem]:
    """All semantic problems, in document order."""
    return _Checks(d).run()
