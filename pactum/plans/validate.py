"""Validation runs: which checks a dictionary asks for, their jobs, and the report.

Per table, nulls, enum membership and all row-level assertions are counted by
one fused aggregate pass; one more pass locates the first few offending rows of
all checks that failed. Keys and references are grouped and joined.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import compiling, syntax
from ..functions.checking import check
from ..operators import assertions, columns, keys
from ..sources import dictionary as source
from ..sources.dictionary import Assertion, Column, Dictionary, Problem, Table
from ..sources.footers import Footers, Leaf, read_footers
from ..sources.parquet import ROW, NotReadable, column_tree, narrowed, read_table, unified, with_rows
from .spec_checks import check_spec, reference_of, scope_of

SAMPLE = 5
REPORT_VERSION = "0.1.0"
TOOL = {"name": "pactum", "version": "0.1.0"}
#: Fixed values of the report format: the kind of each problem, by its code.
KINDS = {
    "M01": "type_mismatch",
    "M02": "missing_in_data",
    "M03": "extra_in_data",
    "M04": "missing_source",
    "M05": "unreadable_source",
    "D01": "nulls_in_required",
    "D02": "duplicate_values",
    "D03": "uniqueness_not_verified",
    "D04": "values_outside_enum",
    "D05": "foreign_key_not_found",
    "D06": "referential_integrity_not_verified",
    "D07": "assertion_violated",
    "D08": "assertion_not_checked",
    "D09": "assertion_overflow",
    "D07 of the table": "assertion_false",
}


@dataclass
class Step:
    code: str
    table: str
    columns: tuple[str, ...] = ()
    assertion: str | None = None
    outcome: str = "unevaluated"
    rows: int | None = None
    failed: int | None = None
    id: int = 0
    subject: object = None


@dataclass
class Result:
    """A check of rows: how it is counted and located, and what was found."""

    step: Step
    metrics: list[SparkColumn]
    condition: SparkColumn | None
    tops: list[str]  # the top-level columns that it reads
    carry: list[SparkColumn] = field(default_factory=list)
    count: int = 0
    failed: int = 0
    prepared: assertions.Prepared | None = None
    verdict: assertions.Verdict | None = None
    shown: list[tuple[str, ...]] = field(default_factory=list)
    rows: list = field(default_factory=list)


@dataclass
class Run:
    dictionary: str
    level: str
    table: str | None
    finished: dt.datetime
    steps: list[Step]
    problems: list[Problem]

    @property
    def status(self) -> str:
        kinds = {p.severity for p in self.problems}
        return "error" if "error" in kinds else "warning" if kinds else "ok"

    def report(self) -> dict:
        run: dict = {"dictionary": self.dictionary, "level": self.level}
        if self.table:
            run["table"] = self.table
        run |= {"generated_at": self.finished.strftime("%Y-%m-%dT%H:%M:%SZ"), "tool": TOOL}
        return {"$version": REPORT_VERSION, "run": run, "status": self.status, "steps": [step_json(s) for s in self.steps], "problems": [problem_json(p) for p in self.problems]}

    def to_json(self, indent: int | None = 2) -> str:
        return json.dumps(self.report(), indent=indent, ensure_ascii=False)


def step_json(s: Step) -> dict:
    out: dict = {"id": s.id, "code": s.code, "table": s.table}
    if s.columns:
        out["columns"] = list(s.columns)
    if s.assertion is not None:
        out["assertion"] = s.assertion
    out["outcome"] = s.outcome
    if s.outcome != "unevaluated" and s.rows is not None:
        out |= {"row_count": s.rows, "failed_row_count": s.failed or 0}
    return out


def span_json(span) -> dict:
    return dict(zip(("start_line", "start_column", "end_line", "end_column"), span, strict=True))


def problem_json(p: Problem) -> dict:
    out: dict = {"code": p.code}
    if p.step is not None:
        out["step"] = p.step
    out |= {"severity": p.severity, "kind": p.kind, "message": p.message}
    for key, value in (("expected", p.expected), ("hint", p.hint), ("table", p.table)):
        if value is not None:
            out[key] = value
    if p.suggestion:
        out["suggestion"] = {"title": p.suggestion[0], "replacement": p.suggestion[1], "location": span_json(p.suggestion[2])}
    if p.columns:
        out["columns"] = list(p.columns)
    out |= {k: v for k, v in p.extra if v is not None and v != []}
    if p.location:
        out["location"] = span_json(p.location)
    if p.context:
        out["context"] = [span_json(c) for c in p.context]
    return out


def rendered(value) -> str | None:
    """A value as the dictionary would write it."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value:
            return "NaN"
        if value in (float("inf"), float("-inf")):
            return "Infinity" if value > 0 else "-Infinity"
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 and str(value)[0] != "-" or value.is_integer() and value < 0 and abs(value) < 1e15 else repr(value)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, dt.datetime):
        return value.isoformat()
    return value.isoformat() if isinstance(value, dt.date) else str(value)


def spark_path(path: tuple[str, ...]) -> SparkColumn:
    return compiling.column_ref(path)


@contextlib.contextmanager
def in_utc(spark: SparkSession) -> Iterator[None]:
    """Dates and times are compared in UTC; the session's own zone is back afterwards."""
    key = "spark.sql.session.timeZone"
    before = spark.conf.get(key)
    spark.conf.set(key, "UTC")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Validator:
    """Validates one dictionary at a level: ``spec``, ``meta`` or ``data``."""

    def __init__(self, spark: SparkSession, d: Dictionary, level: str = "data", table: str | None = None, now: dt.datetime | None = None, sample: int = SAMPLE):
        self.spark, self.d, self.level, self.only, self.sample = spark, d, level, table, sample
        self.now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)  # bound once for the run
        self.steps: list[Step] = []
        self.problems: list[Problem] = []
        self.frames: dict[str, DataFrame] = {}
        self.counts: dict[str, int] = {}
        self.trees: dict[str, list[Leaf]] = {}
        self.footers: dict[str, Footers | None] = {}
        self.bad: set[tuple[str, str]] = set()  # (table, top-level column) whose data checks can't run

    def run(self) -> Run:
        self.problems += check_spec(self.d)
        if self.level != "spec" and not any(p.severity == "error" for p in self.problems):
            with in_utc(self.spark):
                self.checks()
        return Run(self.d.path or source.DEFAULT_NAME, self.level, self.only, dt.datetime.now(dt.UTC), self.steps, self.problems)

    def checks(self) -> None:
        tables = [t for t in self.d.tables if self.only in (None, t.name)]
        for t in tables:
            self.plan(t)
        for k, s in enumerate(self.steps, 1):
            s.id = k
        for t in tables:
            self.meta(t)
        if self.level == "data":
            for t in tables:
                if t.name in self.frames:
                    checks = self.rows(t)
                    self.scan(t, checks)
                    self.unique(t)
                    self.asserts(t, checks)
            for t in tables:
                if t.name in self.frames:
                    self.references(t)

    # ------------------------------------------------------------ steps

    def plan(self, t: Table) -> None:
        data = self.level == "data"
        put = lambda code, cols=(), assertion=None, subject=None: self.steps.append(Step(code, t.name, tuple(cols), assertion, subject=subject))
        put("M04", subject=t)
        scope = scope_of(t)
        self_reads = lambda a: [".".join(p) for p in check(syntax.parse(a.text), scope).columns]
        by_first: dict[str | None, list[Assertion]] = {}
        for a in [*(a for c in t.columns for a in c.assertions), *t.assertions]:
            first = a.column or next((p.split(".")[0] for p in self_reads(a)), None)
            by_first.setdefault(first, []).append(a)
        pk = t.primary_key

        def below(c: Column, path: tuple[str, ...]) -> None:
            name = ".".join(path)
            put("M01", [name], subject=(c, path))
            if data:
                if len(path) == 1 and c.required:
                    put("D01", [name], subject=c)
                if len(path) == 1:
                    if "unique" in c.constraints:
                        put("D02", [name], subject=[c])
                    if pk and pk[0] is c:
                        put("D02", [x.name for x in pk], subject=pk)
                if c.element[1] == "enum" and c.values:
                    put("D04", [name], subject=(c, path))
                if len(path) == 1 and "foreign_key" in c.constraints:
                    put("D05", [name], subject=c)
                if len(path) == 1:
                    for a in by_first.get(c.name, ()):
                        put("D07", self_reads(a), a.text, a)
            for f in c.fields:
                below(f, (*path, f.name))

        for c in t.columns:
            below(c, (c.name,))
        for a in by_first.get(None, ()) if data else ():
            put("D07", (), a.text, a)

    def of(self, t: Table, code: str) -> list[Step]:
        return [s for s in self.steps if s.table == t.name and s.code == code]

    def settle(self, s: Step, failed: int = 0) -> None:
        s.outcome, s.rows, s.failed = ("fail" if failed else "pass"), self.counts[s.table], failed

    def report(self, code: str, kind: str, message: str, expected: str, t: Table, s: Step | None = None, cols=(), location=None, context=(), severity="error", **extra) -> None:
        where = tuple(x for x in ((t.span,) if location != t.span else ()) + tuple(context) if x is not None)
        self.problems.append(Problem(code, message, severity, kind, expected, None, t.name, tuple(cols), location, where, s.id if s else None, tuple(extra.items())))

    # ------------------------------------------------------------- meta

    def meta(self, t: Table) -> None:
        (step,) = self.of(t, "M04")
        if t.source is None:
            step.outcome = "fail"
            self.report("M04", KINDS["M04"], "has no `source`", "Checking data needs a `source` to read.", t, step, location=t.span)
            return
        path = self.d.source_path(t)
        try:
            df, footers = self.open(t, path)
        except NotReadable as e:
            step.outcome = "fail"
            self.report("M05", KINDS["M05"], str(e), "The file named by `source` has to open as Parquet.", t, step, location=t.source_span)
            return
        self.counts[t.name] = df.count() if footers is None else footers.rows
        self.frames[t.name], self.footers[t.name] = df, footers
        self.settle(step)
        steps = {s.columns[0]: s for s in self.of(t, "M01")}
        self.compare(t, t.columns, self.trees[t.name], (), steps)
        for shape in footers.shapes[1:] if footers else ():  # what the first file does not tell
            self.deviations(t, t.columns, self.trees[t.name], shape.tree, (), steps, shape.file)

    def open(self, t: Table, path: str) -> tuple[DataFrame, Footers | None]:
        """A table's frame, and the footers of all its files where they can be read; its columns go to ``trees``."""
        df = read_table(self.spark, path)
        footers = read_footers(self.spark, path)
        if footers is not None and footers.unread:
            raise NotReadable(footers.unread)
        if footers is not None and len(footers.shapes) > 1:
            df, conflicts = unified(self.spark, path, footers, {c.name for c in t.columns})
            if conflicts:
                name, file, stored, first = conflicts[0]
                raise NotReadable(f"`{name}` is stored as {stored} in {file}, but as {first} before")
        self.trees[t.name] = column_tree(self.spark, path, footers)
        return df, footers

    def deviations(self, t: Table, declared: list[Column], known: list[Leaf], found: list[Leaf], above: tuple[str, ...], steps: dict[str, Step], file: str) -> None:
        """M01 and M02 of a further schema of the table, for columns of which nothing has been reported yet."""
        for c in declared:
            path = (*above, c.name)
            name, leaf, first = ".".join(path), next((x for x in found if x.name == c.name), None), next((x for x in known if x.name == c.name), None)
            if first is None or not self.usable(t, path):
                continue
            step = steps[name]
            wrong = leaf is not None and c.type is not None and not compatible(c.type, leaf)
            if leaf is None or wrong:
                step.outcome, step.failed = "fail", 0
                self.bad.add((t.name, name))
            if leaf is None:
                self.report("M02", KINDS["M02"], f"is not in the data of {file}", "What the dictionary lists has to be stored in every file.", t, step, [name], c.span)
            elif wrong:
                kind = c.node.get("type")
                self.report("M01", KINDS["M01"], f"is declared {c.type}, but the data is {leaf.label()} in {file}", "Declared and stored types have to agree in every file.", t, step, [name], kind.span, (c.span,), declared=c.type, actual=leaf.label())
            elif c.fields:
                self.deviations(t, c.fields, inside(first), inside(leaf), path, steps, file)

    def stats(self, t: Table, name: str):
        """What the footers tell of a column; None if they don't."""
        footers = self.footers[t.name]
        return footers.columns.get(name) if footers is not None else None

    def compare(self, t: Table, declared: list[Column], found: list[Leaf], above: tuple[str, ...], steps: dict[str, Step]) -> None:
        for c in declared:
            path = (*above, c.name)
            name, leaf = ".".join(path), next((x for x in found if x.name == c.name), None)
            step = steps[name]
            if leaf is None:
                step.outcome, step.rows, step.failed = "fail", self.counts[t.name], 0
                self.bad.add((t.name, name))
                self.report("M02", KINDS["M02"], "is not in the data", "What the dictionary lists has to be stored.", t, step, [name], c.span)
                continue
            if c.type is not None and not compatible(c.type, leaf):
                step.outcome, step.rows, step.failed = "fail", self.counts[t.name], 0
                self.bad.add((t.name, name))
                kind = c.node.get("type")
                self.report("M01", KINDS["M01"], f"is declared {c.type}, but the data is {leaf.label()}", "Declared and stored types have to agree.", t, step, [name], kind.span, (c.span,), declared=c.type, actual=leaf.label())
                continue
            self.settle(step)
            if c.fields:
                self.compare(t, c.fields, inside(leaf), path, steps)
        names = {c.name for c in declared}
        for leaf in found:
            if leaf.name not in names:
                name = ".".join((*above, leaf.name))
                self.report("M03", KINDS["M03"], "is not in the dictionary", "Stored columns are best described as well.", t, None, [name], severity="warning", actual=leaf.label())

    def usable(self, t: Table, path: tuple[str, ...]) -> bool:
        return not any((t.name, ".".join(path[:k])) in self.bad for k in range(1, len(path) + 1))

    def known(self, t: Table, name: str) -> keys.Known | None:
        """What the footers tell of a whole-numbered column's range."""
        whole = self.frames[t.name].schema[name].dataType.typeName() in ("long", "integer", "short", "byte")
        return keys.known_range(self.footers[t.name], name) if whole else None

    # ------------------------------------------------- checks of rows

    def rows(self, t: Table) -> list[Result]:
        """D01, D04 and D07 of a table: one pass counts what breaks them all, one more locates it for those that failed."""
        base = self.frames[t.name]
        checks = [*self.nulls(t), *self.outsiders(t)]
        live, prepared, tops = self.prepared(t)
        by_row = bool(checks) or any(p.by_row and p.barrier is None for p in prepared)
        shown = list(dict.fromkeys([*tops, *(x for c in checks for x in c.tops)]))
        df = with_rows(base, shown) if by_row else narrowed(base, shown)
        verdicts, folded, judged, told, block = assertions.evaluate(df, prepared, self.now, [c.metrics for c in checks], self.counts[t.name], self.sample)
        for c, (sums, _) in zip(checks, told, strict=False):
            c.count, c.failed = sums[0], sums[-1]
        for s, p, v, j in zip(live, prepared, verdicts, judged, strict=True):
            shown = [path for path in p.typed.columns if not t.column(path[0]).restricted]
            checks.append(Result(s, [], j.violated if j else None, [path[0] for path in p.typed.columns], [spark_path(path) for path in shown], v.count, v.count, p, v, shown))
        lost = [(c, blocks) for c, (_, blocks) in zip(checks, told, strict=True) if c.count]
        if lost:
            numbered = with_rows(base, list(dict.fromkeys(x for c, _ in lost for x in c.tops)))
            if any(c.verdict for c, _ in lost):
                numbered = folded.onto(numbered)
            first = columns.first_rows_each(numbered, [(c.condition, c.carry, blocks) for c, blocks in lost], self.sample, block)
            for (c, _), rows in zip(lost, first, strict=True):
                c.rows = rows
        return checks

    def nulls(self, t: Table) -> list[Result]:
        out = []
        for s in self.of(t, "D01"):
            if self.usable(t, (s.subject.name,)):
                known = self.stats(t, s.subject.name)
                if known is not None and known.nulls == 0:  # nulls are located by a scan; their absence needs none
                    self.settle(s)
                    continue
                condition = spark_path((s.subject.name,)).isNull()
                out.append(Result(s, [columns.count_where(condition)], condition, [s.subject.name]))
        return out

    def outsiders(self, t: Table) -> list[Result]:
        out = []
        for s in self.of(t, "D04"):
            c, path = s.subject
            if self.usable(t, path):
                steps, top = self.steps_to(t, path, c), spark_path(path[:1])
                n = columns.outside_values(top, steps, c.values)
                sample = [] if t.column(path[0]).restricted else [columns.outside_sample(top, steps, c.values)]
                out.append(Result(s, [F.sum(n), columns.count_where(n > 0)], n > 0, [path[0]], sample))
        return out

    def scan(self, t: Table, checks: list[Result]) -> None:
        for r in checks:
            s = r.step
            if s.code == "D01":
                self.settle(s, r.count)
                if r.count:
                    c = s.subject
                    at = c.constraints.get("required") or c.constraints.get("primary_key")
                    self.report("D01", KINDS["D01"], f"has {r.count} null(s)", "Every row needs a value here.", t, s, s.columns, at, (c.span,), count=r.count, rows=[x[ROW] for x in r.rows])
            elif s.code == "D04":
                self.settle(s, r.failed)
                if r.count:
                    c, path = s.subject
                    hidden = t.column(path[0]).restricted
                    values = None if hidden else [{s.columns[0]: rendered(x["v0"])} for x in r.rows]
                    self.report(
                        "D04", KINDS["D04"], f"has {r.count} value(s) outside the allowed set", "Only the listed `values` may occur.",
                        t, s, s.columns, c.node.get("values").span, (c.span,), count=r.count, rows=[x[ROW] for x in r.rows], values=values, redacted=hidden,
                    )

    def steps_to(self, t: Table, path: tuple[str, ...], c: Column) -> list:
        """How to reach a nested column from its top-level one: names, and None through lists."""
        at, out = t.column(path[0]), []
        out += [None] * at.element[0]
        for name in path[1:]:
            at = next(f for f in at.fields if f.name == name)
            out += [name] + [None] * at.element[0]
        return out

    # ----------------------------------------------------------- keys

    def leaf(self, t: Table, name: str) -> Leaf | None:
        return next((x for x in self.trees[t.name] if x.name == name), None)

    def unique(self, t: Table) -> None:
        for s in self.of(t, "D02"):
            cols = list({c.name: c for c in s.subject}.values())
            if not all(self.usable(t, (c.name,)) for c in cols):
                continue
            at = cols[0].constraints.get("unique" if len(s.subject) == 1 and "unique" in cols[0].constraints else "primary_key")
            barrier = next((x for c in cols if (x := self.leaf(t, c.name)) is not None and not x.comparable), None)
            if barrier is not None:
                self.report("D03", KINDS["D03"], f"uniqueness was not checked: {barrier.reason}", "Duplicates can only be looked for among values that compare.", t, s, s.columns, at, (cols[0].span,), "warning", reason=barrier.reason)
                continue
            known = self.stats(t, cols[0].name) if len(cols) == 1 else None
            if known is not None and known.nulls == 0 and known.distinct == known.rows:
                self.settle(s)
                continue
            keyed = [spark_path((c.name,)) for c in cols]
            count = keys.duplicate_count(narrowed(self.frames[t.name], [c.name for c in cols]), keyed, [self.known(t, c.name) for c in cols]).first()["duplicates"]
            self.settle(s, count)
            if count:
                df = with_rows(self.frames[t.name], [c.name for c in cols])
                hidden = [c.name for c in cols if c.restricted]
                shown = [c for c in cols if not c.restricted]
                rows = keys.duplicate_rows(df, keyed, [spark_path((c.name,)).alias(f"v{k}") for k, c in enumerate(shown)]).orderBy(ROW).limit(self.sample).collect()
                values = [{c.name: rendered(r[f"v{k}"]) for k, c in enumerate(shown)} for r in rows] if shown else None
                self.report("D02", KINDS["D02"], f"has {count} repeated occurrence(s)", "No two rows may have the same value here." if len(cols) == 1 else "No two rows may have the same key.", t, s, s.columns, at, (cols[0].span,), count=count, rows=[r[ROW] for r in rows], values=values, redacted=bool(hidden))

    def references(self, t: Table) -> None:
        for s in self.of(t, "D05"):
            c = s.subject
            found = reference_of(self.d, t, c)
            if found is None or not self.usable(t, (c.name,)):
                continue
            target, key = found
            if target.name not in self.frames:
                if self.only is None or target.source is None:
                    continue
                try:
                    path = self.d.source_path(target)
                    self.frames[target.name], self.footers[target.name] = self.open(target, path)
                except NotReadable:
                    continue
            if not self.usable(target, (key.name,)) or self.leaf(target, key.name) is None:
                continue
            refers = {"table": target.name, "column": key.name}
            at = c.constraints["foreign_key"]
            barrier = next((x for x in (self.leaf(t, c.name), self.leaf(target, key.name)) if not x.comparable), None)
            if barrier is not None:
                self.report("D06", KINDS["D06"], f"the reference was not checked: {barrier.reason}", "References can only be followed between values that compare.", t, s, s.columns, at, (c.span,), "warning", column=c.name, references=refers, reason=barrier.reason)
                continue
            child, parent = narrowed(self.frames[t.name], [c.name]), narrowed(self.frames[target.name], [key.name])
            pair = (spark_path((c.name,)), child.schema[c.name].dataType, parent, spark_path((key.name,)), parent.schema[key.name].dataType)
            count = keys.orphan_count(child, *pair, (self.known(t, c.name), self.known(target, key.name))).first()["orphans"]
            self.settle(s, count)
            if count:
                lost = keys.orphans(with_rows(self.frames[t.name], [c.name]), *pair, [spark_path((c.name,)).alias("v")])
                rows = lost.orderBy(ROW).limit(self.sample).collect()
                values = None if c.restricted else [{c.name: rendered(r["v"])} for r in rows]
                self.report("D05", KINDS["D05"], f"has {count} value(s) that `{target.name}.{key.name}` lacks", "Each value needs its row in the table referred to.", t, s, s.columns, at, (c.span,), column=c.name, references=refers, count=count, rows=[r[ROW] for r in rows], values=values, redacted=c.restricted)

    # ------------------------------------------------------ assertions

    def prepared(self, t: Table) -> tuple[list[Step], list[assertions.Prepared], list[str]]:
        """The assertions whose columns can be used, ready to run, and the columns that they read."""
        steps, scope = self.of(t, "D07"), scope_of(t)
        typed = [check(syntax.parse(s.subject.text), scope) for s in steps]
        live = [k for k, x in enumerate(typed) if all(self.usable(t, p) for p in x.columns)]
        out = []
        for k in live:
            p = assertions.prepare(typed[k], scope, self.frames[t.name].schema, self.now)
            unreadable = next((path for path in typed[k].columns if self.unreadable(t, path)), None)
            if unreadable and p.barrier is None and not self.only_null_tests(typed[k], unreadable):
                p.barrier = compiling.Unreadable(unreadable, "its stored type can't be read as its declared type")
            out.append(p)
        return [steps[k] for k in live], out, list(dict.fromkeys(p[0] for k in live for p in typed[k].columns))

    def asserts(self, t: Table, checks: list[Result]) -> None:
        for r in checks:
            if r.verdict is None:
                continue
            s, a, v = r.step, r.step.subject, r.verdict
            context = (t.column(a.column).span,) if a.column else ()
            put = lambda code, kind, message, expected, **extra: self.report(code, kind, message, expected, t, s, s.columns, a.span, context, assertion=a.text, **extra)  # noqa: E731,B023
            if v.outcome == "holds":
                self.settle(s)
            elif v.outcome == "unreadable":
                put("D08", KINDS["D08"], f"was not checked: {v.barrier}", "A rule needs columns that read as declared.", column=".".join(v.barrier.path), reason=str(v.barrier))
            elif v.outcome == "bad_pattern":
                put("D08", KINDS["D08"], "was not checked: a pattern from the data is malformed", "Patterns taken from rows have to be valid.", reason=f"row {v.row} holds a malformed pattern")
            elif v.outcome == "overflow":
                put("D09", KINDS["D09"], "integer arithmetic left the 64-bit range", "The arithmetic of a rule has to stay in range.", row=v.row)
            elif v.outcome == "false":
                s.outcome, s.rows, s.failed = "fail", self.counts[t.name], 0
                put("D07", KINDS["D07 of the table"], "is false", "The table as a whole has to satisfy this rule.")
            else:
                self.settle(s, v.count)
                hidden = len(r.shown) < len(r.prepared.typed.columns)
                values = [{".".join(path): rendered(x[f"v{i}"]) for i, path in enumerate(r.shown)} for x in r.rows] if r.shown else None
                put("D07", KINDS["D07"], f"is false for {v.count} row(s)", "No row may make this rule false.", count=v.count, rows=[x[ROW] for x in r.rows], values=values, redacted=hidden)

    def unreadable(self, t: Table, path: tuple[str, ...]) -> bool:
        leaf = self.leaf(t, path[0])
        for name in path[1:]:
            leaf = leaf.child(name) if leaf else None
        return leaf is not None and not leaf.readable

    @staticmethod
    def only_null_tests(typed, path: tuple[str, ...]) -> bool:
        """Whether an expression asks nothing of a column but whether it is null."""

        def bare(node, exempt=False) -> bool:
            if isinstance(node, syntax.Column):
                return node.path == path and not exempt
            exempt = isinstance(node, syntax.IsNull) or isinstance(node, syntax.Call) and node.name == "COUNT"
            return any(bare(c, exempt) for c in node.children())

        return not bare(typed.tree)


def inside(leaf: Leaf) -> list[Leaf]:
    """The fields of a struct, or of the structs of a list."""
    while leaf.type == "list" and leaf.children:
        leaf = leaf.children[0]
    return leaf.children


def compatible(declared: str, leaf: Leaf) -> bool:
    if declared.startswith("list("):
        return leaf.type == "list" and bool(leaf.children) and compatible(declared[5:-1], leaf.children[0])
    wanted = "number" if declared.startswith("number") else "string" if declared == "enum" else declared
    return leaf.type == wanted


def validate(spark: SparkSession | None, path: str | None = None, level: str = "data", table: str | None = None, text: str | None = None, now: dt.datetime | None = None) -> Run:
    """Validate a dictionary file (or its text, whose sources are relative to ``path``)."""
    d, problems = source.load_text(text, path) if text is not None else source.load(path)
    if d is None:
        return Run(path or source.DEFAULT_NAME, level, table, dt.datetime.now(dt.UTC), [], problems)
    if table is not None and d.table(table) is None:
        raise ValueError(f"no table `{table}` in the dictionary")
    run = Validator(spark, d, level, table, now).run()
    return replace(run, problems=[*problems, *run.problems])


def problems_frame(spark: SparkSession, run: Run) -> DataFrame:
    """The problems of a run as a frame."""
    rows = [(p.code, p.severity, p.kind, p.table, ",".join(p.columns), dict(p.extra).get("count"), p.message) for p in run.problems]
    schema = T.StructType([T.StructField(n, T.LongType() if n == "count" else T.StringType()) for n in ("code", "severity", "kind", "table", "columns", "count", "message")])
    return spark.createDataFrame(rows, schema)
