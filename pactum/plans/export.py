"""A dictionary as JSON, with or without profiles of its data; descriptions; drafts.

``export_spec`` needs no data. ``export_data`` adds a profile per column (one
fused pass per table, see :mod:`pactum.operators.profiling`).
"""

from __future__ import annotations

import html
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import checking, syntax
from ..functions.compiling import column_ref
from ..operators.profiling import Profile, element_column, footer_ranges, profile
from ..sources import dictionary as source
from ..sources.dictionary import Assertion, Column, Dictionary, Table
from ..sources.footers import Footers, read_footers
from ..sources.parquet import FILE, IN_FILE, read_table
from .relationships import normalized
from .spec_checks import check_spec, reference_of, scope_of
from .translate import EXPORTED, translation

EXPORT_VERSION = "0.1.0"
EXPORT_BINS = 200
DESCRIBE_BINS = 20
IMPLIED = {"primary_key": ("unique", "required")}


class Invalid(ValueError):
    """The dictionary has errors; nothing is exported."""

    def __init__(self, problems):
        super().__init__("; ".join(f"{p.code}: {p.message}" for p in problems))
        self.problems = problems


def scalar(v):
    """JSON has no infinities; dates are ISO text."""
    if isinstance(v, float) and not math.isfinite(v):
        return None
    return v.isoformat() if hasattr(v, "isoformat") else v


def prose(text: str) -> str:
    """Markdown's paragraphs, emphasis, code and links as HTML; raw HTML is escaped."""
    out = []
    for block in re.split(r"\n\s*\n", html.escape(text.strip(), quote=False)):
        block = re.sub(r"`([^`]+)`", r"<code>\1</code>", block)
        block = re.sub(r"\*\*([^*]+)\*\*", r"<strong>\1</strong>", block)
        block = re.sub(r"(?<!\w)[*_]([^*_]+)[*_](?!\w)", r"<em>\1</em>", block)
        block = re.sub(r"\[([^\]]+)\]\(([^)\s]+)\)", r'<a href="\2">\1</a>', block)
        lines = block.split("\n")
        if all(x.lstrip().startswith(("- ", "* ")) for x in lines):
            out.append("<ul>" + "".join(f"<li>{x.lstrip()[2:]}</li>" for x in lines) + "</ul>")
        else:
            out.append(f"<p>{block}</p>")
    return "\n".join(out)


def _texts(node, keys: tuple[str, ...]) -> dict:
    out = {}
    for k in keys:
        v = node.get(k)
        if v is not None and v.data is not None:
            out[k] = prose(v.data) if k in ("description", "details", "todo") else v.data
    return out


def canonical(kind: str) -> str:
    return re.sub(r"\s+", "", kind)


def assertion_json(a: Assertion, table: Table) -> dict:
    scope = scope_of(table)
    typed = checking.check(syntax.parse(a.text), scope)
    out: dict = {"expression": a.text}
    if a.description:
        out["description"] = prose(a.description)
    out["columns"] = [".".join(p) for p in typed.columns]
    if typed.definitions:
        out["definitions"] = typed.definitions
    out["translations"] = [translation(a.text, scope, t) for t in EXPORTED]
    return out


def definition_json(d, table: Table) -> dict:
    scope = scope_of(table)
    typed = checking.check(scope.definitions[d.name], scope, boolean=False)
    kind = "metric" if typed.shape != checking.ROW else "filter" if typed.type == "boolean" else "derived"
    out: dict = {"name": d.name, **_texts(d.node, ("label", "description", "details", "todo")), "expression": d.text, "kind": kind}
    if typed.type in checking.SCALARS:
        out["type"] = typed.type
    direct = [n.path for n in syntax.walk(scope.definitions[d.name]) if isinstance(n, syntax.Column)]
    used = [p[0] for p in direct if len(p) == 1 and p[0] in scope.definitions and scope.column(p[0]) is None]
    out["columns"] = list(dict.fromkeys(".".join(p) for p in direct if p[0] not in used)) if typed.selected is None else [".".join(p) for p in typed.columns]
    if used:
        out["definitions"] = list(dict.fromkeys(used))
    out["translations"] = [translation(d.text, scope, t, boolean=False) for t in EXPORTED]
    return out


def column_json(d: Dictionary, t: Table, c: Column, path: tuple[str, ...], profiles: dict[str, dict]) -> dict | None:
    if c.type is None:
        return None
    out: dict = {"name": c.name, **_texts(c.node, ("label", "description", "details", "todo"))}
    if c.restricted:
        out["display"] = "restricted"
    out["type"] = canonical(c.type)
    for k in ("units", "time_zone"):
        if c.text(k) is not None:
            out[k] = c.text(k)
    if c.constraints:
        held = list(c.constraints)
        for k in list(held):
            held += [x for x in IMPLIED.get(k, ()) if x not in held]
        out["constraints"] = held
    if len(path) == 1 and "foreign_key" in c.constraints and (found := reference_of(d, t, c)):
        out["references"] = {"table": found[0].name, "column": found[1].name}
    if len(path) == 1 and "primary_key" in c.constraints:
        back = [
            {"table": o.name, "column": x.name}
            for o in d.tables for x in o.columns
            if "foreign_key" in x.constraints and (r := reference_of(d, o, x)) and r[0] is t and r[1] is c
        ]
        if back:
            out["referenced_by"] = back
    if c.values is not None:
        out["values"] = list(c.values)
        if c.value_labels:
            out["value_labels"] = c.value_labels
    if (r := c.text("range")) is not None:
        out["range"] = {"min": scalar(r[0]), "max": scalar(r[1])}
    if (e := c.text("examples")) is not None:
        out["examples"] = [scalar(x) for x in e]
    fields = [f for f in (column_json(d, t, f, (*path, f.name), profiles) for f in c.fields) if f]
    if fields:
        out["fields"] = fields
    if c.assertions:
        out["assertions"] = [assertion_json(a, t) for a in c.assertions]
    if ".".join(path) in profiles:
        out["profile"] = profiles[".".join(path)]
    return out


def export_spec(d: Dictionary, profiles: dict[str, dict[str, dict]] | None = None, rows: dict[str, int] | None = None) -> dict:
    """The dictionary, resolved; ``profiles`` by table and dotted column."""
    problems = [p for p in check_spec(d) if p.severity == "error"]
    if problems:
        raise Invalid(problems)
    doc = d.document
    out: dict = {"$version": EXPORT_VERSION, **_texts(doc, ("name", "label", "description", "details", "todo", "origin"))}
    if doc.get("$learn_more"):
        out["learn_more"] = doc.get("$learn_more").data
    if doc.get("version"):
        out["version"] = doc.get("version").plain()
    out["tables"] = []
    for t in d.tables:
        entry: dict = {"name": t.name, **_texts(t.node, ("label", "description", "details", "todo", "origin"))}
        if t.source is not None:
            entry["source"] = {"parquet": t.source}
        if rows and t.name in rows:
            entry["rows"] = rows[t.name]
        entry["columns"] = [c for c in (column_json(d, t, c, (c.name,), (profiles or {}).get(t.name, {})) for c in t.columns) if c]
        if t.assertions:
            entry["constraints"] = [assertion_json(a, t) for a in t.assertions]
        if t.definitions:
            entry["definitions"] = [definition_json(x, t) for x in t.definitions]
        out["tables"].append(entry)
    if d.relationships:
        out["relationships"] = [{**_texts(r.node, ("description", "todo")), **normalized(r)} for r in d.relationships]
    glossary = doc.get("glossary")
    if glossary:
        out["glossary"] = [{"term": k, "definition": prose(v.data)} for k, (_, v) in glossary.data.items()]
    return out


def profile_json(p: Profile, c: Column | None = None) -> dict:
    """The export's form of a profile; restricted columns give counts only, enums no samples."""
    out: dict = {}
    if p.supported and p.distinct is not None:
        out["distinct"] = {"count": p.distinct, "approximate": p.approximate}
    if p.nulls is not None:
        out["missing"] = p.nulls
    if not p.supported or c is not None and c.restricted:
        return out
    declared = c is not None and c.values is not None
    if p.samples and not declared:
        out["sample_values"] = [scalar(v) for v in p.samples]
    if p.kind in ("text", "boolean"):
        if p.top:
            out["common_values"] = {"approximate": p.approximate, "values": [{"value": scalar(v), "count": n, **({"error": e} if e else {})} for v, n, e in p.top]}
        return out
    if p.low is not None:
        out["range"] = {"min": scalar(p.low), "max": scalar(p.high)}
    if p.bins or p.nans or p.negative_infinities or p.positive_infinities:
        shape: dict = {"bins": [{"min": scalar(b.low), "max": scalar(b.high), "count": b.count, "closed": b.closed} for b in p.bins]}
        shape |= {k: n for k, n in (("nan_count", p.nans), ("negative_infinity_count", p.negative_infinities), ("positive_infinity_count", p.positive_infinities)) if n}
        out["histogram"] = shape
    return out


def profile_table(df: DataFrame, t: Table, bins: int = EXPORT_BINS, footers: Footers | None = None) -> dict[str, dict]:
    """Profiles of declared columns by dotted name; fields below lists are profiled per element.

    Footers, where given, tell the ranges of histograms before the pass.
    """
    flat: dict[str, tuple] = {}
    nested: dict[str, tuple] = {}
    lists: dict[str, object] = {}

    def visit(c: Column, path: tuple[str, ...], steps: list) -> None:
        depth, inner = c.element
        name = ".".join(path)
        if len(path) > 1 and depth and inner != "struct":
            return
        if inner == "struct":
            if depth and len(path) == 1:
                lists[name] = column_ref(path)
            for f in c.fields:
                visit(f, (*path, f.name), [*steps, *[None] * depth, f.name])
        elif depth:
            lists[name] = column_ref(path)
        elif None in steps:
            nested[name] = (c, steps)
        elif c.type is not None:
            flat[name] = (c, column_ref(path))

    for c in t.columns:
        if c.name in df.columns:
            visit(c, (c.name,), [])
    out: dict[str, dict] = {}
    chosen = {n: col for n, (_, col) in flat.items()} | lists
    if chosen:
        shown = {n for n, (c, _) in flat.items() if not c.restricted}
        for n, p in profile(df, chosen, bins, shown, footer_ranges(footers, flat), footers.rows if footers else None).items():
            out[n] = profile_json(p, flat[n][0] if n in flat else None)
    for n, (c, steps) in nested.items():
        elements, x = element_column(df, column_ref((n.split(".")[0],)), steps)
        out[n] = profile_json(profile(elements, {n: x}, bins, set() if c.restricted else {n})[n], c)
    return out


def export_data(spark: SparkSession, d: Dictionary, bins: int = EXPORT_BINS, tables: set[str] | None = None) -> dict:
    """The dictionary with profiles of the tables that have a source (of those in ``tables``, if given)."""
    profiles, rows = {}, {}
    for t in d.tables:
        if t.source is not None and (tables is None or t.name in tables):
            df, footers = read_table(spark, d.source_path(t)), read_footers(spark, d.source_path(t))
            rows[t.name] = footers.rows if footers else df.count()
            profiles[t.name] = profile_table(df, t, bins, footers)
    return export_spec(d, profiles, rows)


def to_json(value, indent: int | None = 2) -> str:
    return json.dumps(value, indent=indent, ensure_ascii=False, default=scalar)


# ------------------------------------------------------------------- describe

_CELLS = " ▏▎▍▌▋▊▉█"


def whole_profile(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, Profile], int]:
    """A table, the profiles of all its columns and its number of rows."""
    df, footers = read_table(spark, path), read_footers(spark, path)
    names = [c for c in df.columns if c not in (FILE, IN_FILE)]
    found = profile(df, {c: column_ref((c,)) for c in names}, DESCRIBE_BINS, None, footer_ranges(footers, names), footers.rows if footers else None)
    return df, found, footers.rows if footers else df.count()


def describe(spark: SparkSession, path: str) -> dict:
    """All columns of a Parquet table, profiled."""
    df, found, rows = whole_profile(spark, path)
    return {"rows": rows, "columns": [{"name": n, "type": df.schema[n].dataType.simpleString(), **profile_json(p)} for n, p in found.items()]}


def bar(n: int, most: int, width: int = 20) -> str:
    """A bar in eighths of a cell."""
    eighths = round(8 * width * n / most) if most else 0
    return "█" * (eighths // 8) + (_CELLS[eighths % 8] if eighths % 8 else "")


def describe_text(described: dict) -> str:
    lines = [f"{described['rows']} rows"]
    for c in described["columns"]:
        lines.append(f"\n{c['name']} <{c['type']}>  missing {c.get('missing', '?')}" + (f"  distinct {'~' if c['distinct']['approximate'] else ''}{c['distinct']['count']}" if "distinct" in c else ""))
        bins = c.get("histogram", {}).get("bins", [])
        most = max((b["count"] for b in bins), default=0)
        lines += [f"  {b['min']} – {b['max']}  {bar(b['count'], most)} {b['count']}" for b in bins]
        common = c.get("common_values", {}).get("values", [])
        most = max((v["count"] for v in common), default=0)
        lines += [f"  {v['value']}  {bar(v['count'], most)} {v['count']}" for v in common[:10]]
    return "\n".join(lines)


# ---------------------------------------------------------------------- draft

ENUM_VALUES = 12


def draft_column(name: str, data_type: str, p: Profile) -> list[str]:
    """YAML lines of a drafted column; what only a person can know is left as a todo."""
    quote = lambda v: json.dumps(scalar(v), ensure_ascii=False) if isinstance(v, str) else json.dumps(scalar(v))
    plain = name if re.fullmatch(r"[A-Za-z_][\w ]*", name) else json.dumps(name)
    lines = [f"- name: {plain}"]
    n = p.rows - (p.nulls or 0)
    all_distinct = p.distinct is not None and n and (p.distinct == n if not p.approximate else abs(p.distinct - n) <= 0.02 * n)
    like_id = re.search(r"(?:^id|_id|key|_code)$", name.lower()) is not None
    if p.kind == "text" and p.distinct is not None and not p.approximate and 0 < p.distinct <= ENUM_VALUES and 2 * p.distinct < n:
        lines += ["  type: enum", f"  values: [{', '.join(quote(v) for v in sorted(v for v, *_ in p.top))}]"]
    elif p.kind == "text":
        lines += ["  type: string", f"  examples: [{', '.join(quote(v) for v in p.samples[:3])}]"]
    elif p.kind == "boolean":
        lines.append("  type: boolean")
    elif p.kind in ("integer", "float"):
        kind = "number(id)" if like_id and p.kind == "integer" else "number"
        lines += [f"  type: {kind}", f"  examples: [{', '.join(quote(v) for v in p.samples[:3])}]"]
    elif p.kind in ("date", "datetime"):
        if p.kind == "datetime":
            lines += ["  type: datetime", f"  time_zone: {'naive' if data_type == 'timestamp_ntz' else 'UTC'}"]
        else:
            lines.append("  type: date")
        if p.low is not None:
            lines.append(f"  range: ['{scalar(p.low)}', '{scalar(p.high)}']")
    lines.append("  todo: describe this column" if p.supported else "  todo: give this column a type")
    constraints = []
    if all_distinct and p.kind in ("integer", "text"):
        constraints.append("primary_key" if like_id and not p.nulls else "unique")
    if not p.nulls and p.supported and "primary_key" not in constraints:
        constraints.append("required")
    if constraints:
        lines.append(f"  constraints: [{', '.join(constraints)}]")
    return lines


def draft_table(spark: SparkSession, name: str, path: str) -> str:
    """A drafted table, as the lines of a list entry."""
    df, found, _ = whole_profile(spark, path)
    lines = [f"- name: {name}", "  source:", f"    parquet: {path}", "  todo: describe this table", "  columns:"]
    for c, p in found.items():
        lines += ["    " + x for x in draft_column(c, df.schema[c].dataType.simpleString(), p)]
    return "\n".join(lines) + "\n"


def draft(spark: SparkSession, tables: dict[str, str], existing: str | None = None) -> str:
    """A new dictionary of Parquet tables by name, or ``existing`` with the tables it lacks appended; its own bytes stay as they are."""
    if existing is None:
        head = '$version: "0.1.0"\n$learn_more: https://example.org/contracts\ntables:\n'
        return head + "".join(_indent(draft_table(spark, n, p)) for n, p in tables.items())
    d, problems = source.load_text(existing)
    if d is None:
        raise Invalid(problems)
    new = {n: p for n, p in tables.items() if d.table(n) is None}
    if not new:
        return existing
    listed = d.document.get("tables")
    text = "".join(_indent(draft_table(spark, n, p)) for n, p in new.items())
    if listed is None or not listed.data:
        return existing + ("" if existing.endswith("\n") else "\n") + "tables:\n" + text
    lines = existing.split("\n")
    last = listed.span[2] if listed.span[3] == 0 else listed.span[2] + 1
    indent = len(lines[listed.span[0]]) - len(lines[listed.span[0]].lstrip())
    body = "".join((" " * indent + x if x else "") + "\n" for x in text.replace("\n  ", "\n").removeprefix("  ").rstrip("\n").split("\n"))
    return "\n".join(lines[:last]) + "\n" + body + "\n".join(lines[last:])


def _indent(text: str) -> str:
    return "".join("  " + x + "\n" for x in text.rstrip("\n").split("\n"))


__all__ = ["describe", "describe_text", "draft", "export_data", "export_spec", "profile_json", "to_json"]
