"""A dictionary as one HTML page that works opened from disk: tables, columns with their profiles, relationships, glossary, a search box.

The page is made of what :mod:`.export` exports, so all that Spark computes for
it is computed there; restricted columns show counts only, as in the export.
"""

from __future__ import annotations

import os
import re
from html import escape

from pyspark.sql import SparkSession

from ..sources.dictionary import Dictionary
from .export import export_data, export_spec

_STYLE = """
body{font:15px/1.5 system-ui,sans-serif;margin:0 auto;max-width:70rem;padding:1rem 2rem;color:#222;background:#fff}
h1,h2,h3{line-height:1.2} h2{border-top:1px solid #ddd;padding-top:1.2rem} code{background:#f3f3f3;padding:0 .25em;border-radius:3px}
table{border-collapse:collapse;width:100%} th,td{text-align:left;vertical-align:top;padding:.4rem .8rem .4rem 0;border-bottom:1px solid #eee}
.bars{display:flex;align-items:flex-end;height:2.5rem;gap:1px;min-width:8rem} .bars i{flex:1;background:#5b8db8;min-height:1px}
.tag{font-size:.8em;border:1px solid #bbb;border-radius:.6em;padding:0 .5em;margin-right:.3em;white-space:nowrap} .dim{color:#666;font-size:.9em}
input{font:inherit;padding:.3rem .6rem;width:20rem;max-width:100%} nav a{margin-right:.8rem} .todo{color:#a04000} [hidden]{display:none}
@media(prefers-color-scheme:dark){body{background:#181818;color:#ddd}code{background:#2a2a2a}th,td,h2{border-color:#333}.dim{color:#999}}
"""
_SEARCH = """
const box=document.getElementById('find');
box.addEventListener('input',()=>{const want=box.value.trim().toLowerCase();
for(const row of document.querySelectorAll('tr[data-find]'))row.hidden=want!==''&&!row.dataset.find.includes(want);
for(const part of document.querySelectorAll('section[data-table]'))part.hidden=want!==''&&!part.dataset.table.includes(want)&&!part.querySelector('tr[data-find]:not([hidden])');});
"""


def _element(tag: str, content: str, **attributes: str) -> str:
    said = "".join(f' {k.rstrip("_").replace("_", "-")}="{escape(str(v), quote=True)}"' for k, v in attributes.items())
    return f"<{tag}{said}>{content}</{tag}>"


def _safe(prose: str) -> str:
    """Exported prose, which is HTML with all raw HTML escaped, without links that are no addresses."""
    return re.sub(r'<a href="(?!https?:|mailto:|#)[^"]*">', "<a>", prose)


def _prose(entry: dict) -> str:
    out = "".join(_safe(entry[k]) for k in ("description", "details") if entry.get(k))
    return out + (_element("div", "To do: " + _safe(entry["todo"]), class_="todo") if entry.get("todo") else "")


def _bars(bins: list[dict]) -> str:
    """A histogram as bars; what a bar stands for is its title."""
    most = max((b["count"] for b in bins), default=0)
    one = lambda b: _element("i", "", style=f"height:{100 * b['count'] / most if most else 0:.1f}%", title=f"{b['min']} to {b['max']}: {b['count']}")
    return _element("div", "".join(map(one, bins)), class_="bars")


def _data(column: dict) -> str:
    """What the profile tells of a column."""
    out = []
    if "distinct" in column:
        out.append(f"{'about ' * column['distinct']['approximate']}{column['distinct']['count']} distinct")
    if "missing" in column:
        out.append(f"{column['missing']} missing")
    if column.get("histogram", {}).get("bins"):
        out.append(_bars(column["histogram"]["bins"]))
    if isinstance(column.get("range"), dict):
        out.append(escape(f"{column['range'].get('min')} – {column['range'].get('max')}"))
    for v in column.get("common_values", {}).get("values", [])[:8]:
        out.append(f"{_element('code', escape(str(v['value'])))} {v['count']}")
    return "<br>".join(out)


def _rule(x: dict) -> str:
    """An assertion, or a definition with its name."""
    name = _element("code", escape(x["name"])) + " = " if "name" in x else ""
    return _element("li", name + _element("code", escape(x["expression"])) + _safe(x.get("description", "")))


def _column_rows(table: str, columns: list[dict], above: str = "") -> str:
    rows = []
    for c in columns:
        name = f"{above}{c['name']}"
        tags = "".join(_element("span", escape(k), class_="tag") for k in c.get("constraints", []))
        listed = _element("p", ", ".join(_element("code", escape(str(v))) for v in c["values"]), class_="dim") if c.get("values") else ""
        listed += _element("ul", "".join(map(_rule, c["assertions"]))) if c.get("assertions") else ""
        rows.append(_element(
            "tr",
            _element("td", _element("code", escape(name))) + _element("td", escape(str(c.get("type", "")))) + _element("td", tags + _prose(c) + listed) + _element("td", _data(c.get("profile", {})), class_="dim"),
            id=f"{table}.{name}", data_find=f"{table}.{name} {c.get('description', '')} {c.get('label', '')}".lower(),
        ))
        rows.append(_column_rows(table, c.get("fields", []), f"{name}."))
    return "".join(rows)


def _table(t: dict) -> str:
    head = _element("h2", escape(t.get("label") or t["name"]) + (_element("span", f" {t['rows']} rows", class_="dim") if "rows" in t else ""))
    rules = "".join(map(_rule, t.get("constraints", [])))
    defined = "".join(map(_rule, t.get("definitions", [])))
    columns = _element("table", _element("tr", "".join(_element("th", h) for h in ("Column", "Type", "Meaning", "Data"))) + _column_rows(t["name"], t["columns"]))
    extra = (_element("h3", "Rules") + _element("ul", rules) if rules else "") + (_element("h3", "Definitions") + _element("ul", defined) if defined else "")
    return _element("section", head + _prose(t) + columns + extra, id=t["name"], data_table=f"{t['name']} {t.get('description', '')}".lower())


def page(exported: dict) -> str:
    """The page of an exported dictionary."""
    title = escape(str(exported.get("label") or exported.get("name") or "Data dictionary"))
    links = _element("nav", "".join(_element("a", escape(t["name"]), href=f"#{t['name']}") for t in exported["tables"]))
    joins = "".join(_element("li", f"{_element('code', escape(str(r.get('join', ''))))} {escape(str(r.get('declared_cardinality', r.get('cardinality', ''))))} {_safe(r.get('description', ''))}") for r in exported.get("relationships", []))
    terms = "".join(_element("dt", escape(str(g["term"]))) + _element("dd", _safe(g["definition"])) for g in exported.get("glossary", []))
    body = (
        _element("h1", title) + _prose(exported) + '<p><input id="find" type="search" placeholder="Find a table or column" aria-label="Find"></p>' + links
        + "".join(map(_table, exported["tables"]))
        + (_element("h2", "Relationships") + _element("ul", joins) if joins else "") + (_element("h2", "Glossary") + _element("dl", terms) if terms else "")
    )
    return f'<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width"><title>{title}</title><style>{_STYLE}</style></head><body>{body}<script>{_SEARCH}</script></body></html>\n'


def render(spark_of, d: Dictionary) -> str:
    """The page of a dictionary; data is profiled into it if the source of at least one table is there.

    ``spark_of`` gives the session; it is called only then.
    """
    present = [t for t in d.tables if t.source is not None and (("://" in (at := d.source_path(t))) or os.path.exists(at))]
    if not present:
        return page(export_spec(d))
    spark: SparkSession = spark_of()
    return page(export_data(spark, d, tables={t.name for t in present}))
