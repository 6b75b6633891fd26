"""Texts of the verbs ``spec``, ``skill-read`` and ``skill-create``: the format of a dictionary as this engine checks it, and how to work with one.

The lists of types, functions and codes come from the modules that define them.
"""

from __future__ import annotations

from ..functions import checking
from . import spec_checks, validate

_SPEC = """# Data dictionaries

A dictionary is a YAML file, `data-dict.yaml` by convention, with the keys `$version`, `$learn_more` and `tables`,
and optionally `name`, `label`, `description`, `details`, `version`, `origin`, `relationships`, `glossary` and `todo`.

## Tables

`name` and `columns` are needed. `source: {{parquet: path}}` names the data, relative to the dictionary's own folder. `constraints` lists
rules of the whole table (`- assert: expression`), `definitions` names expressions that rules and readers use.

## Columns

`name` and `type` are needed. Types: {types}, and `list(...)` of each.

* `description`, `details`, `label`: what it means; `todo`: what is still to be found out.
* `constraints`: `primary_key`, `foreign_key`, `unique`, `required`, and rules (`assert: expression`).
* `values`: what an `enum` may hold. `range`: the least and the greatest value. `examples`: some values. `units`, `time_zone`.
* `fields`: the columns of a `struct`, or of the structs of a list.
* `display: restricted`: no value of the column is ever shown.

## Expressions

Columns by name (nested ones with dots, odd names in double quotes), numbers, 'texts', TRUE, FALSE, NULL; `+ - * / %`, `= <> < <= > >=`,
`BETWEEN`, `IN`, `LIKE`, `SIMILAR TO`, `IS NULL`, `NOT`, `AND`, `OR`, `CASE WHEN ... THEN ... ELSE ... END`. A rule that is null holds.
`COLUMNS('pattern')` and `COLUMNS(a, b)` stand for several columns, each of which is tested.

Functions: {functions}.

## Relationships

`join` is `one.column = other.column`, or bounds such as `a.day >= b.start AND a.day <= b.end`; `cardinality` is `one-to-one`,
`one-to-many` or `many-to-one`, read from left to right. `aliases` names the sides where one table occurs twice.

## Checks

`validate-spec` looks at the dictionary, `validate-meta` at the stored columns of all files too, `validate-data` at all rows too:

{codes}
"""

_READ = """# Reading a data dictionary

1. Look for `data-dict.yaml` beside the data. `export-spec` gives it resolved as JSON, `render` as a page; `export-data` adds profiles.
2. Read the table's description, then the columns you need. A column's `type` tells more than how it is stored: numbers that are ids
   are not added up, enums hold only their `values`, `units` and `time_zone` say what a number or time means.
3. Join tables as `relationships` say, and mind the cardinality: the side that is many multiplies the rows of the other.
4. Use `definitions` for metrics and filters instead of inventing your own; `translate` spells them in another language.
5. Do not show values of columns with `display: restricted`. A `todo` marks what nobody has confirmed yet.
6. Before you trust data, run `validate-data`: an error names the rule, how many rows break it, and the first of them.
"""

_CREATE = """# Writing a data dictionary

1. `draft NAME=PATH ...` profiles Parquet tables and writes a beginning: types, ranges, examples, and a `todo` for what only people know.
2. Work through the todos with someone who knows the data. Describe what a row is, then each column: its meaning, not its name again.
3. Choose types by use: ids and codes are no quantities. List the `values` of columns with few texts as an `enum`.
4. Mark keys (`primary_key`, `foreign_key`, `unique`) and `required` columns; write what else must hold as `assert` rules.
5. Write `relationships` between the tables, and put words that insiders use into the `glossary`.
6. Set `display: restricted` on anything personal; give invented `examples` there.
7. Run `validate-spec`, `validate-meta` and `validate-data` after each change, and keep the dictionary with the data.
"""


def spec() -> str:
    kinds = "\n".join(f"* `{code}`: {kind.replace('_', ' ')}" for code, kind in sorted(validate.KINDS.items()) if " " not in code)
    return _SPEC.format(types=", ".join(f"`{t}`" for t in spec_checks.SCALAR_TYPES), functions=", ".join(f"`{f}`" for f in function_names()), codes=kinds)


def function_names() -> list[str]:
    """The functions and aggregates that the checker knows."""
    return sorted({*checking.SCALAR_FUNCTIONS, *checking.AGGREGATES})


TEXTS = {"spec": spec, "skill-read": lambda: _READ, "skill-create": lambda: _CREATE}
