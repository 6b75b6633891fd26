"""``python -m pactum VERB``: the engine from a command line. Exit code 1 on errors; warnings pass."""

from __future__ import annotations

import argparse
import sys


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pactum", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for level in ("spec", "meta", "data"):
        v = verbs.add_parser(f"validate-{level}", help=f"validate a dictionary at level {level}")
        v.add_argument("dictionary", nargs="?")
        v.add_argument("--table")
        v.add_argument("--json", action="store_true", help="write the report document")
    for level in ("spec", "data"):
        v = verbs.add_parser(f"export-{level}", help="the resolved dictionary as JSON")
        v.add_argument("dictionary", nargs="?")
    v = verbs.add_parser("describe", help="profile a Parquet table")
    v.add_argument("parquet")
    v.add_argument("--json", action="store_true")
    v = verbs.add_parser("draft", help="draft a dictionary of Parquet tables")
    v.add_argument("tables", nargs="+", metavar="NAME=PATH")
    v.add_argument("--append-to", help="a dictionary to add missing tables to")
    v = verbs.add_parser("render", help="the dictionary as one HTML page, with profiles of the data that is there")
    v.add_argument("dictionary", nargs="?")
    v.add_argument("--output", help="where to write; standard output without it")
    for verb, what in (("spec", "the format of a dictionary"), ("skill-read", "how to read one"), ("skill-create", "how to write one")):
        verbs.add_parser(verb, help=f"print {what}")
    v = verbs.add_parser("translate", help="assertions in other languages")
    v.add_argument("dictionary", nargs="?")
    v.add_argument("--table")
    v.add_argument("--to", action="append", help="a target or family; may be repeated")
    v.add_argument("--expr", help="one expression instead of the assertions")
    return p


def loaded(path: str | None):
    from .plans.export import Invalid
    from .plans.spec_checks import check_spec
    from .sources.dictionary import load

    d, problems = load(path)
    problems = [p for p in [*problems, *(check_spec(d) if d else ())] if p.severity == "error"]
    if problems:
        raise Invalid(problems)
    return d


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    from .plans import export, translate
    from .plans.validate import validate

    try:
        if a.verb.startswith("validate-"):
            level = a.verb.removeprefix("validate-")
            run = validate(None if level == "spec" else session(), a.dictionary, level, a.table)
            if a.json:
                print(run.to_json())
            else:
                for p in run.problems:
                    at = f" (line {p.location[0] + 1}, column {p.location[1] + 1})" if p.location else ""
                    print(f"{p.severity}[{p.code}] {p.table or ''}{'.' if p.table and p.columns else ''}{', '.join(p.columns)}: {p.message}{at}")
                print(f"{run.status}: {len(run.problems)} problem(s), {sum(s.outcome == 'pass' for s in run.steps)} of {len(run.steps)} steps passed")
            return int(run.status == "error")
        if a.verb == "export-spec":
            print(export.to_json(export.export_spec(loaded(a.dictionary))))
        elif a.verb == "export-data":
            print(export.to_json(export.export_data(session(), loaded(a.dictionary))))
        elif a.verb in ("spec", "skill-read", "skill-create"):
            from .plans.guide import TEXTS

            print(TEXTS[a.verb](), end="")
        elif a.verb == "render":
            from .plans.page import render

            text = render(session, loaded(a.dictionary))
            if a.output:
                with open(a.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                print(text, end="")
        elif a.verb == "describe":
            found = export.describe(session(), a.parquet)
            print(export.to_json(found) if a.json else export.describe_text(found))
        elif a.verb == "draft":
            existing = None
            if a.append_to:
                with open(a.append_to, encoding="utf-8") as f:
                    existing = f.read()
            print(export.draft(session(), dict(t.split("=", 1) for t in a.tables), existing), end="")
        else:
            d = loaded(a.dictionary)
            if a.expr is None:
                print(export.to_json(translate.translate_all(d, a.to, a.table)))
            else:
                table = d.table(a.table) if a.table else d.tables[0]
                print(export.to_json([translate.translate(a.expr, table, a.to, boolean=False)]))
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
