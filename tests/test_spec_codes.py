"""Every code of the specification's checks, each from the smallest contract that has it, and none from its mended form."""

import pytest

from pactum.plans.spec_checks import check_spec
from pactum.sources.dictionary import load_text

HEAD = '$version: "0.1.0"\n$learn_more: https://example.org\n'
A = "{name: a, type: number(id), examples: [1], constraints: [primary_key]}"
B = "{name: b, type: number(id), examples: [1], constraints: [foreign_key]}"


def tables(*columns, rest="", **more):
    """One table ``t`` of the given columns, and further tables by name."""
    out = "tables:\n"
    for name, held in {"t": columns, **more}.items():
        out += f"  - name: {name}\n    columns:\n" + "".join(f"      - {c}\n" for c in held)
        if name == "t":
            out += rest
    return out


def joined(join="u.b = t.a", cardinality="many-to-one", more="", a=A, b=B):
    return HEAD + tables(a, u=[b]) + f"relationships:\n  - {{join: '{join}', cardinality: {cardinality}{more}}}\n"


def one(column, rest=""):
    return HEAD + tables(column, rest=rest)


def definitions(*pairs):
    return "    definitions:\n" + "".join(f"      - {{name: '{n}', expr: '{e}'}}\n" for n, e in pairs)


NUMBER = "{name: x, type: number(quantity), range: [0, 5]}"
TEXT = "{name: x, type: string, examples: [a]}"
#: code -> (a contract with the problem, one without it)
CASES = {
    "S01": (HEAD + tables(A, u=[B]), joined()),
    "S02": (joined("u.b = w.a"), joined()),
    "S03": (joined("u.zz = t.a"), joined()),
    "S04": (joined("u.b ~ t.a"), joined()),
    "S05": (joined(more=", conflicts: [a]"), joined()),
    "S06": (joined("u.b = t.a", "one-to-one"), joined()),
    "S07": (one("{name: x, type: boolean, examples: [true]}"), one("{name: x, type: boolean}")),
    "S08": (one("{name: x, type: string, examples: [a], units: kg}"), one("{name: x, type: number(quantity), range: [0, 5], units: kg}")),
    "S09": ('$version: "0.1.0"\n' + tables(A), one(A)),
    "S10": (HEAD + tables(A, A), one(A)),
    "S11": (one("{name: '', type: string, examples: [a]}"), one(TEXT)),
    "S12": (one("{name: x, type: number(id), examples: [one]}"), one("{name: x, type: number(id), examples: [1]}")),
    "S13": (one("{name: x, type: number(quantity), range: [5, 1]}"), one(NUMBER)),
    "S14": (one("{name: x, type: string, examples: [a], time_zone: UTC}"), one(TEXT)),
    "S15": (
        one("{name: x, type: datetime, time_zone: Nowhere/Town, range: ['2024-01-01T00:00:00', '2025-01-01T00:00:00']}"),
        one("{name: x, type: datetime, time_zone: Europe/Berlin, range: ['2024-01-01T00:00:00', '2025-01-01T00:00:00']}"),
    ),
    "S16": (HEAD + tables(A).replace("name: t\n", "name: t\n    description: d\n"), HEAD + "description: d\n" + tables(A)),
    "S17": (HEAD + "version: {number: 1.2}\n" + tables(A), HEAD + "version: {number: 1.2.3}\n" + tables(A)),
    "S18": ("$learn_more: https://example.org\n" + tables(A), one(A)),
    "S19": (one(NUMBER, "    constraints:\n      - {assert: 'x >'}\n"), one(NUMBER, "    constraints:\n      - {assert: 'x > 1'}\n")),
    "S20": (one(NUMBER, "    constraints:\n      - {assert: 'y > 1'}\n"), one(NUMBER, "    constraints:\n      - {assert: 'x > 1'}\n")),
    "S21": (one(TEXT, "    constraints:\n      - {assert: 'x > 1'}\n"), one(TEXT, "    constraints:\n      - {assert: \"x > 'a'\"}\n")),
    "S22": (one(NUMBER, "    constraints:\n      - {assert: \"COLUMNS('z.*') > 1\"}\n"), one(NUMBER, "    constraints:\n      - {assert: \"COLUMNS('x.*') > 1\"}\n")),
    "S23": (HEAD + tables("{name: x}", rest="    constraints:\n      - {assert: 'x > 1'}\n"), HEAD + tables("{name: x}", rest="    constraints:\n      - {assert: 'x IS NULL'}\n")),
    "S30": (one(NUMBER, "    constraints:\n      - {assert: 'SUM(MAX(x)) > 1'}\n"), one(NUMBER, "    constraints:\n      - {assert: 'MAX(x) > 1'}\n")),
    "S24": (one("{name: x, type: enum, values: []}"), one("{name: x, type: enum, values: [a]}")),
    "S25": (joined("t.a = t.a"), joined()),
    "S26": (joined("u.b = t.a", more=", aliases: {t: t}"), joined()),
    "S27": (joined("u.b = t.a", more=", aliases: {z: t}"), joined()),
    "S28": (one("{name: x, type: numeral, examples: [1]}"), one(TEXT)),
    "S29": (one("{name: x, type: list(string), examples: [[a]], constraints: [unique]}"), one("{name: x, type: list(string), examples: [[a]]}")),
    "S31": (HEAD + "todo: write it\n" + tables(A), one(A)),
    "S32": ('$version: "9.0.0"\n$learn_more: https://example.org\n' + tables(A), one(A)),
    "S33": (one(NUMBER, definitions(("x", "x > 1"))), one(NUMBER, definitions(("y", "x > 1")))),
    "S34": (one(NUMBER, definitions(("p", "q"), ("q", "p"))), one(NUMBER, definitions(("p", "q"), ("q", "x > 1")))),
    "S60": (HEAD + "tables: [{name: t}]\n", one(A)),
    "S61": (HEAD + "tables: 3\n", one(A)),
    "S62": (joined(cardinality="some-to-some"), joined()),
    "S63": (HEAD + tables(A).replace("name: t\n", "name: t\n    source: {}\n"), HEAD + tables(A).replace("name: t\n", "name: t\n    source: {parquet: t.parquet}\n")),
    "S64": (HEAD + "colour: red\n" + tables(A), one(A)),
    "S65": (HEAD + "description: a\ndescription: b\n" + tables(A), HEAD + "description: a\n" + tables(A)),
    "S69": (one("{name: x, type: number(quantity), range: [1]}"), one(NUMBER)),
}


def codes(text):
    d, problems = load_text(text)
    return {p.code for p in problems} | ({p.code for p in check_spec(d)} if d is not None else set())


@pytest.mark.parametrize("code", sorted(CASES))
def test_code(code):
    bad, good = CASES[code]
    assert code in codes(bad)
    assert code not in codes(good)


def test_mended_forms_are_clean():
    """But for the warning of a contract of one table that has no key, nothing is left."""
    assert {c: codes(good) for c, (_, good) in CASES.items() if codes(good)} == {}


def test_severities_and_places():
    d, problems = load_text(CASES["S13"][0])
    (p,) = [*problems, *check_spec(d)]
    assert (p.severity, p.table, p.columns) == ("error", "t", ("x",)) and p.location is not None
    warnings = {c for c in ("S09", "S16", "S27", "S31") for p in check_spec(load_text(CASES[c][0])[0]) if p.code == c and p.severity == "warning"}
    assert warnings == {"S09", "S16", "S27", "S31"}
