"""Data checks end to end on small Parquet files."""

import datetime as dt
import math

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactum.plans.validate import validate

HEAD = '$version: "0.1.0"\n$learn_more: https://example.org\ntables:\n'


def run(spark, tmp_path, table, columns, constraints="", **more):
    """Write ``table`` (and more tables) and validate it against the given column lines."""
    pq.write_table(table, tmp_path / "t.parquet", row_group_size=3)
    text = HEAD + f"  - name: t\n    source: {{parquet: t.parquet}}\n    columns:\n" + "".join(f"      - {c}\n" for c in columns)
    if constraints:
        text += "    constraints:\n" + "".join(f"      - {{assert: {c!r}}}\n".replace("'", '"') if '"' not in c else c for c in constraints)
    text += more.get("rest", "")
    return validate(spark, str(tmp_path / "contract.yaml"), text=text, now=dt.datetime(2024, 1, 1))


def found(r):
    return [(p.code, p.columns, dict(p.extra)) for p in r.problems if p.severity == "error"]


NUM = "type: number, examples: [1]"


def test_nulls_and_uniqueness(spark, tmp_path):
    t = pa.table({"id": pa.array([1, 2, None, 2, 1, 2], pa.int64()), "x": pa.array([math.nan, 0.0, -0.0, math.nan, None, None], pa.float64())})
    r = run(spark, tmp_path, t, [f"{{name: id, {NUM}, constraints: [required, unique]}}", f"{{name: x, {NUM}, constraints: [unique]}}"])
    assert found(r) == [
        ("D01", ("id",), {"count": 1, "rows": [3]}),
        ("D02", ("id",), {"count": 3, "rows": [4, 5, 6], "values": [{"id": "2"}, {"id": "1"}, {"id": "2"}], "redacted": False}),
        ("D02", ("x",), {"count": 2, "rows": [3, 4], "values": [{"x": "-0.0"}, {"x": "NaN"}], "redacted": False}),
    ]
    steps = {(s.code, s.columns): (s.outcome, s.rows, s.failed) for s in r.steps}
    assert steps[("D01", ("id",))] == ("fail", 6, 1) and steps[("D02", ("id",))] == ("fail", 6, 3)


def test_composite_key_skips_nulls(spark, tmp_path):
    t = pa.table({"a": [1, 1, 1, 2], "b": pa.array(["x", None, "x", "x"])})
    r = run(spark, tmp_path, t, [f"{{name: a, {NUM}, constraints: [primary_key]}}", "{name: b, type: string, examples: [x], constraints: [primary_key]}"])
    assert ("D02", ("a", "b"), {"count": 1, "rows": [3], "values": [{"a": "1", "b": "x"}], "redacted": False}) in found(r)
    assert ("D01", ("b",), {"count": 1, "rows": [2]}) in found(r)


def test_enum_nested_and_restricted(spark, tmp_path):
    kind = pa.struct([("zip", pa.string()), ("country", pa.string())])
    t = pa.table({
        "s": pa.array(["a", "zz", None]), "addr": pa.array([{"zip": "1", "country": "US"}, {"zip": "2", "country": "XX"}, None], kind),
        "tags": pa.array([["a", "b"], ["a", "zz", "yy"], None]), "grid": pa.array([[["a"]], [["a"], ["zz"]], None]),
    })
    r = run(spark, tmp_path, t, [
        "{name: s, type: enum, values: [a, b], display: restricted}",
        "{name: addr, type: struct, fields: [{name: zip, type: string, examples: ['1']}, {name: country, type: enum, values: [US]}]}",
        "{name: tags, type: list(enum), values: [a, b]}", "{name: grid, type: list(list(enum)), values: [a]}",
    ])
    assert found(r) == [
        ("D04", ("s",), {"count": 1, "rows": [2], "values": None, "redacted": True}),
        ("D04", ("addr.country",), {"count": 1, "rows": [2], "values": [{"addr.country": "XX"}], "redacted": False}),
        ("D04", ("tags",), {"count": 2, "rows": [2], "values": [{"tags": "zz"}], "redacted": False}),
        ("D04", ("grid",), {"count": 1, "rows": [2], "values": [{"grid": "zz"}], "redacted": False}),
    ]


def test_assertions(spark, tmp_path):
    t = pa.table({"a": pa.array([1, 0, -7, 5], pa.int64()), "b": pa.array([5, 0, None, 1], pa.int64()), "x": [1.0, math.nan, math.inf, None]})
    rules = ["a > 0", "b / a > 1", "MOD(a, 3) = 2 OR a > -8", "x >= 1", "SUM(a) > 100", "a <= MAX(a)", "a * 9223372036854775807 > 0", "COLUMNS(*) IS NOT NULL", "1 < 2", "COUNT(x) = ROW_COUNT()"]
    text = HEAD + "  - name: t\n    source: {parquet: t.parquet}\n    columns:\n" + "".join(f"      - {{name: {c}, {NUM}}}\n" for c in "abx") + "    constraints:\n" + "".join(f'      - {{assert: "{r}"}}\n' for r in rules)
    pq.write_table(t, tmp_path / "t.parquet")
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    got = {dict(p.extra)["assertion"]: (p.code, dict(p.extra).get("rows"), dict(p.extra).get("row")) for p in r.problems if p.severity == "error"}
    assert got == {
        "a > 0": ("D07", [2, 3], None), "b / a > 1": ("D07", [2, 4], None), "x >= 1": ("D07", [2], None), "SUM(a) > 100": ("D07", None, None),
        "a * 9223372036854775807 > 0": ("D09", None, 3), "COLUMNS(*) IS NOT NULL": ("D07", [3, 4], None), "COUNT(x) = ROW_COUNT()": ("D07", None, None),
    }


def test_empty_table_passes_vacuously(spark, tmp_path):
    t = pa.table({"a": pa.array([], pa.int64())})
    text = HEAD + f"  - name: t\n    source: {{parquet: t.parquet}}\n    columns: [{{name: a, {NUM}, constraints: [primary_key]}}]\n    constraints: [{{assert: SUM(a) > 100}}, {{assert: a > 5}}, {{assert: COUNT(a) = 0}}]\n"
    pq.write_table(t, tmp_path / "t.parquet")
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    assert r.status == "ok" and all(s.outcome == "pass" for s in r.steps)


@pytest.mark.parametrize(
    ("child", "parent", "orphans"),
    [
        (pa.array([1, 9, None], pa.int32()), pa.array([1, 2, 3], pa.int64()), [2]),
        (pa.array(["a", "q", None]), pa.array(["a", "b", "c"]), [2]),
        (pa.array([1.0, math.nan, 2.5]), pa.array([1.0, math.nan, -0.0]), [3]),
        (pa.array(["1", "2", None]), pa.array([1, 2, 3], pa.int64()), [1, 2]),
        (pa.array([dt.date(2020, 1, 1), dt.date(2020, 1, 2), None]), pa.array([dt.date(2020, 1, 1), dt.date(2020, 2, 2), dt.date(2020, 3, 3)]), [2]),
    ],
)
def test_foreign_keys(spark, tmp_path, child, parent, orphans):
    kinds = {pa.int32(): NUM, pa.int64(): NUM, pa.string(): "type: string, examples: [a]", pa.float64(): NUM, pa.date32(): "type: date, range: ['2020-01-01', '2021-01-01']"}
    pq.write_table(pa.table({"k": child}), tmp_path / "c.parquet")
    pq.write_table(pa.table({"id": parent}), tmp_path / "p.parquet")
    text = HEAD + f"  - {{name: c, source: {{parquet: c.parquet}}, columns: [{{name: k, {kinds[child.type]}, constraints: [foreign_key]}}]}}\n  - {{name: p, source: {{parquet: p.parquet}}, columns: [{{name: id, {kinds[parent.type]}, constraints: [primary_key]}}]}}\nrelationships: [{{join: c.k = p.id, cardinality: many-to-one}}]\n"
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    (p,) = [p for p in r.problems if p.code == "D05"]
    assert dict(p.extra)["rows"] == orphans and dict(p.extra)["count"] == len(orphans)


def test_metadata(spark, tmp_path):
    t = pa.table({"a": [1], "n": pa.array([{"x": 1, "y": "b"}]), "extra": ["x"], "l": pa.array([[1]]), "m": pa.array([[("k", 1)]], pa.map_(pa.string(), pa.int64()))})
    r = run(spark, tmp_path, t, [
        "{name: a, type: string, examples: [x]}", "{name: n, type: struct, fields: [{name: x, type: number, examples: [1]}, {name: z, type: string, examples: [x]}]}",
        "{name: gone}", "{name: l, type: list(string), examples: [[x]]}", "{name: m}",
    ])
    got = {(p.code, p.columns) for p in r.problems}
    assert got == {("M01", ("a",)), ("M02", ("n.z",)), ("M03", ("n.y",)), ("M02", ("gone",)), ("M01", ("l",)), ("M03", ("extra",))}


def test_sources(spark, tmp_path):
    text = HEAD + "  - {name: a, columns: [{name: x}]}\n  - {name: b, source: {parquet: none.parquet}, columns: [{name: x, constraints: [required]}]}\n"
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    assert [p.code for p in r.problems] == ["M04", "M05"]
    assert {s.outcome for s in r.steps if s.code != "M04"} == {"unevaluated"}
    assert "row_count" not in r.report()["steps"][0]


def test_unreadable_and_patterns(spark, tmp_path):
    import decimal

    t = pa.table({"a": pa.array([decimal.Decimal(1)], pa.decimal128(38, 0)), "s": ["x"], "p": ["("]})
    r = run(spark, tmp_path, t, ["{name: a, type: number, examples: [1], constraints: [{assert: a > 0}, {assert: a IS NOT NULL}]}", "{name: s, type: string, examples: [x], constraints: [{assert: s SIMILAR TO p}]}", "{name: p, type: string, examples: [x]}"])
    assert [(p.code, dict(p.extra).get("column")) for p in r.problems] == [("D08", "a"), ("D08", None)]


def test_several_files_have_absolute_rows(spark, tmp_path):
    (tmp_path / "t.parquet").mkdir()
    for k in range(3):
        pq.write_table(pa.table({"a": [k * 2, k * 2 + 1]}), tmp_path / "t.parquet" / f"part-{k}.parquet")
    text = HEAD + f"  - {{name: t, source: {{parquet: t.parquet}}, columns: [{{name: a, {NUM}, constraints: [{{assert: a <> 3 AND a <> 4}}]}}]}}\n"
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    assert [dict(p.extra)["rows"] for p in r.problems] == [[4, 5]]


def test_json_is_not_compared(spark, tmp_path):
    notes = pa.array(['{"a":1}', '{"a": 1}'], pa.json_(pa.string()))
    pq.write_table(pa.table({"k": notes}), tmp_path / "c.parquet")
    pq.write_table(pa.table({"id": ["x"]}), tmp_path / "p.parquet")
    kind = "type: string, examples: [x]"
    text = HEAD + f"  - {{name: c, source: {{parquet: c.parquet}}, columns: [{{name: k, {kind}, constraints: [unique, foreign_key]}}]}}\n  - {{name: p, source: {{parquet: p.parquet}}, columns: [{{name: id, {kind}, constraints: [primary_key]}}]}}\nrelationships: [{{join: c.k = p.id, cardinality: many-to-one}}]\n"
    r = validate(spark, str(tmp_path / "d.yaml"), text=text)
    assert [(p.code, p.severity) for p in r.problems] == [("D03", "warning"), ("D06", "warning")]
    assert {s.outcome for s in r.steps if s.code in ("D02", "D05") and s.table == "c"} == {"unevaluated"}


def test_footer_statistics(spark, tmp_path):
    from pactum.sources.parquet import column_tree, footer_stats, row_count

    t = pa.table({"a": pa.array([1, None, 3], pa.uint64()), "d": pa.array([1.5, None, None]), "s": pa.array([{"x": [1]}, None, {"x": None}])})
    pq.write_table(t, tmp_path / "t.parquet")
    path = str(tmp_path / "t.parquet")
    assert (footer_stats(spark, path, "d").rows, footer_stats(spark, path, "d").nulls) == (3, 2)
    assert row_count(spark, path) == 3
    a, d, s = column_tree(spark, path)
    assert (a.type, a.readable, d.readable) == ("number", False, True)
    assert s.child("x").label() == "list(number)"


def test_types_that_spark_refuses_are_read_by_arrow(spark, tmp_path):
    """Half floats, times of day and nanoseconds: other columns are checked as ever, and these by their values."""
    t = pa.table({
        "id": pa.array([1, 2, 2, 4], pa.int64()),
        "half": pa.array([0.0, -0.0, 1.5, None], pa.float16()),
        "at": pa.array([1000, 2000, 1000, 3000], pa.time32("ms")),
        "seen": pa.array([1, 2_000, 3_000, 4_000], pa.timestamp("ns")),
    })
    r = run(spark, tmp_path, t, [
        f"{{name: id, {NUM}, constraints: [unique]}}", f"{{name: half, {NUM}, constraints: [required, unique, {{assert: half < 1}}]}}",
        f"{{name: at, {NUM}, constraints: [unique]}}", "{name: seen, type: datetime, range: [1969-01-01T00:00:00Z, 2030-01-01T00:00:00Z], constraints: [unique]}",
    ])
    assert [(p.code, p.columns, dict(p.extra).get("rows")) for p in r.problems if p.severity == "error"] == [
        ("D01", ("half",), [4]), ("D02", ("id",), [3]), ("D02", ("half",), [2]), ("D02", ("at",), [3]), ("D07", ("half",), [3]),
    ]
    assert not [p for p in r.problems if p.code == "M05"]


def test_patterns_from_rows_obey_the_rules_of_literal_ones(spark, tmp_path):
    """A look-ahead or a back reference in the data is a malformed pattern, as in a contract."""
    columns = ["{name: s, type: string, examples: [x], constraints: [{assert: s SIMILAR TO p}]}", "{name: p, type: string, examples: [x]}"]
    for bad in ("(?=a)a", "(a)\\1", "a++", "a(?<=a)"):
        t = pa.table({"s": ["a", "b", None, "aa"], "p": ["a", "[bc]", "x", bad]})
        assert [(p.code, dict(p.extra)["reason"]) for p in run(spark, tmp_path, t, columns).problems] == [("D08", "row 4 holds a malformed pattern")]
    t = pa.table({"s": ["a", "b", None, "aa", "a\nb", "é"], "p": ["a", "[bc]", "x", "a+", "a.b", "\\w"]})
    assert found(run(spark, tmp_path, t, columns)) == [("D07", ("s", "p"), {"assertion": "s SIMILAR TO p", "count": 2, "rows": [5, 6], "values": [{"s": "a\nb", "p": "a.b"}, {"s": "é", "p": "\\w"}], "redacted": False})]


def test_footers_settle_what_they_can(spark, tmp_path, monkeypatch):
    """Columns without nulls need no scan; nulls are located by one; statistics that are absent say nothing."""
    from pactum.plans import validate as module
    from pactum.sources.footers import Footers, FooterStats, read_footers
    from pactum.sources.parquet import footer_stats

    t = pa.table({"id": [1, 2, 3, 4], "x": pa.array([1, None, 3, None], pa.int64())})
    columns = [f"{{name: id, {NUM}, constraints: [required, unique]}}", f"{{name: x, {NUM}, constraints: [required]}}"]
    scanned = []
    monkeypatch.setattr(module.columns, "count_where", lambda c, real=module.columns.count_where: scanned.append(c) or real(c))
    assert found(run(spark, tmp_path, t, columns)) == [("D01", ("x",), {"count": 2, "rows": [2, 4]})] and len(scanned) == 1
    path = str(tmp_path / "t.parquet")
    assert read_footers(spark, path).columns["x"] == read_footers(spark, path, driver_files=0).columns["x"] == FooterStats(4, 2, None, 1, 3, pytest.approx(1.03, abs=0.01))
    pq.write_table(t, path, write_statistics=False)
    assert footer_stats(spark, path, "x").nulls is None
    # one row group whose writer gives distinct counts
    shapes = read_footers(spark, path).shapes
    monkeypatch.setattr(module, "read_footers", lambda *_: Footers(4, 1, {"id": FooterStats(4, 0, 4), "x": FooterStats(4, 2, 2)}, shapes))
    monkeypatch.setattr(module.keys, "duplicate_count", None)  # must not be asked
    assert found(run(spark, tmp_path, t, columns)) == [("D01", ("x",), {"count": 2, "rows": [2, 4]})]


def test_the_session_keeps_its_time_zone(spark, tmp_path):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        run(spark, tmp_path, pa.table({"id": [1]}), [f"{{name: id, {NUM}}}"])
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
