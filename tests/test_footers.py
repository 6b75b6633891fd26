"""Footers of many files, schemas that differ between files, and scans by Arrow."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pactum.plans.validate import validate
from pactum.sources.footers import DRIVER_FILES, Leaf, read_footers
from pactum.sources.parquet import FILE, arrow_table, narrowed, with_rows

HEAD = '$version: "0.1.0"\n$learn_more: https://example.org\ntables:\n'


def write(folder, tables, **how):
    folder.mkdir()
    for k, t in enumerate(tables):
        pq.write_table(t, folder / f"part-{k:04}.parquet", **how)
    return str(folder)


def check(spark, tmp_path, columns, level="data"):
    text = HEAD + "  - name: t\n    source: {parquet: t}\n    columns:\n" + "".join(f"      - {c}\n" for c in columns)
    return validate(spark, str(tmp_path / "d.yaml"), level, text=text)


ID = "{name: id, type: number, examples: [1], constraints: [required, unique]}"
X = "{name: x, type: number, examples: [1.5]}"


def plain(k, **more):
    return pa.table({"id": pa.array([2 * k, 2 * k + 1], pa.int64()), "x": pa.array([0.5, None]), **more})


def test_footers_are_put_together_from_all_files(spark, tmp_path):
    path = write(tmp_path / "t", [plain(k) for k in range(40)])
    assert 40 > DRIVER_FILES
    for found in (read_footers(spark, path), read_footers(spark, path, driver_files=100)):
        assert (found.rows, found.files, found.unread, len(found.shapes), found.shapes[0].files) == (80, 40, None, 1, 40)
        assert (found.columns["id"].nulls, found.columns["id"].low, found.columns["id"].high) == (0, 0, 79)
        assert (found.columns["x"].nulls, found.columns["x"].low, found.columns["x"].high, found.columns["x"].distinct) == (40, 0.5, 0.5, None)


def test_a_file_without_statistics_leaves_a_column_unknown(spark, tmp_path):
    path = write(tmp_path / "t", [plain(k) for k in range(3)])
    pq.write_table(plain(9), f"{path}/part-0009.parquet", write_statistics=["id"])
    found = read_footers(spark, path).columns
    assert found["x"].nulls is None and found["x"].low is None and found["id"].nulls == 0 and found["id"].high == 19


def test_one_deviating_file_of_two_hundred_is_reported(spark, tmp_path):
    tables = [plain(k) for k in range(200)]
    tables[137] = pa.table({"id": pa.array(["a", "b"]), "x": [0.5, 1.0]})
    write(tmp_path / "t", tables)
    r = check(spark, tmp_path, [ID, X], "meta")
    assert [(p.code, p.columns) for p in r.problems] == [("M01", ("id",))] and "part-0137" in r.problems[0].message
    assert {s.columns: s.outcome for s in r.steps if s.code == "M01"} == {("id",): "fail", ("x",): "pass"}
    r = check(spark, tmp_path, [ID, X])
    assert [(p.code, p.columns) for p in r.problems] == [("M01", ("id",))]  # and no scan of what can't be read as one


def test_many_files_settle_required_columns_without_a_scan(spark, tmp_path, monkeypatch):
    from pactum.plans import validate as module

    write(tmp_path / "t", [plain(k) for k in range(100)])
    monkeypatch.setattr(module.columns, "count_where", None)  # must not be asked
    r = check(spark, tmp_path, [ID, X])
    assert r.status == "ok" and {s.code: s.rows for s in r.steps}["D01"] == 200


def test_schemas_that_one_type_reads_and_schemas_that_none_does(spark, tmp_path):
    wide = pa.table({"id": pa.array([10, 11], pa.int32()), "x": pa.array([1.5, 2.5], pa.float32())})
    write(tmp_path / "t", [plain(0), wide, pa.table({"id": pa.array([10], pa.int64()), "x": [1.0], "extra": [1]})])
    r = check(spark, tmp_path, [ID, X])
    assert [(p.code, p.columns, dict(p.extra).get("rows")) for p in r.problems] == [("M03", ("extra",), None), ("D02", ("id",), [5])]
    pq.write_table(pa.table({"id": [20.5], "x": [1.0]}), tmp_path / "t" / "part-0003.parquet")
    r = check(spark, tmp_path, [ID, X])
    assert [p.code for p in r.problems] == ["M05"] and "double" in r.problems[0].message
    pq.write_table(pa.table({"x": [1.0]}), tmp_path / "t" / "part-0003.parquet")
    assert [(p.code, p.columns) for p in check(spark, tmp_path, [ID, X], "meta").problems] == [("M03", ("extra",)), ("M02", ("id",))]


def test_a_file_that_is_no_parquet_is_named(spark, tmp_path):
    write(tmp_path / "t", [plain(0)])
    (tmp_path / "t" / "part-0001.parquet").write_bytes(b"no parquet at all")
    r = check(spark, tmp_path, [ID, X], "meta")
    assert [p.code for p in r.problems] == ["M05"]


def refused(n):
    return pa.table({
        "id": pa.array(range(n), pa.int64()),
        "half": pa.array([k / 2 for k in range(n)], pa.float16()),
        "deep": pa.array([{"h": None if k % 5 == 0 else k / 4, "at": [dt.time(0, 0, k % 60), None] if k % 3 else None} if k % 7 else None for k in range(n)], pa.struct([("h", pa.float16()), ("at", pa.list_(pa.time32("ms")))])),
        "seen": pa.array([k * 1000 for k in range(n)], pa.timestamp("ns")),
    })


def test_a_task_per_row_group_and_only_the_columns_asked_for(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "t", [refused(40), refused(20)], row_group_size=10)
    df = arrow_table(spark, path)
    assert df.rdd.getNumPartitions() == 6
    numbered = with_rows(df, ["id"])
    assert [r["__row__"] for r in numbered.orderBy("__row__").collect()] == list(range(1, 61))
    assert [r["id"] for r in numbered.orderBy("__row__").collect()] == [*range(40), *range(20)]
    assert set(narrowed(df, ["id"]).columns) == {"id", FILE, "__in_file__"} and narrowed(df, ["id"]).count() == 60


def test_nested_types_that_spark_refuses_are_read(spark, tmp_path):
    path = write(tmp_path / "t", [refused(30)], row_group_size=7)
    rows = {r["id"]: r for r in arrow_table(spark, path).collect()}
    assert rows[0]["deep"] is None and rows[7]["deep"] is None and rows[1]["deep"]["h"] == 0.25 and rows[5]["deep"]["h"] is None
    assert rows[1]["deep"]["at"] == [1000, None] and rows[3]["deep"]["at"] is None and rows[2]["half"] == 1.0
    column = "{name: deep, type: struct, fields: [{name: h, type: number, examples: [1.5]}, {name: at, type: list(number), examples: [[1]]}], constraints: [required]}"
    r = check(spark, tmp_path, ["{name: id, type: number, examples: [1], constraints: [{assert: deep.h < 5}]}", column])
    found = [(p.code, dict(p.extra).get("rows")) for p in r.problems if p.code != "M03"]
    assert found == [("D01", [1, 8, 15, 22, 29]), ("D07", [23, 24, 25, 27, 28])]


@pytest.mark.parametrize(("kind", "told"), [(pa.int64(), "number (INT64)"), (pa.string(), "string (BYTE_ARRAY, STRING)"), (pa.timestamp("us"), "datetime (INT64, TIMESTAMP)"), (pa.list_(pa.date32()), "list(date)")])
def test_types_are_told_with_what_is_stored(spark, tmp_path, kind, told):
    path = write(tmp_path / "t", [pa.table({"c": pa.array([], kind)})])
    (leaf,) = read_footers(spark, path).shapes[0].tree
    assert isinstance(leaf, Leaf) and leaf.described() == told
