"""Footers of all files of a table: rows, schemas and column statistics, without reading a page.

Footers are read in tasks, a task taking its share of the file list, and put
together by one aggregate: what comes to the driver is a row per column and a
row per distinct schema, however many files there are. Tables of few files are
read right here instead, since starting tasks would take longer.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Footers of up to so many files are read by the driver itself.
DRIVER_FILES = 16
#: Files that one task reads the footers of, about, and tasks at most.
TASK_FILES, TASKS = 32, 4096
#: So many distinct schemas of one table are told apart; the number of all is known.
SHAPES = 64

_ROW = "kind string, name string, file string, files long, rows long, groups long, nulls long, unknown_nulls long, distinct_values long, low double, high double, low_long long, high_long long, unknown_range long, words double"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]


@dataclass
class Leaf:
    """A column or field as it is stored."""

    name: str
    type: str  # a dictionary type, or what it is if it has none
    comparable: bool = True
    reason: str | None = None
    readable: bool = True
    children: list[Leaf] = field(default_factory=list)
    stored: str = ""  # the stored type, as Arrow names it
    physical: str = ""  # that of the pages, and its annotation
    annotation: str = ""

    def child(self, name: str) -> Leaf | None:
        return next((c for c in self.children if c.name == name), None)

    def label(self) -> str:
        if self.type == "list":
            return f"list({self.children[0].label()})" if self.children else "list"
        return self.type

    def described(self) -> str:
        """The dictionary type with what is stored, as in ``number (INT64)`` or ``string (BYTE_ARRAY, JSON)``."""
        parts = [p for p in (self.physical, self.annotation) if p]
        return f"{self.label()} ({', '.join(parts)})" if parts else self.label()


@dataclass(frozen=True)
class FooterStats:
    rows: int
    nulls: int | None
    distinct: int | None  # known only if one row group covers the table
    low: object = None  # exact extremes of numbers, in the stored unit; None if a row group lacks them
    high: object = None
    words: float | None = None  # of 64 whole numbers each: how many the row groups' own ranges have together, or their rows


@dataclass
class Shape:
    """A schema that files of the table have: the first of them, and how many."""

    tree: list[Leaf]
    file: str
    files: int


@dataclass
class Footers:
    rows: int
    files: int
    columns: dict[str, FooterStats]
    shapes: list[Shape]  # by their first files
    unread: str | None = None  # why a file's footer can't be read


def file_names(spark: SparkSession, path: str) -> list[str]:
    """The table's files in path order, from the listing that a scan makes anyway."""
    return sorted(spark.read.schema("nothing int").parquet(path).inputFiles())


def open_file(name: str):
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(name)
    return pq.ParquetFile(system.open_input_file(at))


def tree_of(file) -> list[Leaf]:
    """The columns of an open file, with their dictionary types and annotations."""
    annotations = {}
    for k in range(len(file.schema)):
        c = file.schema.column(k)
        annotations[c.path] = (c.logical_type.type, c.physical_type, c.converted_type)
    return [_from_arrow(f.name, f.type, f.name, annotations) for f in file.schema_arrow]


def _from_arrow(name: str, kind, path: str, annotations: dict) -> Leaf:
    import pyarrow as pa

    logical, physical, converted = annotations.get(path, ("NONE", "", "NONE"))
    annotation = next((x for x in (logical, converted) if x != "NONE"), "")
    leaf = lambda *a, **k: Leaf(name, *a, **k, stored=str(kind), physical=physical, annotation=annotation)
    if pa.types.is_struct(kind):
        return leaf("struct", False, "structs are not compared", children=[_from_arrow(f.name, f.type, f"{path}.{f.name}", annotations) for f in kind])
    if pa.types.is_map(kind):
        return leaf("map", False, "maps are not compared")
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        inner = next((f"{path}.list.{e}" for e in ("element", "item") if any(p.startswith(f"{path}.list.{e}") for p in annotations)), path)
        return leaf("list", False, "lists are not compared", children=[_from_arrow("element", kind.value_type, inner, annotations)])
    what = next((x for x in (logical, converted) if x in ("JSON", "BSON")), None)
    if what:
        return leaf("string", False, f"{what} values can't be compared by their bytes")
    if logical in ("UNKNOWN", "NULL") or pa.types.is_null(kind):
        return leaf("unknown", False, "the logical type is unknown")
    if pa.types.is_uint64(kind) or pa.types.is_time(kind):
        return leaf("number", readable=False)
    if pa.types.is_integer(kind) or pa.types.is_floating(kind):
        return leaf("number")
    if pa.types.is_decimal(kind):
        return leaf("number", readable=kind.precision <= 15)
    simple = ((pa.types.is_boolean, "boolean"), (pa.types.is_date, "date"), (pa.types.is_timestamp, "datetime"))
    return leaf(next((t for test, t in simple if test(kind)), "string"))


def tree_text(tree: list[Leaf]) -> str:
    plain = lambda x: {**x.__dict__, "children": [plain(c) for c in x.children]}
    return json.dumps([plain(x) for x in tree], sort_keys=True)


def tree_from(text: str) -> list[Leaf]:
    made = lambda d: Leaf(**{**d, "children": [made(c) for c in d["children"]]})
    return [made(d) for d in json.loads(text)]


def _range_of(statistics, kind) -> tuple | None:
    """Exact extremes of a row group's numbers; None if the footer does not tell them."""
    import pyarrow as pa

    if statistics is None or not statistics.has_min_max:
        return None
    plain = pa.types.is_signed_integer(kind) or pa.types.is_floating(kind) and not pa.types.is_float16(kind)
    if not (plain or pa.types.is_date32(kind) or pa.types.is_timestamp(kind) and kind.unit == "us"):
        return None
    low, high = statistics.min_raw, statistics.max_raw
    good = low <= high and (isinstance(low, int) or abs(low) != float("inf") != abs(high))  # NaN compares as false
    return (low, high) if good else None


def footer_rows(names: Iterable[str]) -> Iterator[tuple]:
    """Rows (``_FIELDS``) that tell of the files ``names``: one per schema, one per top-level column, combined."""
    shapes: dict[str, list] = {}
    columns: dict[str, list] = {}
    unread: tuple[str, str] | None = None
    for name in names:
        try:
            file = open_file(name)
            tree = tree_text(tree_of(file))
            meta, schema = file.metadata, file.schema_arrow
        except Exception as e:  # noqa: BLE001 - no Parquet, or a store that only Spark reads
            unread = min(unread or (name, ""), (name, str(e).split("\n")[0][:300]))
            continue
        seen = shapes.setdefault(tree, [name, 0, 0, 0])
        seen[0] = min(seen[0], name)
        seen[1], seen[2], seen[3] = seen[1] + 1, seen[2] + meta.num_rows, seen[3] + meta.num_row_groups
        for top, leaves, flat in _leaves(schema, file.schema):
            c = columns.setdefault(top, [0, 0, 0, 0, None, None, 0, 0, None, 0.0])
            c[0], c[1], c[2] = c[0] + 1, c[1] + meta.num_rows, c[2] + meta.num_row_groups
            for g in range(meta.num_row_groups):
                group = meta.row_group(g)
                chunks = [group.column(k) for k in leaves]
                nulls = [0 if file.schema.column(k).max_definition_level == 0 else x.statistics.null_count if x.statistics is not None and x.statistics.has_null_count else None for k, x in zip(leaves, chunks, strict=True)]
                known = None not in nulls and (flat or not sum(nulls))  # below a nested column, a null may be of any level
                c[3] += sum(nulls) if known else 0
                c[6] += not known
                if flat:
                    s = chunks[0].statistics
                    if s is not None and s.has_distinct_count:
                        c[8] = (c[8] or 0) + s.distinct_count
                    if known and sum(nulls) == group.num_rows:
                        continue  # no values, no range
                    found = _range_of(s, schema.field(top).type)
                    if found is None:
                        c[7] += 1
                    else:
                        c[9] += min(group.num_rows, (found[1] - found[0]) / 64 + 1)
                        c[4], c[5] = (found if c[4] is None else (min(c[4], found[0]), max(c[5], found[1])))
                else:
                    c[7] += 1
    if unread is not None:
        yield ("unread", unread[1], unread[0], *[0] * 6, None, None, None, None, 0, 0.0)
    for tree, (first, files, rows, groups) in shapes.items():
        yield ("shape", tree, first, files, rows, groups, 0, 0, None, None, None, None, None, 0, 0.0)
    for top, (files, rows, groups, nulls, low, high, no_nulls, no_range, distinct, words) in columns.items():
        whole = isinstance(low, int)
        yield ("column", top, None, files, rows, groups, nulls, no_nulls, distinct, None if whole else low, None if whole else high, low if whole else None, high if whole else None, no_range, words)


def _leaves(arrow, parquet) -> Iterator[tuple[str, list[int], bool]]:
    """(name, numbers of its stored columns, whether it is one flat column) of each top-level column."""
    paths = [parquet.column(k).path for k in range(len(parquet))]
    at = 0
    for f in arrow:
        end = at + 1
        flat = paths[at] == f.name
        while not flat and end < len(paths) and paths[end].startswith(f.name + "."):
            end += 1
        yield f.name, list(range(at, end)), flat
        at = end


def _combined(rows: DataFrame) -> DataFrame:
    total = [F.sum(c).alias(c) for c in ("files", "rows", "groups", "nulls", "unknown_nulls", "distinct_values", "unknown_range", "words")]
    ends = [f(c).alias(c) for f, cs in ((F.min, ("file", "low", "low_long")), (F.max, ("high", "high_long"))) for c in cs]
    return rows.groupBy("kind", "name").agg(*total, *ends)


def read_footers(spark: SparkSession, path: str, driver_files: int = DRIVER_FILES) -> Footers | None:
    """What the footers of all files tell; None if they can't be opened from outside Spark.

    Raises what listing the files raises.
    """
    names = file_names(spark, path)
    if not names:
        return None
    if len(names) <= driver_files:
        found = [dict(zip(_FIELDS, r, strict=True)) for r in footer_rows(names)]
    else:
        files = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k long, name string")
        spread = files.repartitionByRange(min(TASKS, -(-len(names) // TASK_FILES)), "k").select("name")

        def run(batches):
            import pyarrow as pa

            listed = (n for b in batches for n in b.column(0).to_pylist())
            found = list(footer_rows(listed))
            if found:
                yield pa.Table.from_pylist([dict(zip(_FIELDS, r, strict=True)) for r in found], schema=_arrow_row()).to_batches()[0]

        everything = _combined(spread.mapInArrow(run, _ROW))
        first = everything.where("kind = 'column'").unionAll(everything.where("kind <> 'column'").orderBy(F.desc("kind"), "file").limit(SHAPES))
        found = [r.asDict() for r in first.collect()]
    return _put_together(found, len(names))


def _arrow_row():
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split() for f in _ROW.split(", "))])


def _put_together(found: list[dict], files: int) -> Footers | None:
    shapes = sorted((r for r in found if r["kind"] == "shape"), key=lambda r: r["file"])
    bad = sorted((r["file"], r["name"]) for r in found if r["kind"] == "unread")
    if not shapes:
        return None
    columns = {}
    for r in found:
        if r["kind"] != "column":
            continue
        everywhere = r["files"] == files and not bad
        low, high = (r["low_long"], r["high_long"]) if r["low_long"] is not None else (r["low"], r["high"])
        mixed = r["low_long"] is not None and r["low"] is not None
        ranged = everywhere and not r["unknown_range"] and not mixed
        columns[r["name"]] = FooterStats(
            r["rows"], r["nulls"] if everywhere and not r["unknown_nulls"] else None, r["distinct_values"] if everywhere and r["groups"] == 1 else None,
            low if ranged else None, high if ranged else None, r["words"] if ranged else None,
        )
    whole = [Shape(tree_from(r["name"]), r["file"], r["files"]) for r in shapes]
    return Footers(sum(r["rows"] for r in shapes), files, columns, whole, f"{bad[0][0]}: {bad[0][1]}" if bad else None)
