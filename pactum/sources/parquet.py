"""Parquet tables: projected scans with absolute row numbers, and footers.

A scan is ``spark.read.parquet`` with a projection; Spark prunes columns and
splits files. Row numbers are 1-based and run over the table's files in path
order: within a file they come from ``_metadata.row_index``, and the rows of
earlier files are added from one count per file (a scan without columns).

Footers (:mod:`.footers`) are read where Spark's schema says too little:
annotations that it erases (ENUM, JSON, BSON, UUID), unsigned 64-bit integers,
and files whose schemas differ. Tables with half floats, times of day or
nanosecond timestamps, which Spark's reader refuses, are read by Arrow in tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .footers import DRIVER_FILES, TASK_FILES, Footers, FooterStats, Leaf, file_names, open_file, read_footers

ROW = "__row__"
#: Of tables read by Arrow: each row's file, and its number there.
FILE, IN_FILE = "__path__", "__in_file__"
#: Up to so many files (a checked number of rows of about 200 bytes) their first row numbers are broadcast.
BROADCAST_FILES = 100_000


class NotReadable(ValueError):
    """The source can't be read."""


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; columns whose stored types Spark's reader refuses come through Arrow (:func:`arrow_table`)."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - whatever the reader says, the source is unreadable
        found = arrow_table(spark, path) if "PARQUET_TYPE" in str(e) else None
        if found is None:
            raise NotReadable(str(e).split("\n")[0][:300]) from e
        return found


def _readable_type(kind):
    """What a column is read as where Spark's reader refuses its stored type, nested or not; else the type itself."""
    import pyarrow as pa

    if pa.types.is_float16(kind):
        return pa.float32()
    if pa.types.is_time(kind):
        return pa.int64()  # microseconds or nanoseconds of the day, as stored
    if pa.types.is_timestamp(kind) and kind.unit == "ns":
        return pa.timestamp("us", kind.tz)
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, _readable_type(f.type)) for f in kind])
    if pa.types.is_list(kind) or pa.types.is_large_list(kind):
        return pa.list_(_readable_type(kind.value_type))
    if pa.types.is_map(kind):
        return pa.map_(_readable_type(kind.key_type), _readable_type(kind.item_type))
    return kind


def _as_readable(column, kind):
    """An Arrow array as ``kind``, the readable type of its own."""
    import pyarrow as pa

    if column.type == kind:
        return column
    if pa.types.is_struct(kind):
        inner = [_as_readable(column.field(k), f.type) for k, f in enumerate(kind)]
        return pa.StructArray.from_arrays(inner, fields=list(kind), mask=column.is_null())
    if pa.types.is_list(kind):
        at = column.offsets.cast(pa.int32())
        offsets = pa.array([None if gone else n for n, gone in zip(at.to_pylist(), [*column.is_null().to_pylist(), False], strict=True)], pa.int32()) if column.null_count else at
        return pa.ListArray.from_arrays(offsets, _as_readable(column.values, kind.value_type))
    if pa.types.is_map(kind):
        return pa.array(column.to_pylist(), kind)
    if pa.types.is_time32(column.type):
        return column.cast(pa.int32()).cast(kind)
    return column.cast(kind, safe=False) if pa.types.is_timestamp(kind) else column.cast(kind)


#: Tasks of a scan by Arrow, at most.
ARROW_TASKS = 4096


def arrow_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """A table with half floats, times of day or nanosecond timestamps, read by Arrow: a task per row group.

    Half floats become floats, times of day whole numbers, and nanoseconds are
    cut to microseconds, at any depth. Only ``columns`` are decoded
    (:func:`narrowed` chooses them later). Each row has its file and its number
    in it, so row numbers work as for Spark's own scans. None where the files
    can't be opened from here.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import from_arrow_type

    names = file_names(spark, path)
    try:
        schema = open_file(names[0]).schema_arrow
        chosen = [f for f in schema if columns is None or f.name in columns]
        fields = [T.StructField(f.name, from_arrow_type(_readable_type(f.type), prefer_timestamp_ntz=True)) for f in chosen]
    except Exception:  # noqa: BLE001 - a store that only Spark reads
        return None
    held = T.StructType([*fields, T.StructField(FILE, T.StringType()), T.StructField(IN_FILE, T.LongType())])
    wanted = [f.name for f in chosen]

    def split(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                meta, before, rows = open_file(name).metadata, 0, []
                for g in range(meta.num_row_groups):
                    rows.append((name, g, before))
                    before += meta.row_group(g).num_rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["name", "part", "before"])

    def read(batches):
        for batch in batches:
            for name, g, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for rows in open_file(name).iter_batches(8192, row_groups=[g], columns=wanted):
                    cells = [_as_readable(rows.column(rows.schema.get_field_index(n)), _readable_type(rows.schema.field(n).type)) for n in wanted]
                    numbers = pa.array(range(before + 1, before + rows.num_rows + 1), pa.int64())
                    yield pa.RecordBatch.from_arrays([*cells, pa.array([name] * rows.num_rows), numbers], names=held.names)
                    before += rows.num_rows

    if len(names) <= DRIVER_FILES:
        found = [(n, g, sum(m.row_group(i).num_rows for i in range(g))) for n in names for m in [open_file(n).metadata] for g in range(m.num_row_groups)]
        tasks = max(1, min(ARROW_TASKS, len(found)))
        placed = spark.createDataFrame([(*f, k % tasks) for k, f in enumerate(found)], "name string, part long, before long, place int")
    else:  # the row groups are listed in tasks too
        files = spark.createDataFrame([(n,) for n in names], "name string").repartition(min(ARROW_TASKS, -(-len(names) // TASK_FILES)))
        tasks = ARROW_TASKS
        placed = files.mapInArrow(split, "name string, part long, before long").withColumn("place", F.pmod(F.xxhash64("name", "part"), F.lit(tasks)).cast("int"))
    out = placed.repartitionById(tasks, "place").drop("place").mapInArrow(read, held)
    out._arrow_path = path
    return out


def narrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """A table that Arrow reads, with the decoding of ``columns`` only; Spark's own scans are pruned by Spark."""
    path = getattr(df, "_arrow_path", None)
    return df if path is None else arrow_table(df.sparkSession, path, columns)


def with_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of a Parquet frame and their row number in ``ROW``."""
    read_by_arrow = FILE in df.columns
    if read_by_arrow and columns is not None:
        df = narrowed(df, columns)
    chosen = [F.col("`" + c.replace("`", "``") + "`") for c in ([c for c in df.columns if c not in (FILE, IN_FILE)] if columns is None else columns)]
    local = F.col(IN_FILE) if read_by_arrow else F.col("_metadata.row_index").cast("bigint") + 1
    path = F.col(FILE) if read_by_arrow else F.col("_metadata.file_path")
    many = BROADCAST_FILES if read_by_arrow else len(df.inputFiles())  # names that Spark's index of the table has on the driver already
    if many <= 1:
        return df.select(*chosen, local.alias(ROW))
    files = df.groupBy(path.alias("__file__")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__file__").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    starts = files.select(F.col("__file__").alias("__of__"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before__"))
    if many <= BROADCAST_FILES:
        starts = F.broadcast(starts)  # a row per file: the table itself is not shuffled
    placed = df.select(*chosen, local.alias("__local__"), path.alias("__file__"))
    return placed.join(starts, placed["__file__"] == starts["__of__"]).select(*chosen, (F.col("__local__") + F.col("__before__")).alias(ROW))


def unified(spark: SparkSession, path: str, footers: Footers, names: set[str]) -> tuple[DataFrame, list[tuple[str, str, str, str]]]:
    """A table whose files have different schemas: with the columns of all files, whole numbers and floats as wide as the widest.

    Also the conflicts: (column, file, its stored type, the first file's) of the
    columns ``names`` that no one type reads, though their dictionary types agree.
    """
    from pyspark.sql import types as T

    ladders = [[T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()], [T.FloatType(), T.DoubleType()]]
    fields: dict[str, T.StructField] = {}
    first: dict[str, tuple[Leaf, str]] = {}
    conflicts = []
    for shape in footers.shapes:  # bounded: SHAPES
        leaves = {x.name: x for x in shape.tree}
        for f in spark.read.parquet(shape.file).schema.fields:
            seen = fields.get(f.name)
            if seen is None:
                fields[f.name], first[f.name] = f, (leaves[f.name], shape.file)
                continue
            if seen.dataType == f.dataType:
                continue
            ladder = next((x for x in ladders if seen.dataType in x and f.dataType in x), None)
            if ladder is not None:
                fields[f.name] = T.StructField(f.name, max(seen.dataType, f.dataType, key=ladder.index))
            elif f.name in names and first[f.name][0].label() == leaves[f.name].label():
                conflicts.append((f.name, shape.file, leaves[f.name].stored, first[f.name][0].stored))
    return spark.read.schema(T.StructType(list(fields.values()))).parquet(path), conflicts


def column_tree(spark: SparkSession, path: str, footers: Footers | None = None) -> list[Leaf]:
    """The stored columns with their dictionary types; footer annotations where they can be read.

    Of files with different schemas: the columns of all, each as the first file that has it stores it.
    """
    footers = footers or read_footers(spark, path)
    if footers is not None:
        merged: dict[str, Leaf] = {}
        for shape in footers.shapes:
            for leaf in shape.tree:
                merged.setdefault(leaf.name, leaf)
        return list(merged.values())
    return [_from_spark(f.name, f.dataType) for f in read_table(spark, path).schema.fields]


def _from_spark(name: str, kind) -> Leaf:
    from pyspark.sql import types as T

    if isinstance(kind, T.StructType):
        return Leaf(name, "struct", False, "structs are not compared", children=[_from_spark(f.name, f.dataType) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return Leaf(name, "list", False, "lists are not compared", children=[_from_spark("element", kind.elementType)])
    if isinstance(kind, T.MapType):
        return Leaf(name, "map", False, "maps are not compared")
    if isinstance(kind, T.BooleanType):
        return Leaf(name, "boolean")
    if isinstance(kind, T.DateType):
        return Leaf(name, "date")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return Leaf(name, "datetime")
    if isinstance(kind, T.NumericType):
        return Leaf(name, "number", readable=not (isinstance(kind, T.DecimalType) and kind.precision > 15))
    return Leaf(name, "string")


def footer_stats(spark: SparkSession, path: str, column: str) -> FooterStats | None:
    """What the footers of all files say about a column."""
    footers = read_footers(spark, path)
    return None if footers is None else footers.columns.get(column)


def row_count(spark: SparkSession, path: str) -> int:
    """Answered from footers by Spark."""
    return read_table(spark, path).count()
