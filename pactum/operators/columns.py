"""Null and membership checks of columns, flat or nested, as aggregate expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..sources.parquet import ROW


def count_where(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).cast("long")


def outside(value: Column, allowed: list[str]) -> Column:
    """Not null and not among ``allowed``; plain string equality."""
    text = value.cast("string")
    return text.isNotNull() & ~text.isin(allowed) if allowed else text.isNotNull()


def reach(column: Column, steps: list) -> Column:
    """Follow ``steps``: a field name goes into a struct, ``None`` through a list; the result is an array of all values reached if any list is crossed."""
    crossed = False
    for step in steps:
        if step is None:
            column = F.flatten(column) if crossed else column
            crossed = True
        elif crossed:
            column = F.transform(column, _field(step))
        else:
            column = column.getField(step)
    return column


def _field(name: str):
    return lambda x: x.getField(name)


def outside_values(column: Column, steps: list, allowed: list[str]) -> Column:
    """How many values under ``column`` are outside ``allowed``, per row."""
    if None not in steps:
        return F.when(outside(reach(column, steps), allowed), 1).otherwise(0).cast("long")
    held = reach(column, steps)
    return F.coalesce(F.size(F.filter(_no_null_lists(held), lambda x: outside(x, allowed))), F.lit(0)).cast("long")


def _no_null_lists(held: Column) -> Column:
    return F.coalesce(held, F.array().cast("array<string>"))


def outside_sample(column: Column, steps: list, allowed: list[str]) -> Column:
    """The first offending value of a row."""
    if None not in steps:
        return reach(column, steps).cast("string")
    return F.filter(_no_null_lists(reach(column, steps)), lambda x: outside(x, allowed)).getItem(0)


def first_rows(df: DataFrame, condition: Column, carry: list[Column], limit: int) -> DataFrame:
    """The first offending rows by number: TakeOrdered, no full sort."""
    return df.where(condition).select(F.col(ROW), *carry).orderBy(ROW).limit(limit)


def first_rows_each(df: DataFrame, checks: list[tuple[Column, list[Column], list[int]]], limit: int, block: int) -> list[list[Row]]:
    """For each (condition, columns to show, blocks of ``block`` rows to look in): its first offending rows by number, with ``ROW`` and the columns as ``v0``, ``v1``, ...

    One pass for all checks, of which only rows of the blocks go on. Each task
    keeps the first ``limit`` rows of a check before anything is shuffled.
    """
    if not checks:
        return []
    names = [[f"c{k}_{i}" for i in range(len(carry))] for k, (_, carry, _) in enumerate(checks)]
    types = {n: f.dataType for n, f in zip([n for row in names for n in row], df.select(*[c for _, carry, _ in checks for c in carry]).schema.fields, strict=True)}
    found = []
    at = F.floor((F.col(ROW) - 1) / block)
    for k, (condition, carry, blocks) in enumerate(checks):
        own = dict(zip(names[k], carry, strict=True))
        values = [own.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in types.items()]
        found.append(F.when(at.isin(blocks) & condition, F.struct(F.lit(k).alias("k"), *values)))
    each = df.where(at.isin(sorted({b for *_, blocks in checks for b in blocks}))).select(F.col(ROW), F.explode(F.array_compact(F.array(*found))).alias("x")).select(ROW, "x.*")
    first = each.withColumn("at", F.row_number().over(Window.partitionBy("k").orderBy(ROW))).where(F.col("at") <= limit)
    out: list[list[Row]] = [[] for _ in checks]
    for r in sorted(first.collect(), key=lambda r: r["at"]):  # limit rows a check
        out[r["k"]].append(Row(**{ROW: r[ROW]}, **{f"v{i}": r[n] for i, n in enumerate(names[r["k"]])}))
    return out
