"""Evaluation of all assertions of a table in few passes.

One aggregate pass folds every aggregate of every assertion; its single row is
joined (by broadcast: it is one row) for the row pass, which counts violations
and finds first faults of all row-level assertions at once; other checks of
rows can share it. A single count of distinct values shares the first pass;
several share one pass of their own, with one shuffle for all of them, since
beside them every other aggregate's input would be multiplied too.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checking, compiling
from ..functions.compiling import BAD_PATTERN, Compiled, Unreadable
from ..sources.parquet import ROW


@dataclass
class Prepared:
    """An assertion ready to run: its instances (one per selected column), or why it can't run."""

    typed: checking.Typed
    instances: list[checking.Typed]
    barrier: Unreadable | None = None

    @property
    def by_row(self) -> bool:
        return self.typed.shape == checking.ROW


@dataclass
class Verdict:
    outcome: str  # holds, violated, false, overflow, bad_pattern, unreadable
    count: int = 0
    row: int | None = None
    barrier: Unreadable | None = None


@dataclass
class Folded:
    """Aggregates of one table: frames of one row each, and how nodes read them."""

    frames: list[DataFrame] = field(default_factory=list)
    values: dict[int, Compiled] = field(default_factory=dict)

    def onto(self, df: DataFrame) -> DataFrame:
        for f in self.frames:
            df = df.crossJoin(F.broadcast(f))  # exactly one row
        return df

    def alone(self, spark) -> DataFrame:
        """One row with the aggregates."""
        return self.onto(spark.sql("SELECT * FROM VALUES (1) AS t(__one__)"))

    def settled(self, spark) -> Folded:
        """The aggregates computed, as literals: passes that use them do not compute them again."""
        if not self.frames:
            return self
        frame = self.alone(spark)
        row, types = frame.first(), {f.name: f.dataType for f in frame.schema.fields}
        fixed = {n: F.lit(row[n]).cast(t) for n, t in types.items()}
        return Folded([], {k: Compiled(fixed[f"__v{i}"], c.kind, None if c.fault is None else fixed[f"__f{i}"]) for i, (k, c) in enumerate(self.values.items())})


def prepare(typed: checking.Typed, scope: checking.Scope, schema: T.StructType, now: dt.datetime) -> Prepared:
    """Check that every column the expression computes with can be read."""
    each = checking.instances(typed, scope)
    out = Prepared(typed, each)
    try:
        for one in each:
            for node in compiling.aggregate_nodes(one.tree):
                compiling.fold(node, schema, now)
            placeholder = {id(n): Compiled(F.lit(None), "null") for n in compiling.aggregate_nodes(one.tree)}
            compiling.compile_row(one, schema, now, placeholder)
    except Unreadable as e:
        out.barrier = e
    return out


def fold_all(df: DataFrame, prepared: list[Prepared], now: dt.datetime) -> Folded:
    out, expressions, distinct = Folded(), [], []
    nodes = [n for p in prepared if p.barrier is None for one in p.instances for n in compiling.aggregate_nodes(one.tree)]
    folds = [compiling.fold(n, df.schema, now) for n in nodes]
    alone = sum(f.distinct is not None for f in folds) == 1
    for node, f in zip(nodes, folds, strict=True):
        k = len(out.values)
        if f.distinct is None:
            expressions.append(f.value.alias(f"__v{k}"))
        elif alone:  # one distinct count shares the pass with the other aggregates
            expressions.append(F.count_distinct(f.distinct).alias(f"__v{k}"))
        else:
            distinct.append(F.count_distinct(f.distinct).alias(f"__v{k}"))
        fault = None
        if f.fault is not None:
            expressions.append(F.coalesce(f.fault, F.lit(0)).alias(f"__f{k}"))
            fault = F.col(f"__f{k}")
        out.values[id(node)] = Compiled(F.col(f"__v{k}"), f.kind, fault)
    out.frames += [df.agg(*e) for e in (distinct, expressions) if e]
    return out


@dataclass
class Judged:
    """The columns that decide one row-level assertion."""

    violated: Column
    fault: Column


def judge(p: Prepared, schema: T.StructType, now: dt.datetime, folded: Folded) -> Judged:
    """A row breaks an assertion if any instance is false and no earlier one failed to compute."""
    violated, fault = F.lit(False), F.lit(0)
    for one in reversed(p.instances):
        c = compiling.compile_row(one, schema, now, folded.values)
        value = c.value.cast("boolean")
        false = F.coalesce(~value, F.lit(False))
        own = F.lit(0) if c.fault is None else F.coalesce(c.fault, F.lit(0))
        violated = F.when(own != 0, F.lit(False)).otherwise(false | violated)
        fault = F.when(own != 0, own).when(false, F.lit(0)).otherwise(fault)
    return Judged(violated, fault)


#: Blocks of rows that a table is divided into to find where a check first fails.
BLOCKS, BLOCK_ROWS = 10_000, 1 << 16


def evaluate(df: DataFrame, prepared: list[Prepared], now: dt.datetime, others: list[list[Column]] = (), rows: int = 0, shown: int = 5) -> tuple[list[Verdict], Folded, list[Judged | None], list[tuple[list[int], list[int]]], int]:
    """Verdicts in order; ``df`` has ``ROW`` if anything is checked by row. Two jobs for any number of assertions.

    ``others`` are other checks that share the row pass: for each its sums, the
    last of which counts the rows that fail. Returned as well: for the others
    and then the assertions, (sums, the first blocks of rows that have
    ``shown`` failing ones), and the rows of a block. A table of about ``rows`` rows has at most
    ``BLOCKS`` blocks, so that what is gathered of a check is bounded.
    """
    folded = fold_all(df, prepared, now).settled(df.sparkSession)
    judged = [judge(p, df.schema, now, folded) if p.barrier is None else None for p in prepared]
    by_row = [k for k, p in enumerate(prepared) if p.barrier is None and p.by_row]
    alone = [k for k, p in enumerate(prepared) if p.barrier is None and not p.by_row]
    verdicts = [Verdict("unreadable", barrier=p.barrier) if p.barrier else Verdict("holds") for p in prepared]
    size = max(BLOCK_ROWS, -(-rows // BLOCKS))
    sums = [list(o) for o in others] + [[F.count_if(judged[k].violated)] for k in by_row]
    located = {}
    if sums:
        faults = [F.min(F.when(judged[k].fault != 0, F.struct(F.col(ROW), judged[k].fault.alias("fault")))).alias(f"f{k}") for k in by_row]
        names = [[f"n{i}_{j}" for j in range(len(x))] for i, x in enumerate(sums)]
        counted = [m.alias(n) for x, y in zip(sums, names, strict=True) for m, n in zip(x, y, strict=True)]
        blocks = (folded.onto(df) if by_row else df).groupBy(F.floor((F.col(ROW) - 1) / size).alias("block")).agg(*counted, *faults)
        first = [F.slice(F.sort_array(F.collect_list(F.when(F.col(y[-1]) > 0, F.struct("block", F.col(y[-1]).alias("n"))))), 1, shown).alias(f"b{i}") for i, y in enumerate(names)]
        found = blocks.agg(*[F.sum(n).alias(n) for y in names for n in y], *[F.min(f"f{k}").alias(f"f{k}") for k in by_row], *first).first()
        for i, y in enumerate(names):
            located[i] = ([found[n] or 0 for n in y], _enough(found[f"b{i}"] or [], shown))
        for i, k in enumerate(by_row, len(others)):
            if found[f"f{k}"] is not None:
                row, fault = found[f"f{k}"]
                verdicts[k] = Verdict("bad_pattern" if fault == BAD_PATTERN else "overflow", row=row)
            elif located[i][0][0]:
                verdicts[k] = Verdict("violated", located[i][0][0])
    if alone:
        found = folded.alone(df.sparkSession).select(*[x for k in alone for x in (judged[k].violated.alias(f"n{k}"), judged[k].fault.alias(f"f{k}"))]).first()
        for k in alone:
            if found[f"f{k}"]:
                verdicts[k] = Verdict("bad_pattern" if found[f"f{k}"] == BAD_PATTERN else "overflow")
            elif found[f"n{k}"]:
                verdicts[k] = Verdict("false")
    places = {k: i for i, k in enumerate(by_row, len(others))}
    told = [located[i] for i in range(len(others))] + [located[places[k]] if k in places else ([0], []) for k in range(len(prepared))]
    return verdicts, folded, judged, told, size


def _enough(blocks: list, rows: int) -> list[int]:
    """The first of sorted (block, failing rows) that hold ``rows`` failing ones."""
    out = []
    for block, n in blocks:
        if rows <= 0:
            break
        out.append(block)
        rows -= n
    return out
