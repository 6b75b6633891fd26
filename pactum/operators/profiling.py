"""Profiles of columns, however many, in one pass over the table; in two where no footer tells the range of a histogram.

Tasks summarise their rows (:mod:`.sketches`), a task and column sending one
summary of bounded size; summaries of one column are merged as they stream
through a task, and only the merged ones come to the driver.

* Frequent values have a count and an error; both are exact up to
  ``EXACT_DISTINCT`` distinct values, and so is the distinct count. Where
  ``exact_top`` asks for it, columns of which summaries dropped values are
  counted once more, by a shuffle of each task's distinct values.
* Samples are spread over at most ``SAMPLE_POOL`` distinct values, those with
  the least hashes.
* Histograms have right-closed bins of equal width (whole-number width for whole
  numbers), as many as the number of rows asks for. Ranges that the footers of
  all files tell exactly (``ranges``) let them join the first pass.
"""

from __future__ import annotations

import datetime as dt
import pickle
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sketches import POOL as SAMPLE_POOL
from .sketches import TRACKED as EXACT_DISTINCT
from .sketches import Bins, Summary

TOP_VALUES = 20
SAMPLES = 20
#: Beyond so many files, summaries are merged in two steps.
MERGED_AT_ONCE = 256
#: Kinds that are laid out in bins.
BINNED = ("integer", "float", "date", "datetime")


@dataclass
class Bin:
    low: object
    high: object
    count: int
    closed: str


@dataclass
class Profile:
    kind: str  # boolean, integer, float, text, date, datetime, or the reason why it is not summarised
    supported: bool
    rows: int
    nulls: int | None
    low: object = None
    high: object = None
    distinct: int | None = None
    approximate: bool = False
    top: list[tuple[object, int, int]] = field(default_factory=list)  # value, count, error
    samples: list = field(default_factory=list)
    bins: list[Bin] = field(default_factory=list)
    nans: int = 0
    negative_infinities: int = 0
    positive_infinities: int = 0


def kind_of(data_type: T.DataType) -> tuple[str, bool]:
    if isinstance(data_type, T.BooleanType):
        return "boolean", True
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer", True
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "float", True
    if isinstance(data_type, T.StringType):
        return "text", True
    if isinstance(data_type, T.DateType):
        return "date", True
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return "datetime", True
    if isinstance(data_type, T.DecimalType):
        return "decimal", False
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        return "nested", False
    return "binary", False


def bin_count(n: int, most: int) -> int:
    """The cube root of twice the rows (Terrell and Scott's rule), between 5 and ``most``."""
    return max(5, min(most, round((2 * n) ** (1 / 3) if n else 0)))


def unscale(kind: str, x):
    """A summarised number as the value it stands for."""
    if kind == "boolean":
        return bool(x)
    if kind == "date":
        return dt.date(1970, 1, 1) + dt.timedelta(days=int(x))
    if kind == "datetime":
        return dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(x))
    return x


def layout(kind: str, low, high, n: int, most: int) -> tuple[object, int]:
    """Width and number of bins over [low, high]."""
    if low == high:
        return 0, 1
    bins = bin_count(n, most)
    if kind == "float":
        return (high - low) / bins, bins
    width = max(1, -(-(high - low) // bins))
    return width, -(-(high - low) // width)


def spread(values: list, n: int = SAMPLES) -> list:
    """Up to ``n`` of sorted values, evenly spread, both ends included."""
    if len(values) <= n:
        return list(values)
    last = len(values) - 1
    return [values[round(i * last / (n - 1))] for i in range(n)]


def summaries(df: DataFrame, columns: dict[str, Column], plans: dict[str, tuple]) -> dict[str, Summary]:
    """The summaries of all columns; ``plans`` are the arguments of each :class:`Summary`."""
    names = list(columns)
    known = [c.isNull() if plans[n][0] == "other" else c for n, c in columns.items()]

    def summarise(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = [Summary(*plans[n]) for n in names]
        for batch in batches:
            for summary, column in zip(held, batch.columns, strict=True):
                summary.add(column)
        part = TaskContext.get().partitionId() % MERGED_AT_ONCE
        blobs = [zlib.compress(pickle.dumps(x), 1) for x in held]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([part] * len(held), pa.int32()), pa.array(blobs, pa.binary())], names=["k", "part", "summary"])

    def merge(batches):
        import pyarrow as pa

        held: dict[int, Summary] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                one = pickle.loads(zlib.decompress(blob.as_py()))
                if k in held:
                    held[k].merge(one)
                else:
                    held[k] = one
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([0] * len(held), pa.int32()), pa.array([zlib.compress(pickle.dumps(x), 1) for x in held.values()], pa.binary())], names=["k", "part", "summary"])

    schema = "k int, part int, summary binary"
    parts = df.select(*[c.alias(f"c{k}") for k, c in enumerate(known)]).mapInArrow(summarise, schema)
    if len(df.inputFiles()) > MERGED_AT_ONCE:
        parts = parts.repartition("k", "part").mapInArrow(merge, schema)
    merged = parts.repartition("k").mapInArrow(merge, schema)
    found = {k: pickle.loads(zlib.decompress(blob)) for k, blob in merged.select("k", "summary").collect()}  # one of bounded size per column
    return {n: found.get(k) or Summary(*plans[n]) for k, n in enumerate(names)}


def bins_for(kind: str, low, high, rows: int, most: int) -> Bins:
    width, count = layout(kind, low, high, rows, most)
    return Bins(low, high, width, count)


def profile(df: DataFrame, columns: dict[str, Column], most_bins: int = 20, values: set[str] | None = None, ranges: dict[str, tuple] | None = None, rows: int | None = None, samples: int = SAMPLES, exact_top: bool = False) -> dict[str, Profile]:
    """Profiles by name; ``columns`` are expressions over ``df``.

    ``values`` names the columns whose values may be shown (all by default).
    ``ranges`` are exact extremes as numbers (days, microseconds) and ``rows``
    the number of rows, where they are known before. With ``exact_top`` the
    frequent values have no errors, however many distinct ones there are.
    """
    types = {n: f.dataType for n, f in zip(columns, df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns.values())]).schema.fields, strict=True)}
    shown = set(columns) if values is None else values
    plans: dict[str, tuple] = {}
    for n, kind_type in types.items():
        kind, ok = kind_of(T.StringType() if isinstance(kind_type, T.BinaryType) else kind_type)  # bytes are text if all of them are
        ends = (ranges or {}).get(n)
        bins = bins_for(kind, *ends, rows, most_bins) if ok and n in shown and kind in BINNED and rows is not None and ends is not None else None
        plans[n] = (kind if ok else "other", bins, n in shown)
    found = summaries(df, columns, plans)
    later = {}
    for n, s in found.items():
        if s.kind in BINNED and n in shown and s.low is not None and s.bins is None:
            later[n] = (s.kind, bins_for(s.kind, s.low, s.high, s.rows, most_bins), False, True)
    if later:
        for n, s in summaries(df, {n: columns[n] for n in later}, later).items():
            found[n].bins, found[n].binned = s.bins, s.binned
    out = {n: _finished(s, types[n], n in shown, samples) for n, s in found.items()}
    if exact_top:
        for n, p in out.items():
            if p.top and found[n].frequent.floor:
                p.top = counted_top(df, columns[n], types[n])
    return out


def counted_top(df: DataFrame, column: Column, data_type: T.DataType) -> list[tuple[object, int, int]]:
    """The most frequent values by exact counts, ties by value."""
    instant = isinstance(data_type, T.TimestampType)
    value = F.unix_micros(column) if instant else column.cast("string") if isinstance(data_type, T.BinaryType) else column
    counted = df.select(value.alias("v")).where(F.col("v").isNotNull()).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    found = counted.orderBy(F.desc("n"), "v").limit(TOP_VALUES).collect()
    return [(unscale("datetime", v) if instant else v, n, 0) for v, n in found]


def _finished(s: Summary, data_type: T.DataType, shown: bool, samples: int) -> Profile:
    if s.kind == "other" or s.invalid:
        return Profile("binary" if s.invalid else kind_of(data_type)[0], False, s.rows, s.nulls)
    p = Profile(s.kind, True, s.rows, s.nulls, nans=s.nans, negative_infinities=s.negative, positive_infinities=s.positive)
    value = lambda x: unscale(s.kind, x)
    if s.kind != "boolean" and s.low is not None:
        p.low, p.high = value(s.low), value(s.high)
    if s.kind != "float":
        exact = not s.frequent.floor and len(s.frequent.values) <= EXACT_DISTINCT
        p.distinct, p.approximate = (len(s.frequent.values), False) if exact else (s.registers.estimate(), True)
    if shown:
        p.top = [(value(v), n, e) for v, n, e in s.frequent.top(TOP_VALUES)]
        p.samples = spread([value(v) for v in sorted(s.pool.values.tolist())], samples)
        if s.bins is not None and s.low is not None:
            b = s.bins
            for k, n in enumerate(s.binned.tolist()):
                start, stop = b.low + k * b.width, b.high if k == b.count - 1 else b.low + (k + 1) * b.width
                p.bins.append(Bin(value(start), value(stop), n, "both" if k == 0 else "right"))
    return p


def footer_ranges(footers, names) -> dict[str, tuple]:
    """Of the columns ``names``: extremes that the footers of all files tell exactly."""
    known = {} if footers is None else footers.columns
    return {n: (known[n].low, known[n].high) for n in names if n in known and known[n].low is not None}


def element_column(df: DataFrame, column: Column, steps: list) -> tuple[DataFrame, Column]:
    """The values under a nested column as a frame of one row per element: ``steps`` as in :func:`columns.reach`."""
    out = df.select(column.alias("value"))
    for step in steps:
        if step is None:
            out = out.select(F.explode("value").alias("value"))
        else:
            out = out.select(F.col("value").getField(step).alias("value"))
    return out, F.col("value")
