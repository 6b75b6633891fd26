"""Uniqueness and referential integrity at scale.

Both start from aggregates that combine before the shuffle. Duplicates are
counted as the sum of ``count - 1`` over keys; rows are located only for keys
that really repeat. Spark's grouping and joins already use the identity order
of values (all NaNs one value, both zeros one value).

Whole numbers and dates that lie densely are counted as bits instead: a key is
one bit of a word of 64, words are combined by OR before the shuffle, and what
is shuffled is two bits a key instead of the key. One pass over the keys
before finds whether they are dense enough (:class:`Dense`); composite keys are
when the product of their ranges is. References compare the words of both
sides, and only children with bits that the parent lacks are ever joined.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.parquet import ROW


def _known(keys: list[Column]) -> Column:
    out = keys[0].isNotNull()
    for k in keys[1:]:
        out = out & k.isNotNull()
    return out


def repeated_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Keys that occur more than once, with ``n`` and the first row; nulls take no part."""
    names = [f"k{i}" for i in range(len(keys))]
    held = df.where(_known(keys)).select(*[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col(ROW))
    return held.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first")).where("n > 1")


#: Keys are counted as bits if the tasks would send at most this many words a key.
WORDS_A_KEY = 0.25
_WORD, _BITS = "__word__", "__bits__"


@dataclass
class Dense:
    """Whole-numbered keys as one number from 0 on: each part's least value, and its range."""

    low: list[int]
    size: list[int]

    def index(self, keys: list[Column]) -> Column:
        parts, stride = [], 1
        for k, low, size in reversed(list(zip(keys, self.low, self.size, strict=True))):
            parts.append((k - F.lit(low).cast("long")) * F.lit(stride).cast("long"))
            stride *= size
        return reduce(add, reversed(parts))

    def within(self, keys: list[Column]) -> Column:
        """Whether a key is in the ranges: others have no number."""
        out = F.lit(True)
        for k, low, size in zip(keys, self.low, self.size, strict=True):
            out = out & k.between(F.lit(low).cast("long"), F.lit(low + size - 1).cast("long"))
        return out


def whole(df: DataFrame, keys: list[Column]) -> list[Column] | None:
    """The keys as longs; None if one of them is neither a whole number nor a date."""
    out = []
    for k, f in zip(keys, df.select(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).schema.fields, strict=True):
        if isinstance(f.dataType, _INTEGERS):
            out.append(k.cast("long"))
        elif isinstance(f.dataType, T.DateType):
            out.append(F.unix_date(k).cast("long"))
        else:
            return None
    return out


@dataclass(frozen=True)
class Known:
    """What is known of a whole-numbered key before any pass: its extremes, its rows and the words that tasks would send."""

    low: int
    high: int
    rows: int
    words: float


def known_range(footers, name: str) -> Known | None:
    """What the footers of all files tell of a whole-numbered column."""
    s = None if footers is None else footers.columns.get(name)
    if s is None or s.words is None or not (isinstance(s.low, int) and isinstance(s.high, int)):
        return None
    return Known(s.low, s.high, s.rows, s.words)


def _settled(low: list[int], high: list[int], rows: int, words: float) -> Dense | None:
    size, total = [b - a + 1 for a, b in zip(low, high, strict=True)], 1
    for x in size:
        total *= x
    few = min(words, rows) <= WORDS_A_KEY * rows + 100_000
    return Dense(low, size) if rows and few and total < 1 << 62 else None


def dense(df: DataFrame, keys: list[Column], known: list[Known | None] = ()) -> Dense | None:
    """Whether whole-numbered keys are dense: by what is ``known`` of all of them, or by one pass that sends a row a task.

    A task sends at most as many words as its keys' own range has, whatever the
    table's, so keys that are clustered in files count as dense however sparse
    the whole is, and keys that are in random order only if all tasks together
    send few. (Of composite keys this is an estimate: a task never sends more
    words than keys.)
    """
    if len(known) == len(keys) and None not in known:
        words = known[0].words
        for k in known[1:]:
            words *= k.high - k.low + 1
        return _settled([k.low for k in known], [k.high for k in known], known[0].rows, words)
    n, ends = len(keys), [x for i, k in enumerate(keys) for x in (F.min(k).alias(f"l{i}"), F.max(k).alias(f"h{i}"))]
    tasks = df.where(_known(keys)).groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n"), *ends)
    span = F.lit(1.0)
    for i in range(n):
        span = span * (F.col(f"h{i}").cast("double") - F.col(f"l{i}") + 1)
    words = F.sum(F.least(F.col("n").cast("double"), span / 64 + 1))
    found = tasks.agg(F.sum("n").alias("n"), words.alias("words"), *[F.min(f"l{i}").alias(f"l{i}") for i in range(n)], *[F.max(f"h{i}").alias(f"h{i}") for i in range(n)]).first()
    if not found["n"]:
        return None
    return _settled([found[f"l{i}"] for i in range(n)], [found[f"h{i}"] for i in range(n)], found["n"], found["words"])


def _bit(index: Column) -> Column:
    """The bit of a key's number in its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), index.bitwiseAND(F.lit(63)).cast("int"))


def duplicate_count(df: DataFrame, keys: list[Column], known: list[Known | None] = ()) -> DataFrame:
    """One row: how many rows repeat a key that an earlier row has.

    Only the keys are shuffled, or their bits, without row numbers: rows are
    located later, and only where the count is not 0.
    """
    numbers = whole(df, keys)
    shape = dense(df, numbers, known) if numbers is not None else None
    if shape is not None:
        held = df.where(_known(numbers)).select(shape.index(numbers).alias("i"))
        counted = held.groupBy(F.shiftright("i", 6).alias(_WORD)).agg(F.bit_or(_bit(F.col("i"))).alias(_BITS), F.count(F.lit(1)).alias("n"))
        return counted.agg(F.coalesce(F.sum(F.col("n") - F.bit_count(_BITS)), F.lit(0)).cast("long").alias("duplicates"))
    names = [f"k{i}" for i in range(len(keys))]
    counted = df.where(_known(keys)).select(*[k.alias(n) for k, n in zip(keys, names, strict=True)]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    return counted.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def duplicate_rows(df: DataFrame, keys: list[Column], carry: list[Column]) -> DataFrame:
    """The repeat occurrences (not the first) with ``carry`` and ``ROW``.

    Only rows of repeated keys are joined; none is sorted by key.
    """
    names = [f"k{i}" for i in range(len(keys))]
    again = repeated_keys(df, keys)
    held = df.where(_known(keys)).select(*carry, *[k.alias(n) for k, n in zip(keys, names, strict=True)], F.col(ROW))
    condition = [held[n].eqNullSafe(again[n]) for n in names]
    joined = held.join(again.select(*names, "first"), condition[0] if len(condition) == 1 else [c for c in condition])
    return joined.where(held[ROW] > again["first"]).select(*[held[c] for c in held.columns if c not in names])


# ----------------------------------------------------------------- foreign keys

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def common_type(child: T.DataType, parent: T.DataType) -> T.DataType | None:
    """The type in which values of both columns can be compared as values; None if there is none."""
    pair = (child, parent)
    if all(isinstance(t, _INTEGERS) for t in pair):
        return T.LongType()
    if all(isinstance(t, (*_INTEGERS, T.DecimalType)) for t in pair):
        whole = scale = 0
        for t in pair:
            p, s = (t.precision, t.scale) if isinstance(t, T.DecimalType) else (19, 0)
            whole, scale = max(whole, p - s), max(scale, s)
        return T.DecimalType(min(38, whole + scale), scale)
    if all(isinstance(t, (*_INTEGERS, T.DecimalType, T.FloatType, T.DoubleType)) for t in pair):
        return T.DoubleType()
    for kinds, to in (((T.StringType, T.BinaryType), None), ((T.BooleanType,), T.BooleanType()), ((T.DateType,), T.DateType())):
        if all(isinstance(t, kinds) for t in pair):
            if to is not None:
                return to
            return T.BinaryType() if all(isinstance(t, T.BinaryType) for t in pair) else T.StringType()
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType)) for t in pair):
        return T.TimestampType()
    return None


def orphans(child: DataFrame, key: Column, key_type: T.DataType, parent: DataFrame, target: Column, target_type: T.DataType, carry: list[Column], known: tuple[Known | None, Known | None] = (None, None)) -> DataFrame:
    """Rows of ``child`` whose non-null key is not among the parent's: ``carry`` and ``ROW``.

    Without a common type every non-null key is an orphan; so is a value that
    the common type can't represent.
    """
    shape = _dense_reference(child, key, key_type, parent, target, target_type, known)
    if shape is not None and not _lost(shape, child, key, parent, target)["lost"]:  # all orphans are outside the parent's range
        return child.where(key.isNotNull() & ~shape.within([key.cast("long")])).select(*carry, F.col(ROW))
    return _without_parent(child, key, key_type, parent, target, target_type, [*carry, F.col(ROW)], shape)


def orphan_count(child: DataFrame, key: Column, key_type: T.DataType, parent: DataFrame, target: Column, target_type: T.DataType, known: tuple[Known | None, Known | None] = (None, None)) -> DataFrame:
    """One row: how many rows of ``child`` are orphans; only keys are shuffled, or their bits where the parent's are dense. ``known`` are the child's key and the parent's."""
    shape = _dense_reference(child, key, key_type, parent, target, target_type, known)
    if shape is not None:
        found = _lost(shape, child, key, parent, target)
        if not found["lost"]:  # all orphans are outside the parent's range
            return child.sparkSession.sql(f"SELECT * FROM VALUES (CAST({found['outside'] or 0} AS BIGINT)) AS t(orphans)")
    return _without_parent(child, key, key_type, parent, target, target_type, [F.lit(1).alias("one")], shape).agg(F.count(F.lit(1)).alias("orphans"))


def _dense_reference(child: DataFrame, key: Column, key_type: T.DataType, parent: DataFrame, target: Column, target_type: T.DataType, known: tuple[Known | None, Known | None] = (None, None)) -> Dense | None:
    """The parent's range, if its keys and the child's within it are dense."""
    if not (isinstance(key_type, _INTEGERS) and isinstance(target_type, _INTEGERS)):
        return None
    shape = dense(parent, [target.cast("long")], [known[1]])
    if shape is None:
        return None
    if known[0] is not None:  # no more words than within the child's own range
        return shape if _settled([known[0].low], [known[0].high], known[0].rows, known[0].words) else None
    return shape if dense(child.where(shape.within([key.cast("long")])), [key.cast("long")]) else None


def _lost(shape: Dense, child: DataFrame, key: Column, parent: DataFrame, target: Column):
    """How many keys of children the parent lacks within its range (``lost``), and how many children are outside it (``outside``)."""
    keys_lost = F.sum(F.when(F.col(_WORD).isNotNull(), F.bit_count(_BITS)))
    return _compared_words(shape, child, key, parent, target).agg(keys_lost.alias("lost"), F.sum(F.when(F.col(_WORD).isNull(), F.col("n"))).alias("outside")).first()


def _compared_words(shape: Dense, child: DataFrame, key: Column, parent: DataFrame, target: Column) -> DataFrame:
    """Words with the bits of keys that children have and parents lack; the null word counts (``n``) the children outside the parent's range."""
    long = key.cast("long")
    of_child = child.where(key.isNotNull()).select(F.when(shape.within([long]), shape.index([long])).alias("i"), F.lit(True).alias("child"))
    of_parent = parent.where(target.isNotNull()).select(shape.index([target.cast("long")]).alias("i"), F.lit(False).alias("child"))
    bit, none = _bit(F.col("i")), F.lit(0).cast("long")
    words = of_child.unionAll(of_parent).groupBy(F.shiftright("i", 6).alias(_WORD)).agg(
        F.bit_or(F.when(F.col("child"), bit).otherwise(none)).alias("c"), F.bit_or(F.when(F.col("child"), none).otherwise(bit)).alias("p"), F.count(F.lit(1)).alias("n")
    )
    return words.select(_WORD, F.col("c").bitwiseAND(F.bitwise_not("p")).alias(_BITS), "n")


def _without_parent(child: DataFrame, key: Column, key_type: T.DataType, parent: DataFrame, target: Column, target_type: T.DataType, carry: list[Column], shape: Dense | None = None) -> DataFrame:
    held = child.where(key.isNotNull())
    to = common_type(key_type, target_type)
    if to is None:
        return held.select(*carry)
    if shape is not None:
        # children meet only words in which the parent lacks something, few where references hold
        long = key.cast("long")
        lost = _compared_words(shape, child, key, parent, target).where((F.col(_BITS) != 0) & F.col(_WORD).isNotNull()).select(_WORD, _BITS)
        probe = held.select(*carry, F.when(shape.within([long]), shape.index([long])).alias("__key__"))
        has_bit = F.col(_BITS).bitwiseAND(_bit(F.col("__key__"))) != 0
        found = probe.where("__key__ is not null").join(lost, (F.shiftright("__key__", 6) == F.col(_WORD)) & has_bit).drop("__key__", _WORD, _BITS)
        return found.unionAll(probe.where("__key__ is null").drop("__key__"))
    same = lambda c, t: c if t == to else c.try_cast(to)
    probe = held.select(*carry, same(key, key_type).alias("__key__"))
    known = parent.select(same(target, target_type).alias("__target__")).where("__target__ is not null")  # a primary key: nothing to deduplicate, and an anti-join would not mind
    return probe.join(known, F.col("__key__") == F.col("__target__"), "left_anti").drop("__key__")
