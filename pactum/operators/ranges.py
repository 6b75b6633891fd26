"""Joins without an equality: a point of one side lies between two bounds of the other.

Points and bands meet in leaves: nodes of a tree of ranges whose splits are
sampled from the points in their own type's order, so numbers, decimals, texts,
dates and times are all joined alike. The tree has as many leaves as the number
of points asks for, and about ``LEAF`` points in each. A band is copied to the
leaves it touches: those between its two ends hold matches only, and in the two
at its ends it is compared with about ``LEAF`` points each. So the comparisons
grow with the bands and the result, not with the product of the sides.

All is expressed as equality joins on a node's number. Both sides can be small
and their pairs many, so a join of many pairs is dealt out by pairs, not by
bytes: points and bands of a leaf, such as that of one frequent value, are cut
into blocks of about ``BLOCK`` by their hashes, every block of points meets every
block of bands, and there are as many tasks as the pairs ask for. A row is copied
once for each block it meets, so copies are a small share of the pairs.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Points of a leaf, about.
LEAF = 512
#: Children of a node, at most; the tree gets another level beyond.
FAN = 1024
#: Sampled points for each split.
SAMPLED = 16
#: Points and bands of a block, about; a task compares about the square of it.
BLOCK = 2048
#: Tasks of a join that is dealt out, at most.
MOST_TASKS = 20_000
#: Leaves that are cut into blocks, at most; blocks are larger where there would be more.
MOST_SPLIT = 100_000
#: Splits of texts and bytes are cut to so many characters: any value can split.
SPLIT_LENGTH = 256

PATH, PATH_OF, NODE, SPLITS = "__path__", "__path_of__", "__node__", "__splits__"
#: The blocks of points and of bands that a copy of a row stands for; with ``_OF`` those of a band.
ROWS, COLS, ROWS_OF, COLS_OF = "__rows__", "__cols__", "__rows_of__", "__cols_of__"
_PARTS = 1 << 24


def between_join(points: DataFrame, point: Column, bands: DataFrame, low: Column, high: Column, conditions: list[Column], leaf: int = LEAF, fan: int = FAN, block: int = BLOCK) -> DataFrame:
    """Points with the bands they lie in: an inner join under ``conditions``, of which ``low <= point <= high`` is a consequence.

    Null points and bounds match nothing; a band whose bounds are the wrong way round is empty.
    """
    n = max(1, points.count())  # of a plain scan: from the footers
    placed, cut = in_leaves(points, point, bands, low, high, n, leaf, fan)
    keys = [(PATH, PATH_OF)]
    if n * bands.count() > block**2:
        met = met_in_leaves(placed, cut).persist()
        pairs, rows = met.agg(F.sum(F.col(ROWS).cast("double") * F.col(COLS)), F.sum(F.col(ROWS) + F.col(COLS))).first()
        if (pairs or 0) > block**2:
            placed, cut = in_blocks(placed, _hash(points), cut, _hash(bands), met, max(block, math.ceil(rows / MOST_SPLIT)))
            keys += [(ROWS, ROWS_OF), (COLS, COLS_OF)]
            tasks = min(MOST_TASKS, math.ceil(pairs / block**2))
            # a given number of partitions is not coalesced; bands are more than their source tells, so none are broadcast
            placed, cut = placed.repartition(tasks, *[a for a, _ in keys]), cut.repartition(tasks, *[b for _, b in keys]).hint("shuffle_hash")
        met.unpersist()
    return placed.join(cut, reduce(and_, [*[F.col(a) == F.col(b) for a, b in keys], *conditions])).drop(*[k for pair in keys for k in pair])


def met_in_leaves(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """Leaves (``NODE``) with both points and bands, and how many: ``ROWS``, ``COLS``."""
    of_points = placed.groupBy(F.col(PATH).alias(NODE)).agg(F.count(F.lit(1)).alias(ROWS))
    return of_points.join(cut.groupBy(F.col(PATH_OF).alias(NODE)).agg(F.count(F.lit(1)).alias(COLS)), NODE)


def in_blocks(placed: DataFrame, of_point: Column, cut: DataFrame, of_band: Column, met: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with one row for each pair of blocks (``ROWS``, ``COLS``) that a row takes part in.

    ``of_point`` and ``of_band`` are hashes of whole rows: a task that runs again
    finds the same blocks, and only equal rows are sure to share one.
    """
    blocks = lambda c: F.ceil(F.col(c) / F.lit(block))
    # leaves of several blocks are at most the rows over ``block``, which the caller bounds
    found = met.where((F.col(ROWS) > block) | (F.col(COLS) > block)).select(NODE, blocks(ROWS), blocks(COLS)).collect()
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = []
    for df, path, of_row, own, other in ((placed, PATH, of_point, ROWS, COLS), (cut, PATH_OF, of_band, COLS_OF, ROWS_OF)):
        if found:
            split = placed.sparkSession.createDataFrame([tuple(r) for r in found], f"{NODE} long, n{ROWS} long, n{COLS} long")
            df = df.join(F.broadcast(split), F.col(path) == F.col(NODE), "left")
            of_points, of_bands = (F.coalesce(F.col(f"n{c}"), one) for c in (ROWS, COLS))
        else:
            of_points = of_bands = one
        mine, others = (of_points, of_bands) if own == ROWS else (of_bands, of_points)
        df = df.withColumn(own, F.pmod(of_row, mine)).withColumn(other, F.explode(F.sequence(zero, others - 1)))
        out.append(df.drop(NODE, f"n{ROWS}", f"n{COLS}"))
    return out[0], out[1]


def in_leaves(points: DataFrame, point: Column, bands: DataFrame, low: Column, high: Column, n: int, leaf: int = LEAF, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """The points with their leaf in ``PATH``, and the bands with one row for each leaf they touch in ``PATH_OF``."""
    leaves = max(2, math.ceil(n / leaf))
    levels = math.ceil(math.log(leaves, fan) - 1e-9) if leaves > fan else 1
    children = math.ceil(leaves ** (1 / levels))
    placed = points.where(point.isNotNull()).withColumn(PATH, F.lit(0).cast("long"))
    cut = bands.where(low <= high).withColumn(PATH_OF, F.lit(0).cast("long"))
    # which rows are sampled depends on their values alone, so a task that runs again finds the same splits
    kept = F.pmod(_hash(points), F.lit(_PARTS))
    kind = points.select(point).schema.fields[0].dataType
    split = F.substring(point, 1, SPLIT_LENGTH) if isinstance(kind, (T.StringType, T.BinaryType)) else point
    for level in range(levels):
        share = min(1.0, SAMPLED * children ** (level + 1) / n)
        sampled = placed if share == 1 else placed.where(kept < int(share * _PARTS))
        held = sampled.groupBy(F.col(PATH).alias(NODE)).agg(F.sort_array(F.collect_set(split)).alias("v"))
        every = F.greatest(F.lit(1), (F.size("v") / F.lit(children)).cast("int"))
        splits = held.select(NODE, F.filter("v", lambda _, i: i % every == every - 1).alias(SPLITS))  # noqa: B023 - used at once
        of_points, of_bands = (splits.select(F.col(NODE).alias(f"{NODE}{side}"), F.col(SPLITS).alias(f"{SPLITS}{side}")) for side in "pb")
        steps = range(children.bit_length(), -1, -1)
        if level:
            placed = placed.join(of_points, F.col(PATH) == F.col(f"{NODE}p"), "left")
            cut = cut.join(of_bands, F.col(PATH_OF) == F.col(f"{NODE}b"), "left")
        else:  # the root is one row
            placed = placed.withColumn(f"{SPLITS}p", splits.select(SPLITS).scalar())
            cut = cut.withColumn(f"{SPLITS}b", splits.select(SPLITS).scalar())
        placed = placed.withColumn(PATH, F.col(PATH) * (2 * children + 2) + _number(F.col(f"{SPLITS}p"), point, steps)).drop(f"{NODE}p", f"{SPLITS}p")
        touched = F.sequence(_number(F.col(f"{SPLITS}b"), low, steps), _number(F.col(f"{SPLITS}b"), high, steps))
        cut = cut.withColumn(f"{NODE}t", F.explode(touched))
        cut = cut.withColumn(PATH_OF, F.col(PATH_OF) * (2 * children + 2) + F.col(f"{NODE}t")).drop(f"{NODE}b", f"{SPLITS}b", f"{NODE}t")
    return placed, cut


def _number(splits: Column, value: Column, steps: range) -> Column:
    """How many of the sorted ``splits`` are at most ``value``, by halving."""
    halve = lambda at, bit: F.when((at + bit <= F.size(splits)) & (F.try_element_at(splits, at + bit) <= value), at + bit).otherwise(at)
    found = F.aggregate(F.array(*[F.lit(1 << k) for k in steps]), F.lit(0), halve)
    return F.when(splits.isNull(), F.lit(0)).otherwise(found)


def _hash(df: DataFrame) -> Column:
    return F.xxhash64(*[c for f, c in zip(df.schema.fields, _columns(df), strict=True) if not _has_map(f.dataType)])


def _columns(df: DataFrame) -> list[Column]:
    return [df["`" + f.name.replace("`", "``") + "`"] for f in df.schema.fields]


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)
