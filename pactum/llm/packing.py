"""Best-fit decreasing packing of token sequences.

The tightest open bin is found with a segment tree over remaining capacities.
A capacity has ``capacity + 1`` possible remainders, so the tree has that many
leaves whatever the number of documents: leaf ``r`` counts the open bins with
``r`` free tokens, and one descent finds the smallest ``r`` that still takes a
piece. Pieces of one length are interchangeable, so the plan is made from the
*histogram of piece lengths* (at most ``capacity`` rows, the only thing the
driver sees), and it equals what best-fit decreasing gives piece by piece: a
bin taken for a piece of length ``s`` stays the tightest one until it holds
``r // s`` of them, so whole runs of bins move at once.

Pieces find their places without a global sort: each task numbers its pieces
of each length while it tokenises, counts per (task, length) are prefix-summed,
and the number within a length determines bin and offset by the plan.

Defined cases: a null text is the empty text (one piece: the end id alone); an
empty table gives no rows; repeated rows are packed as often as they occur;
further columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, materialize, text_slices, texts_of
from .tokens import default_vocabulary, encoder_for

CAPACITY = 4096
END_ID = 1


class CapacityTree:
    """Open bins by free capacity; a sum tree over the leaves 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, free: int, bins: int) -> None:
        node = self.size + free
        while node:
            self.count[node] += bins
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest free capacity of at least ``need`` that some open bin has."""
        node = self.size + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.size
            node >>= 1
        return None


@dataclass(frozen=True)
class Segment:
    """Pieces ``first .. first + pieces - 1`` of a length fill bins from ``bin`` on, ``per_bin`` in each, from ``offset``."""

    first: int
    pieces: int
    bin: int
    per_bin: int
    offset: int


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[Segment]]:
    """Best-fit decreasing over the counts of piece lengths."""
    tree = CapacityTree(capacity)
    open_bins: dict[int, list[tuple[int, int]]] = {}  # free capacity -> runs of bins (first, number)
    bins = 0
    plan: dict[int, list[Segment]] = {}

    def put(free: int, first: int, number: int) -> None:
        if free and number:
            open_bins.setdefault(free, []).append((first, number))
            tree.add(free, number)

    for length in sorted(histogram, reverse=True):
        left, placed, segments = histogram[length], 0, []
        while left:
            free = tree.tightest(length)
            if free is None:
                per_bin = capacity // length
                free, first, number = capacity, bins, max(1, left // per_bin)
                bins += number
            else:
                per_bin = free // length
                first, number = open_bins[free].pop()
                if not open_bins[free]:
                    del open_bins[free]
                tree.add(free, -number)
            full = min(number, left // per_bin)
            if full:
                segments.append(Segment(placed, full * per_bin, first, per_bin, capacity - free))
                placed, left = placed + full * per_bin, left - full * per_bin
                put(free - per_bin * length, first, full)
            if left and full < number:  # the last of these pieces share one bin
                segments.append(Segment(placed, left, first + full, left, capacity - free))
                put(free - left * length, first + full, 1)
                placed, left, full = placed + left, 0, full + 1
            put(free, first + full, number - full)
        plan[length] = segments
    return plan


PIECE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("rank", T.LongType()),
])


def tokenize_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece; ``rank`` numbers a task's pieces of each length from 0."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_for(vocabulary)
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b in text_slices(batch):
                rows = []
                for doc, text in zip(ids[a:b], texts_of(batch, a, b), strict=True):
                    data = encoder.encode(text) + end
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        held = data[at : at + 4 * capacity]
                        n = len(held) // 4
                        rows.append((doc, piece, at // 4, n, crc_of(held), part, seen[n]))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    names=PIECE_SCHEMA.names,
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each piece of ``length`` with its ``part`` and ``rank`` a ``sequence_id`` and an ``offset``.

    ``pieces`` must be stored (it is read twice).
    """
    spark = pieces.sparkSession
    counts = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(plan_packing(histogram, capacity))  # bounded by the capacity, not by the data
    before = counts.select(
        "part", "length",
        F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = pieces.join(before.hint("merge"), ["part", "length"])  # one row per task and length: grows with the data, so never broadcast
    names = [f.name for f in pieces.schema.fields if f.name not in ("part", "rank")]
    schema = T.StructType([pieces.schema[n] for n in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        starts = {length: [s.first for s in segments] for length, segments in plan.value.items()}
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index("length")).to_pylist()
            numbers = np.asarray(batch.column(batch.schema.get_field_index("number")))
            sequence, offset = [], []
            for length, number in zip(lengths, numbers.tolist(), strict=True):
                s = plan.value[length][bisect_right(starts[length], number) - 1]
                k, place = divmod(number - s.first, s.per_bin)
                sequence.append(s.bin + k)
                offset.append(s.offset + place * length)
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return placed.select(*names, (F.col("rank") + F.col("before")).alias("number")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise, cut what is longer than ``capacity``, and pack: one row per piece."""
    pieces = materialize(tokenize_pieces(docs, vocabulary or default_vocabulary(), capacity, end_id), "pack-pieces")
    return pack_pieces(pieces, capacity)
