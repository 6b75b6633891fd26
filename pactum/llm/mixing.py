"""Mix sources to target weights with exact word budgets.

1. *Budgets.* Sources in code-point order (null last) weigh 3, 1, 2, repeating,
   and share a multiple of all words; no target exceeds ``cap`` times its
   source, and what is cut off is shared again by weight. That is water
   filling, ``target = min(cap * size, level * weight)``, solved on one row per
   source.
2. *Order.* Every document gets a hash-random key from its id, its text and the
   seed, so rows without an id spread as well; a source's documents are taken in key order, ids breaking ties, then texts.
3. *Prefix sums.* Keys are uniform, so a source is range-split into cells of
   equal key width, as many as its documents need. Cell sums are prefix-summed
   (one row per cell), and rows are prefix-summed within their own cell only:
   no task ever holds a whole source, however hot.
4. *Cut.* ``taken`` is the part of each document that lies below its source's
   budget, in as many epochs as the budget has: whole epochs, then documents in
   order, the one at the cut in part.

Defined cases: a null or empty text has size 0 and is never taken; sources
without words get target 0; repeated rows are documents of their own; an empty
table gives no rows; runs agree whatever the partitioning.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, named

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = 20_240_501
CELL_ROWS = 4096
#: Up to so many sources (a checked number of rows of about 50 bytes) the plan is broadcast.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Maximal runs outside ``[\\x20\\x09-\\x0D]``; 0 for null."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.length(F.regexp_replace(gaps, "[\\x20\\x09-\\x0D]+", "")).cast("long")


def water_fill(sizes: list[int], weights: list[float], budget: float, cap: float = CAP) -> list[float]:
    """Targets of ``min(cap * size, level * weight)`` that sum to ``budget`` (or all caps, if that is less)."""
    targets = [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n]
    left = float(budget)
    while open_:
        total = math.fsum(weights[i] for i in open_)
        above = [i for i in open_ if left * weights[i] / total > cap * sizes[i]]
        if not above:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in above:
            targets[i] = cap * sizes[i]
        left = max(0.0, float(budget) - math.fsum(targets))
        closed = set(above)
        open_ = [i for i in open_ if i not in closed]
    return targets


def _cells_key(source: str) -> Column:
    """Sources as non-null keys: null and the empty string stay apart."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def mix(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and with ``carry`` the whole row of ``docs`` as the struct ``row``."""
    size = word_count(F.col("text")) if size is None else size
    sized = docs.select(
        F.col("doc_id"), F.col("source"), size.alias("size"),
        F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("key"), F.xxhash64(F.col("text"), F.lit(seed)).alias("tie"),
        *[F.struct(*[named(c) for c in docs.columns]).alias("row")] * carry,
    )
    sized = materialize(sized.withColumn("group", _cells_key("source")), "mix-sizes")
    spark = docs.sparkSession
    totals = sized.groupBy("group", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).collect()  # one row per source
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["source_size"] for r in totals]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    plan = spark.createDataFrame(
        [(r["group"], r["source_size"], t, math.floor(t + 0.5), max(1, -(-r["rows"] // CELL_ROWS))) for r, t in zip(totals, targets, strict=True)],
        "group string, source_size long, target double, budget long, cells long",
    )
    # The key's upper 53 bits as a fraction of 1 choose the cell: equal widths, so cells of one source are about even.
    fraction = F.shiftrightunsigned(F.col("key"), 11).cast("double") / float(1 << 53)
    if len(totals) <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)  # else a shuffled join, whose hot sources are split at run time
    rows = sized.join(plan, "group").withColumn("cell", F.floor(fraction * F.col("cells")))
    order = [F.shiftrightunsigned(F.col("key"), 1), F.col("key").bitwiseAND(F.lit(1)), F.col("doc_id").asc_nulls_first(), F.col("tie")]
    sums = rows.groupBy("group", "cell").agg(F.sum("size").alias("cell_size"))
    to_here = Window.partitionBy("group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("group", "cell", F.coalesce(F.sum("cell_size").over(to_here), F.lit(0)).alias("before_cell"))
    in_cell = Window.partitionBy("group", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("through", F.sum("size").over(in_cell)).join(sums, ["group", "cell"])
    before = F.col("before_cell") + F.col("through") - F.col("size")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("budget") - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - before))
    return placed.select(
        "doc_id", "source", "size", "source_size", "target",
        (epochs * F.col("size") + last).cast("long").alias("taken"),
        *["row"] * carry,
    )


def take_words(docs: DataFrame) -> DataFrame:
    """``docs`` without its last column, a number of words after which each text ends."""
    schema = StructType(docs.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = batch.column(batch.num_columns - 1).to_pylist()
            cut = [_first_words(t, n) for t, n in zip(batch.column(at).to_pylist(), counts, strict=True)]
            columns = [pa.array(cut, batch.schema.field(at).type) if k == at else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def _first_words(text: str, n: int) -> str:
    for k, word in enumerate(re.finditer("[^\\x20\\x09-\\x0D]+", text), 1):
        if k == n:
            return text[: word.end()]
    return text


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus itself, with the columns of ``docs``: a document is repeated once per whole epoch, and one that the budget cuts ends with the words it takes."""
    whole = mix(docs, carry=True, **options).where("size > 0").select("row", "size", "taken")
    epochs = F.floor(F.col("taken") / F.col("size")).cast("int")
    repeated = whole.where("taken >= size").select("row", F.explode(F.sequence(F.lit(1), epochs)).alias("copy")).select("row.*")
    cut = take_words(whole.where("taken % size > 0").select("row.*", (F.col("taken") % F.col("size")).alias("words to take")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return repeated.union(cut)
