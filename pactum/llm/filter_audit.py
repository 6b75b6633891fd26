"""Which of five filters removes what, in every order, by an incremental stream with retractions.

All files of the documents are processed as available-now micro-batches of a
Structured Streaming query:

1. a task finds the failure bits A to D of each whole text and its digest
   (128 bits of SHA-256; texts go no further);
2. labels are joined by ``doc_id``;
3. a task settles what it can by itself: of rows with one text, those above the
   task's smallest id fail E whatever comes, so only the smallest goes on by
   digest, and a text that a third of all rows share costs one row a task;
4. state is keyed by the text, in buckets of digests (one state row of a bucket
   holds its texts, as compressed columns, so that a batch is merged by
   vectorised code): the smallest id of each text, with the part, bits and
   labels of the rows that have it. When a smaller id arrives, the earlier
   holder's row is retracted from its part's counters and counted again with E;
5. each micro-batch's changes of the counters are written under its number, so
   that a batch that is repeated after a failure replaces its own changes.

The counters, one per part, bits and labels, then give all orders and steps.

State lives where the session's state store keeps it, its changes and the
stream's progress in the shared folder; sessions with large tables should set
the RocksDB provider.

Defined results: a null text is the empty one, so null and empty texts are
identical; a null lang and an empty one are the part ``''``; rows that share a
smallest id all pass E; a null id is smaller than none and none is smaller, so
such a row passes E and has no labels; of several labels of one document any
counts; further columns are ignored; an empty table has no parts and gives no
rows. Ids are integers.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.window import Window

from .common import free, materialize, named, remove, scratch_path, text_slices, texts_of

FILTERS = "ABCDE"
A, B, C, D, E, GOOD, TOXIC = (1 << k for k in range(7))
#: Micro-batches of one audit; a table of fewer files takes fewer.
BATCHES = 8
#: Texts that one bucket of the state holds on average.
BUCKET_ROWS = 200_000
#: Rows that a task combines at once.
COMBINED_ROWS = 1 << 18

_SYMBOLS = re.compile(rb"[#$%&*|]")
_FEATURES = "doc_id long, part string, high long, low long, bits int"
_COMBINED = "bucket long, settled boolean, high long, low long, doc_id long, part string, bits int, n long"
_CHANGES = "part string, bits int, n long"
_STATE = "texts binary"


def failures(text: str | None) -> int:
    """The bits A to D of a text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    out = 0
    if len(words) < 200:
        out |= A
    if 100 * len(set(words)) < 50 * len(words):
        out |= B
    if 100 * (len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) > 3 * len(text):
        out |= C
    if _SYMBOLS.search(data):
        out |= D
    return out


def _features(batches):
    for batch in batches:
        for start, end in text_slices(batch):
            texts = texts_of(batch, start, end)
            digests = np.frombuffer(b"".join(hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()[:16] for t in texts), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start),
                pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array([failures(t) for t in texts], pa.int32()),
            ], names=["doc_id", "part", "high", "low", "bits"])


def _combiner(buckets: int):
    """Settle rows within a task; the rest goes on by text, one row per text, part and labels."""

    def combine(batches):
        held: list[pd.DataFrame] = []
        count = 0
        for batch in batches:
            held.append(batch.to_pandas(integer_object_nulls=True))
            count += batch.num_rows
            if count >= COMBINED_ROWS:
                yield settle(pd.concat(held))
                held, count = [], 0
        if count:
            yield settle(pd.concat(held))

    def settle(rows: pd.DataFrame) -> pa.RecordBatch:
        known = rows["doc_id"].notna().to_numpy()
        with_id = rows[known].astype({"doc_id": np.int64})
        least = with_id.groupby(["high", "low"])["doc_id"].transform("min")
        later = (with_id["doc_id"] > least).to_numpy()
        counted = [with_id[~later].groupby(["high", "low", "doc_id", "part", "bits"], as_index=False).size().rename(columns={"size": "n"}).assign(settled=False)]
        done = pd.concat([with_id[later].assign(bits=lambda x: x["bits"] | E), rows[~known]])
        counted.append(done.groupby(["part", "bits"], as_index=False).size().rename(columns={"size": "n"}).assign(settled=True, high=0, low=0, doc_id=0))
        out = pd.concat(counted)
        # settled rows may be counted anywhere: by part and bits, so that no bucket has all
        place = np.where(out["settled"], pd.util.hash_pandas_object(out["part"], index=False).to_numpy() % np.uint64(buckets) + out["bits"].to_numpy().astype(np.uint64), out["high"].to_numpy().view(np.uint64))
        out["bucket"] = (place % np.uint64(buckets)).astype(np.int64)
        return pa.RecordBatch.from_pandas(out.astype({"bits": np.int32, "n": np.int64, "settled": bool})[["bucket", "settled", "high", "low", "doc_id", "part", "bits", "n"]], preserve_index=False)

    return combine


_HELD = ["high", "low", "doc_id", "part", "bits"]


def merge(held: pd.DataFrame | None, new: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What a bucket holds after a batch, and the changes of the counters.

    ``held`` has the rows with the smallest id of each text so far; they have been
    counted without E. ``new`` may have any ids.
    """
    settled = new[new["settled"]]
    new = new[~new["settled"]].assign(old=False)
    rows = new if held is None else pd.concat([held.assign(old=True), new])
    least = rows.groupby(["high", "low"])["doc_id"].transform("min")
    beaten = (rows["doc_id"] > least).to_numpy()
    old = rows["old"].to_numpy(bool)
    changes = pd.concat([
        settled, rows[~old & ~beaten], rows[beaten].assign(bits=lambda x: x["bits"] | E),
        rows[old & beaten].assign(n=lambda x: -x["n"]),  # retracted
    ])
    changes = changes.groupby(["part", "bits"], as_index=False)["n"].sum()
    return rows[~beaten].groupby(_HELD, as_index=False)["n"].sum(), changes[changes["n"] != 0]


def _packed(held: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(held, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _keep_state(key, frames, state):
    held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
    after, changes = merge(held, pd.concat(list(frames)))
    state.update((_packed(after),))
    yield changes.astype({"bits": np.int32, "n": np.int64})[["part", "bits", "n"]]


def label_bits(labels: DataFrame) -> DataFrame:
    """``label_of`` and its bits GOOD and TOXIC; documents without either are left out."""
    flag = lambda c, bit: F.max(F.when(named(c) == 1, bit).otherwise(0))
    known = labels.where(named("doc_id").isNotNull()).groupBy(named("doc_id").cast("long").alias("label_of"))
    return known.agg((flag("quality", GOOD) + flag("toxic", TOXIC)).alias("label_bits")).where("label_bits > 0")


def folder_of(spark: SparkSession, path: str) -> tuple[str, str | None]:
    """A stream reads folders: the folder of a table, and the file's name if the table is one file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        return where.getParent().toString(), where.getName()
    return path, None


def count_parts(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Documents by ``part`` and ``bits`` (failures and labels), from the stream over the files at ``path``."""
    table = spark.read.parquet(path)
    buckets = max(32, math.ceil(table.count() / BUCKET_ROWS))  # rows of the footers
    per_batch = max(1, math.ceil(len(table.inputFiles()) / batches))
    label_rows = materialize(label_bits(labels), "audit-labels")
    counters, progress = scratch_path(spark, "audit-counters"), scratch_path(spark, "audit-progress")
    spark.createDataFrame([], _CHANGES).write.parquet(f"{counters}/batch=-1")

    # files are never too old: the age counts from the newest file
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", per_batch).option("maxFileAge", "36500d")
    folder, file = folder_of(spark, path)
    if file is not None:
        source = source.option("pathGlobFilter", re.sub(r"([\\*?\[\]{}])", r"\\\1", file))
    files = source.parquet(folder)
    rows = files.select(named("doc_id").cast("long").alias("doc_id"), F.coalesce(named("lang"), F.lit("")).alias("part"), named("text").alias("text")).mapInArrow(_features, _FEATURES)
    # rows without an id spread over the join's tasks by their digest and match no label
    key, absent = F.coalesce("doc_id", "high"), F.col("doc_id").isNull()
    labelled = rows.withColumns({"key": key, "absent": absent}).join(label_rows.withColumn("with_id", F.lit(False)), [F.col("key") == F.col("label_of"), F.col("absent") == F.col("with_id")], "left")
    bits = labelled.select("doc_id", "part", "high", "low", F.col("bits").bitwiseOR(F.coalesce("label_bits", F.lit(0))).alias("bits"))
    changes = bits.mapInArrow(_combiner(buckets), _COMBINED).groupBy("bucket").applyInPandasWithState(_keep_state, _CHANGES, _STATE, "update", GroupStateTimeout.NoTimeout)

    def put(batch: DataFrame, number: int) -> None:
        batch.groupBy("part", "bits").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{counters}/batch={number}")

    stream = changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", progress).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
        remove(spark, progress)
    free(label_rows)
    return spark.read.schema(_CHANGES).parquet(counters).groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")


def all_steps() -> str:
    """The 600 steps of all orders, as JSON."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order):
            own = 1 << FILTERS.index(letter)
            out.append({"filter_order": "".join(order), "step": k + 1, "filter": letter, "own": own, "before": before})
            before |= own
    return json.dumps(out)


def steps_of(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part, from its counters: at most 128 counters a part, each with 600 steps."""
    steps = F.from_json(F.lit(all_steps()), "array<struct<filter_order:string,step:int,filter:string,own:int,before:int>>")
    each = counts.select("part", "bits", "n", F.explode(steps).alias("s")).select("part", "bits", "n", "s.*")
    fails, gone = F.col("bits").bitwiseAND(F.col("own")) != 0, F.col("bits").bitwiseAND(F.col("before")) != 0
    total = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    has = lambda bit: F.col("bits").bitwiseAND(F.lit(bit)) != 0
    found = each.groupBy("part", "filter_order", "step", "filter").agg(
        total(~fails & ~gone).alias("kept"), total(fails & ~gone).alias("removed"), total(fails & gone).alias("redundant"),
        total(F.col("bits").bitwiseAND(F.lit(A | B | C | D | E)) == F.col("own")).alias("unique_fails"),
        total(fails & ~gone & has(GOOD)).alias("good_lost"), total(fails & ~gone & has(TOXIC)).alias("toxic_lost"),
    )
    return found.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(spark: SparkSession, path: str, labels: DataFrame, batches: int = BATCHES) -> DataFrame:
    """One row per part, order and step, with what the step's filter does there."""
    return steps_of(count_parts(spark, path, labels, batches))
