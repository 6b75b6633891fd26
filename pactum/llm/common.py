"""Shared pieces of the training-data operators.

Rules every operator here follows:

* columns are read by name; further columns of the input are carried or
  ignored, never looked up by position;
* a null text is the empty text unless the operator says otherwise;
* whole texts are processed, in slices of bounded size per Arrow batch;
* intermediate results that are read more than once go to a Parquet table in
  the cluster's shared folder (``spark.checkpoint.dir``), so that a lost
  executor costs a re-read and never a recomputation with other splits.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import pickle
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker handles at once.
SLICE_BYTES = 2 << 20

_SCRATCH: list[tuple[SparkSession, str]] = []
_OWN_DIR: dict[str, str] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a private one only where none is set and all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster, intermediate tables need a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="pactum-")
    return "file://" + _OWN_DIR[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/pactum/{tag}-{uuid.uuid4().hex}"
    _SCRATCH.append((spark, path))
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Hadoop gives it: one without a scheme lies in the cluster's default file system."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = system.makeQualified(where).toString()
    return re.sub(r"^file:/(?!/)", "file:///", uri)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage."""
    path = scratch_path(df.sparkSession, tag)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._scratch = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def materialize_counted(df: DataFrame, tag: str) -> tuple[DataFrame, int, object]:
    """:func:`materialize`, with the number of rows and an order-free checksum of its long columns taken while writing."""
    seen = Observation()
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest")
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), digest), tag)
    found = seen.get
    return out, found.get("rows") or 0, found.get("digest")


def free(df: DataFrame) -> None:
    """Delete the table behind a frame of :func:`materialize` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    for held in [x for x in _SCRATCH if x[1] == path]:
        _SCRATCH.remove(held)
        remove(*held)


@contextlib.contextmanager
def scratch_made() -> Iterator[list[tuple[SparkSession, str]]]:
    """The scratch tables that are written inside the block, for :func:`drop_scratch`."""
    before = set(_SCRATCH)
    made: list[tuple[SparkSession, str]] = []
    try:
        yield made
    finally:
        made += [x for x in _SCRATCH if x not in before]


def drop_scratch(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete scratch tables that no frame reads any more."""
    while tables:
        held = tables.pop()
        if held in _SCRATCH:
            _SCRATCH.remove(held)
            remove(*held)


def release_scratch() -> None:
    """Delete every scratch table; results that still read them become invalid."""
    while _SCRATCH:
        spark, path = _SCRATCH.pop()
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session has already ended
            pass


atexit.register(release_scratch)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` with about ``limit`` bytes of text each (one row at least)."""
    if batch.num_rows == 0:
        return
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=width)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield start, end
        start = end


def texts_of(batch: pa.RecordBatch, start: int, end: int, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).slice(start, end - start).to_pylist()


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; none for null.

    ``bytes.split`` separates at exactly these six ASCII characters.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def held_out_column(doc_id: str = "doc_id"):
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def named(column: str) -> Column:
    """A column by its exact name, dots and quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def crc_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 arrays."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fit_in_task(sample: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """``train`` applied to a bounded sample, in one task of an executor; only the model comes to the driver.

    The sample's size must be bounded by a parameter of the caller.
    """
    schema = sample.columns

    def run(batches):
        steady_memory()
        held = list(batches)
        table = pa.Table.from_batches(held) if held else pa.table({n: [] for n in schema})
        del held
        with one_blas_thread():
            model = train(table)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(found[0]["model"]) if found else train(pa.table({n: [] for n in schema}))


def sample_rows(df: DataFrame, order_key: str, limit: int) -> DataFrame:
    """``limit`` rows with the least hashes of a column: the same rows on every run.

    Only for fitting models; never for results. Rows whose hash lies far above
    the expected bound go first, so that tasks do not each send ``limit`` rows.
    """
    digest = F.xxhash64(F.col(order_key))
    rows = df.count()
    if rows > 4 * limit:
        bound = int((2 * limit + 1000) / rows * (1 << 64)) - (1 << 63)
        if bound < (1 << 63) - 1:
            few = df.where(digest < F.lit(bound))
            if few.count() >= limit:  # ids that repeat may fall short
                df = few
    return df.orderBy(digest, F.col(order_key)).limit(limit)


def steady_memory() -> None:
    """In a Python worker: give freed arrays back to the system instead of keeping them for later."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: fixed, so that it does not grow with what was freed
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


@contextlib.contextmanager
def one_blas_thread():
    """Many small products in one process: threads of the linear-algebra library would only wait for each other."""
    change, before = None, 1
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for path in paths:
            lib = ctypes.CDLL(path)
            for ends in ("64_", ""):
                for starts in ("scipy_openblas", "openblas"):
                    if change is None and hasattr(lib, f"{starts}_set_num_threads{ends}"):
                        change, before = getattr(lib, f"{starts}_set_num_threads{ends}"), getattr(lib, f"{starts}_get_num_threads{ends}")()
    except (OSError, AttributeError):
        pass
    if change:
        change(1)
    try:
        yield
    finally:
        if change:
            change(before)


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """For applications (the queries and the pipeline), never called by an operator: fewer rows per Arrow batch than the default of 10,000 keep both sides small where whole texts go to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def batches_of(items: Iterable, size: int) -> Iterator[list]:
    block = []
    for item in items:
        block.append(item)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
