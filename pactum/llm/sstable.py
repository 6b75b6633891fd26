"""Sorted-string-table shards of token ids, keyed by document id.

One shard file holds the documents of one range of ids, ascending:

* data blocks: entries ``shared, unshared, value bytes, key tail, value``; keys
  are 9 bytes (null first, then the id in order-preserving form) and share the
  prefix of the entry before them, except at the start of a block; a block is
  compressed as a whole;
* a sparse index: the first key, place and size of every block;
* a Bloom filter over the keys;
* a footer of fixed size: places of index and filter, numbers of entries and
  of ids, and a magic number.

A point lookup asks the filter, searches the index by bisection and then one
block. Shards are written by the task that holds the range, under a temporary
name that is then renamed, so a task that runs twice leaves one file.

Defined cases: a null text is the empty text (the end id alone); a null id is
a key of its own that sorts first; repeated ids keep one entry each, in the order
of their compressed texts; an empty table leaves no shards and gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, materialize_counted, qualified, scratch_path, text_slices, texts_of
from .tokens import default_vocabulary, encoder_for

END_ID = 2
BLOCK_BYTES = 64 << 10
SHARD_TEXT_BYTES = 24 << 20
#: Tasks that write; beyond so many, each writes several shards, one after another.
MAX_TASKS = 1 << 15
BLOOM_BITS_PER_KEY = 10
BLOOM_PROBES = 7
#: Fixed values of the file format.
MAGIC = b"PACTSST1"
FOOTER = struct.Struct("<QQQQQQ8s")
ENTRY = struct.Struct("<BBI")
INDEX_ENTRY = struct.Struct("<9sQI")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_PROBES)]


def build_shard(entries: Iterable[tuple[int | None, bytes]], block_bytes: int = BLOCK_BYTES) -> bytes:
    """``entries`` ascending by id; a value is the document's ids, little-endian uint32."""
    pack = zstandard.ZstdCompressor(level=1)
    out, index, keys, ids = [], [], [], 0
    block, last, size, at = [], b"", 0, 0

    def flush() -> None:
        nonlocal block, last, size, at
        if block:
            data = pack.compress(b"".join(block))
            index.append((first, at, len(data)))
            out.append(data)
            at, block, last, size = at + len(data), [], b"", 0

    first = b""
    for doc_id, value in entries:
        key = key_of(doc_id)
        if not block:
            first = key
        shared = 0
        while shared < len(last) and last[shared] == key[shared]:
            shared += 1
        block += [ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], narrow(value)]
        keys.append(key)
        last, size, ids = key, size + len(value), ids + len(value) // 4
        if size >= block_bytes:
            flush()
    flush()
    bits = max(64, -(-len(keys) * BLOOM_BITS_PER_KEY // 8) * 8)
    bloom = np.zeros(bits, dtype=np.uint8)
    for key in keys:
        bloom[_probes(key, bits)] = 1
    index_bytes = b"".join(INDEX_ENTRY.pack(*x) for x in index)
    bloom_bytes = np.packbits(bloom, bitorder="little").tobytes()
    footer = FOOTER.pack(at, len(index_bytes), at + len(index_bytes), len(bloom_bytes), len(keys), ids, MAGIC)
    return b"".join([*out, index_bytes, bloom_bytes, footer])


def narrow(value: bytes) -> bytes:
    """A width byte, then the ids in two bytes each where all fit, else in four."""
    ids = np.frombuffer(value, dtype="<u4")
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + value


def widen(stored: bytes) -> bytes:
    return np.frombuffer(stored, dtype="<u2", offset=1).astype("<u4").tobytes() if stored[0] == 2 else stored[1:]


def stored_size(n_bytes: int, width: int) -> int:
    return 1 + (n_bytes // 2 if width == 2 else n_bytes)


class ShardReader:
    """Reads a shard from its bytes."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < FOOTER.size:
            raise ValueError("not a shard: too short")
        index_at, index_size, bloom_at, bloom_size, self.entries, self.ids, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard: wrong magic number")
        self.index = list(INDEX_ENTRY.iter_unpack(data[index_at : index_at + index_size]))
        self.first_keys = [x[0] for x in self.index]
        self.bloom = np.frombuffer(data, dtype=np.uint8, count=bloom_size, offset=bloom_at)
        self.unpack = zstandard.ZstdDecompressor()

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key_of(doc_id), 8 * len(self.bloom)))

    def _block(self, number: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size = self.index[number]
        data, key, at = self.unpack.decompress(self.data[at : at + size]), b"", 0
        while at < len(data):
            shared, unshared, n = ENTRY.unpack_from(data, at)
            at += ENTRY.size
            key = key[:shared] + data[at : at + unshared]
            at += unshared
            held = stored_size(n, data[at])
            yield key, widen(data[at : at + held])
            at += held

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for number in range(len(self.index)):
            for key, value in self._block(number):
                yield id_of(key), value

    def lookup(self, doc_id: int | None) -> list[bytes]:
        """The values of an id (several if the id was written several times)."""
        if not self.may_hold(doc_id):
            return []
        key, found = key_of(doc_id), []
        for number in range(max(bisect_left(self.first_keys, key) - 1, 0), bisect_right(self.first_keys, key)):
            found += [value for k, value in self._block(number) if k == key]
        return found


def _put(uri: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    hidden = f"{path}/_{name}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(hidden) as f:
        f.write(data)
    target = f"{path}/{name}"
    there = lambda: system.get_file_info(target).type != fs.FileType.NotFound
    if not there():
        try:
            system.move(hidden, target)
            return
        except OSError:  # a second run of the task was faster: it wrote the same bytes
            if not there():
                raise
    system.delete_file(hidden)


SHARD_SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("shard", T.LongType()), ("path", T.StringType()), ("entries", T.LongType()), ("ids", T.LongType()), ("bytes", T.LongType()))])


def write_shards(docs: DataFrame, uri: str, vocabulary: str | None = None, end_id: int = END_ID, shard_text_bytes: int = SHARD_TEXT_BYTES) -> DataFrame:
    """Write one shard per range of ids under ``uri``; returns a lazy frame of the shards written.

    Texts travel compressed to the task of their range and become ids there.
    The ranges are cut by percentiles of the ids alone, so texts are read and
    compressed once.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = int(end_id).to_bytes(4, "little")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    tasks = min(MAX_TASKS, max(1, -(-total // shard_text_bytes)))

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    cuts = ids.agg(F.percentile_approx("doc_id", [k / tasks for k in range(1, tasks)], 20 * tasks)).first()[0] if tasks > 1 else None
    bounds = np.array(cuts or [], np.int64)  # at most MAX_TASKS

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids = batch.column(0)
            for a, b in text_slices(batch):
                held = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts_of(batch, a, b)]
                own = ids.slice(a, b - a)
                place = np.searchsorted(bounds, own.fill_null(0).to_numpy())
                place[own.is_null().to_numpy(zero_copy_only=False)] = 0  # nulls come first
                yield pa.RecordBatch.from_arrays([own, pa.array(held, pa.binary()), pa.array(place, pa.int32())], names=["doc_id", "packed", "place"])

    def write(batches):
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        encoder, unpack = encoder_for(vocabulary), zstandard.ZstdDecompressor()

        def out(held):
            data = build_shard(held)
            name = f"shard-{task:06d}-{number:06d}.sst"
            _put(uri, name, data)
            reader = ShardReader(data)
            row = (task << 32 | number, f"{uri}/{name}", reader.entries, reader.ids, len(data))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=SHARD_SCHEMA.names)

        held, size = [], 0
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = unpack.decompress(packed.as_py())
                if held and size + len(text) > 2 * shard_text_bytes:
                    yield out(held)
                    held, size, number = [], 0, number + 1
                held.append((doc_id, encoder.encode(text.decode("utf-8", "surrogatepass")) + end))
                size += len(text)
        if held:
            yield out(held)

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(squeeze, "doc_id long, packed binary, place int")
    ordered = packed.repartitionById(int(tasks), "place").drop("place").sortWithinPartitions("doc_id", "packed")
    return ordered.mapInArrow(write, SHARD_SCHEMA)


def _shard_number(path: str) -> int:
    task, number = path.rpartition("shard-")[2].split(".")[0].split("-")
    return int(task) << 32 | int(number)


READ_SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("shard", "doc_id", "start", "n_tokens", "ids_crc32")])


def read_shards(spark, uri: str, written: DataFrame | None = None) -> DataFrame:
    """One row per entry of every shard under ``uri``; ``start`` counts all ids before it.

    ``written`` is what :func:`write_shards` returned; without it the footers
    are read for the number of ids of each shard.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.sst").load(uri)

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard, rows, start = _shard_number(path), [], 0
                for doc_id, value in ShardReader(content.as_py()):
                    n = len(value) // 4
                    rows.append((shard, doc_id, start, n, crc_of(value)))
                    start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=READ_SCHEMA.names)

    entries = files.select("path", "content").mapInArrow(read, READ_SCHEMA)
    before = ids_before(footers(files) if written is None else written.select("shard", "ids"))
    return entries.join(before, "shard").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def ids_before(totals: DataFrame) -> DataFrame:
    """(shard, before): prefix sums of ``totals(shard, ids)``, first over the tasks and then over the shards of each."""
    task = totals.withColumn("task", F.shiftright("shard", 32))
    up_to = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = task.groupBy("task").agg(F.sum("ids").alias("ids"))  # at most MAX_TASKS rows
    tasks = tasks.select("task", up_to(Window.orderBy("task")).alias("before_task"))
    inside = task.withColumn("before_shard", up_to(Window.partitionBy("task").orderBy("shard")))
    return inside.join(tasks, "task").select("shard", (F.col("before_task") + F.col("before_shard")).alias("before"))


def ids_in_footer(tail: bytes) -> int:
    return FOOTER.unpack(tail[-FOOTER.size :])[5]


def footers(files: DataFrame) -> DataFrame:
    def read(batches):
        for batch in batches:
            found = [(_shard_number(p), ids_in_footer(c.as_py())) for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["shard", "ids"])

    size = FOOTER.size
    tail = files.select("path", F.expr(f"substring(content, length(content) - {size - 1}, {size})").alias("content"))
    return tail.mapInArrow(read, "shard long, ids long")


def token_tables(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids as shards in the shared folder and return what reading the files back gives."""
    spark = docs.sparkSession
    uri = qualified(spark, scratch_path(spark, "sstable"))
    written, shards, _ = materialize_counted(write_shards(docs, uri, vocabulary, end_id), "sstable-shards")
    if not shards:
        return spark.createDataFrame([], T.StructType(READ_SCHEMA.fields[1:]))
    return read_shards(spark, uri, written)
