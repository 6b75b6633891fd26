"""Near duplicates: banded MinHash candidates, odd sketches, full-set confirmation.

1. Every whole text becomes its set of hashed word shingles. Texts with equal
   sets form one class; only the smallest document of a class goes on.
2. MinHash samples of the set give band keys; documents with a common key are
   candidates. The samples, folded into a parity bitmap (odd sketch), estimate
   high similarities from the population count of an XOR.
3. *Hubs first.* In every bucket each member is compared with the smallest one
   only: as many pairs as members. Sketches and set sizes discard pairs before
   any text moves; what stays is confirmed by exact intersections of full sets,
   one text per pair and one per hub being shuffled. The components of these
   links hold almost all of a family of near copies.
4. *What is still open.* Buckets whose members lie in several components are
   compared by sketch in blocks of bounded size, each pair of blocks a task of
   its own, across components only and each pair in the first band it shares.
   Only documents with a pair that passes send their texts to the blocks where
   it did, and a task returns at most one link per member.
5. Components of all links, then back to all documents by class.

With 24 bands of 5 rows a pair at the threshold of 0.85 shares no band with a
probability of 8e-7; the sketch loses one with a probability of about 1e-9.

Defined cases: a text without words (or null) has an empty set and is linked
with nothing; a text with fewer words than a shingle has one shingle, its whole
word sequence; rows that share a document id count as one document in links,
and each gets a row. A row with a null id cannot be named by a link: it is in the
component of the rows whose set equals its own, and linked with no other set; a
class of null ids only is a component of its own, with a null name.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize, materialize_counted, mix64, steady_memory, text_slices, texts_of
from .components import connected_components

WORDS = 5
PERCENT = 85
BANDS = 24
ROWS = 5
SKETCH_BITS = 512
#: Samples of 120 that may differ at 85 %: 46 is over seven standard deviations; each differing sample sets two bits at most.
SKETCH_LIMIT = 2 * 46
#: Members of an open bucket, and their shingles, that one block holds.
BLOCK_DOCS = 2048
BLOCK_SHINGLES = 2_000_000
SEED = 0x5DEECE66D

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, for n positions."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, dtype=np.uint64))]) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[str | bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    split = [(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"").translate(_LOWER).split() for t in texts]
    counts = np.array([len(w) for w in split], dtype=np.int64)
    if not counts.sum():
        return [np.empty(0, np.uint64) for _ in texts]
    joined = b" ".join([b" ".join(w) for w in split if w])
    data = np.frombuffer(joined, dtype=np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], gaps + 1])
    ends = np.concatenate([gaps, [len(data)]])
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    out, at = [], 0
    for n in counts.tolist():
        if n == 0:
            out.append(np.empty(0, np.uint64))
            continue
        k = min(n, words)
        a, b = starts[at : at + n - k + 1], ends[at + k - 1 : at + n]
        out.append(np.unique(mix64((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * np.uint64(SEED))))
        at += n
    return out


def _multipliers(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + np.uint64(SEED)) | np.uint64(1)


def signatures(sets: list[np.ndarray], samples: int = BANDS * ROWS) -> np.ndarray:
    """MinHash samples, one row per set; an empty set has all ones."""
    out = np.full((len(sets), samples), np.iinfo(np.uint64).max, dtype=np.uint64)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    offsets = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
    for k, a in enumerate(_multipliers(samples)):
        out[full, k] = np.minimum.reduceat(flat * a, offsets)
    return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = mix64(sig[:, : bands * rows]).reshape(len(sig), bands, rows)
    weights = _multipliers(rows)
    return mix64((parts * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(_BASE))


def odd_sketches(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as rows of uint64 words."""
    n, k = sig.shape
    bit = mix64(sig + np.arange(k, dtype=np.uint64) * np.uint64(_BASE)) % np.uint64(bits)
    cell = (np.arange(n, dtype=np.int64)[:, None] * bits + bit.astype(np.int64)).ravel()
    parity = (np.bincount(cell, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(parity, axis=1, bitorder="little").view(np.uint64)


def sketch_similarity(a: np.ndarray, b: np.ndarray, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Estimated Jaccard similarity of sketches (rows of ``a`` with ``b``)."""
    odd = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * odd / bits, 1e-9))


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set: equal sets have equal keys."""
    one = np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    two = np.array([mix64(s + np.uint64(SEED)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return one.view(np.int64), two.view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the class key (k1, k2), band keys and odd sketch (as 64-bit words) of every text."""

    def lists(rows: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.view(np.int64).ravel()))

    def run(batches):
        steady_memory()
        for batch in batches:
            ids = batch.column(0)
            for a, b in text_slices(batch):
                sets = shingle_sets(texts_of(batch, a, b))
                sig = signatures(sets)
                k1, k2 = set_keys(sets)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), lists(band_keys(sig)), lists(odd_sketches(sig))],
                    names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(id, packed) of every text that is not null."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for a, b in text_slices(batch):
                held = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in texts_of(batch, a, b)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(held, pa.binary())], names=["id", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").mapInArrow(squeeze, "id long, packed binary")


def _unpacked_sets(packed: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
    """Shingle sets and their first keys."""
    unpack = zstandard.ZstdDecompressor()
    sets = shingle_sets([unpack.decompress(x) for x in packed])
    return sets, set_keys(sets)[0].tolist()


def alike(one: np.ndarray, two: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets are as similar as the threshold."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(small) + len(large) - common)


def _confirm_pairs(batches):
    """Rows (a, ka, packed_a, b, kb, packed_b); rows of one hub ``b`` mostly follow each other, so its set is kept."""
    steady_memory()
    hub, hub_set, hub_key = None, None, None
    for batch in batches:
        ids_a, keys_a, ids_b, keys_b = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("a", "ka", "b", "kb"))
        texts_b = batch.column(batch.schema.get_field_index("packed_b"))
        for start, end in text_slices(batch, "packed_a", 1 << 19):
            sets, keys = _unpacked_sets(texts_of(batch, start, end, "packed_a"))
            found = []
            for k in range(start, end):
                if keys[k - start] != keys_a[k]:
                    continue  # another text of the same id
                packed = texts_b[k].as_py()
                if packed != hub:
                    hub = packed
                    (hub_set,), (hub_key,) = _unpacked_sets([packed])
                if hub_key == keys_b[k] and alike(sets[k - start], hub_set):
                    found.append((ids_a[k], ids_b[k]))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The links (a, b) among candidate ``pairs(a, ka, b, kb)``: each text of ``a`` is sent once per pair, that of a hub once per hub."""
    texts = packed_texts(docs)
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), "b")
    return with_b.select("a", "ka", "packed_a", "b", "kb", "packed_b").mapInArrow(_confirm_pairs, "a long, b long").distinct()


OPEN_FIELDS = "bucket long, i int, j int, id long, block int, band int, component long, k1 long, n long, bands array<long>, sketch array<long>"
_NAMES = [f.split()[0] for f in OPEN_FIELDS.split(", ")]


class Members:
    """The members of one pair of blocks of an open bucket, as arrays; :meth:`partners` gives whom a member is to be compared with."""

    def __init__(self, rows: list[dict]):
        self.ids, self.block, self.component, self.sizes = (np.array([r[n] for r in rows], dtype=np.int64) for n in ("id", "block", "component", "n"))
        self.sketch = np.array([r["sketch"] for r in rows], dtype=np.int64).view(np.uint64)
        self.earlier = np.array([r["bands"][: rows[0]["band"]] for r in rows], dtype=np.int64).reshape(len(rows), -1)
        self.across = rows[0]["i"] != rows[0]["j"]

    def partners(self, k: int, percent: int = PERCENT) -> np.ndarray:
        """Members in other components (and across the blocks, if there are two) whose size and sketch allow a link and that share no earlier band."""
        open_ = self.component != self.component[k]
        if self.across:
            open_ &= self.block != self.block[k]
        small, large = np.minimum(self.sizes, self.sizes[k]), np.maximum(self.sizes, self.sizes[k])
        at = np.flatnonzero(open_ & (100 * small >= percent * large))
        at = at[np.bitwise_count(self.sketch[at] ^ self.sketch[k]).sum(axis=1) <= SKETCH_LIMIT]
        return at[~(self.earlier[at] == self.earlier[k]).any(axis=1)] if self.earlier.shape[1] else at

    def outside(self) -> np.ndarray:
        """Members that are not in the largest component: every pair across components has one."""
        names, counts = np.unique(self.component, return_counts=True)
        return np.flatnonzero(self.component != names[counts.argmax()])


def _by_block_pair(batches):
    """The rows of each (bucket, i, j), which follow each other."""
    group, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = (row["bucket"], row["i"], row["j"])
            if key != group:
                if rows:
                    yield rows
                group, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _passing(batches):
    """The rows of members that have a pair which passes the sketches."""
    for rows in _by_block_pair(batches):
        members = Members(rows)
        hit = np.zeros(len(rows), dtype=bool)
        for k in members.outside().tolist():
            at = members.partners(k)
            hit[at] = True
            hit[k] |= len(at) > 0
        kept = np.flatnonzero(hit).tolist()
        for a in range(0, len(kept), 1024):
            some = [rows[k] for k in kept[a : a + 1024]]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in some], t) for n, t in zip(_NAMES, _OPEN_KINDS, strict=True)], names=_NAMES)


_OPEN_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))


def links_in_block(members: Members, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A link for each merge of two components by a confirmed pair: at most one less than there are members."""
    found = []
    for k in members.outside().tolist():
        for at in members.partners(k).tolist():
            if members.component[at] != members.component[k] and alike(sets[at], sets[k]):
                found.append((int(members.ids[at]), int(members.ids[k])))
                members.component[members.component == members.component[at]] = members.component[k]
    return found


def _confirm_blocks(batches):
    steady_memory()
    for rows in _by_block_pair(batches):
        sets, keys = _unpacked_sets([r["packed"] for r in rows])
        good = [k for k, r in enumerate(rows) if keys[k] == r["k1"]]  # not other texts of the same id
        if len(good) > 1:
            found = links_in_block(Members([rows[k] for k in good]), [sets[k] for k in good])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def open_links(docs: DataFrame, reps: DataFrame, crowded: DataFrame, components: DataFrame) -> DataFrame | None:
    """Links across ``components`` in buckets of three or more members (``crowded(bucket)``); None if no bucket is open."""
    placed = reps.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "bucket")).join(crowded.select("bucket"), "bucket")
    placed = materialize(placed.join(components, "id", "left").withColumn("component", F.coalesce("component", "id")), "near-crowded")
    state = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"), F.min("component").alias("least"), F.max("component").alias("most"))
    blocks = F.greatest(F.ceil(F.col("docs") / BLOCK_DOCS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    sizes, buckets, _ = materialize_counted(state.where("least <> most").select("bucket", blocks.alias("blocks")), "near-open")
    if not buckets:
        return None
    told = reps.select(F.col("doc_id").alias("id"), "k1", "bands", "sketch")
    inside = placed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).join(told, "id")
    paired = inside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = paired.select(*_NAMES).repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    passed, rows, _ = materialize_counted(ordered.mapInArrow(_passing, OPEN_FIELDS).select(*_NAMES), "near-passed")
    free(placed)
    free(sizes)
    if not rows:
        return None
    sent = passed.join(packed_texts(docs), "id").select(*_NAMES, "packed").repartition(parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return sent.mapInArrow(_confirm_blocks, "a long, b long")


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    described = materialize(describe(docs), "near-described")
    classes = described.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = materialize(classes, "near-classes")
    reps = described.where("n_shingles > 0").join(classes.select(F.col("rep").alias("doc_id"), "k1", "k2"), ["doc_id", "k1", "k2"], "left_semi")
    reps = materialize(reps.select("doc_id", "k1", "n_shingles", "bands", "sketch"), "near-reps")
    members = reps.select("doc_id", F.explode("bands").alias("bucket"))
    hubs = members.groupBy("bucket").agg(F.min("doc_id").alias("b"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("docs"))
    hubs = materialize(hubs.where("b <> top").drop("top"), "near-hubs")
    stars = members.join(hubs.select("bucket", "b"), "bucket").where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    for side in "ab":
        told = reps.select(F.col("doc_id").alias(side), F.col("k1").alias(f"k{side}"), F.col("n_shingles").alias(f"n{side}"), F.col("sketch").alias(f"sketch_{side}"))
        stars = stars.join(told, side)
    odd = reduce(Column.__add__, [F.bit_count(F.col("sketch_a")[k].bitwiseXOR(F.col("sketch_b")[k])) for k in range(SKETCH_BITS // 64)])
    sized = 100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    pairs = materialize(stars.where(sized & (odd <= SKETCH_LIMIT)).select("a", "ka", "b", "kb"), "near-pairs")
    linked = connected_components(confirmed(pairs, docs))
    rest = open_links(docs, reps, hubs.where("docs > 2"), linked)
    if rest is not None:
        more, found, _ = materialize_counted(rest, "near-rest")
        if found:
            linked = connected_components(linked.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))
    for done in (hubs, pairs, reps):
        free(done)

    named = classes.join(linked.withColumnRenamed("id", "rep"), "rep", "left").select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    whole = described.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that stay: the smallest of each component. An id that repeats stays if one of its rows does."""
    gone = link_documents(docs).groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("kept").alias("stays")).where("not stays").select("gone_id")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]), "left_anti")
