"""Removal of long byte strings that an earlier document has: a logarithmic family of sparse suffix arrays.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a
document with a smaller id.

*Sparse suffixes.* Of the ``WINDOW - GRAM + 1`` grams in a window, the one with
the least hash is its anchor; equal windows have equal anchors at equal places.
Consecutive windows with one anchor form a run, and the suffix at the anchor is
kept, one for each run (about every 14th position). The suffix array of a batch
holds these suffixes in the order of their bytes: the gram's bytes are compared
as they are; what lies beyond, to the right and to the left of it as far as the
run's windows reach, is compared by a hash of the whole span.

*Index family.* Batches are cut from the input (4 MB of text each); suffixes go
to shards by a hash of their first bytes. In a shard every batch's array is
merged into the family: levels of about equal size merge geometrically, so an
entry takes part in a logarithmic number of merges. A merge meets equal entries
side by side: of two equal spans the one in the larger document is covered, and
only the smaller document's stays in the family. A scan of the last level finds
neighbours whose longest common prefix is at least ``GRAM`` although their
spans differ. A window around the gram has ``WINDOW - GRAM`` bytes more: two
thirds of these on one side, or a third on both. Neighbours that differ in the
hashes of these three surroundings have no window in common. The few others are
resolved window by window, in a second family that is keyed by the hashes of
the windows themselves.

*Hot strings.* A batch sends one entry per distinct span, so a passage that a
third of all documents share costs a shard one entry per batch, not one per
document; copies of whole texts collapse in the same way.

*Scale.* A task takes several shards, one after another, so it holds one at a
time whatever their number. A batch sends at most ``MAX_GROUPS`` rows, however
many shards there are; a task splits what it got into its shards, which Spark
sorts (and spills) there.

Two entries count as equal if the 16 bytes of the gram and 88 bits of two
independent hashes of the span agree (in the second family: 88 bits of two
hashes of the window), so that among 10¹² spans around one gram a false match
has a probability of about 0.002.

Defined cases: a null text is the empty text; texts shorter than a window lose
nothing; a null id is neither smaller nor larger than any other, so its text
takes no part in matching; rows with the same id do not match each other;
further columns are ignored by :func:`find_repeats` and kept, whatever their
names, by :func:`remove_repeats`.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of, materialize, mix64, named, steady_memory, text_slices, texts_of

WINDOW = 50
GRAM = 16
#: Words of a gram.
GRAM_KEYS = GRAM // 8
#: Bytes of a gram that differ from the second one before, of ``GRAM - 2``, if it is no rule or padding.
VARIED = 6
#: Keys of an entry: the gram, and two hashes of the span.
SUFFIX_KEYS = GRAM_KEYS + 2
#: Windows that are handled in one pass over a long text: its arrays stay in the processor's cache.
PASS_WINDOWS = 1 << 16
#: Text per batch.
BATCH_BYTES = 4 << 20
#: Texts are packed once, and shuffled and read twice.
PACK_LEVEL = 6
#: Text per shard of the family, and shards per task where there are fewer than MAX_GROUPS.
SHARD_BYTES = 6 << 20
TASK_SHARDS = 4
#: Rows that a batch sends at most; each holds the entries of one shard or, beyond, of several.
MAX_GROUPS = 1 << 14
#: Bytes before and after the gram of which a window has one pair at least.
FAR = -(-2 * (WINDOW - GRAM) // 3)
NEAR = WINDOW - GRAM - FAR + 1
SIDES = ((FAR, 0), (0, FAR), (NEAR, NEAR))

_B1 = 0x9E3779B97F4A7C15 | 1
_B2 = 0xD6E8FEB86659FD93
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    if base not in _TABLES or len(_TABLES[base][0]) < n:
        size = max(n, PASS_WINDOWS + WINDOW)
        _TABLES[base] = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, dtype=np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    one, two = _TABLES[base]
    return one[:n], two[:n]


class Spans:
    """64-bit hashes of any spans of a byte array."""

    def __init__(self, data: np.ndarray, base: int):
        power, self.inverse = _powers(base, len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        weighted = data.astype(np.uint64)
        weighted += np.uint64(1)
        weighted *= power[:-1]
        np.cumsum(weighted, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * np.uint64(_B2))


def _gram_hashes(data: np.ndarray, spans: Spans) -> np.ndarray:
    """Hashes of all ``GRAM``-byte grams; their upper bits decide, so one round of mixing does.

    Grams of which most bytes equal the second one before (rules, padding) have
    the largest ones, so that only windows of nothing else are anchored at them.
    """
    h = spans.sums[GRAM:] - spans.sums[:-GRAM]
    h *= spans.inverse[: len(h)]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    differs = np.zeros(len(data) + 1, np.int32)  # up to each byte: how many differ from the second one before
    np.cumsum(data[2:] != data[:-2], out=differs[3:])
    h >>= np.uint64(1)
    h[differs[GRAM:] - differs[2 : len(h) + 2] < VARIED] |= np.uint64(1 << 63)
    return h


def runs_of(data: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of one pass: place of the anchor, two hashes of the span, first window, number of windows, and the side hashes.

    ``owner_end[i]`` is the end of the document that byte ``i`` belongs to.
    """
    none = np.empty(0, np.int64)
    nothing = (none, none.astype(np.uint64), none.astype(np.uint64), none, none, [none.astype(np.uint8)] * len(SIDES))
    windows = len(data) - WINDOW + 1
    if windows <= 0:
        return nothing
    valid = np.arange(windows) + WINDOW <= owner_end[:windows]
    others = Spans(data, _B2)
    h = _gram_hashes(data, others)
    low = np.uint64((1 << 23) - 1)
    key = h & ~low
    key |= np.arange(len(h), dtype=np.uint64)
    width, wanted = 1, WINDOW - GRAM + 1
    while 2 * width <= wanted:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < wanted:
        key = np.minimum(key[: windows], key[wanted - width : wanted - width + windows])
    at = np.flatnonzero(valid)
    if not len(at):
        return nothing
    anchor = (key[at] & low).astype(np.int64)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
    starts = np.flatnonzero(new)
    count = np.diff(np.concatenate([starts, [len(at)]]))
    first, anchor = at[starts], anchor[starts]
    del h, key
    spans = Spans(data, _B1)
    end = first + count + WINDOW - 1
    place = (anchor - first).astype(np.uint64)
    return anchor, mix64(spans.of(first, end) + place), mix64(others.of(first, end) + place), first, count, side_hashes(spans, anchor, first, end)


def first_bytes(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The gram at each place as big-endian words: their order is that of the bytes."""
    held = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at] if len(at) else np.empty((0, GRAM), np.uint8)
    words = np.ascontiguousarray(held).view(">u8")
    return [words[:, k].astype(np.uint64) for k in range(GRAM_KEYS)]


def side_hashes(spans: Spans, anchor: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """8-bit hashes of each gram with the surroundings ``SIDES``; 0 where the run, from ``begin`` to ``end``, has fewer bytes."""
    out = []
    for before, after in SIDES:
        start, stop = anchor - before, anchor + GRAM + after
        has = (start >= begin) & (stop <= end)
        side = np.zeros(len(anchor), np.uint8)
        side[has] = (spans.of(start[has], stop[has]) % np.uint64(255)).astype(np.uint8) + 1
        out.append(side)
    return out


class Batch:
    """The texts of a batch as one byte array, and its sparse suffix array."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, lengths: np.ndarray, data: np.ndarray):
        self.ids, self.known, self.lengths, self.data = ids, known, lengths, data
        self.ends = np.cumsum(lengths)

    def passes(self):
        """(first byte, bytes, document of each byte, end of its document) of each pass."""
        for a in range(0, max(len(self.data) - WINDOW + 1, 0), PASS_WINDOWS):
            b = min(len(self.data), a + PASS_WINDOWS + WINDOW - 1)
            first, last = np.searchsorted(self.ends, [a, b - 1], side="right")
            ends = self.ends[first : last + 1]
            sizes = np.diff(np.concatenate([[a], np.minimum(ends, b)]))
            doc = np.repeat(np.arange(first, last + 1), sizes)
            yield a, self.data[a:b], doc, np.repeat(ends - a, sizes)

    def index(self, shards: int) -> None:
        """The sparse suffix array, by shard: runs in the order of (shard, bytes, span, id); runs with equal bytes and span form one entry."""
        kinds = (*[np.uint64] * SUFFIX_KEYS, np.int64, np.int32, np.int32, *[np.uint8] * len(SIDES))
        found: list[list] = [[] for _ in kinds]
        for a, data, doc, ends in self.passes():
            anchor, span, check, first, count, sides = runs_of(data, ends)
            owner = doc[first]
            keep = self.known[owner]
            for to, x, kind in zip(found, (*first_bytes(data, anchor), span, check >> np.uint64(40), first + a, count, owner, *sides), kinds, strict=True):
                to.append(x[keep].astype(kind, copy=False))
        columns = []
        for kind in kinds:
            held = found.pop(0)
            columns.append(np.concatenate(held) if held else np.empty(0, kind))
        keys, (first, count, owner, *sides) = columns[:SUFFIX_KEYS], columns[SUFFIX_KEYS:]
        order = sorted_order([*keys, self.ids[owner]])
        if shards > 1:
            shard = shard_of(keys, shards)
            order = order[np.argsort(shard[order].astype(np.uint16 if shards <= 1 << 16 else np.uint32), kind="stable")]
        self.first, self.count = first[order], count[order].astype(np.int64)
        for k in range(len(keys)):
            keys[k] = keys[k][order]
        doc = self.ids[owner[order]]
        new = starts_of(keys)
        self.entry_at = np.flatnonzero(new)
        self.entry = np.cumsum(new) - 1
        self.entry_doc = doc[self.entry_at]
        self.least = doc == self.entry_doc[self.entry]  # runs of the entry's smallest document
        for k in range(len(keys)):
            keys[k] = keys[k][self.entry_at]
        self.keys = keys
        self.sides = [x[order][self.entry_at] for x in sides]


def sorted_order(keys: list[np.ndarray]) -> np.ndarray:
    """The order by all keys, most significant first: by the first one, then by the others where that is equal."""
    order = np.argsort(keys[0])
    first = keys[0][order]
    same = first[1:] == first[:-1]
    at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]])) if len(order) else order
    if len(at):
        rows = order[at]
        order[at] = rows[np.lexsort([k[rows] for k in reversed(keys)])]
    return order


def shard_of(keys: list[np.ndarray], shards: int) -> np.ndarray:
    """By the upper bits of a hash of the first bytes: even, whatever the texts."""
    h = mix64(keys[0])
    for k in keys[1:GRAM_KEYS]:
        h = mix64(h + k)
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def starts_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where neighbours in sorted arrays differ."""
    new = np.ones(len(keys[0]), dtype=bool)
    if len(new):
        new[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return new


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


class Form:
    """How the entries of a family are laid out: bytes of each key, and how many side hashes follow."""

    def __init__(self, widths: tuple[int, ...], sides: int):
        self.widths, self.sides = widths, sides

    def pack(self, keys: list[np.ndarray], doc: np.ndarray, sides: list[np.ndarray], pack: zstandard.ZstdCompressor) -> bytes:
        parts = [_planes(k, w) for k, w in zip(keys, self.widths, strict=True)] + [x.tobytes() for x in sides] + [_planes(doc.view(np.uint64), 8)]
        return len(doc).to_bytes(4, "little") + pack.compress(b"".join(parts))

    def unpack(self, blob: bytes) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
        n, at = int.from_bytes(blob[:4], "little"), 0
        data = zstandard.ZstdDecompressor().decompress(blob[4:])

        def take(width: int) -> bytes:
            nonlocal at
            at += width * n
            return data[at - width * n : at]

        keys = [_unplanes(take(w), n, w) for w in self.widths]
        sides = [np.frombuffer(take(1), dtype=np.uint8) for _ in range(self.sides)]
        return keys, _unplanes(take(8), n, 8).view(np.int64), sides


SUFFIXES = Form((8,) * GRAM_KEYS + (8, 3), len(SIDES))
WINDOWS = Form((6, 5), 0)


class IndexFamily:
    """Levels of merged suffix arrays; sizes at least double from each level to the one below.

    A level is its keys, most significant first, then document, batch and
    ordinal of each entry, and further columns.
    """

    def __init__(self, keys: int):
        self.keys = keys
        self.levels: list[tuple[np.ndarray, ...]] = []
        self.covered: list[tuple[np.ndarray, np.ndarray]] = []  # (batch, ordinal) of entries that a smaller document has

    def add(self, batch: int, keys: list[np.ndarray], doc: np.ndarray, more: list[np.ndarray] = ()) -> None:
        level = (*keys, doc, np.full(len(doc), batch, dtype=np.int32), np.arange(len(doc), dtype=np.int32), *more)
        while self.levels and len(self.levels[-1][0]) <= 2 * len(level[0]):
            level = self._merge(self.levels.pop(), level)
        self.levels.append(level)

    def _merge(self, x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
        both = [np.concatenate(p) for p in zip(x, y, strict=True)]
        order = np.argsort(both[0], kind="stable")  # two sorted runs: one merging pass
        both = [p[order] for p in both]
        same = both[0][1:] == both[0][:-1]
        if same.any():  # order what has an equal first word by the rest of its keys and the document
            at = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
            fix = at[np.lexsort([p[at] for p in reversed(both[: self.keys + 1])])]
            for p in both:
                p[at] = p[fix]
            new = starts_of(both[: self.keys])
            doc = both[self.keys]
            stays = doc == doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            self.covered.append((both[self.keys + 1][~stays], both[self.keys + 2][~stays]))
            both = [p[stays] for p in both]
        return tuple(both)

    def finish(self) -> tuple[np.ndarray, ...]:
        """Merge all levels; the arrays of the last one."""
        while len(self.levels) > 1:
            self.levels.append(self._merge(self.levels.pop(), self.levels.pop()))
        return self.levels[0]


def partly_matching(level: tuple[np.ndarray, ...]) -> np.ndarray:
    """Entries of the last level that share their gram and one of its surroundings with an entry of another document."""
    new = starts_of(level[:GRAM_KEYS])  # a longest common prefix of less than GRAM begins a group
    group = np.cumsum(new) - 1
    doc = level[len(SUFFIXES.widths)]
    crowded = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(group) else np.empty(0, np.int64)
    out = np.zeros(len(group), dtype=bool)
    for side in level[-len(SIDES) :]:
        at = crowded[side[crowded] > 0]
        at = at[np.lexsort((side[at], group[at]))]
        if len(at):
            starts = np.flatnonzero(starts_of([group[at], side[at]]))
            mixed = np.minimum.reduceat(doc[at], starts) != np.maximum.reduceat(doc[at], starts)
            out[at] |= np.repeat(mixed, np.diff(np.append(starts, len(at))))
    return out


def resolve(runs: list[tuple[int, bytes]], form: Form) -> list[tuple[int, bytes]]:
    """Answers for the batches of one shard: a code per entry, 1 if a smaller document has it; 2 (of suffixes) if another document has a part of it."""
    family, sizes, keys = IndexFamily(len(form.widths)), [], len(form.widths)
    for k, (_, blob) in enumerate(runs):
        held, doc, sides = form.unpack(blob)
        sizes.append(len(doc))
        family.add(k, held, doc, sides)
    last = family.finish()
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    codes = np.zeros(bounds[-1], dtype=np.uint8)
    for batch, at in family.covered:
        codes[bounds[batch] + at] = 1
    if form.sides:
        hit = partly_matching(last)
        codes[bounds[last[keys + 1][hit]] + last[keys + 2][hit]] = 2
    pack = zstandard.ZstdCompressor(level=1)
    return [(batch, pack.compress(codes[a:b].tobytes())) for (batch, _), a, b in zip(runs, bounds[:-1], bounds[1:], strict=True) if codes[a:b].any()]


def _resolve_shards(batches, form: Form):
    """Rows (shard, batch, entries), sorted by shard."""

    def out(shard, runs):
        answers = resolve(runs, form)
        if answers:
            b, c = zip(*answers, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([shard] * len(b), pa.int64()), pa.array(c, pa.binary())], names=["batch", "shard", "codes"])

    steady_memory()
    now, runs = None, []
    for batch in batches:
        for shard, number, blob in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if shard != now:
                if runs:
                    yield from out(now, runs)
                now, runs = shard, []
            runs.append((number, blob))
    if runs:
        yield from out(now, runs)


def cut_batches(docs: DataFrame) -> DataFrame:
    """The texts in batches of about 4 MB, compressed."""

    def run(batches):
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=PACK_LEVEL)
        ids: list = []
        texts: list[bytes] = []

        def out():
            nonlocal number
            known = np.array([i is not None for i in ids], dtype=np.uint8)
            row = (
                (part << 32) | number,
                np.array([i or 0 for i in ids], dtype="<i8").tobytes(),
                known.tobytes(),
                np.array([len(t) for t in texts], dtype="<i8").tobytes(),
                pack.compress(b"".join(texts)),
                sum(map(len, texts)),
            )
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=BATCH_SCHEMA.names)

        held = 0
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in text_slices(batch):
                for doc, text in zip(column[a:b], texts_of(batch, a, b), strict=True):
                    data = (text or "").encode("utf-8", "surrogatepass")
                    if texts and held + len(data) > BATCH_BYTES:
                        yield out()
                        ids, texts, held = [], [], 0
                    ids.append(doc)
                    texts.append(data)
                    held += len(data)
        if ids:
            yield out()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, BATCH_SCHEMA)


BATCH_SCHEMA = T.StructType([
    T.StructField("batch", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("known", T.BinaryType()),
    T.StructField("lengths", T.BinaryType()), T.StructField("payload", T.BinaryType()), T.StructField("bytes", T.LongType()),
])
ENTRY_SCHEMA = "sent int, batch long, pieces array<struct<shard: bigint, entries: binary>>"
ANSWER_SCHEMA = "batch long, shard long, codes binary"


def _opened(batches, shards: int):
    """Each row of a frame of batches as (row dict, indexed Batch)."""
    steady_memory()
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for k in range(batch.num_rows):
            row = {n: batch.column(i)[k].as_py() for i, n in enumerate(batch.schema.names)}
            lengths = np.frombuffer(row["lengths"], dtype="<i8")
            data = np.frombuffer(unpack.decompress(row.pop("payload")), dtype=np.uint8) if lengths.sum() else np.empty(0, np.uint8)
            opened = Batch(np.frombuffer(row["ids"], dtype="<i8"), np.frombuffer(row["known"], dtype=np.uint8).astype(bool), lengths, data)
            opened.index(shards)
            yield row, opened


def _sections(shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shards that sorted entries have, and where each begins (and the last one ends)."""
    starts = np.flatnonzero(starts_of([shard]))
    return shard[starts], np.append(starts, len(shard))


def _entries_by_shard(number: int, shard: np.ndarray, shards: int, form: Form, keys, doc, sides=()):
    """At most ``MAX_GROUPS`` rows for a batch, each with the entries of consecutive shards."""
    pack = zstandard.ZstdCompressor(level=1)
    present, bounds = _sections(shard)
    if not len(present):
        return
    groups = min(shards, MAX_GROUPS)
    blobs = [form.pack([k[a:b] for k in keys], doc[a:b], [x[a:b] for x in sides], pack) for a, b in itertools.pairwise(bounds.tolist())]
    sent = present * groups // shards
    rows, offsets = _sections(sent)
    pieces = pa.StructArray.from_arrays([pa.array(present, pa.int64()), pa.array(blobs, pa.binary())], names=["shard", "entries"])
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([number] * len(rows), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)], names=["sent", "batch", "pieces"])


def _codes(answers: list | None, shard: np.ndarray) -> np.ndarray:
    """The codes of a batch's sorted entries."""
    codes = np.zeros(len(shard), dtype=np.uint8)
    present, bounds = _sections(shard)
    for answer in answers or ():
        k = int(np.searchsorted(present, answer["shard"]))
        codes[bounds[k] : bounds[k + 1]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(answer["codes"]), dtype=np.uint8)
    return codes


def _window_shards(one: np.ndarray, shards: int) -> np.ndarray:
    """Of sorted 48-bit window hashes."""
    return ((one >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _open_windows(batch: Batch, codes: np.ndarray):
    """Sorted distinct windows of the entries with code 2, and of each such run's windows which one it is.

    Returns (hash 1, hash 2, document) of the distinct windows; (runs, number of the distinct window per run and window).
    """
    entries = np.flatnonzero(codes == 2)
    lead = batch.entry_at[entries]
    total = batch.count[lead]
    run = np.repeat(np.arange(len(entries)), total)
    within = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(total)[:-1]]), total) if len(run) else np.empty(0, np.int64)
    start = batch.first[lead][run] + within
    one, two = np.empty(len(start), np.uint64), np.empty(len(start), np.uint64)
    for a, data, _, _ in batch.passes():
        mine = (start >= a) & (start < a + PASS_WINDOWS)
        if mine.any():
            s = start[mine] - a
            one[mine], two[mine] = Spans(data, _B1).of(s, s + WINDOW) >> np.uint64(16), Spans(data, _B2).of(s, s + WINDOW) >> np.uint64(24)
    doc = batch.entry_doc[entries][run]
    order = np.lexsort((doc, two, one))
    one, two, doc = one[order], two[order], doc[order]
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]) if len(order) else np.empty(0, bool)
    at = np.flatnonzero(new)
    window = np.empty(len(order), np.int64)
    window[order] = np.cumsum(new) - 1
    larger = np.empty(len(order), bool)  # a smaller document of this batch has the window
    larger[order] = doc != doc[at][np.cumsum(new) - 1] if len(order) else larger
    return (one[at], two[at], doc[at]), entries, total, window, larger


def _covered(batch: Batch, codes: np.ndarray, windows=None, window_codes=None) -> np.ndarray:
    """Which bytes of the batch are to go."""
    whole = ~batch.least | (codes == 1)[batch.entry] if len(batch.entry) else np.empty(0, bool)
    change = np.zeros(len(batch.data) + 1, dtype=np.int32)  # first windows of runs are distinct, and so are last ones
    change[batch.first[whole]] += 1
    change[batch.first[whole] + batch.count[whole] + WINDOW - 1] -= 1
    if windows is not None and len(windows[1]):
        _, entries, total, window, larger = windows
        gone = larger | (window_codes[window] == 1)
        offset = np.concatenate([[0], np.cumsum(total)])
        place = np.full(len(batch.entry_at), -1)
        place[entries] = np.arange(len(entries))
        runs = np.flatnonzero(batch.least & (place[batch.entry] >= 0))  # every run of the entry's smallest document
        k = place[batch.entry[runs]]
        n = total[k]
        run = np.repeat(np.arange(len(runs)), n)
        within = np.arange(len(run)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        start = batch.first[runs][run] + within
        start = start[gone[offset[k][run] + within]]
        change[start] += 1
        change[start + WINDOW] -= 1
    return np.cumsum(change[:-1]) > 0


RESULT_FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
TEXT_FIELDS = ", kept string, crc long"


def _solve(docs: DataFrame, with_text: bool) -> DataFrame:
    """The result fields of every row; with the text that is kept and a checksum of the old one if ``with_text``."""
    fields = RESULT_FIELDS + TEXT_FIELDS * with_text
    table = materialize(cut_batches(docs), "suffix-batches")
    total = table.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    shards = max(1, int(-(-total // SHARD_BYTES)))

    def entries(batches):
        for row, b in _opened(batches, shards):
            yield from _entries_by_shard(row["batch"], shard_of(b.keys, shards), shards, SUFFIXES, b.keys, b.entry_doc, b.sides)

    def windows(batches):
        for row, b in _opened(batches, shards):
            codes = _codes(row["answers"], shard_of(b.keys, shards))
            if (codes == 2).any():
                (one, two, doc), *_ = _open_windows(b, codes)
                yield from _entries_by_shard(row["batch"], _window_shards(one, shards), shards, WINDOWS, (one, two), doc)

    def result(batches):
        for row, b in _opened(batches, shards):
            codes = _codes(row["answers"], shard_of(b.keys, shards))
            held = window_codes = None
            if (codes == 2).any():
                held = _open_windows(b, codes)
                window_codes = _codes(row["window_answers"], _window_shards(held[0][0], shards))
            gone = _covered(b, codes, held, window_codes)
            rows, start = [], 0
            for doc, known, end in zip(b.ids.tolist(), b.known.tolist(), b.ends.tolist(), strict=True):
                mask = gone[start:end]
                kept = b.data[start:end][~mask].tobytes()
                spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
                text = (kept.decode("utf-8", "ignore"), crc_of(b.data[start:end].tobytes())) if with_text else ()
                rows.append((doc if known else None, end - start, int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), *text))
                start = end
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())[: len(rows[0])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    def answered(frame: DataFrame, form: Form, tag: str) -> DataFrame:
        tasks = max(1, -(-min(shards, MAX_GROUPS) // TASK_SHARDS))
        pieces = frame.repartition(tasks, "sent").select("batch", F.explode("pieces").alias("piece")).select("piece.shard", "batch", "piece.entries")
        return materialize(pieces.sortWithinPartitions("shard", "batch").mapInArrow(lambda batches: _resolve_shards(batches, form), ANSWER_SCHEMA), tag)

    def by_batch(answers: DataFrame, name: str) -> DataFrame:
        """All answers of a batch: no more bytes than the batch has entries."""
        return answers.groupBy("batch").agg(F.collect_list(F.struct("shard", "codes")).alias(name))

    first = by_batch(answered(table.mapInArrow(entries, ENTRY_SCHEMA), SUFFIXES, "suffix-answers"), "answers")
    second = by_batch(answered(table.join(first, "batch").mapInArrow(windows, ENTRY_SCHEMA), WINDOWS, "suffix-windows"), "window_answers")
    return table.join(first.join(second, "batch", "left"), "batch", "left").mapInArrow(result, fields)


def find_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what is left of every text."""
    return _solve(docs, with_text=False)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes removed from ``text``; what a cut leaves of a character goes too.

    Documents of which nothing is left go. Rows with a null id stay as they are;
    rows that share an id are cut each by its own text.
    """
    cut = _solve(docs, with_text=True).where("n_removed > 0").dropDuplicates(["doc_id", "n_bytes", "crc"])
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("row"))  # names of the input cannot clash with ours
    own = lambda c: F.col("row").getField(c)
    same = (own("doc_id") == F.col("doc_id")) & (F.octet_length(own("text")) == F.col("n_bytes")) & (F.crc32(own("text")) == F.col("crc"))
    uncut = F.col("doc_id").isNull()
    changed = {"text": F.when(uncut, own("text")).otherwise(F.col("kept"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(uncut, own("n_chars")).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    joined = rows.join(cut, same, "left").where(uncut | (F.length("kept") > 0))
    return joined.select(*[changed.get(c, own(c)).alias(c) for c in docs.columns])
