"""Hashed character n-grams of whole texts, as count vectors."""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of

_SPREAD = np.uint32(0x9E3779B1)


def ngram_counts(text: str | None, bits: int, sizes: tuple[int, ...] = (1, 2, 3)) -> np.ndarray:
    """Counts of the n-grams of the lower-cased text, padded with one space on each side, by hash of ``bits`` bits."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    shift = np.uint32(32 - bits)
    counts = np.zeros(1 << bits, dtype=np.int64)
    for n in sizes:
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k : len(points) - n + 1 + k]) * _SPREAD
            h ^= h >> np.uint32(15)
        counts += np.bincount((h * _SPREAD) >> shift, minlength=1 << bits)
    return counts


def case_shapes(text: str | None) -> str:
    """The text with letters by kind (A, a), digits as 0 and runs of the same word marked: what words look like, not which they are."""
    words = (text or "").split()
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return (text or "").translate(_SHAPES) + " \x01" * min(len(words), same)


class _Shape(dict):
    def __missing__(self, point: int) -> int:
        c = chr(point)
        self[point] = out = ord("A") if c.isupper() else ord("a") if c.isalpha() else ord("0") if c.isdigit() else point
        return out


_SHAPES = _Shape()


def document_frequencies(docs: DataFrame, bits: int, counts) -> tuple[np.ndarray, int]:
    """In how many rows of ``docs(text)`` each feature occurs, and the number of rows; ``counts(text)`` gives a count vector.

    Every row takes part. Each task sends one row per feature at most.
    """

    def run(batches):
        total, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for a, b in text_slices(batch):
                for text in texts_of(batch, a, b):
                    total += counts(text) > 0
                    n += 1
        if n:
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1), pa.int64()), pa.array(np.append(total[held], n), pa.int64())], names=["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # one row per feature
    out = np.zeros(1 << bits, dtype=np.int64)
    rows = 0
    for r in found:
        if r["feature"] < 0:
            rows = r["n"]
        else:
            out[r["feature"]] = r["n"]
    return out, rows


@dataclass(frozen=True)
class SparseRows:
    """Rows of a sparse matrix: row ``k`` has the entries from ``offsets[k]`` to ``offsets[k + 1]``."""

    offsets: np.ndarray
    features: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(dense: np.ndarray) -> SparseRows:
        row, feature = np.nonzero(dense)
        return SparseRows(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(dense)))]).astype(np.int64), feature, dense[row, feature])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def take(self, rows: np.ndarray) -> SparseRows:
        sizes = np.diff(self.offsets)[rows]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        at = np.arange(offsets[-1]) + np.repeat(self.offsets[rows] - offsets[:-1], sizes)
        return SparseRows(offsets, self.features[at], self.values[at])

    def owner(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self)), np.diff(self.offsets))

    def sums(self, per_entry: np.ndarray) -> np.ndarray:
        """Sums of ``per_entry`` by row; rows without entries have 0."""
        out = np.zeros((len(self), *per_entry.shape[1:]), dtype=per_entry.dtype)
        full = np.flatnonzero(np.diff(self.offsets))
        if len(full):
            out[full] = np.add.reduceat(per_entry, self.offsets[full], axis=0)
        return out

    def times(self, weights: np.ndarray) -> np.ndarray:
        """The product with a dense matrix of weights by feature; only the rows of weights that occur are read."""
        return self.sums(self.values[:, None] * weights[self.features])

    def dense(self, width: int) -> np.ndarray:
        out = np.zeros((len(self), width), dtype=np.float32)
        np.add.at(out, (self.owner(), self.features), self.values)
        return out


def sparse_rows(counts: list[np.ndarray]) -> SparseRows:
    where = [np.flatnonzero(c) for c in counts]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in where])]).astype(np.int64)
    features = np.concatenate(where).astype(np.int32) if where else np.empty(0, np.int32)
    values = np.concatenate([c[w] for c, w in zip(counts, where, strict=True)]).astype(np.float32) if where else np.empty(0, np.float32)
    return SparseRows(offsets, features, values)


def sparse_vectors(docs: DataFrame, label: str, counts) -> DataFrame:
    """(label, features, counts) of a bounded frame (text, label): the texts stay where they are."""
    kind = docs.schema[label].dataType.simpleString()

    def run(batches):
        for batch in batches:
            labels = batch.column(batch.schema.get_field_index(label))
            for a, b in text_slices(batch):
                rows = sparse_rows([counts(t) for t in texts_of(batch, a, b)])
                offsets = pa.array(rows.offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [labels.slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(rows.features, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(rows.values.astype(np.int32)))],
                    names=["label", "features", "counts"],
                )

    return docs.select("text", label).mapInArrow(run, f"label {kind}, features array<int>, counts array<int>")


def gathered(table: pa.Table) -> tuple[SparseRows, list]:
    """The rows and labels of :func:`sparse_vectors`, in an order that depends on their values only."""
    if not table.num_rows:
        return SparseRows(np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.float32)), []
    features, counts = (table.column(n).combine_chunks() for n in ("features", "counts"))
    offsets = np.asarray(features.offsets).astype(np.int64)
    rows = SparseRows(offsets - offsets[0], np.asarray(features.flatten()), np.asarray(counts.flatten()).astype(np.float32))
    labels = table.column("label").to_pylist()
    seen = [zlib.crc32(rows.values[a:b].tobytes(), zlib.crc32(rows.features[a:b].tobytes())) for a, b in itertools.pairwise(rows.offsets.tolist())]
    order = np.array(sorted(range(len(labels)), key=lambda k: (seen[k], str(labels[k]))), dtype=np.int64)
    return rows.take(order), [labels[k] for k in order]
