"""Mergeable summaries of one column, of bounded size: what a profile needs from one pass.

A task summarises each batch by Arrow's and numpy's vectorised operations and
adds it up; summaries of tasks are merged in any order. They hold

* counts, extremes and non-finite tallies;
* frequent values with counts and errors: a value's true count lies between
  ``count - error`` and ``count``. Up to ``TRACKED`` distinct values nothing is
  dropped and all errors are 0; beyond, the least frequent go, and ``floor``
  bounds the true count of every value that is not held;
* distinct values, by the greatest hash rank in each of 2¹⁴ registers;
* the ``POOL`` distinct values with the least hashes, whatever their frequency;
* counts by bin, where the bins are known before the pass.

Numbers, dates and times are summarised as numbers (days, microseconds), texts as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct values that are counted exactly; a summary holds up to ``SLACK`` times as many.
TRACKED, SLACK = 1000, 4
POOL = 1024
REGISTER_BITS = 14


@dataclass(frozen=True)
class Bins:
    """Right-closed bins of equal width from ``low``; the first also holds its lower end."""

    low: float
    high: float
    width: float
    count: int

    def numbers(self, x: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(x), np.int64)
        if isinstance(self.width, int):
            at = (x - self.low + self.width - 1) // self.width - 1
        else:
            at = np.ceil((x - self.low) / self.width) - 1
        return np.clip(at, 0, self.count - 1).astype(np.int64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(values: np.ndarray) -> np.ndarray:
    """64-bit hashes that depend on the values alone."""
    if values.dtype == object:
        from pandas.util import hash_array

        return mixed(hash_array(values, categorize=False)) if len(values) else np.empty(0, np.uint64)
    return mixed(values.astype(np.float64 if values.dtype.kind == "f" else np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Frequent:
    """Values with counts and errors; both are upper bounds, exact while ``floor`` is 0."""

    values: np.ndarray
    counts: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    errors: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    floor: int = 0

    @staticmethod
    def empty(dtype) -> Frequent:
        return Frequent(np.empty(0, dtype))

    def merge(self, other: Frequent) -> Frequent:
        """A value that one side does not hold may have occurred there up to that side's floor."""
        if not len(other.values) and not other.floor:
            return self
        values = np.concatenate([self.values, other.values])
        if values.dtype == object:
            seen: dict = {}
            at = np.array([seen.setdefault(v, len(seen)) for v in values], np.int64)
            kept = np.empty(len(seen), object)
            kept[:] = list(seen)
        else:
            kept, at = np.unique(values, return_inverse=True)
        n, k = len(kept), len(self.values)
        here, there = np.zeros(n, bool), np.zeros(n, bool)
        here[at[:k]], there[at[k:]] = True, True
        missing = np.where(here, 0, self.floor) + np.where(there, 0, other.floor)
        total = lambda a, b: np.bincount(at, np.concatenate([a, b]), n).astype(np.int64) + missing  # noqa: E731 - exact below 2**53
        return Frequent(kept, total(self.counts, other.counts), total(self.errors, other.errors), self.floor + other.floor).cut(SLACK * TRACKED)

    def order(self) -> np.ndarray:
        """Most frequent first, ties by value."""
        by_value = np.argsort(self.values, kind="stable")
        return by_value[np.argsort(-self.counts[by_value], kind="stable")]

    def cut(self, most: int) -> Frequent:
        if len(self.values) <= most:
            return self
        order = self.order()
        kept, gone = order[: most // 2], order[most // 2]  # half, so that it is seldom done
        return Frequent(self.values[kept], self.counts[kept], self.errors[kept], max(self.floor, int(self.counts[gone])))

    def top(self, k: int) -> list[tuple]:
        at = self.order()[:k]
        return list(zip(self.values[at].tolist(), self.counts[at].tolist(), self.errors[at].tolist(), strict=True))


@dataclass
class Pool:
    """The distinct values with the least hashes."""

    hashes: np.ndarray
    values: np.ndarray

    def merge(self, other: Pool) -> Pool:
        h, first = np.unique(np.concatenate([self.hashes, other.hashes]), return_index=True)
        return Pool(h[:POOL], np.concatenate([self.values, other.values])[first[:POOL]])

    def take(self, h: np.ndarray, values: np.ndarray) -> Pool:
        """With more values; those that cannot get in are left out first."""
        if len(self.hashes) == POOL:
            near = h < self.hashes[-1]
            if not near.any():
                return self
            h, values = h[near], values[near]
        return self.merge(Pool(h, values))


class Registers:
    """How many distinct hashes there were, to about 1 %."""

    def __init__(self):
        self.ranks = np.zeros(1 << REGISTER_BITS, np.uint8)

    def add(self, h: np.ndarray) -> None:
        at = (h >> np.uint64(64 - REGISTER_BITS)).astype(np.int64)
        rest = (h << np.uint64(REGISTER_BITS)) | np.uint64(1 << (REGISTER_BITS - 1))
        rank = 64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11 + 1  # leading zeros and one
        np.maximum.at(self.ranks, at, rank.astype(np.uint8))

    def merge(self, other: Registers) -> None:
        np.maximum(self.ranks, other.ranks, out=self.ranks)

    def estimate(self) -> int:
        m, empty = len(self.ranks), int((self.ranks == 0).sum())
        found = 0.7213 / (1 + 1.079 / m) * m * m / np.ldexp(1.0, -self.ranks.astype(np.int64)).sum()
        return round(m * math.log(m / empty)) if found <= 2.5 * m and empty else round(found)


class Summary:
    """A column of one of the kinds boolean, integer, float, text, date and datetime; of any other kind its nulls only."""

    def __init__(self, kind: str, bins: Bins | None = None, values: bool = True, only_bins: bool = False):
        self.kind, self.bins, self.values, self.only_bins = kind, bins, values, only_bins
        self.rows = self.nulls = self.nans = self.negative = self.positive = 0
        self.low = self.high = None
        self.invalid = False  # bytes that are no text
        self.binned = np.zeros(bins.count if bins else 0, np.int64)
        dtype = object if kind == "text" else np.float64 if kind == "float" else np.int64
        self.frequent, self.registers = Frequent.empty(dtype), Registers()
        self.pool = Pool(np.empty(0, np.uint64), np.empty(0, dtype))

    def add(self, column: pa.Array) -> None:
        self.rows += len(column)
        if self.kind == "other":  # the column tells whether the value is null
            self.nulls += pc.sum(column).as_py() or 0
            return
        self.nulls += column.null_count
        if self.invalid or len(column) == column.null_count:
            return
        found = pc.value_counts(column.drop_null())
        counts = found.field(1).to_numpy().astype(np.int64)
        values = self._plain(found.field(0))
        if values is None:
            return
        if self.kind == "float":
            finite = np.isfinite(values)
            if not finite.all():
                tally = lambda which: int(counts[which].sum())
                self.nans, self.negative, self.positive = self.nans + tally(np.isnan(values)), self.negative + tally(values == -np.inf), self.positive + tally(values == np.inf)
                values, counts = values[finite], counts[finite]
        if not len(values):
            return
        if self.bins is not None:
            self.binned += np.bincount(self.bins.numbers(values), counts, self.bins.count).astype(np.int64)
        if self.only_bins:
            return
        low, high = (min(values), max(values)) if self.kind == "text" else (values.min().item(), values.max().item())
        self._extend(low, high)
        h = hashes(values)
        if self.kind != "float":
            self.registers.add(h)
            self.frequent = self.frequent.merge(Frequent(values, counts, np.zeros(len(counts), np.int64)))
        if self.values:
            self.pool = self.pool.take(h, values)

    def _plain(self, values: pa.Array) -> np.ndarray | None:
        """Distinct values as numbers or texts; None of bytes that are no text."""
        if self.kind == "text":
            try:
                if pa.types.is_binary(values.type) or pa.types.is_large_binary(values.type):
                    values = values.cast(pa.large_string())
                values.validate(full=True)
            except pa.ArrowInvalid:
                self.invalid = True
                return None
            out = np.empty(len(values), object)
            out[:] = values.to_pylist()
            return out
        if self.kind == "boolean":
            return values.cast(pa.int8()).to_numpy().astype(np.int64)
        if self.kind == "date":
            return values.cast(pa.int32()).to_numpy().astype(np.int64)
        if self.kind == "datetime":
            return values.cast(pa.timestamp("us", values.type.tz), safe=False).cast(pa.int64()).to_numpy()
        return values.to_numpy().astype(np.float64) + 0.0 if self.kind == "float" else values.to_numpy().astype(np.int64)

    def _extend(self, low, high) -> None:
        self.low = low if self.low is None or low < self.low else self.low
        self.high = high if self.high is None or high > self.high else self.high

    def merge(self, other: Summary) -> None:
        self.rows, self.nulls, self.invalid = self.rows + other.rows, self.nulls + other.nulls, self.invalid or other.invalid
        self.nans, self.negative, self.positive = self.nans + other.nans, self.negative + other.negative, self.positive + other.positive
        self.binned = self.binned + other.binned
        if other.low is not None:
            self._extend(other.low, other.high)
        self.registers.merge(other.registers)
        self.frequent = self.frequent.merge(other.frequent)
        self.pool = self.pool.merge(other.pool)
