"""Rules on word statistics, and an isolation forest over them.

Base statistics (see :func:`base_stats`) are exact and need no model. The
forest reads *rates* made of them and of a few more counts of the same pass;
every tree is grown on a small random subset of the fitting rows with splits at
random values of random statistics, and rows that few splits separate are
anomalous. The threshold is calibrated on all labelled rows that are not held
out: the score that separates their labels best, from a histogram.

Defined cases: a null or empty text has all counts 0, fails the base rule and
is not kept; repeated rows get equal verdicts; without labels the forest
rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out_column, materialize, sample_rows, text_slices, texts_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fixed values of the rules: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())

TREES = 128
SUBSET = 256
FIT_ROWS = 8192
BINS = 2000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_marks", "n_shouts", "n_same")
RATES = ("word length", "symbols a word", "duplicate lines", "repeated words", "upper case", "marks a word", "shouts a word", "distinct words", "same word again")


def base_stats(text: str | None) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a whole text."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    left = lambda chars: len(data) - len(data.translate(None, chars))
    lines, seen, again = data.split(b"\n"), set(), 0
    full = [x for x in lines if x.strip(_SPACE)]
    for x in full:
        again += x in seen
        seen.add(x)
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64)
    repeats = 0
    if n >= 3:
        size = np.uint64(len(number))
        key = ids[:-1] * size + ids[1:]
        if len(number) > 1 << 21:
            key = np.unique(key, return_inverse=True)[1].astype(np.uint64)
        key = key[:-1] * size + ids[2:]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        twice = count[back] > 1
        held = np.zeros(n, dtype=bool)
        for k in range(3):
            held[k : n - 2 + k] |= twice
        repeats = int(held.sum())
    same = int((ids[1:] == ids[:-1]).sum())
    return (n, len(text) - left(_SPACE), left(SYMBOLS), again, repeats, len(full), len(number), left(_UPPER), left(_PUNCTUATION), left(b"!?"), same)


def rates(counts: np.ndarray) -> np.ndarray:
    """What the forest reads, from rows of ``COUNTS``."""
    c = {name: counts[:, k].astype(np.float64) for k, name in enumerate(COUNTS)}
    words, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_lines"], 1)
    low = lambda x: x**3  # noqa: E731  a little of it is common in good texts
    high = np.sqrt  # a little of it tells already
    return np.column_stack([
        c["word_chars"] / words, high(np.minimum(c["n_symbols"] / words, 4)), low(c["n_dup_lines"] / lines), low(c["n_repeat_words"] / words),
        c["n_upper"] / np.maximum(c["word_chars"], 1), high(np.minimum(c["n_marks"] / words, 9)), high(np.minimum(c["n_shouts"] / words, 4)),
        (np.log1p(c["n_distinct"]) / np.log1p(words)) ** 2, high(c["n_same"] / words),
    ])


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def average_path(n: int) -> float:
    """Mean depth of a random search tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass(frozen=True)
class IsolationForest:
    """Trees as arrays: inner nodes have a statistic and a split, leaves a path length."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    subset: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 is anomalous."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            live = rows
            while len(live):
                at = node[live]
                inner = self.feature[at] >= 0
                live, at = live[inner], at[inner]
                node[live] = self.left[at] + (x[live, self.feature[at]] >= self.split[at])
            total += self.path[node]
        return 2.0 ** -(total / len(self.roots) / max(average_path(self.subset), 1e-9))


def grow(x: np.ndarray, trees: int = TREES, subset: int = SUBSET, seed: int = 3) -> IsolationForest:
    """Splits are uniform between the bounds that the *fitting rows as a whole* have in a node's box, so a region that a tree's own subset leaves empty is cut off early."""
    rng = np.random.default_rng(seed)
    subset = min(subset, len(x))
    limit = max(1, int(np.ceil(np.log2(max(subset, 2))))) + 4
    low, high = x.min(axis=0), x.max(axis=0)
    feature, split, left, path, roots = [], [], [], [], []

    def new() -> int:
        for column, value in ((feature, -1), (split, 0.0), (left, 0), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    for _ in range(trees):
        root = new()
        roots.append(root)
        work = [(root, x[rng.choice(len(x), subset, replace=False)], 0, low.copy(), high.copy())]
        while work:
            node, rows, depth, lo, hi = work.pop()
            wide = np.flatnonzero(hi > lo)
            if len(rows) <= 1 or depth >= limit or not len(wide):
                path[node] = depth + average_path(len(rows))
                continue
            f = int(rng.choice(wide))
            s = float(rng.uniform(lo[f], hi[f]))
            a = new()
            b = new()
            feature[node], split[node], left[node] = f, s, a
            below = rows[:, f] < s
            hi_a, lo_b = hi.copy(), lo.copy()
            hi_a[f] = lo_b[f] = s
            work += [(a, rows[below], depth + 1, lo, hi_a), (b, rows[~below], depth + 1, lo_b, hi)]
    return IsolationForest(np.array(feature), np.array(split), np.array(left), np.array(path), np.array(roots), subset)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``COUNTS`` of every row."""

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch):
                found = zip(*map(base_stats, texts_of(batch, a, b)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, pa.int64()) for c in found)], names=["doc_id", *COUNTS])

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in COUNTS)])
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _scored(stats: DataFrame, forest: IsolationForest) -> DataFrame:
    held = stats.sparkSession.sparkContext.broadcast(forest)  # bounded by trees and subset
    schema = T.StructType([*stats.schema.fields, T.StructField("anomaly", T.DoubleType())])

    def run(batches):
        for batch in batches:
            counts = np.column_stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in COUNTS])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(held.value.scores(rates(counts)))], names=schema.names)

    return stats.mapInArrow(run, schema)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """From histograms over ``BINS`` bins of [0, 1]: rejects what is at or above it.

    Maximises the sum of both labels' hit rates; of equal choices the middle.
    """
    if not good.sum() or not bad.sum():
        return 2.0
    hit = np.cumsum(good) / good.sum() + 1 - np.cumsum(bad) / bad.sum()
    best = np.flatnonzero(hit >= hit.max() - 1e-12)
    return (float(best[0] + best[-1]) / 2 + 1) / BINS


def judge(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, base statistics, base_failed, the anomaly score and kept for every row."""
    stats = materialize(statistics(docs), "rule-stats")
    marks = labels.where(F.col("quality").isNotNull() & ~held_out_column()).groupBy(F.col("doc_id").alias("labelled")).agg(F.max("quality").alias("quality"))
    fits = sample_rows(stats.where("n_words >= 1"), "doc_id", fit_rows).select(*COUNTS).toPandas().to_numpy()
    fits = fits[np.lexsort(fits.T)]  # the order of arrival is not fixed
    if not len(fits):
        scored, threshold = stats.withColumn("anomaly", F.lit(0.0)), 2.0
    else:
        scored = _scored(stats, grow(rates(fits)))
        known = scored.where(~base_failed()).join(marks, F.col("doc_id") == F.col("labelled"))
        cells = known.groupBy("quality", F.least(F.floor(F.col("anomaly") * BINS), F.lit(BINS - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # two rows per bin
        good, bad = np.zeros(BINS), np.zeros(BINS)
        for r in cells:
            (good if r["quality"] else bad)[r["bin"]] += r["n"]
        threshold = best_threshold(good, bad)
    failed = base_failed()
    return scored.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), "anomaly", (~failed & (F.col("anomaly") < threshold)).alias("kept"))
