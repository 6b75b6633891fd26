"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

* Features: hashed character 1- to 3-grams of the whole lower-cased text,
  ``log(1 + count) * idf`` at unit length. Document frequencies cover every
  row that may be learnt from.
* Training: follow-the-regularised-leader with per-coordinate rates and
  elastic-net (L1 and L2) penalties, on at most ``FIT_ROWS`` rows, shared among
  all languages of the known rows and chosen by the hash of their ids; L1 leaves
  the weights sparse, and rows and weights are stored as such. The fit is one task of
  an executor. Beyond ``FIT_ROWS`` languages the most frequent take part.
* Calibration: one temperature, chosen on rows that the weights were not
  fitted to, to least log loss.

Defined cases: a text that is null or has no letter is ``und`` with score 1;
without any row to learn from every text is ``und`` with score 0; repeated
rows get equal predictions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fit_in_task, held_out_column, text_slices, texts_of
from .ngrams import SparseRows, document_frequencies, gathered, ngram_counts, sparse_rows, sparse_vectors

BITS = 13
FIT_ROWS = 4000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.0005
MAX_WEIGHT = 64.0
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def features(text: str | None) -> np.ndarray:
    return ngram_counts(text, BITS)


def scaled(counts: SparseRows, idf: np.ndarray) -> SparseRows:
    """``log(1 + count) * idf`` at unit length, by row."""
    x = np.log1p(counts.values) * idf[counts.features]
    norm = np.maximum(np.sqrt(counts.sums(x * x)), 1e-12)
    return replace(counts, values=(x / norm[counts.owner()]).astype(np.float32))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class LanguageModel:
    """``place`` has for each feature the row of ``weights`` it has kept, or the row of zeros at the end."""

    classes: tuple[str, ...]
    idf: np.ndarray
    place: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    @staticmethod
    def of(classes: tuple[str, ...], idf: np.ndarray, w: np.ndarray, temperature: float) -> LanguageModel:
        """From dense weights (features and a bias, by class): what the L1 penalty made 0 is not stored."""
        kept = np.flatnonzero(w[:-1].any(axis=1))
        place = np.full(len(w) - 1, len(kept), dtype=np.int32)
        place[kept] = np.arange(len(kept))
        weights = np.concatenate([w[kept], np.zeros((1, w.shape[1]))]).astype(np.float32)
        return LanguageModel(classes, idf.astype(np.float32), place, weights, w[-1].astype(np.float32), temperature)

    def logits(self, x: SparseRows) -> np.ndarray:
        return replace(x, features=self.place[x.features]).times(self.weights) + self.bias

    def scores(self, counts: SparseRows) -> np.ndarray:
        return softmax(self.logits(scaled(counts, self.idf)) / self.temperature)


def train_ftrl(x: SparseRows | np.ndarray, y: np.ndarray, classes: int, width: int | None = None, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, batch: int = 16, weight: np.ndarray | None = None) -> np.ndarray:
    """FTRL-proximal on mini-batches of sparse rows; weights of (``width`` features + bias) by class.

    Only the coordinates that a mini-batch has are touched; ``weight`` is that of each row's loss.
    """
    if isinstance(x, np.ndarray):
        x, width = SparseRows.of(x), x.shape[1]
    z = np.zeros((width + 1, classes), np.float64)
    n = np.zeros_like(z)
    w = np.zeros_like(z)
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            some = x.take(rows)
            seen, at = np.unique(some.features, return_inverse=True)
            seen = np.append(seen, width).astype(np.int64)
            xb = np.zeros((len(rows), len(seen)))
            xb[some.owner(), at] = some.values
            xb[:, -1] = 1
            p = softmax(xb @ w[seen])
            p[np.arange(len(rows)), y[rows]] -= 1
            if weight is not None:
                p *= weight[rows][:, None]
            g = xb.T @ p / len(rows)
            sigma = (np.sqrt(n[seen] + g * g) - np.sqrt(n[seen])) / alpha
            z[seen] += g - sigma * w[seen]
            n[seen] += g * g
            w[seen] = np.where(np.abs(z[seen]) <= l1, 0, -(z[seen] - np.sign(z[seen]) * l1) / ((beta + np.sqrt(n[seen])) / alpha + l2))
    return w


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    tried = np.geomspace(0.02, 20, 61)
    losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def shares(counts: dict, limit: int) -> dict:
    """How many of ``limit`` rows each label gets: a quarter of the limit is shared equally, the rest by count."""
    total = sum(counts.values())
    if total <= limit:
        return counts
    floor = max(1, limit // (4 * len(counts)))
    least = {g: min(n, floor) for g, n in counts.items()}
    held = sum(least.values())
    return {g: least[g] + (n - least[g]) * (limit - held) // (total - held) for g, n in counts.items()}


def sample_languages(known: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` rows (text, lang), of each language those with the least hashes of their ids."""
    some = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(limit).collect()  # one row per language
    counts = {r["lang"]: r["n"] for r in some}
    quota, top = shares(counts, limit), (1 << 63) - 1
    # rows whose hash lies far above the expected bound go first, so that no task gets a whole language
    bound = {g: min(top, int((2 * q + 100) / counts[g] * (1 << 64)) - (1 << 63)) for g, q in quota.items()}

    def below(bound: dict) -> DataFrame:
        plan = known.sparkSession.createDataFrame([(g, q, bound[g]) for g, q in quota.items()], f"lang {known.schema['lang'].dataType.simpleString()}, quota long, bound long")
        digest = F.xxhash64("doc_id")
        return known.select("doc_id", "text", "lang", digest.alias("digest")).join(F.broadcast(plan), "lang").where("digest <= bound")

    found = {r["lang"]: r["n"] for r in below(bound).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    bound = {g: b if found.get(g, 0) >= quota[g] else top for g, b in bound.items()}  # ids that repeat may fall short
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("digest", "doc_id"))
    return below(bound).withColumn("rank", rank).where("rank <= quota").select("text", "lang")


def set_aside(y: np.ndarray) -> np.ndarray:
    """Every fifth row of each class, so that every class has rows to learn from."""
    out = np.zeros(len(y), dtype=bool)
    for c in np.unique(y):
        out[np.flatnonzero(y == c)[4::5]] = True
    return out


def balance(y: np.ndarray) -> np.ndarray:
    """Weights of rows that give every class the same share, up to ``MAX_WEIGHT``: a rare language is not drowned."""
    counts = np.bincount(y)
    return np.minimum(MAX_WEIGHT, len(y) / (np.count_nonzero(counts) * np.maximum(counts, 1)))[y]


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel | None:
    """Learn from ``text`` and non-null ``lang`` of rows that are not held out."""
    known = docs.where(~held_out_column() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    df, rows = document_frequencies(known, BITS, features)
    if not rows:
        return None
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)

    def learn(table: pa.Table) -> LanguageModel | None:
        counts, labels = gathered(table)
        if not labels:
            return None
        x = scaled(counts, idf)
        classes = tuple(sorted(set(labels)))
        y = np.array([classes.index(label) for label in labels])
        aside = set_aside(y)
        w = train_ftrl(x.take(np.flatnonzero(~aside)), y[~aside], len(classes), 1 << BITS, weight=balance(y[~aside]))
        model = LanguageModel.of(classes, idf, w, 1.0)
        if not aside.any():
            return model
        return replace(model, temperature=fit_temperature(model.logits(x.take(np.flatnonzero(aside))), y[aside]))

    some = sample_languages(known, fit_rows).select("text", F.col("lang").cast("string").alias("lang"))
    return fit_in_task(sparse_vectors(some, "lang", features), learn)


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # features by classes: bounded

    def run(batches):
        model = held.value
        for batch in batches:
            for a, b in text_slices(batch):
                texts = texts_of(batch, a, b)
                label, score = [UNDETERMINED] * len(texts), [1.0 if model else 0.0] * len(texts)
                if model:
                    at = [k for k, t in enumerate(texts) if t is not None and _LETTER.search(t)]
                    for c in range(0, len(at), 256):
                        part = at[c : c + 256]
                        p = model.scores(sparse_rows([features(texts[k]) for k in part]))
                        best = p.argmax(axis=1)
                        for k, i, v in zip(part, best.tolist(), p.max(axis=1).tolist(), strict=True):
                            label[k], score[k] = model.classes[i], min(1.0, v)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(label), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out_column().alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
