"""Quality scores by nearest-neighbour voting in a latent semantic space.

* Features: hashed character n-grams of the whole text and of its letter
  shapes; ``log(1 + count) * idf``. Document frequencies cover all documents.
* Latent space: a truncated singular value decomposition (randomised range
  finder) of at most ``FIT_ROWS`` labelled documents, chosen by the hash of
  their ids, in one task of an executor. Their unit vectors and labels are broadcast: at most ``FIT_ROWS``
  by ``DIMENSIONS`` floats, whatever the size of the corpus.
* Score: exact cosine products of every document with every labelled vector,
  in blocks; the ``NEIGHBOURS`` most similar vote with their label, weighted
  by the similarity, and the prior rate of label 1 has the weight ``PRIOR``.

Defined cases: a null or empty text has the features of the empty text, and is
scored like any other; repeated rows get equal scores; without labels
every score is 0.5; several labels of one id count by their mean, and of several
texts of one labelled id the least is learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fit_in_task, held_out_column, sample_rows, text_slices, texts_of
from .ngrams import case_shapes, document_frequencies, gathered, ngram_counts, sparse_vectors

BITS = 12
FIT_ROWS = 4000
DIMENSIONS = 48
NEIGHBOURS = 15
#: Cosines that differ by no more are equal: what rounding leaves between equal vectors.
TIE = 1e-6
PRIOR = 0.2
ACCEPT = 0.3


def features(text: str | None) -> np.ndarray:
    half = BITS - 1
    return np.concatenate([ngram_counts(text, half, (2, 3)), ngram_counts(case_shapes(text), half, (2, 3, 4))])


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative frequencies, damped: the length of a text does not show."""
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return (np.sqrt(share) * idf).astype(np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    centre: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def embed(self, counts: np.ndarray) -> np.ndarray:
        return unit((weighted(counts, self.idf) - self.centre) @ self.basis)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        return vote(self.embed(counts), self.vectors, self.labels)


def vote(x: np.ndarray, vectors: np.ndarray, labels: np.ndarray, k: int = NEIGHBOURS, prior: float = PRIOR) -> np.ndarray:
    """Similarity-weighted mean label of the ``k`` nearest labelled vectors.

    Vectors as near as the ``k``-th (within ``TIE``) share the places that nearer
    ones leave, in equal parts, so the order of the labelled rows decides nothing.
    """
    k = min(k, len(vectors))
    cos = x @ vectors.T
    last = np.partition(cos, len(vectors) - k, axis=1)[:, len(vectors) - k]
    row, at = np.nonzero(cos >= (last - TIE)[:, None])  # hardly more than k a row
    near = cos[row, at]
    above = near > last[row] + TIE
    places = lambda which: np.bincount(row[which], minlength=len(x))
    share = (k - places(above)) / np.maximum(places(~above), 1)
    weight = np.where(above, 1, share[row]) * np.maximum(near, 0) ** 2
    total = lambda w: np.bincount(row, w, minlength=len(x))
    return (prior * labels.mean() + total(weight * labels[at])) / (prior + total(weight))


def latent_basis(x: np.ndarray, dimensions: int) -> np.ndarray:
    """Right singular vectors by a randomised range finder with two power steps."""
    rng = np.random.default_rng(11)
    k = min(dimensions + 8, *x.shape)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], k)).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(x @ np.linalg.qr(x.T @ q)[0])[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return vt[:dimensions].T


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> QualityModel | None:
    """Learn from the labels of rows that are not held out."""
    df, rows = document_frequencies(docs, BITS, features)
    idf = (np.log((1 + rows) / (1 + df)) + 1).astype(np.float32)
    marks = labels.where(F.col("quality").isNotNull() & ~held_out_column()).groupBy(F.col("doc_id").alias("labelled")).agg(F.avg("quality").alias("label"))
    some = sample_rows(marks, "labelled", fit_rows)  # the bounded sample
    known = docs.select(F.col("doc_id").alias("own_id"), "text").join(F.broadcast(some), F.col("own_id") == F.col("labelled")).groupBy("own_id", "label").agg(F.min("text").alias("text"))

    def learn(table: pa.Table) -> QualityModel | None:
        counts, marked = gathered(table)
        if not len(counts):
            return None
        x = weighted(counts.dense(1 << BITS), idf)
        centre = x.mean(axis=0)
        x -= centre
        basis = latent_basis(x, DIMENSIONS)
        return QualityModel(idf, centre, basis, unit(x @ basis), np.array(marked, dtype=np.float32))

    return fit_in_task(sparse_vectors(known, "label", features), learn)


def _scores(model: QualityModel | None, texts: list[str | None]) -> np.ndarray:
    out = np.full(len(texts), 0.5)
    if model:
        for c in range(0, len(texts), 256):
            out[c : c + 256] = np.clip(model.scores(np.stack([features(t) for t in texts[c : c + 256]])), 0, 1)
    return out


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FIT_ROWS

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch):
                out = _scores(held.value, texts_of(batch, a, b))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(out), pa.array((out >= ACCEPT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out_column().alias("held_out"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with the columns of ``docs``: one pass, without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))  # bounded by FIT_ROWS

    def run(batches):
        for batch in batches:
            for a, b in text_slices(batch):
                yield batch.slice(a, b - a).filter(pa.array(_scores(held.value, texts_of(batch, a, b)) >= ACCEPT))

    return docs.mapInArrow(run, docs.schema)
