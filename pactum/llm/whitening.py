"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Rows of centred integers ``X`` (n by d) are never multiplied with each other.
Each step is one distributed pass for the pair of products ``X v`` and
``Xᵀ u``: tasks take packed blocks of rows, form their part of the new left
vector, take away what earlier left vectors hold of it, and add up its
products with the rows and with the earlier left vectors. A left vector is
kept as the ``d`` coefficients that make it from the rows (``u = X a``), so
that no column of length ``n`` is stored and a lost task is only run again.
Right vectors are orthogonalised on the driver, twice, against all before
(``d`` by ``d`` numbers at most); the coefficients of the left ones come from
``Uᵀ(X v) = (Xᵀ U)ᵀ v`` first and are corrected with the measured ``Uᵀ u``.
The singular value decomposition of the small bidiagonal matrix then gives
components and deviations.

The recursion ends after ``d`` steps, or as soon as the leading values have
converged *and* what is left of the trace is smaller than the last of them, so
that no further component, repeated ones included, can be among the leading.

Defined results: a row whose vector is null, or has a null, NaN or infinite
entry, is dropped; so is a row of another dimension than that of most rows
(the larger one of two equally frequent). Entries beyond ±2⁵¹ are taken as
these. Components without variance (deviation below 1e-12 of the largest) are
not returned, so an empty table, one row, or equal rows give no rows; there are
fewer than 8 where the data have fewer directions. Equal vectors have equal
results, repeated ids are rows of their own, a null id stays null, further
columns are ignored. ``deviation`` is exact and null where it exceeds a long;
``deviation_double`` holds it rounded always.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free, materialize, named, one_blas_thread

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Rows of a packed block: what one product handles at once.
BLOCK_ROWS = 4096
#: A component is returned if its singular value is above this part of the largest.
LEAST_DEVIATION = 1e-12
LARGEST = float(1 << 51)

_PACKED = "n long, wide boolean, x binary, sums array<decimal(38,0)>"


@dataclass
class Whitening:
    """Components by falling variance, and what rows are centred and scaled with."""

    n: int
    sums: list[int]  # per dimension, exact
    components: np.ndarray  # d by k, unit columns
    variances: np.ndarray  # k
    trace: float
    steps: int
    identity_error: float = 0.0

    @property
    def dimension(self) -> int:
        return len(self.sums)


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector can be used, with it as doubles in ``__v``."""
    entries = named(column).cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(finite).withColumn("__v", entries)


def dimension_of(rows: DataFrame) -> int:
    """The dimension of most rows; 0 without rows."""
    found = rows.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return found[0]["d"] if found else 0


def integers(batch: pa.RecordBatch, d: int, column: int) -> np.ndarray:
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype(np.int64) + SHIFT


def packed_blocks(rows: DataFrame, d: int) -> DataFrame:
    """The rows as blocks of integers, written once and read by every step."""

    def pack(batches):
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(integers(batch, d, 0))
                count += batch.num_rows
            while count >= BLOCK_ROWS:
                x = np.concatenate(held)
                yield block(x[:BLOCK_ROWS])
                held, count = [x[BLOCK_ROWS:]], count - BLOCK_ROWS
        if count:
            yield block(np.concatenate(held))

    def block(x: np.ndarray) -> pa.RecordBatch:
        wide = bool(np.abs(x).max() > 0x7FFFFFFF)
        # halves, so that no sum of a block can overflow
        sums = [Decimal((int(h) << 32) + int(low)) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
        return pa.RecordBatch.from_arrays([
            pa.array([len(x)], pa.int64()), pa.array([wide]), pa.array([x.astype("<i8" if wide else "<i4").tobytes()], pa.binary()),
            pa.array([sums], pa.list_(pa.decimal128(38, 0))),
        ], names=["n", "wide", "x", "sums"])

    return materialize(rows.where(F.size("__v") == d).select("__v").mapInArrow(pack, _PACKED), "vectors")


class Centre:
    """Centring without loss: the whole part of the mean is subtracted in integers, the rest in doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], object)
        self.part = np.array([(s % n) / n for s in sums], np.float64)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Per row the sum of ``(n x - S)²``: rounded, and exact where it fits in a long.

        Sums that are surely below 2⁶³ may be taken modulo 2⁶⁴; only those next to that limit need long integers.
        """
        rounded = (self.rows(x) ** 2).sum(axis=1) * float(self.n) ** 2
        with np.errstate(over="ignore"):
            y = (x - self.whole).astype(np.uint64) * np.uint64(self.n) - self.rest.astype(np.uint64)
            wrapped = (y * y).sum(axis=1, dtype=np.uint64)
        exact: list[int | None] = []
        for k, about in enumerate(rounded):
            if about < 2.0**63 * (1 - 1e-6):
                exact.append(int(wrapped[k]))
            elif about > 2.0**63 * (1 + 1e-6):
                exact.append(None)
            else:
                total = sum((self.n * (int(a) - int(w)) - r) ** 2 for a, w, r in zip(x[k], self.whole, self.rest, strict=True))
                exact.append(total if total < 1 << 63 else None)
        return rounded, exact


def blocks_of(batches, d: int):
    for batch in batches:
        for wide, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield np.frombuffer(x.as_buffer(), "<i8" if wide else "<i4").reshape(-1, d).astype(np.int64)


def summed(packed: DataFrame, d: int, parts) -> np.ndarray:
    """The sum over all blocks of what ``parts`` makes of a block: an array of fixed length.

    A task sends one array; arrays are added in Spark, and only their sum comes to the driver.
    """

    def run(batches):
        total = None
        with one_blas_thread():
            for x in blocks_of(batches, d):
                one = parts(x)
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    found = packed.select("wide", "x").mapInArrow(run, "part array<double>").select(F.posexplode("part")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
    out = np.zeros(len(found))
    for pos, s in found:
        out[pos] = s
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> Whitening | None:
    """The leading components of all usable vectors; None where no direction has variance."""
    rows = usable(vectors, column)
    d = dimension_of(rows)
    if d == 0:
        return None
    packed = packed_blocks(rows, d)
    try:
        n = packed.agg(F.sum("n")).first()[0]
        sums = [int(r["s"]) for r in packed.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("s")).orderBy("pos").collect()]
        centre = Centre(n, sums)
        model = bidiagonalise(packed, centre, sums, components)
        if model is not None:
            model.identity_error = identity_error(packed, centre, model)
        return model
    finally:
        free(packed)


def bidiagonalise(packed: DataFrame, centre: Centre, sums: list[int], components: int) -> Whitening | None:
    n, d = centre.n, len(sums)
    total = float(summed(packed, d, lambda x: np.array([(centre.rows(x) ** 2).sum()]))[0])
    if total <= 0:
        return None
    tiny = 1e-13 * np.sqrt(total)
    rng = np.random.default_rng(d)

    def orthogonal(v: np.ndarray, to: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - to @ (to.T @ v)
        return v

    def fresh(to: np.ndarray) -> np.ndarray:
        v = orthogonal(rng.standard_normal(d), to)
        return v / np.linalg.norm(v)

    right = fresh(np.zeros((d, 0)))[:, None]  # v_1, v_2, ... as columns
    left = np.zeros((d, 0))  # a_1, a_2, ...: u = X a
    back = np.zeros((d, 0))  # Xᵀ u_1, Xᵀ u_2, ...
    alphas: list[float] = []
    betas: list[float] = []
    while True:
        k, v = len(alphas), right[:, -1]
        a = v - left @ (back.T @ v)

        def step(x, a=a, left=left):
            rows = centre.rows(x)
            u = rows @ a
            return np.concatenate([[u @ u], (rows @ left).T @ u, rows.T @ u])

        found = summed(packed, d, step)
        again = found[1 : 1 + k]  # what rounding left of the earlier left vectors
        alpha = float(np.sqrt(max(found[0] - again @ again, 0.0)))
        if alpha > tiny:
            u_back = (found[1 + k :] - back @ again) / alpha
            left = np.column_stack([left, (a - left @ again) / alpha])
            back = np.column_stack([back, u_back])
            rest = orthogonal(u_back - alpha * v, right)
            beta = float(np.linalg.norm(rest))
        else:  # the rows have nothing more in the span of the right vectors
            alpha = beta = 0.0
            left, back = np.column_stack([left, np.zeros(d)]), np.column_stack([back, np.zeros(d)])
        alphas.append(alpha)
        if beta <= tiny:
            beta = 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        p, s, qt = np.linalg.svd(small)
        if len(alphas) == d:
            break
        lead = min(components, len(s))
        settled = len(s) >= components and np.all(beta * np.abs(p[-1, :lead]) <= 1e-15 * s[0])
        if settled and total - float(s @ s) < s[lead - 1] ** 2 * (1 - 1e-9):
            break
        if total - float(s @ s) <= 1e-24 * total:
            break
        betas.append(beta)
        right = np.column_stack([right, rest / beta if beta else fresh(right)])
    keep = [j for j in range(min(components, len(s))) if s[j] > LEAST_DEVIATION * s[0]]
    vectors = right @ qt.T[:, keep]
    vectors /= np.linalg.norm(vectors, axis=0)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(keep))])
    return Whitening(n, sums, vectors, s[keep] ** 2 / n, total / n, len(alphas))


def identity_error(packed: DataFrame, centre: Centre, model: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, measured over all rows."""
    k = len(model.variances)
    onto = model.components / np.sqrt(model.variances)

    def products(x):
        z = centre.rows(x) @ onto
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = summed(packed, model.dimension, products) / model.n
    mean = found[:k]
    return float(np.abs(found[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening | None, column: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per usable vector and component."""
    id_type = vectors.schema[vec_id].dataType
    schema = T.StructType([
        T.StructField("vec_id", id_type), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()), T.StructField("deviation_double", T.DoubleType()),
    ])
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    d, k = model.dimension, len(model.variances)

    def run(batches):
        centre = Centre(model.n, model.sums)
        onto = model.components / np.sqrt(model.variances)
        with one_blas_thread():
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    x = integers(part, d, 1)
                    rounded, exact = centre.deviations(x)
                    rows = len(x)
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).take(pa.array(np.repeat(np.arange(rows), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, np.int64)),
                        pa.array([e for e in exact for _ in range(k)], pa.int64()), pa.array((centre.rows(x) @ onto).ravel()),
                        pa.array(np.tile(model.variances / model.trace, rows)), pa.array(np.full(rows * k, model.identity_error)), pa.array(np.repeat(rounded, k)),
                    ], names=schema.names)

    rows = usable(vectors, column).where(F.size("__v") == d)
    return rows.select(named(vec_id).alias("vec_id"), "__v").mapInArrow(run, schema)
