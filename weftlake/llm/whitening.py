"""Embedding whitening from a bit-sliced scatter.

An entry ``c`` of a vector becomes the whole number ``x = floor(256 * c)``; each
distinct vector of these counts once in the fit.  A task takes rows in batches,
shifts each dimension by its smallest value there and cuts the shifted numbers
into bit planes: plane ``b`` of dimension ``j`` packs bit ``b`` of all rows into
64-bit words.  The sum of products of two dimensions is then the sum over their
planes of ``2**(a + b)`` times the number of ones in the AND of two planes, an
exact whole number; the shifts are added back exactly.  A task sends on one row
for each pair of dimensions, in limbs of 32 bits whose sums cannot overflow.

The summed scatter ``X`` and sums ``S`` of ``n`` vectors are a table of
dimensions squared, the size of the model.  It is centred as whole numbers,
``n * X - S * S'``, divided by ``n * n`` only then, and decomposed; the vectors
themselves stay in Spark.  How far the whitened fit vectors are from unit
covariance is measured on them in a pass of its own.

Defined results: vectors that are null, empty or hold null or non-finite entries
give no rows, and neither do vectors with an entry of 2**53 or more either way, whose
whole numbers, and their differences, need not fit a long; vectors of each length
are fitted among themselves; every row that takes part gives its components,
rows with one id or none too; fewer dimensions than ``components`` give fewer
rows; a component without variance has a null ``whitened``, and ``explained`` is
null where no component has any; a ``deviation`` beyond a long is null; other
columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE = 256
COMPONENTS = 4
#: Rows cut into planes at once.
BATCH = 8192
LIMBS = 5
#: Entries from here on are not taken: differences of 256 times them might leave a long.
LARGEST = float(1 << 53)
#: Eigenvalues below this share of the largest are those of a component without variance.
FLAT = 1e-13


def planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(dimension, bit, word) of whole numbers >= 0 (rows, dimensions): each bit of all rows packed into words."""
    rows, dims = shifted.shape
    out = np.zeros((dims, bits, -(-rows // 64)), np.uint64)
    for b in range(bits):
        packed = np.packbits(((shifted >> b) & 1).astype(np.uint8).T, axis=1)
        out[:, b].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def scatter(x: np.ndarray) -> np.ndarray:
    """Sums of products of all pairs of columns of whole numbers, exact (Python integers)."""
    rows, dims = x.shape
    total = np.zeros((dims, dims), object)
    if not rows:
        return total
    low = x.min(0)
    shifted = x - low
    bits = max(1, int(shifted.max()).bit_length())
    cut = planes(shifted, bits).reshape(dims * bits, -1)
    ones = np.zeros((dims * bits, dims * bits), np.int64)
    for p in range(len(cut)):
        ones[p, p:] = np.bitwise_count(cut[p] & cut[p:]).sum(1)
    ones = np.triu(ones) + np.triu(ones, 1).T
    weight = np.array([1 << b for b in range(bits)], np.int64 if 2 * bits + rows.bit_length() < 63 else object)
    total = np.einsum("iajb,a,b->ij", ones.reshape(dims, bits, dims, bits), weight, weight, optimize=weight.dtype != object)
    low, sums = low.astype(object), shifted.sum(0, dtype=object) if bits > 40 else shifted.sum(0).astype(object)
    shift = np.outer(low, sums)
    return total.astype(object) + shift + shift.T + rows * np.outer(low, low)


def limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as LIMBS longs of 32 bits, the last one signed."""
    out = []
    for _ in range(LIMBS - 1):
        out.append((values & 0xFFFFFFFF).astype(np.int64))
        values = values >> 32
    return [*out, values.astype(np.int64)]


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_SUMS = "i int, j int, n long, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def _partial_sums(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (i, j) of the scatter, with j = -1 for the sums of dimension i."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((width, width), object), np.zeros(width, object), 0
        for batch in batches:
            every = _vectors(batch.column(0), width)
            for at in range(0, len(every), BATCH):
                x = every[at : at + BATCH]
                total, first, n = total + scatter(x), first + x.sum(0, dtype=object), n + len(x)
        if n:
            i, j = np.triu_indices(width)
            values = np.concatenate([total[i, j], first])
            i, j = np.concatenate([i, np.arange(width)]), np.concatenate([j, np.full(width, -1)])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), n)), *map(pa.array, limbs(values))], names=["i", "j", "n", *(f"l{k}" for k in range(LIMBS))])

    return sums


class Model:
    """Whitening of whole-number vectors of one length: n, sums, components, eigenvalues, shares, error."""

    def __init__(self, n: int, sums: np.ndarray, products: np.ndarray, components: int = COMPONENTS) -> None:
        self.n, self.sums, self.error = n, sums, None
        centred = n * products - np.outer(sums, sums)  # whole numbers
        # divided only here; n * n first keeps the quotient of two whole numbers correctly rounded
        covariance = np.array([[int(v) / (n * n) for v in row] for row in centred])
        size = np.abs(covariance).max() or 1.0
        values, vectors = np.linalg.eigh(covariance / size)
        order = np.argsort(-values, kind="stable")[:components]
        self.vectors, values = vectors[:, order], values[order]
        self.variance = np.where(values > max(values[0], 0) * FLAT, values, 0.0) * size
        trace = sum(int(v) for v in np.diag(centred)) / (n * n)
        self.explained = self.variance / trace if trace else None

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """Rows by components; NaN for a component without variance."""
        centred = (self.n * x.astype(object) - self.sums).astype(np.float64) if self._wide(x) else (self.n * x - self.sums.astype(np.int64)).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variance > 0, centred / self.n @ self.vectors / np.sqrt(self.variance), np.nan)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n * x - S) squared, null beyond a long."""
        if self._wide(x):
            far = self.n * x.astype(object) - self.sums
            return [int(v) if v < 1 << 63 else None for v in (far * far).sum(1)]
        far = self.n * x - self.sums.astype(np.int64)
        return (far * far).sum(1).tolist()

    def _wide(self, x: np.ndarray) -> bool:
        """Whether squares of n * x - S might leave a long."""
        most = 2 * self.n * max(int(np.abs(x).max(initial=0)), int(np.abs(self.sums).max()) // self.n + 1)
        return most * most * x.shape[1] >= 1 << 62


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Model | None:
    """The model of a stored table of distinct vectors x (array<long>) of one length."""
    table = distinct.select("x").mapInArrow(_partial_sums(width), _SUMS).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", *(f"l{k}" for k in range(LIMBS)))])
    got = table.toArrow()  # width * (width + 3) / 2 rows
    if not len(got):
        return None
    column = lambda c: got.column(c).to_numpy()
    values = sum(column(f"l{k}").astype(object) << (32 * k) for k in range(LIMBS))
    i, j = column("i"), column("j")
    products, sums = np.zeros((width, width), object), np.zeros(width, object)
    one = j < 0
    sums[i[one]] = values[one]
    products[i[~one], j[~one]] = values[~one]
    products[j[~one], i[~one]] = values[~one]
    model = Model(int(column("n")[0]), sums, products, components)
    model.error = _measured(distinct, model, width)
    return model


def _measured(distinct: DataFrame, model: Model, width: int) -> float | None:
    """The largest entry of the whitened fit vectors' covariance less the identity, from a pass over them."""
    live = np.flatnonzero(model.variance > 0)
    if not len(live):
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = model.whiten(_vectors(batch.column(0), width))[:, live]
            full = np.concatenate([y.sum(0), (y.T @ y).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(full)), pa.int32()), pa.array(full)], names=["k", "s"])

    k = len(live)
    got = dict(distinct.select("x").mapInArrow(moments, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect())  # k * (k + 1) rows
    full = np.array([got[i] for i in range(k * (k + 1))]) / model.n
    return float(np.abs(full[k:].reshape(k, k) - np.outer(full[:k], full[:k]) - np.eye(k)).max())


_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _projected(model: Model, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(1), width)
            y = model.whiten(x)
            m, k = y.shape
            explained = [None] * k if model.explained is None else model.explained.tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, model.n, np.int64)),
                    pa.array(model.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(y.ravel(), from_pandas=True),
                    pa.array(explained * m, pa.float64()),
                    pa.array([model.error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return project


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that takes part."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter("v is not null and size(v) > 0").filter(F.forall("v", lambda c: F.coalesce(F.abs(c) < F.lit(LARGEST), F.lit(False))))
    rows = materialize(rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("x")), "whole")
    distinct = materialize(rows.select("x").distinct(), "distinct")
    lengths = [r["d"] for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]  # a few lengths
    out = rows.sparkSession.createDataFrame([], _SCHEMA)
    for d in lengths:
        model = fit(distinct.filter(F.size("x") == d), d, components)
        out = out.unionByName(rows.filter(F.size("x") == d).mapInArrow(_projected(model, d), _SCHEMA))
    return out
