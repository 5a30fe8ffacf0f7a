"""Embedding whitening by matrix-free block Lanczos.

Entries become integers, floor(SCALE * c), so counts, sums and deviations are exact.  (A
constant added to every entry, such as 1,000,000, changes none of the results, as all of
them are of centred values; it is left out.)  The covariance is never formed: a pass over
the table gives, for a thin block Q, the sum over all vectors of x (x' Q) with x centred
before it is multiplied.  Tasks add up their own vectors, and Spark adds the tasks' sums
by dimension.

On the driver, blocks are orthogonalised twice against all earlier ones.  The basis's
images are kept, so Rayleigh-Ritz values and true residuals cost no pass.  It ends when
the wanted residuals are at rounding level and the trace that the basis leaves over is
below the least wanted value, so that nothing larger can have been missed, or when the
basis fills the space.  Where a block loses rank, which an invariant subspace or equal
eigenvalues bring about, random directions take the lost columns' places.

The driver holds matrices of dimensions x dimensions at most (DIMS bounds them), never
vectors.  The integers are written once, packed, to the shared folder; every pass reads
those files, so no lost executor can change what was fitted.

Edge cases: vectors that are null or hold null, NaN or infinite entries are dropped, and
so are those whose length is not the commonest (of equally common ones, the longest);
integers beyond 2^62 are held there; directions whose eigenvalue is at most RANK of the
largest carry no variance and get no component, so a single vector, equal vectors, empty
vectors and an empty table give no rows; fewer dimensions than components give as many
components as there are; null and repeated ids are kept; repeated vectors count as often
as they occur; equal eigenvalues give one orthonormal choice, the same for all rows;
other columns are not read and may have any name; a deviation of over 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaver.llm.shared import map_arrow, materialise

SCALE, COMPONENTS, BLOCK, SEED = 64, 32, 16, 11
#: Residuals and eigenvalues, as shares of the largest eigenvalue, that count as converged and as none.
CONVERGED, RANK = 1e-13, 1e-10
#: Most dimensions (the driver's matrices), largest integer, vectors that a task works on at once.
DIMS, MOST, ROWS = 8192, 1 << 62, 2048
WIDTHS = ((1 << 15, "<i2"), (1 << 31, "<i4"), (1 << 63, "<i8"))


def integers(c: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * c) of finite doubles, held to what 64 bits can take."""
    return np.clip(np.floor(c * scale), -float(MOST), float(MOST)).astype(np.int64)


def packed(df: DataFrame, id: str, vector: str, scale: float) -> tuple[DataFrame, int]:
    """(id, packed floor(scale * entry) little-endian, in the least width of its batch) of the vectors that count; their length."""
    v = F.col(vector)
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    good = df.select(F.col(id).alias("_id"), v.cast("array<double>").alias("_v")).where(v.isNotNull() & finite)
    size = good.groupBy(F.size("_v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = size["size"] if size else 0
    if dims > DIMS:
        raise ValueError(f"vectors of {dims} entries; the driver's matrices allow {DIMS}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = integers(b.column(1).flatten().to_numpy(zero_copy_only=False), scale)
            most = int(np.abs(x).max(initial=0))
            kind = next(k for limit, k in WIDTHS if most < limit)
            raw, step = x.astype(kind).tobytes(), dims * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([raw[i * step : (i + 1) * step] for i in range(b.num_rows)], pa.binary())], ["_id", "_x"])

    schema = T.StructType([T.StructField("_id", df.schema[id].dataType), T.StructField("_x", T.BinaryType())])
    return materialise(map_arrow(good.where(F.size("_v") == dims), run, schema), "vectors"), dims


def rows(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of runs of at most ROWS vectors of one width."""
    column = batch.column(batch.num_columns - 1)
    if not dims or not len(column):
        return
    sizes = np.array([len(x) for x in column.to_pylist()])
    cuts = np.flatnonzero(np.diff(sizes, prepend=-1))
    for a, z in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
        for i in range(a, z, ROWS):
            part = column.slice(i, min(ROWS, z - i)).to_pylist()
            yield i, np.frombuffer(b"".join(part), f"<i{sizes[a] // dims}").reshape(len(part), dims).astype(np.int64)


@dataclass
class Whitening:
    """What a fit found.  ``sums``: exact, of the integers, by dimension."""

    dims: int
    n: int
    sums: list[int]
    trace: float = 0.0
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    residuals: np.ndarray = field(default_factory=lambda: np.zeros(0))
    passes: int = 0
    restarts: int = 0

    def __post_init__(self) -> None:
        # integers are taken from a whole number near the mean: n x - S stays the same and small
        self.near = [(2 * s + self.n) // (2 * self.n) if self.n else 0 for s in self.sums]
        self.rest = [s - self.n * c for s, c in zip(self.sums, self.near, strict=True)]
        self._near, self._rest = np.array(self.near, object), np.array(self.rest, object)

    def _shifted(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """x and S about the near mean; whether n x - S and its parts fit 64 bits."""
        near = max(map(abs, self.near), default=0)
        if near + int(np.abs(x).max(initial=0)) < MOST:
            x = x - self._near.astype(np.int64)
            most = int(np.abs(x).max(initial=0))
            if self.dims * most * max(most, self.n) < MOST:  # |S| <= n here
                return x, self._rest.astype(np.int64), True
            return x.astype(object), self._rest, False
        return x.astype(object) - self._near, self._rest, False

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles, from the exact n x - S."""
        y, rest, small = self._shifted(x)
        d = self.n * y - rest
        return d / float(self.n) if small else (d / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The exact sum over dimensions of (n x - S)^2, by row."""
        y, rest, _ = self._shifted(x)
        square, cross, own = (y * y).sum(axis=1).tolist(), (y * rest).sum(axis=1).tolist(), sum(r * r for r in self.rest)
        n = self.n
        return [n * n * a - 2 * n * b + own for a, b in zip(square, cross, strict=True)]

    @property
    def weights(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _sums(table: DataFrame, width: int, function: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> dict[int, np.ndarray]:
    """Every task's matrix (rows x width), added over all tasks by row; row numbers start at 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = function(batches)
        if got is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), *(pa.array(np.ascontiguousarray(got[:, j])) for j in range(width))], ["i", *(f"c{j}" for j in range(width))])

    parts = map_arrow(table, run, "i int, " + ", ".join(f"c{j} double" for j in range(width)))
    return {r[0]: np.array(r[1:]) for r in parts.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).collect()}


def moments(table: DataFrame, dims: int) -> Whitening:
    """Exact count and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            for _, x in rows(b, dims):
                n += len(x)
                high += (x >> 31).sum(axis=0)
                low += (x & 0x7FFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()), pa.array(high), pa.array(low)], ["i", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(28,0)"))
    got = map_arrow(table, run, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n"), wide("high"), wide("low")).orderBy("i").collect() if dims else []
    return Whitening(dims, int(got[0][1]) if got else 0, [(int(r[2]) << 31) + int(r[3]) for r in got] if got and got[0][1] else [0] * dims)


def product(table: DataFrame, fit: Whitening, q: np.ndarray) -> tuple[np.ndarray, float]:
    """(V q, trace of V) of the covariance V, in one pass."""
    width, shared = q.shape[1], table.sparkSession.sparkContext.broadcast((fit, q))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own, block = shared.value
        out, square = np.zeros((own.dims + 1, width)), float(own.n) ** 2
        for b in batches:
            for _, x in rows(b, own.dims):
                c = own.centred(x)
                out[:-1] += c.T @ (c @ block)
                out[-1, 0] += sum(d / square for d in own.deviations(x))
        return out

    got = _sums(table, width, run)
    shared.destroy()
    y = np.array([got[i] for i in range(fit.dims)]) / fit.n
    return y, float(got[fit.dims][0]) / fit.n


def _outside(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    return block


def extend(block: np.ndarray, basis: np.ndarray, scale: float, width: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Orthonormal columns beside the basis: the block's own directions, random ones for those it lost; how many are random."""
    u, s, _ = np.linalg.svd(_outside(block, basis), full_matrices=False)
    own = u[:, s > CONVERGED * scale * 10][:, :width]
    lost = width - own.shape[1]
    if lost:
        own = np.hstack([own, _outside(rng.standard_normal((len(basis), lost)), np.hstack([basis, own]))])
    return np.linalg.qr(_outside(own, basis))[0], lost


def lanczos(apply: Callable[[np.ndarray], tuple[np.ndarray, float]], fit: Whitening, wanted: int, block: int, seed: int) -> None:
    """Puts the largest eigenvalues and their vectors into ``fit``."""
    rng, dims = np.random.default_rng(seed), fit.dims
    basis = image = np.zeros((dims, 0))
    new = np.linalg.qr(rng.standard_normal((dims, min(block, dims))))[0]
    while True:
        own, fit.trace = apply(new)
        fit.passes += 1
        basis, image = np.hstack([basis, new]), np.hstack([image, own])
        t = basis.T @ image
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        k = min(wanted, len(values))
        scale = max(float(values[0]), np.finfo(float).tiny)
        fit.residuals = np.linalg.norm(image @ turn[:, :k] - (basis @ turn[:, :k]) * values[:k], axis=0)
        left = fit.trace - float(values.sum())
        done = k == min(wanted, dims) and fit.residuals.max() <= CONVERGED * scale * np.sqrt(dims) and left < values[k - 1]
        if done or len(values) == dims:
            break
        new, lost = extend(own, basis, scale, min(block, dims - len(values)), rng)
        fit.restarts += lost > 0
    real = values[:k] > RANK * scale
    fit.values, fit.vectors = values[:k][real], (basis @ turn[:, :k])[:, real]


def fit_whitening(table: DataFrame, dims: int, *, components: int = COMPONENTS, block: int = BLOCK, seed: int = SEED) -> Whitening:
    """The components of the packed vectors' covariance (divisor n), by falling eigenvalue."""
    fit = moments(table, dims)
    if fit.n and dims:
        lanczos(lambda q: product(table, fit, q), fit, components, block, seed)
    return fit


def identity_error(table: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, measured over the table."""
    k = len(fit.values)
    if not k:
        return 0.0
    shared = table.sparkSession.sparkContext.broadcast((fit, fit.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        own, w = shared.value
        out = np.zeros((k + 1, k))
        for b in batches:
            for _, x in rows(b, own.dims):
                z = own.centred(x) @ w
                out[:-1] += z.T @ z
                out[-1] += z.sum(axis=0)
        return out

    got = _sums(table, k, run)
    shared.destroy()
    mean = got[k] / fit.n
    return float(np.abs(np.array([got[i] for i in range(k)]) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], pa.decimal128(38, 0))


def whiten(table: DataFrame, fit: Whitening, id: str = "vec_id") -> DataFrame:
    """A row for each packed vector and component: ``id``, component, deviation, whitened, explained."""
    k, kind = len(fit.values), table.schema["_id"].dataType
    shared = table.sparkSession.sparkContext.broadcast((fit, fit.weights, fit.values / (fit.trace or 1.0)))
    names = [id, "component", "deviation", "whitened", "explained"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w, share = shared.value
        for b in batches:
            for i, x in rows(b, own.dims if k else 0):
                each = pa.array(np.repeat(np.arange(len(x)), k))
                columns = [b.column(0).slice(i, len(x)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), _decimals(own.deviations(x)).take(each)]
                columns += [pa.array((own.centred(x) @ w).ravel()), pa.array(np.tile(share, len(x)))]
                yield pa.RecordBatch.from_arrays(columns, names)

    types = [kind, T.IntegerType(), T.DecimalType(38, 0), T.DoubleType(), T.DoubleType()]
    return map_arrow(table, run, T.StructType([T.StructField(n, t) for n, t in zip(names, types, strict=True)]))


def q_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of embeddings, whitened; a deviation beyond a long is null."""
    table, dims = packed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SCALE)
    fit = fit_whitening(table, dims)
    error = identity_error(table, fit)
    return whiten(table, fit).select("vec_id", "component", F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation as bigint)").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))
