"""Whitening of embeddings by the leading eigenvectors of their covariance.

1. Numbers and sums of the vectors: whole numbers, so exact in any order.
2. Covariance. A vector is centred by the exact mean before it is multiplied, and
   a task adds up the products of all its vectors; Spark adds up the tasks' entries.
3. Spectrum of that matrix, on the driver since its size is that of a vector:
   Householder reflections make it tridiagonal, counts of sign changes (Sturm)
   bisect for the leading eigenvalues, inverse iteration finds their vectors, those
   of one cluster orthogonal to one another, and the reflections carry them back.
4. The components go to all tasks, which project their vectors on them. What comes
   out is measured first (its covariance against the identity), then given out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE = 64.0
OFFSET = 1_000_000
#: Larger entries than this, which no embedding has, count as this.
LARGEST = float(1 << 40)
#: Numbers of a slice of vectors that is worked on at once.
SLICE = 1 << 20
#: Components whose variance is below this share of the whole have none but rounding, and are left out.
NO_VARIANCE = 1e-13


# -- eigenvectors ---------------------------------------------------------------


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, what is beside it, reflections as rows) of a symmetric matrix, by Householder."""
    a = np.array(v, float)
    n = len(a)
    mirrors = np.zeros((max(n - 2, 0), n))
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(length, x[0])
        u = x / np.linalg.norm(x)
        mirrors[k, k + 1 :] = u
        # H a H with H = 1 - 2uu' as one symmetric update
        p = a[k + 1 :, k + 1 :] @ u
        w = 2 * (p - (u @ p) * u)
        a[k + 1 :, k + 1 :] -= np.outer(u, w) + np.outer(w, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def sturm_count(d: np.ndarray, e: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each shift: the negative pivots of T - shift."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = d[0] - shifts
    n = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[k] - shifts - e[k - 1] ** 2 / q
        n += q < 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each between two numbers next to one another in double precision."""
    n = len(d)
    reach = np.concatenate((np.abs(e), [0])) + np.concatenate(([0], np.abs(e)))
    low, high = np.full(k, (d - reach).min()), np.full(k, (d + reach).max())
    low, high = low - 1e-12 * np.abs(low) - 1e-300, high + 1e-12 * np.abs(high) + 1e-300
    below = n - np.arange(k)  # the j-th largest is the first number with so many at or below it
    for _ in range(1100):
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            break
        more = sturm_count(d, e, middle) >= below
        high, low = np.where(more, middle, high), np.where(more, low, middle)
    return low + (high - low) / 2


def _solver(d: np.ndarray, e: np.ndarray, shift: float, least: float):
    """Solves (T - shift) y = b by elimination with row exchanges; pivots are at least ``least``."""
    n = len(d)
    rows = []  # (pivot, first and second above it, exchanged, multiplier)
    a, b, c = d[0] - shift, e[0] if n > 1 else 0.0, 0.0
    for k in range(n - 1):
        below, nxt, after = e[k], d[k + 1] - shift, e[k + 1] if k + 2 < n else 0.0
        exchanged = abs(below) > abs(a)
        if exchanged:
            a, b, c, below, nxt, after = below, nxt, after, a, b, c
        if abs(a) < least:
            a = least
        m = below / a
        rows.append((a, b, c, exchanged, m))
        a, b, c = nxt - m * b, after - m * c, 0.0
    rows.append((a if abs(a) >= least else least, 0.0, 0.0, False, 0.0))

    def solve(y: np.ndarray) -> np.ndarray:
        y = y.tolist()
        for k, (_, _, _, exchanged, m) in enumerate(rows[:-1]):
            if exchanged:
                y[k], y[k + 1] = y[k + 1], y[k]
            y[k + 1] -= m * y[k]
        for k in range(n - 1, -1, -1):
            a, b, c, _, _ = rows[k]
            y[k] = (y[k] - b * (y[k + 1] if k + 1 < n else 0.0) - c * (y[k + 2] if k + 2 < n else 0.0)) / a
        return np.array(y)

    return solve


def inverse_iteration(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of the tridiagonal matrix as columns, for eigenvalues that fall.

    Vectors of eigenvalues that are near to one another (a cluster) are made
    orthogonal to those before them in the cluster at every step.
    """
    n = len(d)
    norm = max(np.abs(d).max(initial=0), np.abs(e).max(initial=0), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    start = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > 1e-3 * norm:
            first = j
        # equal eigenvalues: shifts a little apart, so that each has a vector of its own
        shift = value if j == first else min(value, shift - 4 * eps * norm)
        solve = _solver(d, e, shift, eps * norm)
        cluster = out[:, first:j]
        y = start.standard_normal(n)
        for _ in range(6):
            y = y / np.abs(y).max()
            y = solve(y)
            for _ in range(3):  # what is left may be little, and is orthogonal only as far as that goes
                y /= np.linalg.norm(y)
                y -= cluster @ (cluster.T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def leading_eigenvectors(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(the k largest eigenvalues, falling; their unit eigenvectors as columns) of a symmetric matrix."""
    k = min(k, len(v))
    size = np.abs(v).max(initial=0)
    if not k or not size:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, mirrors = tridiagonal(v / size)
    values = leading_values(d, e, k)
    vectors = inverse_iteration(d, e, values)
    for u in mirrors[::-1]:
        vectors -= 2 * np.outer(u, u @ vectors)
    return values * size, vectors


# -- the data -------------------------------------------------------------------


@dataclass(frozen=True)
class Mean:
    """The mean of n vectors as whole numbers and what is over: S = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Mean:
        return cls(n, np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        return (x - self.whole) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum of (n * x - S)**2 of each vector, exact."""
        off = x - self.whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((self.n * off - self.rest) ** 2).sum(1).tolist()
        return [sum((self.n * a - r) ** 2 for a, r in zip(row, self.rest.tolist(), strict=True)) for row in off.tolist()]


@dataclass(frozen=True)
class Model:
    """What whitens the vectors of one width: projection = eigenvectors over the roots of the eigenvalues."""

    mean: Mean
    projection: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.projection


def whole_vectors(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, x of those rows) of the vectors of a batch that take part, in slices of bounded size."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    ends = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False).astype(float)  # a null is nan
    widths = np.diff(ends)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = (bad[ends[1:]] == bad[ends[:-1]]) & (widths > 0)
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    for width in np.unique(widths[good]).tolist():
        rows = np.flatnonzero(good & (widths == width))
        step = max(1, SLICE // width)
        for k in range(0, len(rows), step):
            own = rows[k : k + step]
            c = flat[ends[own][:, None] + np.arange(width)]
            yield width, own, np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + OFFSET


def _long_entries(found: dict[int, tuple[int, list]]) -> Iterator[pa.RecordBatch]:
    for width, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(sums, pa.int64())], ["width", "i", "n", "s"])


def means(vectors: DataFrame) -> dict[int, Mean]:
    """The mean of the vectors of each width; one row for each width and dimension reaches the driver."""

    def run(batches):
        found: dict[int, tuple[int, list]] = {}
        for batch in batches:
            for width, _, x in whole_vectors(batch):
                n, sums = found.get(width, (0, [0] * width))
                found[width] = n + len(x), [a + b for a, b in zip(sums, x.sum(0).tolist(), strict=True)]
        yield from _long_entries(found)

    added = vectors.select("embedding").mapInArrow(run, "width int, i int, n long, s long").groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    by_width: dict[int, dict[int, tuple[int, int]]] = {}
    for r in added.collect():
        by_width.setdefault(r["width"], {})[r["i"]] = (r["n"], int(r["s"]))
    return {width: Mean.of(own[0][0], [own[i][1] for i in range(width)]) for width, own in by_width.items()}


def _products(rows: DataFrame, centred, size_of) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(sums, sums of products) by width of what ``centred`` makes of x.

    A task gives one row for each entry of its matrices, Spark adds them up, and
    as many rows as the matrices have entries reach the driver.
    """

    def run(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for width, _, x in whole_vectors(batch):
                y = centred(width, x)
                own = np.vstack((y.T @ y, y.sum(0)))
                found[width] = found[width] + own if width in found else own
        for width, own in found.items():
            i, j = np.nonzero(np.tri(*own.shape, dtype=bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), width, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(own[i, j])], ["width", "i", "j", "s"])

    added = rows.select("embedding").mapInArrow(run, "width int, i int, j int, s double").groupBy("width", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for r in added.collect():
        width, i, j, s = r
        k = size_of(width)
        sums, products = out.setdefault(width, (np.zeros(k), np.zeros((k, k))))
        if i == k:
            sums[j] = s
        else:
            products[i, j] = products[j, i] = s
    return out


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """The model of each width, from all vectors that take part."""
    mean = means(vectors)
    shared = vectors.sparkSession.sparkContext.broadcast(mean)
    found = _products(vectors, lambda width, x: shared.value[width].centred(x), lambda width: width)
    models = {}
    for width, (_, products) in found.items():
        v = products / mean[width].n
        values, u = leading_eigenvectors(v, components)
        whole = np.trace(v)
        kept = values > NO_VARIANCE * whole
        models[width] = Model(mean[width], u[:, kept] / np.sqrt(values[kept]), values[kept] / whole if whole else values[kept])
    return models


def identity_errors(vectors: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """For each width how far the covariance of its whitened vectors is from the identity."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)
    found = _products(vectors, lambda width, x: shared.value[width].whiten(x), lambda width: models[width].projection.shape[1])
    out = {}
    for width, m in models.items():
        if m.projection.shape[1]:
            sums, products = found[width]
            mean = sums / m.mean.n  # nothing but rounding: the vectors were centred before
            out[width] = float(np.abs(products / m.mean.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each vector and component.

    Vectors that are null, empty, or hold a null or non-finite entry take no part.
    Rows of a null id, rows that share one and repeated rows are vectors of their
    own. Vectors of each width have a mean, a covariance and components of their
    own; n is then their number. There are as many components as ``components``,
    the width, or the dimensions in which the vectors differ at all: one without
    variance cannot be brought to unit variance. So equal vectors, a single one
    and an empty table give no rows. Other columns are dropped. deviation is null
    beyond 38 digits.
    """
    spark = vectors.sparkSession
    models = fit(vectors, components)
    errors = identity_errors(vectors, models)
    shared = spark.sparkContext.broadcast((models, errors))

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for width, rows, x in whole_vectors(batch):
                model = shared.value[0][width]
                k = model.projection.shape[1]
                if not k:
                    continue
                step = max(1, 8 * SLICE // (k * max(width, k)))
                for low in range(0, len(rows), step):
                    own, part = rows[low : low + step], x[low : low + step]
                    m = len(own)
                    deviation = pa.array([Decimal(v) if v < 10**38 else None for v in model.mean.deviation(part)], pa.decimal128(38, 0))
                    at = pa.array(np.repeat(np.arange(m), k))
                    columns = [
                        ids.take(pa.array(own)).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.mean.n, np.int64)), deviation.take(at),
                        pa.array(model.whiten(part).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, shared.value[1][width])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", *[c.split()[0] for c in WHITENED.split(", ")]])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, {WHITENED}")


def op12_householder_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all embeddings on their 32 leading components; a deviation beyond 64 bits is null there."""
    out = whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("vec_id", F.col("vec_id").cast("long")).withColumn("deviation", F.col("deviation").try_cast("long"))
