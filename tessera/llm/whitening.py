"""Operator 13: whitening of embeddings by an incremental eigendecomposition.

Components become integers, floor(scale * c).  The distinct vectors are fitted:

* every partition keeps the spectrum (mean, eigenvalues and eigenvectors of the
  scatter matrix) of its vectors and updates it by centred rank-one terms.  An
  update solves the secular equation for the new eigenvalues, each relative to its
  nearer old one, after *deflation*: equal eigenvalues are reflected so that one of
  them meets the term, and eigenvalues whose part in the term is negligible stay.
  A block of rows is first shrunk to its triangular factor, so that it costs as
  many rank-one terms as there are dimensions, however many rows it has;
* spectra are combined by successive rank-one updates, one for each eigenvector of
  the other spectrum and one for the distance of the means, in a tree of three
  levels with a fan-in of ``FAN_IN``;
* a last pass over the distinct vectors takes their covariance within the
  eigenvectors found, and its small eigenproblem turns these to the final ones
  (Rayleigh-Ritz), which removes the rounding of the updates.

Each spectrum is two matrices of the dimension squared, whatever the number of
rows.  Only distinct vectors (once) and spectra are shuffled.

Defined results: vectors that are null, or hold null or non-finite components, are
dropped.  Vectors of unlike dimension go on with zeros up to the longest.  Rows
that repeat a vector, an id or a null id keep a result each, and the fit takes the
vector once.  A component whose eigenvalue is zero (within rounding) cannot be
whitened and is left out, so a single distinct vector and an empty table give no
rows.  Components are oriented so that their greatest entry is positive.  A
deviation beyond the range of a bigint is null.  Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, stored

BLOCK_ROWS = 4096  # vectors that are shrunk to their triangular factor together
FAN_IN = 64  # spectra combined by one task
EPS = float(np.finfo(float).eps)


# ------------------------------------------------------- rank-one updates


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) for rising distinct poles and
    positive weights: for each root its pole of reference and the distance to it.

    Root i lies between poles i and i + 1 (the last one within the sum of the
    weights).  All are iterated together by interpolating the two sums with
    one pole each, within a bracket that bisection shrinks where that fails."""
    n = len(poles)
    upper = np.append(poles[1:], poles[-1] + weights.sum())
    width = upper - poles
    # which pole is nearer: the sign in the middle; the last root is seen from its own
    middle = 1 + (weights / (poles - (poles + width / 2)[:, None])).sum(axis=1)
    near = np.where((middle >= 0) | (np.arange(n) == n - 1), np.arange(n), np.arange(n) + 1)
    gaps = poles[None, :] - poles[near][:, None]  # root's row: all poles from its own
    left, right = poles - poles[near], upper - poles[near]
    low = np.where(near == np.arange(n), 0.0, -width / 2)
    high = np.where(near == np.arange(n), np.where(np.arange(n) == n - 1, width, width / 2), 0.0)
    x = (low + high) / 2
    below = np.arange(n)[None, :] <= np.arange(n)[:, None]
    with np.errstate(all="ignore"):
        for _ in range(200):
            part = weights / (gaps - x[:, None])
            slope = part / (gaps - x[:, None])
            f = 1 + part.sum(axis=1)
            low, high = np.where(f < 0, x, low), np.where(f > 0, x, high)
            done = (np.abs(f) <= 2 * n * EPS * (1 + np.abs(part).sum(axis=1))) | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))
            if done.all():
                break
            to_left, to_right = left - x, right - x
            rises, falls = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
            c = f - to_left * rises - to_right * falls
            a = (to_left + to_right) * f - to_left * to_right * (rises + falls)
            b = to_left * to_right * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = x + step
            new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
            x = np.where(done, x, new)
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of vectors * values * vectors' plus
    the outer product of ``term``."""
    z = vectors.T @ term
    size = float(z @ z)
    if size == 0.0:
        return values, vectors
    tolerance = 8 * EPS * max(float(values[-1]), size)
    vectors = vectors.copy()
    # equal eigenvalues: one reflection leaves the term in the first of them
    start = 0
    for end in np.append(np.flatnonzero(np.diff(values) > tolerance) + 1, len(values)).tolist():
        # a chain of close values is cut where it strays from its first
        while start < end:
            stop = start + int(np.searchsorted(values[start:end], values[start] + tolerance, side="right"))
            if stop - start > 1:
                u = z[start:stop].copy()
                norm = float(np.sqrt(u @ u))
                if norm > 0:
                    u[0] += norm if u[0] >= 0 else -norm
                    u /= np.sqrt(u @ u)
                    own = vectors[:, start:stop]
                    vectors[:, start:stop] = own - 2 * np.outer(own @ u, u)
                    z[start:stop] -= 2 * u * (u @ z[start:stop])
                    z[start + 1 : stop] = 0.0
            start = stop
    live = np.flatnonzero(np.abs(z) * np.sqrt(size) > tolerance)
    if not len(live):
        return values, vectors
    d, w = values[live], z[live]
    near, x = secular_roots(d, w * w)
    # distances of all roots (rows) to all poles (columns)
    apart = (d[near][:, None] - d[None, :]) + x[:, None]
    # the term for which the roots are exact, so that the vectors are orthogonal
    ratio = np.ones_like(apart)
    n = len(d)
    row, column = np.indices((n, n))
    np.divide(apart, d[:, None] - d[None, :], out=ratio, where=row < column)
    np.divide(apart, np.append(d[1:], 0.0)[:, None] - d[None, :], out=ratio, where=(row >= column) & (row < n - 1))
    ratio[-1] = apart[-1]
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) * np.sign(w)
    turn = exact[:, None] / -apart.T
    turn /= np.sqrt((turn * turn).sum(axis=0))
    values = values.copy()
    values[live] = d[near] + x
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return np.maximum(values[order], 0.0), vectors[:, order]


@dataclass
class Spectrum:
    """Number, sums and scatter matrix, as eigenvalues and vectors, of rows."""

    n: int
    sums: np.ndarray  # Python integers: exact
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, width: int) -> Spectrum:
        return cls(0, np.zeros(width, object), np.zeros(width), np.eye(width))

    def mean(self) -> np.ndarray:
        return (self.sums / self.n).astype(float)

    def _joined(self, n: int, sums: np.ndarray, terms: np.ndarray) -> None:
        """Add ``n`` rows: the rows of ``terms`` make their scatter matrix."""
        terms = [t for t in terms if t.any()]
        if self.n:
            apart = (self.sums / self.n - sums / n).astype(float)
            terms.append(apart * np.sqrt(self.n * n / (self.n + n)))
        for t in terms:
            self.values, self.vectors = rank_one(self.values, self.vectors, t)
        self.n, self.sums = self.n + n, self.sums + sums

    def add_rows(self, rows: np.ndarray) -> None:
        """Integer rows, block by block."""
        for at in range(0, len(rows), BLOCK_ROWS):
            block = rows[at : at + BLOCK_ROWS]
            sums = exact_sums(block)
            centred = block - (sums / len(block)).astype(float)
            if len(block) > block.shape[1]:
                centred = np.linalg.qr(centred, mode="r")
            self._joined(len(block), sums, centred)

    def add(self, other: Spectrum) -> None:
        if other.n:
            self._joined(other.n, other.sums, (other.vectors * np.sqrt(other.values)).T[::-1])

    FIELDS = "n bigint, sums array<string>, eigenvalues array<double>, eigenvectors array<double>"

    def columns(self) -> dict[str, pa.Array]:
        return {
            "n": pa.array([self.n], pa.int64()),
            "sums": pa.array([[str(s) for s in self.sums]], pa.list_(pa.string())),
            "eigenvalues": pa.array([self.values], pa.list_(pa.float64())),
            "eigenvectors": pa.array([self.vectors.ravel()], pa.list_(pa.float64())),
        }

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        width = len(row["sums"])
        return cls(row["n"], np.array([int(s) for s in row["sums"]], object), np.array(row["eigenvalues"], float), np.array(row["eigenvectors"], float).reshape(width, width))


def exact_sums(rows: np.ndarray) -> np.ndarray:
    """Column sums as Python integers."""
    most = max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0))))
    if most * max(1, len(rows)) < 1 << 62:
        return np.array([int(s) for s in rows.sum(axis=0)], object)
    return rows.astype(object).sum(axis=0)


# ------------------------------------------------------------ Spark operators


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("bigint"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer rows, with zeros up to ``width``."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


@dataclass
class Whitening:
    """The fitted components, most variance first, as columns of ``components``."""

    n: int
    sums: np.ndarray
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float = 0.0

    def mean(self) -> np.ndarray:
        return (self.sums / max(1, self.n)).astype(float)

    def project(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean()) @ self.components) / np.sqrt(self.eigenvalues)

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Sums of squares of n * x - sums, exactly."""
        big = max([abs(int(s)) for s in self.sums], default=0)
        most = self.n * max(abs(int(rows.max(initial=0))), abs(int(rows.min(initial=0)))) + big
        if most * most * max(1, rows.shape[1]) < 1 << 63:
            return ((self.n * rows - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        off = self.n * rows.astype(object) - self.sums
        return [x if x < 1 << 63 else None for x in (off * off).sum(axis=1)]


def spectrum(vectors: DataFrame, width: int) -> Spectrum:
    """The spectrum of the integer vectors ``x``, a row of at most ``width`` each."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum.empty(width)
        for batch in batches:
            own.add_rows(matrix(batch.column(0), width))
        if own.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), **own.columns()})

    def combined(group: pa.Table) -> pa.Table:
        own, rows = Spectrum.empty(width), sorted(group.to_pylist(), key=lambda r: r["part"])
        for row in rows:
            own.add(Spectrum.of(row))
        return pa.table({"part": pa.array([rows[0]["group"]], pa.int64()), **own.columns()})

    schema = "part bigint, " + Spectrum.FIELDS
    found = vectors.select("x").mapInArrow(local, schema)
    for groups in (FAN_IN * FAN_IN, FAN_IN, 1):
        found = found.withColumn("group", F.col("part") % groups).groupBy("group").applyInArrow(combined, schema)
    rows = found.collect()
    return Spectrum.of(rows[0].asDict()) if rows else Spectrum.empty(width)


def summed(vectors: DataFrame, products) -> np.ndarray:
    """The sum, over all rows, of the matrices that ``products`` makes of blocks:
    one matrix a task, added in two levels."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = products(batch.column(0))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "m": pa.array([total.ravel()], pa.list_(pa.float64()))})

    def added(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: r["part"])
        return pa.table({"part": pa.array([rows[0]["group"]], pa.int64()), "m": pa.array([np.sum([r["m"] for r in rows], axis=0)], pa.list_(pa.float64()))})

    found = vectors.select("x").mapInArrow(local, "part bigint, m array<double>")
    for groups in (FAN_IN * FAN_IN, FAN_IN, 1):
        found = found.withColumn("group", F.col("part") % groups).groupBy("group").applyInArrow(added, "part bigint, m array<double>")
    return np.array(found.collect()[0]["m"], float)


def distinct_vectors(rows: DataFrame, vector_col: str, scale: int) -> DataFrame:
    """(x) every usable vector in integers, once, zeros at its end left out (they
    stand for nothing, and vectors of unlike dimension compare equal)."""
    x = quantised(col(vector_col), scale)
    return rows.where(usable(col(vector_col))).select(trimmed(x).alias("x")).distinct()


def trimmed(x: Column) -> Column:
    last = F.array_max(F.transform(x, lambda v, i: F.when(v != 0, i + 1)))
    return F.slice(x, 1, F.coalesce(last, F.lit(0)))


def fit(rows: DataFrame, vector_col: str = "embedding", n_components: int = 4, scale: int = 256) -> Whitening:
    """The whitening of the distinct vectors.  The dimension is that of the data."""
    vectors = stored(distinct_vectors(rows, vector_col, scale), "whitening-vectors")
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    if not width:
        return Whitening(0, np.zeros(0, object), 0.0, np.zeros(0), np.zeros((0, 0)))
    found = spectrum(vectors, width)
    mean, basis = found.mean(), found.vectors[:, ::-1].copy()

    def within(lists: pa.Array) -> np.ndarray:
        z = (matrix(lists, width) - mean) @ basis
        return z.T @ z

    ritz = summed(vectors, within).reshape(width, width) / found.n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    keep = [i for i in range(min(n_components, width)) if values[i] > width * EPS * max(values[0], 0.0) and values[i] > 0]
    components = basis @ turn[:, keep]
    if keep:
        components *= np.sign(components[np.abs(components).argmax(axis=0), np.arange(len(keep))])
    model = Whitening(found.n, found.sums, float(np.trace(ritz)), values[keep], components)
    if keep:

        def moments(lists: pa.Array) -> np.ndarray:
            w = model.project(matrix(lists, width))
            w = np.hstack([np.ones((len(w), 1)), w])
            return w.T @ w

        total = summed(vectors, moments).reshape(len(keep) + 1, len(keep) + 1) / found.n
        covariance = total[1:, 1:] - np.outer(total[0, 1:], total[0, 1:])
        model.identity_error = float(np.abs(covariance - np.eye(len(keep))).max())
    return model


def whiten(rows: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every
    usable row and component."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(model)  # a vector of the data's dimension a component
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k, width = len(m.eigenvalues), len(m.sums)
        for batch in batches if k else ():
            x = matrix(batch.column(1), width)
            at = np.repeat(np.arange(len(x)), k)
            one = np.tile(np.arange(k), len(x))
            yield pa.RecordBatch.from_pydict({
                id_col: batch.column(0).take(pa.array(at)),
                "component": pa.array(one + 1, pa.int32()),
                "n": pa.array(np.full(len(at), m.n), pa.int64()),
                "deviation": pa.array(m.deviations(x), pa.int64()).take(pa.array(at)),
                "whitened": pa.array(m.project(x).ravel()),
                "explained": pa.array((m.eigenvalues / m.trace)[one]),
                "identity_error": pa.array(np.full(len(at), m.identity_error)),
            })

    name = "`" + id_col.replace("`", "``") + "`"
    schema = f"{name} {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    own = rows.where(usable(col(vector_col))).select(col(id_col), trimmed(quantised(col(vector_col), scale)).alias("x"))
    return own.mapInArrow(run, schema)
