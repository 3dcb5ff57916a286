"""Embedding whitening by incremental eigendecomposition.

A vector's entries c, as doubles, become the integers x = floor(64 c) + 1,000,000. The fit list is each
distinct x vector once; its size n and sums S are exact. Each task of the fit list holds a spectrum:
eigenvalues and orthonormal eigenvectors of the scatter about S / n so far. A row enters by a rank-one update:
the secular equation of the old eigenvalues and the row's coordinates gives the new eigenvalues, entries that
cannot move an eigenvalue are deflated, and eigenvectors follow from the roots. Rows come in blocks of
`block` rows that are first rotated to a triangle (the scatter of a block is that of the triangle's rows), so a
block costs as many updates as a vector has entries. Spectra of tasks are combined in a tree: each eigenpair
of one is a rank-one update of the other; a group holds FAN_IN spectra. At last a distributed pass projects the
centred rows on the basis found, and the Ritz pairs of the sum of their products (Rayleigh-Ritz) are the
components; it corrects what the updates have lost to rounding.

What moves is integers of distinct vectors once (to tell them apart) and, for each task, one spectrum and one
product, bounded by the square of the number of entries.

Defined results: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those
that do not have the commonest number of entries (of equally common ones the largest). Equal rows each get
their result; they count once in the fit. Components with an eigenvalue of at most RANK times the largest do
not exist: a single distinct vector has none, so no row is returned. The sign of a component makes its
largest entry positive. Extra columns are not read. An empty table gives an empty table. Integers beyond 64 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK = 1024
FAN_IN = 16
RANK = 1e-12
EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) for ascending different d and positive z2, one above each d: the
    pole each root is told from, and its distance to it. Bracketed; steps by the two poles beside a root."""
    n = len(d)
    after = np.append(d[1:], d[-1] + z2.sum())
    middle = (after - d) / 2
    f = 1 + (z2 / (d[None, :] - d[:, None] - middle[:, None])).sum(axis=1)
    left = (f >= 0) | (np.arange(n) == n - 1)  # the root lies in the left half, or is the last
    pole = np.where(left, np.arange(n), np.minimum(np.arange(n) + 1, n - 1))
    gap = d[None, :] - d[pole][:, None]
    lo, hi = np.where(left, 0.0, -middle), np.where(left, np.where(np.arange(n) == n - 1, after - d, middle), 0.0)
    x = (lo + hi) / 2
    below = np.arange(n)[None, :] <= np.arange(n)[:, None]
    near, far = np.arange(n), np.minimum(np.arange(n) + 1, n - 1)
    active = np.ones(n, dtype=bool)
    for _ in range(80):
        away = gap - x[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            part = z2 / away
            f = 1 + part.sum(axis=1)
            slope = part / away
            psi, phi = np.where(below, slope, 0.0).sum(axis=1), np.where(below, 0.0, slope).sum(axis=1)
            size = 1 + np.abs(part).sum(axis=1)
            active = active & (np.abs(f) > 4 * EPS * size) & (hi - lo > 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
            if not active.any():
                break
            lo, hi = np.where(active & (f < 0), x, lo), np.where(active & (f >= 0), x, hi)
            a1, a2 = away[near, near], np.where(near == n - 1, after[-1] - d[-1] - x, away[near, far])
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b = a1 * a2 * f
            c = f - a1 * psi - a2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            to = x + step
        inside = np.isfinite(to) & (to > lo) & (to < hi)
        x = np.where(active, np.where(inside, to, (lo + hi) / 2), x)
    return pole, x


def updated(values: np.ndarray, vectors: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending values, vectors as columns) of V diag(values) V' + row row'."""
    z = vectors.T @ row
    length = float(np.sqrt(z @ z))
    if length == 0:
        return values, vectors
    scale = max(float(values[-1]), length * length)
    vectors = vectors.copy()
    d, z = values.copy(), z.copy()
    tol = 8 * EPS * scale
    order = np.arange(len(d))
    moved = np.abs(z) * length > tol  # the rest is deflated: no eigenvalue feels it
    last = -1
    for i in order[moved]:
        if last >= 0 and d[i] - d[last] <= tol:  # equal eigenvalues: turn the pair so that one entry is zero
            r = float(np.hypot(z[last], z[i]))
            c, s = z[i] / r, z[last] / r
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            z[last], z[i] = 0.0, r
            moved[last] = False
        last = i
    k = np.nonzero(moved)[0]
    if not len(k):
        return values, vectors
    dk = d[k]
    pole, x = secular_roots(dk, z[k] ** 2)
    apart = (dk[:, None] - dk[pole][None, :]) - x[None, :]  # d_i - root_j
    # entries for which the roots found are exact, so that vectors come out orthogonal
    between = dk[:, None] - dk[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = apart / between
    np.fill_diagonal(ratio, np.diag(apart))
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[k])
    with np.errstate(divide="ignore", invalid="ignore"):
        w = exact[:, None] / apart
    whole = np.isfinite(w).all(axis=0)
    w[:, ~whole] = np.eye(len(k))[:, ~whole]  # a root on its pole: the vector stays
    w /= np.sqrt((w * w).sum(axis=0))
    d[k] = dk[pole] + x
    vectors[:, k] = vectors[:, k] @ w
    order = np.argsort(d, kind="stable")
    return d[order], vectors[:, order]


@dataclass
class Spectrum:
    """Eigenvalues, ascending, and eigenvectors of a scatter matrix."""

    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(dim: int) -> Spectrum:
        return Spectrum(np.zeros(dim), np.eye(dim))

    def add(self, rows: np.ndarray) -> None:
        """Rank-one updates by centred rows; more rows than entries are rotated to a triangle first."""
        if len(rows) > rows.shape[1]:
            rows = np.linalg.qr(rows, mode="r")
        for row in rows:
            self.values, self.vectors = updated(self.values, self.vectors, row)

    def join(self, values: np.ndarray, vectors: np.ndarray) -> None:
        """Rank-one updates by the eigenpairs of another spectrum."""
        for value, vector in zip(values, vectors.T, strict=True):
            if value > 0:
                self.values, self.vectors = updated(self.values, self.vectors, np.sqrt(value) * vector)


SPECTRUM = "part long, spectrum_values array<double>, spectrum_vectors array<double>"


def _row(part: int, s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "spectrum_values": [s.values], "spectrum_vectors": [s.vectors.ravel()]})


def _rows(batches: Iterator[pd.DataFrame], sums: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """Centred rows, a block at a time. The whole part of S / n is taken off as integers, so nothing is lost."""
    whole, rest = sums // n, (sums % n) / n
    for b in batches:
        if len(b):
            yield (np.stack(b["x"].to_numpy()).astype(np.int64) - whole) - rest


def spectra(fit: DataFrame, sums: np.ndarray, n: int, block: int = BLOCK) -> DataFrame:
    """One spectrum for each task of `fit(x)`."""
    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        s = None
        for rows in _rows(batches, sums, n):
            s = s or Spectrum.empty(rows.shape[1])
            for at in range(0, len(rows), block):
                s.add(rows[at : at + block])
        if s:
            yield _row(TaskContext.get().partitionId(), s)

    return fit.select("x").mapInPandas(of, SPECTRUM)


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    group, total = group.sort_values("part"), None
    for values, vectors in zip(group["spectrum_values"], group["spectrum_vectors"], strict=True):
        values = np.asarray(values)
        vectors = np.asarray(vectors).reshape(len(values), len(values))
        if total is None:
            total = Spectrum(values, vectors)
        else:
            total.join(values, vectors)
    return _row(int(group["part"].iloc[0]) // FAN_IN, total)


def combined(parts: DataFrame) -> Spectrum:
    """All spectra in one, by a tree of groups of FAN_IN."""
    parts = written(parts, "spectra")
    while parts.count() > 1:
        parts = written(parts.groupBy(F.expr(f"part div {FAN_IN}")).applyInPandas(_joined, SPECTRUM), "spectra")
    row = parts.first()
    values = np.array(row["spectrum_values"])
    return Spectrum(values, np.array(row["spectrum_vectors"]).reshape(len(values), len(values)))


def products(fit: DataFrame, sums: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Covariance of the centred rows of `fit` projected on the columns of `basis`, summed over tasks in Spark."""
    k = basis.shape[1]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for rows in _rows(batches, sums, n):
            y = rows @ basis
            total += y.T @ y
        yield pd.DataFrame({"at": np.arange(k * k), "product": total.ravel()})

    found = fit.select("x").mapInPandas(of, "at int, product double").groupBy("at").agg(F.sum("product").alias("product"))
    out = np.zeros(k * k)
    for r in found.collect():  # k * k numbers
        out[r["at"]] = r["product"]
    return out.reshape(k, k) / n


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    components: np.ndarray  # columns
    values: np.ndarray  # falling
    trace: float
    identity_error: float


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False))


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): rows that count, as integers."""
    rows = table.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("vector") == (sizes["size"] if sizes else 0)).select("vec_id", integers(F.col("vector")).alias("x"))


def fit(vectors: DataFrame, components: int = COMPONENTS, block: int = BLOCK) -> Whitening | None:
    """The whitening of `vectors(x)`; none of an empty table."""
    distinct = written(vectors.select("x").distinct(), "whitening-fit")
    n = distinct.count()
    if n == 0:
        return None
    total = distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).orderBy("at").collect()  # a row for each entry
    sums = np.array([r["s"] for r in total], dtype=np.int64)
    found = combined(spectra(distinct, sums, n, block))
    basis = np.linalg.qr(found.vectors[:, ::-1])[0]
    values, turn = np.linalg.eigh(products(distinct, sums, n, basis))  # Rayleigh-Ritz
    vectors_, values = basis @ turn[:, ::-1], np.maximum(values[::-1], 0)
    keep = min(components, int((values > RANK * values[0]).sum())) if values[0] > 0 else 0
    own = vectors_[:, :keep] / np.linalg.norm(vectors_[:, :keep], axis=0)
    own = own * np.sign(own[np.abs(own).argmax(axis=0), np.arange(keep)]) if keep else own
    error = 0.0
    if keep:
        error = float(np.abs(products(distinct, sums, n, own / np.sqrt(values[:keep])) - np.eye(keep)).max())
    return Whitening(n, sums, own, values[:keep], float(values.sum()), error)


def _whitened(model: Whitening, x: Column) -> Column:
    whole, rest = model.sums // model.n, (model.sums % model.n) / model.n
    to = model.components / np.sqrt(model.values)

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series(list(((np.stack(xs.to_numpy()).astype(np.int64) - whole) - rest) @ to) if len(xs) else [])

    return of(x)



def whiten(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, block: int = BLOCK) -> DataFrame:
    """(vec_id, whitened array<double>, deviation) of all rows that count, with the model's columns n, explained
    (array) and identity_error."""
    vectors = vectors_of(table, id_col, vector_col)
    model = fit(vectors, components, block)
    if model is None or not len(model.values):
        return vectors.where("false").select("vec_id", F.array().cast("array<double>").alias("whitened"), F.lit(0).cast("long").alias("deviation"), F.lit(0).cast("long").alias("n"),
                                             F.array().cast("array<double>").alias("explained"), F.lit(0.0).alias("identity_error"))
    sums = F.array(*[F.lit(int(s)).cast("long") for s in model.sums])
    n = F.lit(model.n).cast("long")
    off = F.zip_with("x", sums, lambda x, s: n * x - s)
    deviation = F.aggregate(off, F.lit(0).cast("long"), lambda total, v: total + v * v)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return vectors.select("vec_id", _whitened(model, F.col("x")).alias("whitened"), deviation.alias("deviation"), n.alias("n"), explained.alias("explained"),
                          F.lit(model.identity_error).alias("identity_error"))


def by_component(rows: DataFrame) -> DataFrame:
    """A row for each vector and component."""
    one = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return one.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("at")].alias("explained"), "identity_error")
