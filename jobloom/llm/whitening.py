"""Whitening of embeddings by incremental eigendecomposition.

A `Spectrum` holds the eigenpairs of a centred scatter matrix. A vector is a rank-one change of it: its part outside of the known
directions opens a new one, eigenvalues that the change does not move, or that lie together, are deflated, and the others are
the roots of the secular equation. Each partition of the distinct vectors makes its spectrum; spectra are combined in groups, in
rounds: one for the step between their means, one for each eigenpair. The directions found are a basis for a last
Rayleigh-Ritz step, a pass over all vectors that projects the covariance on it, so that the rounding of many updates is gone.

What goes through the driver is a matrix of dimensions x dimensions; tasks hold one such matrix and a batch of vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, table

EPS = float(np.finfo(np.float64).eps)
#: Spectra that one task combines.
FAN = 8
#: Eigenvalues below this part of the largest count as none: their directions have no variance to be scaled.
LEAST_EIGENVALUE = 1e-13
#: Steps of the root finder at most; brackets halve (or better) in each.
STEPS = 200


# -- one rank-one change ----------------------------------------------------------------------------------------------------


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and eigenvectors (columns) of diag(d) + rho z z', for rising distinct d, z of unit length without zeros, rho > 0.

    Root j lies between d[j] and d[j+1] and is sought as a distance from the nearer one, by interpolation with both poles inside
    a bracket. Vectors come from the z for which the roots found are exact, which keeps them orthogonal.
    """
    m = len(d)
    z2 = z * z
    up = np.append(d[1:], d[-1] + rho)
    gap = up - d
    at = np.arange(m)
    middle = gap / 2
    f_middle = 1 + rho * (z2[:, None] / ((d[:, None] - d[None, :]) - middle)).sum(0)
    right = (f_middle < 0) & (at < m - 1)
    base = np.where(right, d[np.minimum(at + 1, m - 1)], d)
    far = d[:, None] - base[None, :]
    lo = np.where(right, -middle, np.where((at == m - 1) & (f_middle < 0), middle, 0.0))
    hi = np.where(right, 0.0, np.where((at == m - 1) & (f_middle < 0), gap, middle))
    mu = (lo + hi) / 2
    left = (at[:, None] <= at[None, :]).astype(float)
    for _ in range(STEPS):
        t = far - mu
        q = rho * z2[:, None] / t
        slope = q / t
        f = 1 + q.sum(0)
        hi, lo = np.where(f >= 0, mu, hi), np.where(f < 0, mu, lo)
        done = (np.abs(f) <= EPS * m * (1 + np.abs(q).sum(0))) | (hi - lo <= 2 * EPS * np.maximum(np.abs(lo), np.abs(hi)))
        if done.all():
            break
        psi, all_ = (slope * left).sum(0), slope.sum(0)
        near, next_ = d - base - mu, up - base - mu
        a = (near + next_) * f - near * next_ * all_
        b = near * next_ * f
        c = f - near * psi - next_ * (all_ - psi)
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            new = mu + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        # halves of a bracket that reaches a pole go by orders of magnitude
        size, least = np.maximum(np.abs(lo), np.abs(hi)), np.minimum(np.abs(lo), np.abs(hi))
        half = np.where(size > 16 * least, np.where(least > 0, np.sqrt(size * least), size / 1024), (size + least) / 2) * np.where(hi > 0, 1.0, -1.0)
        mu = np.where(done, mu, np.where((new > lo) & (new < hi), new, half))
    t = far - mu  # d[i] - root[j]
    under = np.where(at[None, :] < at[:, None], d[None, :] - d[:, None], np.append(d[1:], 0.0)[None, :] - d[:, None])
    under[:, -1] = rho
    z_new = np.copysign(np.sqrt(np.abs(np.prod(-t / under, axis=1))), z)
    v = z_new[:, None] / t
    return base + mu, v / np.sqrt((v * v).sum(0))


@dataclass
class Spectrum:
    """Count and exact sums of whole-number vectors, and the eigenpairs of their centred scatter: rising values, vectors in columns."""

    dims: int
    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.sums = self.sums or [0] * self.dims
        self.vectors = np.zeros((self.dims, 0)) if self.vectors is None else self.vectors

    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])

    def add(self, x: list[int]) -> None:
        """One vector: its distance from the mean so far, weighted n / (n + 1)."""
        if self.n:
            self.rank_one(self.n / (self.n + 1), np.array([(v * self.n - s) / self.n for v, s in zip(x, self.sums, strict=True)]))
        self.n += 1
        self.sums = [s + v for s, v in zip(self.sums, x, strict=True)]

    def merge(self, other: Spectrum) -> None:
        """The vectors of another spectrum: the step between the means, then its eigenpairs one by one."""
        if not other.n:
            return
        if self.n:
            self.rank_one(self.n * other.n / (self.n + other.n), other.mean() - self.mean())
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.rank_one(float(value), vector)
        self.n += other.n
        self.sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def rank_one(self, rho: float, u: np.ndarray) -> None:
        """The eigenpairs after rho u u' is added."""
        length = float(np.sqrt(u @ u))
        if rho <= 0 or length == 0 or not np.isfinite(length):
            return
        u, rho = u / length, rho * length * length
        values, vectors = self.values, self.vectors
        z = vectors.T @ u
        if len(values) < self.dims:
            out = u - vectors @ z
            again = vectors.T @ out  # once more, as the first projection leaves rounding along known directions
            out, z = out - vectors @ again, z + again
            new = float(np.sqrt(out @ out))
            if new > 16 * EPS:
                values, vectors, z = np.append(0.0, values), np.column_stack([out / new, vectors]), np.append(new, z)
        least = 8 * EPS * max(float(np.abs(values).max(initial=0.0)), rho)
        live = np.flatnonzero(rho * np.abs(z) > least)
        a, b = z[live[:-1]], z[live[1:]]
        keep = [] if ((values[live[1:]] - values[live[:-1]]) * np.abs(a * b) <= least * (a * a + b * b)).any() else live.tolist()
        for i in live if not keep else ():  # neighbours that lie together are turned so that one of them takes no part
            if keep:
                j = keep[-1]
                r = float(np.hypot(z[i], z[j]))
                c, s = z[i] / r, z[j] / r
                if (values[i] - values[j]) * abs(c * s) <= least:
                    vectors = vectors.copy() if vectors is self.vectors else vectors
                    vectors[:, [j, i]] = vectors[:, [j, i]] @ np.array([[c, s], [-s, c]])
                    z[i], z[j] = r, 0.0
                    keep.pop()
            keep.append(i)
        if keep:
            rows, weight = np.array(keep), z[keep]
            scale = float(np.sqrt(weight @ weight))
            found, turn = secular(values[rows], weight / scale, rho * scale * scale)
            values, vectors = values.copy(), vectors.copy() if vectors is self.vectors else vectors
            values[rows], vectors[:, rows] = found, vectors[:, rows] @ turn
        order = np.argsort(values, kind="stable")
        self.values, self.vectors = values[order], vectors[:, order]

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "sums": [str(s) for s in self.sums], "vals": self.values.tolist(), "vecs": self.vectors.T.ravel().tolist()}

    @staticmethod
    def of(row) -> Spectrum:
        values = np.asarray(row.vals, dtype=float)
        return Spectrum(len(row.sums), int(row.n), [int(s) for s in row.sums], values, np.asarray(row.vecs, dtype=float).reshape(len(values), len(row.sums)).T.copy())


SPECTRUM = "part long, n long, sums array<string>, vals array<double>, vecs array<double>"


# -- vectors -----------------------------------------------------------------------------------------------------------------


def whole(v: Column) -> Column:
    """floor(256 * c) of the entries, as longs (the nearest long beyond their range); null for a vector that takes no part."""
    sound = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    return F.when(v.isNotNull() & (F.size(v) > 0) & sound, F.transform(v, lambda c: F.floor(c.cast("double") * 256)))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of number arrays of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n, by whole numbers as far as they go."""
    quotient, rest = np.array([s // n for s in sums], dtype=np.int64), np.array([s % n / n for s in sums])
    if len(x) and max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(quotient).max()) >= 1 << 62:
        return x.astype(np.float64) - quotient - rest
    return (x - quotient).astype(np.float64) - rest


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sums of (n * x - sums)^2 of the rows, exact; the largest long beyond its range."""
    if not len(x):
        return []
    reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if reach * reach * x.shape[1] < 1 << 63:
        y = x * n - np.array(sums, dtype=np.int64)
        return (y * y).sum(1).tolist()
    return [min(sum((n * v - s) ** 2 for v, s in zip(row, sums, strict=True)), (1 << 63) - 1) for row in x.tolist()]


def spectra(fit: DataFrame, dims: int) -> DataFrame:
    """A row of SPECTRUM for each partition of `fit` (x array<long>) that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Spectrum(dims)
        for b in batches:
            for x in b.column(0).to_pylist():
                one.add(x)
        if one.n:
            numbers = pa.list_(pa.float64())
            schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("vals", numbers), ("vecs", numbers)])
            yield pa.RecordBatch.from_pylist([one.row(TaskContext.get().partitionId())], schema=schema)

    return fit.select("x").mapInArrow(run, SPECTRUM)


def combined(parts: DataFrame, scratch: Scratch) -> Spectrum:
    """One spectrum of all, FAN to one in each round."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        one = Spectrum.of(rows.iloc[0])
        for _, row in rows.iloc[1:].iterrows():
            one.merge(Spectrum.of(row))
        return pd.DataFrame([one.row(int(rows.part.iloc[0]) // FAN)])

    parts = scratch.save(parts, "spectra")
    while (left := parts.agg(F.max("part")).first()[0]) > 0:
        nxt = scratch.save(parts.groupBy(F.floor(F.col("part") / FAN).alias("_g")).applyInPandas(merge, SPECTRUM), "spectra")
        assert nxt.agg(F.max("part")).first()[0] < left
        scratch.drop(parts)
        parts = nxt
    return Spectrum.of(parts.first())


def projected_sums(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the vectors of y y' and of y (last column), y = project(x): partial sums by partition, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width + 1))
        for b in batches:
            if len(b):
                y = project(matrix(b.column(0)))
                out[:, :width] += y.T @ y
                out[:, width] += y.sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(out.size), pa.int32()), "v": pa.array(out.ravel())})

    rows = fit.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width * (width + 1))
    for r in rows:
        out[r["at"]] = r["v"]
    return out.reshape(width, width + 1)


@dataclass
class Whitening:
    """A fitted whitening: count and sums of the fit list, components in columns, their eigenvalues, explained shares, error."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums) @ self.components / np.sqrt(self.values)


def fit_whitening(vectors: DataFrame, components: int | None = None) -> Whitening | None:
    """The whitening of `vectors` (x array<long>), each distinct one counted once; None without vectors.

    Those of the length that most distinct ones have are fitted. Directions without variance are no components, so there may
    be fewer than asked for, none at all for a single vector.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    # equal vectors are merged before the shuffle, however many there are
    every = scratch.save(vectors.select("x").groupBy("x").agg(F.lit(0)).select("x"), "fit")
    first = every.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if first is None:
        return None
    dims = first.dims
    fit = every.where(F.size("x") == dims)
    rough = combined(spectra(fit, dims), scratch)
    n, sums = rough.n, rough.sums
    basis = np.linalg.qr(rough.vectors[:, ::-1], mode="complete")[0] if len(rough.values) else np.eye(dims)
    ritz = projected_sums(fit, lambda x: centred(x, n, sums) @ basis, dims)
    values, turn = np.linalg.eigh(ritz[:, :dims] / n - np.outer(ritz[:, dims], ritz[:, dims]) / n / n)
    values, turn = values[::-1], turn[:, ::-1]
    k = int((values > LEAST_EIGENVALUE * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    k = min(k, components or dims)
    out = Whitening(n, sums, basis @ turn[:, :k], values[:k], values[:k] / max(float(np.maximum(values, 0).sum()), np.finfo(float).tiny))
    if k:
        mean = (ritz[:, dims] / n) @ turn[:, :k] / np.sqrt(out.values)
        whitened = projected_sums(fit, lambda x: out(x) - mean, k)
        out.identity_error = float(np.abs(whitened[:, :k] / n - np.outer(whitened[:, k], whitened[:, k]) / n / n - np.eye(k)).max())
    scratch.drop(every)
    return out


def whiten(df: DataFrame, vector_col: str = "embedding", components: int | None = None) -> tuple[DataFrame, Whitening | None]:
    """(rows with n, deviation, whitened array<double>; the fitted whitening): every row whose vector takes part, all its columns.

    Vectors are rounded down to whole 1/256ths (`whole`). Rows with a null or empty vector, null or non-finite entries are left
    out, and so are vectors of another length than that of most distinct ones (the longer one of a tie). Repeated rows, null ids and
    equal vectors stay and have equal answers; equal vectors are fitted once. An empty table gives an empty result and
    no whitening. Columns of `df` named n, deviation or whitened are replaced.
    """
    df = df.drop("n", "deviation", "whitened")
    rows = df.select(F.struct(*df.columns).alias("_doc"), whole(F.col(vector_col)).alias("x")).where("x is not null")
    model = fit_whitening(rows, components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = matrix(b.column(1))
            y = model(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(y), model.n), pa.int64()), pa.array(deviations(x, model.n, model.sums), pa.int64()), lists], names=["_doc", "n", "deviation", "whitened"])

    schema = T.StructType([rows.schema["_doc"], *T.StructType.fromDDL("n long, deviation long, whitened array<double>")])
    out = rows.where(F.size("x") == len(model.sums) if model else F.lit(False)).mapInArrow(run, schema)
    return out.select(*[F.col(f"_doc.`{c}`") for c in df.columns], "n", "deviation", "whitened"), model


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four leading components, one row for each; see `whiten` for rows that take no part."""
    d, model = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    explained = F.array(*[F.lit(float(e)) for e in (model.explained if model else [])]).cast("array<double>")
    rows = d.select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error if model else 0.0).alias("identity_error"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLE_SQL: dict[str, str] = {}
