"""Whitening by an incremental eigendecomposition.

Each partition keeps the mean and the spectrum (eigenvalues and eigenvectors) of the rows that it has read: a row changes
their scatter by one centred rank-one term, whose new eigenvalues are the roots of the secular equation, after entries that
do not move have been deflated. Spectra of partitions are combined in a tree: the eigenpairs of one, and the term for the
distance of both means, are rank-one updates of the other. Two Rayleigh-Ritz rounds end it: the covariance in the basis found
is summed over all rows again and its small eigenproblem solved; the second one measures what the first has left.

Rows whose vector is null or holds null or non-finite entries give no result; neither do vectors that are not as long as
most (ties: the longer), nor empty ones. Equal vectors count once in the fit, and every row, repeated ones too, is whitened.
Components whose eigenvalue is 0 but for rounding are left out, so that equal vectors alone, one row or an empty table give
no rows. Equal eigenvalues share their space: any basis of it may come. Further columns are ignored. A deviation that 63
bits do not hold raises an OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from netaccess.llm.common import map_arrow
from netaccess.runtime import discard, materialize

COMPONENTS = 4
#: Spectra that one task combines.
FAN_IN = 8
#: Rows between two times that rounding in the eigenvectors is taken out.
TIDY_EVERY = 2_000
EPS = np.finfo(float).eps
SPECTRUM = "part long, n long, mean binary, values binary, vectors binary"


def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2 / (d - x) = 0 for ascending distinct d and z2 > 0, as (pole next to each root, step from it).

    Root j lies between d[j] and d[j + 1] (the last within sum z2 of d). It is counted from the nearer of both poles, which the
    sign at the middle tells, so that differences to the poles keep all their digits. Each step solves the equation with the sums
    on either side replaced by one pole each; a step that would leave the bracket halves it instead.
    """
    k = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    gap = right - d
    j = np.arange(k)
    ahead = d[:, None] - d[None, :]
    middle = 1 + (z2[:, None] / (ahead - gap / 2)).sum(0)
    near_right = (middle < 0) & (j < k - 1)
    pole = np.where(near_right, j + 1, j)
    delta = d[:, None] - d[pole][None, :]
    low, high = np.where(near_right, -gap / 2, 0.0), np.where(near_right, 0.0, gap / 2)
    low[-1], high[-1] = (gap[-1] / 2, gap[-1]) if middle[-1] < 0 else (0.0, gap[-1] / 2)
    t = (low + high) / 2
    upper = j[:, None] > j[None, :]
    d_left, d_right = d - d[pole], right - d[pole]
    settled = np.zeros(k, bool)
    for _ in range(60):
        u = z2[:, None] / (delta - t)
        slopes = u / (delta - t)
        f = 1 + u.sum(0)
        phi, psi = np.where(upper, slopes, 0.0).sum(0), np.where(upper, 0.0, slopes).sum(0)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        a, b = d_left - t, d_right - t
        qa, qb, qc = f - a * psi - b * phi, (a + b) * f - a * b * (psi + phi), a * b * f
        root = np.sqrt(np.maximum(qb * qb - 4 * qa * qc, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(qb <= 0, (qb - root) / (2 * qa), 2 * qc / (qb + root))
        settled |= (np.abs(f) <= 4 * EPS * (1 + np.abs(u).sum(0))) | (np.abs(step) <= EPS * np.abs(t))
        if settled.all():
            break
        new = t + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        t = np.where(settled, t, new)
    return pole, t


def rank_one(values: np.ndarray, vectors: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of Q diag(values) Q' + x x'."""
    z = vectors.T @ x
    size = max(float(values[-1]), float(z @ z))
    if size == 0:
        return values, vectors
    small = 8 * EPS * size
    moving = np.abs(z) * np.linalg.norm(z) > small
    # of values that are as good as equal, one turns to take the whole of z and the others rest
    at = np.flatnonzero(moving)
    close = np.flatnonzero(np.diff(values[at]) <= small) if len(at) > 1 else ()
    if len(close):
        vectors = vectors.copy()
        for k in close:
            i, j = at[k], at[k + 1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vi, vj = vectors[:, i].copy(), vectors[:, j].copy()
            vectors[:, i], vectors[:, j] = c * vi - s * vj, s * vi + c * vj
            z[i], z[j], moving[i] = 0.0, r, False
        at = np.flatnonzero(moving)
    if not len(at):
        return values, vectors
    d, w = values[at], z[at]
    if len(at) == 1:
        new, turned = d + w * w, vectors[:, at]
    else:
        pole, t = secular_roots(d, w * w)
        apart = (d[:, None] - d[pole][None, :]) - t  # d_i - root_j, with all its digits
        new = d[pole] + t
        # the z for which these roots are exact makes the vectors orthogonal
        k = len(d)
        ratio = apart / np.where(np.eye(k, dtype=bool), 1.0, d[:, None] - d[None, :])
        np.fill_diagonal(ratio, -np.diagonal(apart))
        exact = np.sqrt(np.abs(ratio.prod(1))) * np.sign(w)
        u = exact[:, None] / apart
        turned = vectors[:, at] @ (u / np.linalg.norm(u, axis=0))
    values, out = values.copy(), vectors.copy()
    values[at], out[:, at] = new, turned
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


class Spectrum:
    """Number, mean and scatter (as eigenpairs) of the rows taken in."""

    def __init__(self, dims: int):
        self.n, self.mean, self.values, self.vectors = 0, np.zeros(dims), np.zeros(dims), np.eye(dims)
        self.updates = 0

    def update(self, x: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, x)
        self.updates += 1
        if self.updates % TIDY_EVERY == 0:
            q, r = np.linalg.qr(self.vectors)
            self.vectors = q * np.sign(np.diagonal(r))

    def add(self, x: np.ndarray) -> None:
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        if self.n > 1:
            self.update(off * np.sqrt((self.n - 1) / self.n))

    def combine(self, other: Spectrum) -> None:
        if not other.n:
            return
        both = self.n + other.n
        off = other.mean - self.mean
        self.update(off * np.sqrt(self.n * other.n / both))
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.update(vector * np.sqrt(value))
        self.n, self.mean = both, self.mean + off * (other.n / both)

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "mean": self.mean.tobytes(), "values": self.values.tobytes(), "vectors": np.ascontiguousarray(self.vectors).tobytes()}

    @classmethod
    def read(cls, row: dict) -> Spectrum:
        mean = np.frombuffer(row["mean"])
        out = cls(len(mean))
        out.n, out.mean, out.values, out.vectors = int(row["n"]), mean, np.frombuffer(row["values"]), np.frombuffer(row["vectors"]).reshape(len(mean), len(mean))
        return out


def matrix(column) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def partition_spectra(fit: DataFrame, dims: int) -> DataFrame:
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        from pyspark import TaskContext

        held = Spectrum(dims)
        for b in batches:
            for x in matrix(b["x"]):
                held.add(x)
        if held.n:
            yield {k: [v] for k, v in held.row(TaskContext.get().partitionId()).items()}

    schema = StructType([StructField("part", LongType()), StructField("n", LongType()), *(StructField(c, BinaryType()) for c in ("mean", "values", "vectors"))])
    return map_arrow(fit.select("x"), run, schema)


def combined(group: pd.DataFrame) -> pd.DataFrame:
    rows = group.sort_values("part").to_dict("records")
    first = Spectrum.read(rows[0])
    for row in rows[1:]:
        first.combine(Spectrum.read(row))
    return pd.DataFrame([first.row(int(rows[0]["part"]) // FAN_IN)])


def spectrum_of(fit: DataFrame, dims: int) -> Spectrum:
    """The spectrum of all rows: those of partitions, combined ``FAN_IN`` at a time."""
    written = [materialize(partition_spectra(fit, dims), "whitening-spectra")]
    most = written[0].agg(F.max("part")).first()[0]
    while most:
        groups = written[-1].withColumn("g", F.floor(F.col("part") / FAN_IN)).groupBy("g")
        written.append(materialize(groups.applyInPandas(combined, SPECTRUM), "whitening-level"))
        most //= FAN_IN
    out = Spectrum.read(written[-1].first().asDict())
    discard(*written)
    return out


def ritz_matrix(fit: DataFrame, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance in ``basis``: products of centred rows, added by Spark entry by entry."""
    mean, dims = sums / n, basis.shape[1]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        total = np.zeros((dims, dims))
        for b in batches:
            y = (matrix(b["x"]) - mean) @ basis
            total += y.T @ y
        yield {"at": np.arange(dims * dims), "s": total.ravel()}

    found = map_arrow(fit.select("x"), run, StructType([StructField("at", IntegerType()), StructField("s", DoubleType())])).groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(dims * dims)
    for at, s in found:  # dims * dims numbers, whatever the rows
        out[at] = s
    out = out.reshape(dims, dims) / n
    return (out + out.T) / 2


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """Number and exact per-dimension sums, one number a dimension to the driver."""

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(b["x"]), -1)
            if len(x) and np.abs(x.astype(float)).max() * len(x) >= 2.0**62:
                raise OverflowError("a sum may not fit into 63 bits")
            yield {"dim": np.arange(-1, x.shape[1]), "s": np.concatenate([[len(x)], x.sum(0)])}

    rows = map_arrow(fit.select("x"), run, StructType([StructField("dim", IntegerType()), StructField("s", LongType())]))
    found = dict(rows.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    return int(found.get(-1, 0)), [int(found[k]) for k in range(len(found) - 1)]


def sound_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """vec_id and x, floor(256 * entry) as longs, of the rows whose vector is sound."""
    sound = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    return rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every sound row and component.

    ``components`` come by falling eigenvalue of the covariance (divisor n) of the distinct vectors; ``identity_error`` is the
    largest entry of the whitened vectors' covariance less the identity, over all components given out.
    """
    spark = rows.sparkSession
    found = [StructField("vec_id", LongType()), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()), StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())]
    schema = StructType(found)
    sound = sound_vectors(rows, vector)
    lengths = sound.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dims = lengths["dims"]
    sound = sound.filter(F.size("x") == dims)
    fit = materialize(sound.select("x").distinct(), "whitening-fit")
    n, exact = exact_sums(fit)
    sums = np.array(exact, float)
    basis, _ = np.linalg.qr(spectrum_of(fit, dims).vectors)
    values, turn = np.linalg.eigh(ritz_matrix(fit, n, sums, basis))
    basis = basis @ turn
    # the second round: what is left off the diagonal, and the values once more
    again = ritz_matrix(fit, n, sums, basis)
    values, turn = np.linalg.eigh(again)
    order = np.argsort(values)[::-1]
    values, turn = values[order], turn[:, order]
    keep = [k for k in range(min(components, dims)) if values[k] > dims * EPS * max(values[0], 0.0)]
    if not keep:
        return spark.createDataFrame([], schema)
    scale = turn[:, keep] / np.sqrt(values[keep])
    error = float(np.abs(scale.T @ again @ scale - np.eye(len(keep))).max())
    project, shares = basis @ scale, (values[keep] / np.trace(again)).tolist()
    whole = np.array(exact, object)

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for b in batches:
            x = b["x"].flatten().to_numpy(zero_copy_only=False).reshape(len(b["x"]), dims)
            most = n * (float(np.abs(x.astype(float)).max(initial=0)) + 1) * 2
            if dims * most * most < 2.0**63:
                deviation = ((n * x - whole.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                deviation = ((n * x.astype(object) - whole) ** 2).sum(1).tolist()
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation does not fit into 63 bits")
            white = (x - sums / n) @ project
            m = len(keep)
            times = lambda values: np.repeat(np.array(values, np.int64), m)
            yield {
                "vec_id": b["vec_id"].take(np.repeat(np.arange(len(x)), m)), "component": np.tile(np.arange(1, m + 1), len(x)), "n": np.full(len(x) * m, n), "deviation": times(deviation),
                "whitened": white.ravel(), "explained": np.tile(shares, len(x)), "identity_error": np.full(len(x) * m, error),
            }

    return map_arrow(sound, run, schema)
