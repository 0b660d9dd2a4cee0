"""Whitening of embeddings: a distributed centred covariance, eigenvectors by bisection, a broadcast projection.

Each entry c of a vector counts as the whole number ``floor(1024 * c) + 100000``, so sums are exact.
A first pass gives number and sums of the vectors, a second the covariance: every task centres its
vectors by the exact mean and adds their products up in a square table, and the tables' rows are
added by row. The driver gets the sums and the covariance only: both follow the dimension, not the
rows. There the covariance is brought to tridiagonal form by Householder
reflections. The leading eigenvalues are bisected by Sturm counts, all at once; their vectors
come from inverse iteration, each kept orthogonal to the earlier ones of its cluster, and are
reflected back. A third pass projects every vector on the components, which are broadcast.

Rows whose vector is null, empty or holds null or non-finite entries are dropped; so are rows whose vector has
another length than most (of two lengths that occur as often, the longer). Beyond 2**53 either way
a whole number stays at that bound. Components without variance (an eigenvalue under 1e-12 of the trace, as
when all vectors are equal or there are fewer than components) are left out, since nothing can be
scaled to them: with no variance at all, as with an empty table, there is no row. Repeated rows
count as often as they occur. A deviation that no long can hold is null. Only the vector and the kept columns are read; kept columns may have
any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

SCALE, SHIFT, MOST = 1024, 100_000, 1 << 53
COMPONENTS, NOISE = 8, 1e-12


def whole_numbers(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the usable vectors, their lengths, and the whole numbers of all of them in a row."""
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(vectors)
    values = pc.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    bad = np.bincount(row[~np.isfinite(values)], minlength=len(size)) > 0
    use = (size > 0) & ~bad
    x = np.clip(np.floor(SCALE * values[use[row]]), -MOST, MOST).astype(np.int64) + SHIFT
    return np.flatnonzero(use), size[use], x


def _of_size(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    at, size, x = whole_numbers(vectors)
    return at[size == dim], x[np.repeat(size == dim, size)].reshape(-1, dim)


@dataclass
class Centre:
    n: int
    sums: list[int]

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: long where it fits, else Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums))
        if most < 1 << 62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.deviations(x) / self.n).astype(float)


@dataclass
class Whitening:
    centre: Centre
    vectors: np.ndarray  # a column for each component, of length one
    values: np.ndarray  # eigenvalues, falling
    trace: float


def householder(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix, and the unit vectors of the reflections."""
    a, mirrors = np.array(a, float), []
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        x[0] += np.copysign(size, x[0])
        length = np.linalg.norm(x)
        v = x / length if length else x
        mirrors.append(v)
        if length:
            b = a[k + 1 :, k + 1 :]
            p = b @ v
            w = 2 * (p - (v @ p) * v)
            b -= np.outer(v, w) + np.outer(w, v)
            a[k + 1, k] = a[k, k + 1] = -np.copysign(size, x[0])
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix lie below each number."""
    tiny = np.finfo(float).tiny * 4 + np.finfo(float).eps * np.abs(e).max(initial=0) * 1e-8
    off, q, n = np.concatenate(([0.0], e**2)), np.ones(len(at)), np.zeros(len(at), np.int64)
    for k in range(len(d)):
        q = d[k] - at - off[k] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)  # a pivot of zero counts as below
        n += q < 0
    return n


def leading_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected down to neighbouring doubles."""
    around = np.concatenate(([0], np.abs(e))) + np.concatenate((np.abs(e), [0]))
    lo, hi = np.full(k, (d - around).min()), np.full(k, (d + around).max())
    room = np.finfo(float).eps * max(np.abs(lo[0]), np.abs(hi[0])) * 4 + np.finfo(float).tiny
    lo, hi = lo - room, hi + room
    upto = len(d) - np.arange(k)  # so many eigenvalues lie below anything above the one sought
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if not ((mid > lo) & (mid < hi)).any():
            break
        over = below(d, e, mid) >= upto
        hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
    return lo + (hi - lo) / 2


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """The tridiagonal system by elimination with row exchanges; pivots are ``least`` at least."""
    n = len(d)
    pivot, up, upper, x = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        lower = e[k]
        if abs(lower) > abs(pivot[k]):
            pivot[k], lower = lower, pivot[k]
            up[k], pivot[k + 1] = pivot[k + 1], up[k]
            upper[k], up[k + 1] = up[k + 1], 0.0
            x[k], x[k + 1] = x[k + 1], x[k]
        if abs(pivot[k]) < least:
            pivot[k] = np.copysign(least, pivot[k])
        m = lower / pivot[k]
        pivot[k + 1] -= m * up[k]
        up[k + 1] -= m * upper[k]
        x[k + 1] -= m * x[k]
    if abs(pivot[-1]) < least:
        pivot[-1] = np.copysign(least, pivot[-1])
    for k in range(n - 1, -1, -1):
        x[k] = (x[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (upper[k] * x[k + 2] if k + 2 < n else 0)) / pivot[k]
    return x


def leading(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; the largest entry of each is positive."""
    scale = np.abs(v).max()
    if not scale:
        return np.zeros(k), np.eye(len(v))[:, :k]
    d, e, mirrors = householder(v / scale)
    values = leading_values(d, e, k)
    norm = np.abs(d).max() + 2 * np.abs(e).max(initial=0)
    out: list[np.ndarray] = []
    for j, value in enumerate(values):
        cluster = []
        for i in range(j - 1, -1, -1):
            if values[i] - values[i + 1] > 1e-3 * norm:
                break
            cluster.append(out[i])
        x = np.random.default_rng(j).standard_normal(len(d))
        for _ in range(4):
            x /= np.linalg.norm(x)
            x = _solve(d, e, value, x, np.finfo(float).eps * norm)
            x /= np.abs(x).max()
            for _ in range(2):
                for c in cluster:
                    x -= (c @ x) * c
        out.append(x / np.linalg.norm(x))
    q = np.stack(out, axis=1)
    for i in range(len(mirrors) - 1, -1, -1):
        m = mirrors[i]
        q[i + 1 :] -= 2 * np.outer(m, m @ q[i + 1 :])
    q *= np.sign(q[np.abs(q).argmax(axis=0), np.arange(k)])
    return values * scale, q


def centre(vectors: DataFrame) -> Centre | None:
    """Number and sums of the usable vectors of the length that most have; ``vectors`` has one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        sums: dict[int, np.ndarray] = {}
        for b in slices(batches, 512):
            _, size, x = whole_numbers(b.column(0))
            for dim in np.unique(size).tolist():
                mine = x[np.repeat(size == dim, size)].reshape(-1, dim)
                n[dim] = n.get(dim, 0) + len(mine)
                sums[dim] = sums.get(dim, np.zeros(dim, object)) + mine.sum(axis=0).astype(object)  # 512 times 2**53 fits
        for dim, total in sums.items():
            cols = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n[dim]] * dim, pa.int64()), pa.array([Decimal(int(s)) for s in total], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(cols, ["dim", "place", "n", "s"])

    parts = staged(vectors.mapInArrow(run, "dim int, place int, n bigint, s decimal(38,0)"), "vector-sums")
    sums = parts.groupBy("dim", "place").agg(F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    most = sums.where("place = 0").orderBy(F.desc("n"), F.desc("dim")).first()
    if most is None:
        return None
    rows = sorted(sums.where(F.col("dim") == most.dim).collect(), key=lambda r: r.place)  # one number a dimension
    return Centre(most.n, [int(r.s) for r in rows])


def covariance(vectors: DataFrame, centre: Centre) -> np.ndarray:
    dim = len(centre.sums)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((dim, dim))
        for b in slices(batches, 4096):
            y = centre.centred(_of_size(b.column(0), dim)[1])
            table += y.T @ y
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([r.astype("<f8").tobytes() for r in table])], ["place", "r"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # a task's share of the table's rows
        for b in batches:
            for k, r in zip(b.column("place").to_pylist(), b.column("r").to_pylist(), strict=True):
                total[k] = total.get(k, 0.0) + np.frombuffer(r, "<f8")
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.astype("<f8").tobytes() for x in total.values()])], ["place", "r"])

    kind = "place int, r binary"
    rows = vectors.mapInArrow(products, kind).repartition(F.col("place")).sortWithinPartitions("place", "r").mapInArrow(added, kind).collect()  # dim rows
    table = np.zeros((dim, dim))
    for r in rows:
        table[r.place] = np.frombuffer(r.r, "<f8")
    return (table + table.T) / 2 / centre.n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """None where no vector is usable."""
    c = centre(vectors)
    if c is None:
        return None
    v = covariance(vectors, c)
    trace = float(np.trace(v))
    values, q = leading(v, min(components, len(v)))
    k = int(np.sum(values > NOISE * trace)) if trace > 0 else 0
    return Whitening(c, q[:, :k], values[:k], trace)


def whiten(rows: DataFrame, vector: str, keep: tuple[str, ...] = (), components: int = COMPONENTS) -> DataFrame:
    """``keep`` columns, n, deviation, whitened (a number for each component) and explained (likewise) of every usable row."""
    model = fit(rows.select(vector), components)
    chosen = rows.select(*keep, F.col(vector).alias("__vector"))
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n bigint, deviation bigint, whitened array<double>, explained array<double>"])
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], kind)
    given = rows.sparkSession.sparkContext.broadcast(model)  # components times dimensions numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        dim, k = m.vectors.shape
        for b in slices(batches, 1024):
            at, x = _of_size(b.column(b.num_columns - 1), dim)
            whole = m.centre.deviations(x)
            far = whole.astype(object) if whole.dtype == object or dim * float(np.abs(whole).max(initial=0)) ** 2 > 2.0**62 else whole
            square = [None if s >= 1 << 63 else int(s) for s in (far * far).sum(axis=1)] if len(x) else []
            w = (whole / m.centre.n).astype(float) @ m.vectors / np.sqrt(m.values)
            ends = pa.array(np.arange(len(at) + 1) * k, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (w, np.tile(m.values / m.trace, (len(at), 1)))]
            kept = [c.take(pa.array(at)) for c in b.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([m.centre.n] * len(at), pa.int64()), pa.array(square, pa.int64()), *lists], [*b.schema.names[:-1], "n", "deviation", "whitened", "explained"])

    return chosen.mapInArrow(project, kind)


def identity_error(whitened: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row: the largest entry, without sign, of the whitened columns' covariance minus the identity."""
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    sums = whitened.agg(*[F.covar_pop(F.get("whitened", F.lit(a)), F.get("whitened", F.lit(b))).alias(f"c{a}_{b}") for a, b in pairs])
    return sums.select(F.greatest(F.lit(0.0), *[F.abs(F.col(f"c{a}_{b}") - float(a == b)) for a, b in pairs]).alias("identity_error"))
