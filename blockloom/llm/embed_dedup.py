"""Embedding near-duplicates: randomised-rotation binary codes with correction factors.

A unit vector is rotated at random into ``bits`` dimensions; its code is the signs there,
and its stored factor is the inner product of the vector with its own code. The inner
product of a code and another vector, divided by the factor, is an unbiased estimate of
the cosine, within ``EPSILON * sqrt((1 - f*f) / (f*f)) / sqrt(bits - 1)`` but with a
vanishing probability. Pairs whose upper bound is below the threshold are left; the others
are recomputed exactly, in double precision.

Candidates: bands of code bits. The bits of a band grow with the logarithm of the largest
label's rows, and the number of bands follows so that a pair right at the threshold meets
with probability ``RECALL`` (closer pairs more surely). A pair that meets in several bands
is counted in the first. Equal vectors of a label are one node with a multiplicity.

Buckets are compared in numpy blocks inside a task and return a number of links and one
edge per row, never pairs. Buckets of ``SMALL`` rows or fewer are compared many at once. Buckets over ``HOT`` rows are cut in chunks whose pairs of
chunks are dealt to different tasks; the table of hot buckets is joined by its size.

Null labels, null, empty or zero vectors and vectors with null or non-finite components
link with nothing; vectors of different lengths never link. A node is a 64-bit hash of
label and vector. Repeated rows and null ids count as vectors of their own; a component of
null ids alone has a null id. An empty table gives an empty one. Columns other than id, vector and label aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import connected_components

EPSILON, RECALL, PER_BUCKET, HOT, TILE, SMALL, SEED = 4.0, 0.998, 16, 4096, 2048, 64, 11


def bands_for(rows: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands) for the number of rows of the largest label."""
    same = 1 - math.acos(threshold) / math.pi
    bits = min(40, max(4, math.ceil(math.log2(max(rows, 1) / PER_BUCKET + 1))))
    return bits, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - same**bits)))


class Coder:
    """Codes, factors and band keys of vectors of one length."""

    def __init__(self, dim: int, bits: int, bands: int, seed: int = SEED):
        self.bits = -(-max(256, dim, bits * bands) // 64) * 64  # no bit in two bands, so that bands are independent
        rng = np.random.default_rng([seed, dim])
        self.rotation = np.linalg.qr(rng.standard_normal((self.bits, dim)))[0]
        self.places = rng.permutation(self.bits)[: bits * bands].reshape(bands, bits)
        self.weights, self.dim = 1 << np.arange(bits, dtype=np.int64), dim

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return (x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.rotation.T

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = self.rotate(x)
        return r > 0, np.abs(r).sum(axis=1) / math.sqrt(self.bits)

    def keys(self, code: np.ndarray) -> np.ndarray:
        """A row per vector, a column per band."""
        return (code[:, self.places] @ self.weights) | np.int64(self.dim << 40)

    def bound(self, factor: np.ndarray) -> np.ndarray:
        return EPSILON * np.sqrt(np.maximum(0.0, 1 - factor**2)) / factor / math.sqrt(self.bits - 1)


def _star(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n rows the least row that it reaches."""
    root = np.arange(n)
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def bucket_links(x: np.ndarray, code: np.ndarray, factor: np.ndarray, mult: np.ndarray, chunk: np.ndarray, band: int, coder: Coder, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(links counted here, least row reached) of the rows of a bucket, or None without links.

    ``chunk``: where it has two values, only pairs across them count here.
    """
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rotated, sign = (unit @ coder.rotation.T).astype(np.float32), np.where(code, np.float32(1), np.float32(-1))
    bound, keys = coder.bound(factor), coder.keys(code)[:, :band]
    across = chunk.min() != chunk.max()
    links, count = [], np.zeros(n, np.int64)
    for i in range(0, n, TILE // 2):
        for j in range(i, n, TILE // 2):
            ri, rj = slice(i, i + TILE // 2), slice(j, j + TILE // 2)
            upper = (sign[ri] @ rotated[rj].T) / (math.sqrt(coder.bits) * factor[ri, None]) + bound[ri, None]
            need = upper >= threshold - 1e-6
            if i == j:
                need &= np.triu(np.ones(need.shape, bool), 1)
            if across:
                need &= chunk[ri, None] != chunk[None, rj]
            a, b = np.nonzero(need)
            a, b = a + i, b + j
            for k in range(0, len(a), 65536):
                p, q = a[k : k + 65536], b[k : k + 65536]
                near = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
                p, q = p[near], q[near]
                if len(p):
                    links.append((p, q))
                    new = ~(keys[p] == keys[q]).any(axis=1)
                    np.add.at(count, p[new], mult[q[new]])
                    np.add.at(count, q[new], mult[p[new]])
    return (count, _star(n, links)) if links else None


def small_links(x: np.ndarray, code: np.ndarray, factor: np.ndarray, mult: np.ndarray, band: np.ndarray, sizes: np.ndarray, coder: Coder, threshold: float) -> tuple[np.ndarray, np.ndarray] | None:
    """As ``bucket_links``, for whole buckets of few rows that lie one after another; ``band``: of each row."""
    n = len(x)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    rotated, sign = (unit @ coder.rotation.T).astype(np.float32), np.where(code, np.float32(1), np.float32(-1))
    scale, bound, keys = math.sqrt(coder.bits) * factor, coder.bound(factor), coder.keys(code)
    starts, links, count = np.cumsum(sizes) - sizes, [], np.zeros(n, np.int64)
    m = 2
    while m < 2 * sizes.max():  # buckets of over m / 2 to m rows, filled up to m with their last row
        those = np.flatnonzero((sizes <= m) & (sizes > m // 2))
        step = max(1, (1 << 20) // (m * coder.bits))
        for k in range(0, len(those), step):
            g = those[k : k + step]
            rows = starts[g, None] + np.minimum(np.arange(m), sizes[g, None] - 1)
            upper = np.matmul(sign[rows], rotated[rows].transpose(0, 2, 1)) / scale[rows][:, :, None] + bound[rows][:, :, None]
            need = (upper >= threshold - 1e-6) & np.triu(np.ones((m, m), bool), 1) & (np.arange(m) < sizes[g, None])[:, None, :]
            at, a, b = np.nonzero(need)
            a, b = rows[at, a], rows[at, b]
            near = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[near], b[near]
            if len(a):
                links.append((a, b))
                new = ~((keys[a] == keys[b]) & (np.arange(keys.shape[1]) < band[a, None])).any(axis=1)
                np.add.at(count, a[new], mult[b[new]])
                np.add.at(count, b[new], mult[a[new]])
        m *= 2
    return (count, _star(n, links)) if links else None


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _banded(nodes: DataFrame, bits: int, bands: int, wide: bool) -> DataFrame:
    """A row per node and band: label, band, key, and for ``wide`` node, mult, factor, code, x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for whole in batches:
            dims = whole.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = whole.filter(pa.array(dims == dim))
                coder = coders.setdefault(dim, Coder(dim, bits, bands))
                for at in range(0, part.num_rows, 512):
                    b = part.slice(at, 512)
                    code, factor = coder.encode(_vectors(b.column("x")))
                    n = b.num_rows
                    take = pa.array(np.repeat(np.arange(n), bands))
                    out = [b.column("label").take(take), pa.array(np.tile(np.arange(bands, dtype=np.int32), n)), pa.array(coder.keys(code).ravel())]
                    if wide:
                        packed = pa.array([r.tobytes() for r in np.packbits(code, axis=1)], pa.binary())
                        out += [b.column("node").take(take), b.column("mult").take(take), pa.array(factor).take(take), packed.take(take), b.column("x").take(take)]
                    yield pa.RecordBatch.from_arrays(out, ["label", "band", "key", "node", "mult", "factor", "code", "x"][: len(out)])

    kind = nodes.schema["x"].dataType.simpleString()
    narrow = "label int, band int, key bigint"
    return nodes.mapInArrow(run, f"{narrow}, node bigint, mult bigint, factor double, code binary, x {kind}" if wide else narrow)


def near_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    x = F.col("x")
    usable = x.isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)
    usable &= F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("x"), F.col(label).cast("int").alias("label"))
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "x")))
    nodes = rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("x").alias("x"), F.count("*").alias("mult"), F.min("vec_id").alias("least"))
    nodes = staged(nodes.withColumn("dim", F.size("x")), "nodes")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = bands_for(largest, threshold)
    bucket = ["label", "band", "key"]
    sizes = _banded(nodes, bits, bands, False).groupBy(*bucket).count().where(F.col("count") > HOT)
    few = SMALL
    hot = staged(sizes.select(*bucket, F.ceil(F.col("count") / (TILE // 2)).cast("int").alias("chunks")), "hot")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}

        def work(t: pa.RecordBatch, sizes: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            """Links in one bucket, or in small buckets of ``sizes`` rows."""
            xs = _vectors(t.column("x"))
            if xs.shape[1] not in coders:
                coders[xs.shape[1]] = Coder(xs.shape[1], bits, bands)
            coder = coders[xs.shape[1]]
            packed = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(len(xs), -1)
            code = np.unpackbits(packed, axis=1).astype(bool)
            node, factor, mult, band = (t.column(c).to_numpy() for c in ("node", "factor", "mult", "band"))
            if sizes is None:
                found = bucket_links(xs, code, factor, mult, t.column("chunk").to_numpy(), int(band[0]), coder, threshold)
            else:
                found = small_links(xs, code, factor, mult, band, sizes, coder, threshold)
            if found is not None:
                count, root = found
                own = (count > 0) | (root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(count[own]), pa.array(node[root[own]])], ["node", "links", "to"])

        def whole(b: pa.RecordBatch, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Links of the buckets that begin and end at ``cuts``."""
            starts, sizes = cuts[:-1], np.diff(cuts)
            small = (sizes <= few) & (b.column("ta").to_numpy()[starts] == b.column("tb").to_numpy()[starts])
            for k in np.flatnonzero(~small & (sizes > 1)).tolist():
                yield from work(b.slice(int(starts[k]), int(sizes[k])), None)
            dims = pc.list_value_length(b.column("x")).to_numpy()[starts]
            small &= sizes > 1
            for dim in np.unique(dims[small]).tolist():
                of = np.flatnonzero(small & (dims == dim))
                part = np.split(of, np.flatnonzero(np.diff(np.cumsum(sizes[of]) // 4096)) + 1)  # about 4,096 rows at a time
                for g in part:
                    first = np.cumsum(sizes[g]) - sizes[g]
                    rows = np.repeat(starts[g] - first, sizes[g]) + np.arange(sizes[g].sum())
                    yield from work(b.take(pa.array(rows)), sizes[g])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            b = pa.concat_batches([*held, batch])
            change = np.zeros(b.num_rows - 1, bool)
            for c in [*bucket, "ta", "tb"]:
                v = b.column(c).to_numpy()
                change |= v[1:] != v[:-1]
            cuts = np.concatenate(([0], np.flatnonzero(change) + 1))  # the last bucket may go on
            if len(cuts) > 1:
                yield from whole(b, cuts)
            held = [b.slice(int(cuts[-1]))]
        if held:
            yield from whole(held[0], np.array([0, held[0].num_rows]))

    banded = _banded(nodes, bits, bands, True).join(hot, bucket, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    banded = banded.withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("chunks")).cast("int"))
    banded = banded.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    banded = banded.withColumns({"ta": F.least("chunk", "o"), "tb": F.greatest("chunk", "o")}).drop("chunks", "o")
    dealt = banded.repartition(*bucket, "ta", "tb").sortWithinPartitions(*bucket, "ta", "tb")
    found = staged(dealt.mapInArrow(links, "node bigint, links bigint, to bigint"), "vector-links")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "n")
    classes = nodes.select("node", "mult", "least").join(counted, "node", "left").join(roots, F.col("node") == F.col("n"), "left")
    classes = classes.select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "least", F.coalesce("root", "node").alias("root"))
    best = classes.groupBy("root").agg(F.min("least").alias("component"))
    of = staged(classes.join(best, "root").select("node", "n_links", "component"), "vector-components")
    linked = rows.where("node is not null").select("vec_id", "node").join(of, "node").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("node is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
