"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: bit i is 1 if set in over half of the XXH64 hashes of a text's
word shingles. Fingerprints within 4 bits are linked.

Keys: the 64 bits are cut in segments of 22, 21 and 21. A segment is read as a word of the
perfect binary Golay code [23, 12, 7] (missing bits zero), and the words within one bit of
it are decoded to the indices of their nearest codewords: one to six of them. Two segments
within two bits have a word within one bit of both, so they share an index. Of 4 differing
bits over three segments, the two least changed segments have at most two each. So linked
fingerprints share a key (pair of segments, index, index) for some pair, and no link is lost.

Equal fingerprints are one node first, so exact copies cost nothing. Keys are shuffled once
and sorted; small buckets compare rows at each distance, larger ones compare in tiles and
return a spanning star of each of their components instead of all pairs. Buckets beyond
``LARGE`` are returned by key and parted once more: of five runs of bits two linked fingerprints agree on
one, so each row goes to its five parts of the bucket. Only parts that are beyond ``LARGE`` too, of
fingerprints that lie close together, are compared in tiles dealt over tasks.

Null texts count as empty: fingerprint zero, linked like any other. Null ids take part; a
component of null ids alone has a null id. Repeated rows share a component. An empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, WORD, slices, staged
from .components import connected_components

RADIUS, SHINGLE, SEED = 4, 4, 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
PAIRS = ((0, 1), (0, 2), (1, 2))
SMALL, LARGE, TILE = 16, 8192, 2048
_WORD = re.compile(WORD.encode())
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; of the whole sequence where it is shorter."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES))
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[s:e], SEED) for s, e in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; none: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


class Golay:
    """Nearest codeword indices in the systematic [23, 12] code: 12 message bits above 11 check bits."""

    def __init__(self):
        checks = np.arange(4096, dtype=np.uint32) << np.uint32(11)
        for bit in range(22, 10, -1):
            checks = np.where(checks >> np.uint32(bit) & np.uint32(1), checks ^ np.uint32(_GENERATOR << (bit - 11)), checks)
        self.check = checks.astype(np.uint32)
        self.error = np.zeros(2048, np.uint32)
        bits = [1 << i for i in range(23)]
        few = [0] + bits + [a | b for i, a in enumerate(bits) for b in bits[:i]]
        few += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
        e = np.array(few, np.uint32)
        self.error[self.syndrome(e)] = e  # perfect: each of the 2048 syndromes has one error of at most three bits

    def syndrome(self, word: np.ndarray) -> np.ndarray:
        return self.check[word >> np.uint32(11)] ^ (word & np.uint32(0x7FF))

    def indices(self, word: np.ndarray, bits: int) -> np.ndarray:
        """A row per word: the indices of the codewords nearest to the words within one of ``bits`` bits; repeats are -1."""
        flips = np.array([0] + [1 << i for i in range(bits)], np.uint32)
        near = word[:, None] ^ flips[None, :]
        index = np.sort(((near ^ self.error[self.syndrome(near)]) >> np.uint32(11)).astype(np.int32), axis=1)
        index[:, 1:][index[:, 1:] == index[:, :-1]] = -1
        return -np.sort(-index, axis=1)[:, :6]


def bucket_keys(fp: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint), all keys of all fingerprints."""
    each = [golay.indices(((fp >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.uint32), n) for s, n in SEGMENTS]
    keys, owners = [], []
    for p, (i, j) in enumerate(PAIRS):
        a, b = each[i][:, :, None], each[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), (p << 24) | (a << 12) | b, -1).reshape(len(fp), -1)
        row, col = np.nonzero(key >= 0)
        keys.append(key[row, col].astype(np.int64))
        owners.append(fp[row])
    return np.concatenate(keys), np.concatenate(owners)


def _links(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of x and y (columns: words of 64 bits) differ in ``radius`` bits at most."""
    d = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
    for w in range(1, x.shape[1]):
        d = d + np.bitwise_count(x[:, None, w] ^ y[None, :, w])  # up to 255 bits in a byte
    return d <= radius


def star_edges(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, centre) by row number: a spanning star of each component of some fingerprints."""
    left, a, b = np.arange(len(fp)), [left0 := np.zeros(0, np.int64)], [left0]
    while len(left) > 1:
        root, front, rest = left[0], left[:1], left[1:]
        while len(front) and len(rest):
            hit = np.zeros(len(rest), bool)
            for k in range(0, len(front), TILE):
                todo = np.flatnonzero(~hit)
                if not len(todo):
                    break
                for t in range(0, len(todo), TILE):
                    part = todo[t : t + TILE]
                    hit[part] = _links(fp[rest[part]], fp[front[k : k + TILE]], radius).any(axis=1)
            front, rest = rest[hit], rest[~hit]
            a.append(front)
            b.append(np.repeat(root, len(front)))
        left = rest
    return np.concatenate(a), np.concatenate(b)


def _edge_batch(a: np.ndarray, b: np.ndarray, large: np.ndarray) -> pa.RecordBatch:
    if len(a):
        a, b = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    n = len(large)
    cols = [np.concatenate([a, large]), np.concatenate([b, large]), np.concatenate([np.zeros(len(a), bool), np.ones(n, bool)])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "large"])


def _columns(batch: pa.RecordBatch, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Node numbers and fingerprint words of a batch."""
    fp = np.stack([batch.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
    return batch.column("node" if len(words) > 1 else words[0]).to_numpy(), fp


def bucket_edges(batches: Iterator[pa.RecordBatch], radius: int, words: list[str], chunk: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Edges (node, node) of buckets that arrive sorted by key; a bucket beyond LARGE gives its key instead."""
    held: list[tuple] = []
    rows, skip = 0, None

    def work(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff(np.append(first, len(key)))
        small = np.repeat(count <= SMALL, count)
        a, b, over = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for d in range(1, min(SMALL, int(count.max()))):
            i = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]).sum(axis=1) <= radius]
            a.append(node[i])
            b.append(node[i + d])
        for g in np.flatnonzero(count > SMALL):
            at = slice(first[g], first[g] + count[g])
            if count[g] > LARGE:
                over.append(key[first[g]])
                continue
            x, y = star_edges(fp[at], radius)
            a.append(node[at][x])
            b.append(node[at][y])
        return _edge_batch(np.concatenate(a), np.concatenate(b), np.array(over, np.int64))

    for batch in batches:
        key, (node, fp) = batch.column("key").to_numpy(), _columns(batch, words)
        if skip is not None:  # the rest of a bucket that was given by key
            go = int(np.searchsorted(key, skip, side="right"))
            key, node, fp = key[go:], node[go:], fp[go:]
        if not len(key):
            continue
        skip = None
        held.append((key, node, fp))
        rows += len(key)
        if rows < chunk:
            continue
        key, node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if len(key) - cut > LARGE:
            skip, cut = int(key[-1]), len(key)
        if cut:
            yield work(key[:cut], node[:cut], fp[:cut])
        held, rows = [(key[cut:], node[cut:], fp[cut:])] if cut < len(key) else [], len(key) - cut
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _linked_in_buckets(keyed: DataFrame, radius: int, words: list[str]) -> DataFrame:
    """Edges (a, b) by node that connect whatever a bucket links, from rows (key, fingerprint words and, of several words, node)."""
    kind = "a bigint, b bigint, large boolean"

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from bucket_edges(batches, radius, words)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            node, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            x, y = star_edges(fp, radius)
            return _edge_batch(node[x], node[y], np.zeros(0, np.int64))

        for b in batches:  # sorted by tile: a pair of chunks of one bucket
            t, (node, fp) = b.column("tile").to_numpy(), _columns(b, words)
            first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else []
            for s, e in zip(first, [*first[1:], len(t)], strict=False):
                if t[s] != at and held:
                    yield done()
                    held = []
                at = t[s]
                held.append((node[s:e], fp[s:e]))
        if held:
            yield done()

    def linked(keyed: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Links of the buckets, and the rows of those that are too large."""
        found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(edges, kind), "links")
        hot = found.where("large").select(F.col("a").alias("key")).distinct()
        return found.where(~F.col("large")).select("a", "b"), keyed.join(hot, "key") if hot.limit(1).count() else None

    links, rows = linked(keyed)
    if rows is not None and len(words) == 1:
        size = -(-64 // (radius + 1))
        runs = [F.struct(F.lit(k).alias("k"), F.expr(f"shiftrightunsigned({words[0]}, {k}) & {(1 << min(size, 64 - k)) - 1}L").alias("v")) for k in range(0, 64, size)]
        parts = rows.withColumn("run", F.explode(F.array(*runs))).withColumn("key", F.xxhash64("key", "run.k", "run.v")).drop("run")
        more, rows = linked(staged(parts.select(*keyed.columns), "parted"))
        links = links.unionByName(more)
    if rows is not None:
        sizes = staged(rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n")), "large")
        rows = rows.join(sizes, "key").withColumn("c", F.pmod(F.xxhash64(*words), F.col("n")).cast("int"))
        rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        rows = rows.select(F.xxhash64("key", F.least("c", "o"), F.greatest("c", "o")).alias("tile"), *[c for c in keyed.columns if c != "key"])
        links = links.unionByName(rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(tiles, kind).select("a", "b"))
    return links


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column("__text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp)], [*b.schema.names[:-1], "fp"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "fp bigint"])
    return chosen.mapInArrow(run, ddl)


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect what is linked, from a table of distinct ``fp``. Not all links: a spanning set of them."""
    if radius > RADIUS:
        raise ValueError(f"these keys find links up to {RADIUS} bits")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for b in slices(batches, 4096):
            k, f = bucket_keys(b.column("fp").to_numpy().view(np.uint64), golay)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(f.view(np.int64))], ["key", "fp"])

    return _linked_in_buckets(distinct.select("fp").mapInArrow(keys, "key bigint, fp bigint"), radius, ["fp"])


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns, ``fp`` and ``component_id``, the smallest id of what is reachable over links."""
    named = docs.select(*keep, F.col(doc_id).alias("__id"), text)
    rows = staged(fingerprints(named, text, (*keep, "__id"), shingle), "fingerprints")
    distinct = staged(rows.groupBy("fp").agg(F.min("__id").alias("least")), "distinct")
    roots = connected_components(fingerprint_links(distinct, radius))
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = staged(classes.join(best, "root").select(F.col("fp").alias("f"), "component_id"), "components")
    return rows.join(of, F.col("fp") == F.col("f")).select(*keep, "fp", "component_id")


COPY_SHINGLE, COPY_BANDS, COPY_ROWS = 5, 10, 4
_HASHES = 1 << 20  # shingle hashes of a chunk of a large bucket
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def alike(both, a, b):
    """A Jaccard similarity of 0.8 or more, in whole numbers: 5 both >= 4 (a + b - both)."""
    return 9 * both >= 4 * (a + b)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, COPY_SHINGLE))


def copy_keys(h: np.ndarray) -> np.ndarray:
    """A key per band: sets at similarity s share one with probability s**4 each, 0.41 at 0.8, so some key of ten with 0.995."""
    rng = np.random.default_rng(23)
    mask, factor = rng.integers(0, 1 << 64, (2, COPY_BANDS * COPY_ROWS, 1), np.uint64)
    factor |= np.uint64(1)
    least = np.full(len(mask), np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(h), 8192):
        mixed = (h[None, at : at + 8192] ^ mask) * factor
        least = np.minimum(least, ((mixed ^ (mixed >> np.uint64(31))) * _SPREAD).min(axis=1))
    key = np.arange(COPY_BANDS, dtype=np.uint64)
    for r in range(COPY_ROWS):
        key = (key ^ least[r::COPY_ROWS]) * _SPREAD
        key ^= key >> np.uint64(29)
    return key


def copy_star(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(member, centre) by row number: a spanning star of each component of sets that are alike, all pairs judged."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    end = np.cumsum(size)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    left, a, b = np.arange(len(sets)), [], []
    while len(left) > 1:
        root, front, rest = int(left[0]), [int(left[0])], left[1:]
        while front and len(rest):
            f = front.pop()
            own = np.zeros(len(values), bool)
            own[code[end[f] - size[f] : end[f]]] = True
            near = rest[alike(np.minimum(size[rest], size[f]), size[rest], size[f])]
            if not len(near):
                continue
            if len(near) * 4 < len(sets):
                both = np.array([np.count_nonzero(own[code[end[x] - size[x] : end[x]]]) for x in near.tolist()])
            else:
                sums = np.concatenate(([0], np.cumsum(own[code])))
                both = sums[end[near]] - sums[end[near] - size[near]]
            hit = near[alike(both, size[near], size[f])]
            a += hit.tolist()
            b += [root] * len(hit)
            front += hit.tolist()
            rest = rest[~np.isin(rest, hit)]
        left = rest
    return a, b


def _copies_in_tiles(rows: DataFrame) -> DataFrame:
    """Edges (a, b) from rows (tile, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, sets, a, b = None, [], [], [], []

        def done() -> None:
            if len(node) > 1:
                x, y = copy_star(sets)
                a.extend(node[i] for i in x)
                b.extend(node[i] for i in y)

        for batch in batches:
            for t, n, s in zip(batch.column("tile").to_pylist(), batch.column("node").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if t != at:
                    done()
                    at, node, sets = t, [], []
                node.append(n)
                sets.append(np.frombuffer(s, "<u8"))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear(), b.clear()
        done()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("tile", "node", "shingles").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a bigint, b bigint")


def _copy_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            both = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
            ok = [bool(alike(len(np.intersect1d(x := np.frombuffer(s, "<u8"), y := np.frombuffer(t, "<u8"), assume_unique=True)), len(x), len(y))) for s, t in both]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(c), F.col("shingles").alias(d)) for c, d in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def copy_links(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the alike of each bucket, from rows (key, node) and (node, size, shingles).

    Pairs of a bucket are judged by their whole sets. In a bucket beyond a chunk all rows meet
    its least node first; those unlike it then meet all rows in tiles, dealt over tasks.
    """
    sized = keyed.join(sets.select("node", "size"), "node")
    chunks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum("size") / _HASHES)).cast("int")
    buckets = staged(sized.groupBy("key").agg(chunks.alias("n"), F.min("node").alias("pivot")), "copy-buckets")
    rows = staged(keyed.join(buckets, "key"), "copy-rows")
    links = _copies_in_tiles(rows.where("n = 1").select(F.col("key").alias("tile"), "node").join(sets, "node"))
    if buckets.where("n > 1").limit(1).count():
        large = rows.where("n > 1")
        near = staged(_copy_pairs(large.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), sets), "copy-pivots")
        known = near.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.lit(True).alias("known"))
        large = large.join(known, ["node", "pivot"], "left").withColumn("known", F.col("known").isNotNull() | (F.col("node") == F.col("pivot")))
        large = staged(large.withColumn("c", F.pmod(F.xxhash64("node"), F.col("n")).cast("int")), "copy-large")
        # A tile is a chunk of the rows that the pivot leaves and a chunk of all rows.
        open_ = large.where("not known").select("key", F.col("c").alias("o")).distinct()
        every = large.join(open_, "key").select("key", "node", "o", "c")
        own = large.where("not known").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", "node", F.col("c").alias("o"), F.col("d").alias("c"))
        tiles = every.unionByName(own).select(F.xxhash64("key", "o", "c").alias("tile"), "node").distinct()
        links = links.unionByName(near).unionByName(_copies_in_tiles(tiles.join(sets, "node")))
    return links


def near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each group of near copies: shingles of five words, similarity 0.8 or more.

    Similarity is that of Jaccard between the sets of shingle hashes (64 bits). Candidates are linked by their
    fingerprints (``fingerprint_links``), directly or over others, or, as fingerprints miss pairs at 0.8, share
    one of ten keys, each the hash of four least values of the set under fixed mixings: a pair
    at 0.8 shares one with probability 0.995, at 0.85 with 0.999, at any size of sets and input.
    (Fingerprints of half the bits would need more keys with every doubling.) A candidate
    links only if its whole sets are alike. Equal sets are one node first; buckets with the
    same members are one.

    The row with the smallest id stays, null ids last, ties by the hash of the row; rows alike in all columns
    leave one. Null texts count as empty, and empty ones are copies of each other.
    """
    names = docs.columns
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in names])

    def node_of(h: np.ndarray) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(h.tobytes(), SEED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column("t").to_pylist()]
            node = pa.array(np.array([node_of(h) for h in sets], np.uint64).view(np.int64))
            keys = pa.array([copy_keys(h).view(np.int64) if len(h) else [] for h in sets], pa.list_(pa.int64()))
            fp = pa.array(np.array([fingerprint(t) for t in b.column("t").to_pylist()], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], node, keys, fp], ["id", "h", "node", "keys", "fp"])

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column("t").to_pylist()]
            cols = [b.column("node"), pa.array(list(map(len, sets)), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "size", "shingles"])

    chosen = docs.select(F.col(doc_id).alias("id"), row_hash.alias("h"), F.col(text).alias("t"))
    kind = chosen.schema["id"].dataType.simpleString()
    rows = staged(chosen.mapInArrow(run, f"id {kind}, h bigint, node bigint, keys array<bigint>, fp bigint"), "copy-keys")
    first = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("h").alias("h"))
    distinct = staged(rows.groupBy("node").agg(F.min("keys").alias("keys"), F.min(first).alias("first")), "copy-distinct")
    printed = staged(rows.where(F.size("keys") > 0).select("node", "fp").distinct(), "copy-prints")
    linked = connected_components(fingerprint_links(printed.select("fp").distinct())).withColumnRenamed("node", "f")
    groups = printed.join(linked, F.col("fp") == F.col("f"), "left").select(F.xxhash64(F.lit("fp"), F.coalesce("root", "fp")).alias("key"), "node").distinct()
    keyed = distinct.select(F.explode("keys").alias("key"), "node").unionByName(groups)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("m"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    keyed = staged(keyed.join(shared.groupBy("n", "m", "x").agg(F.min("key").alias("key")).select("key"), "key"), "copy-shared")
    wanted = distinct.join(keyed.select("node").distinct(), "node").select("node", F.col("first.id").alias("i"), F.col("first.h").alias("g"))
    texts = chosen.join(wanted, (F.col("h") == F.col("g")) & F.col("id").eqNullSafe(F.col("i"))).select("node", "t")
    sets = staged(texts.mapInArrow(shingles, "node bigint, size bigint, shingles binary").dropDuplicates(["node"]), "copy-sets")
    roots = connected_components(copy_links(keyed, sets)).withColumnRenamed("node", "n")
    classes = distinct.join(roots, F.col("node") == F.col("n"), "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    stays = classes.groupBy("root").agg(F.min("first").alias("stays"))
    of = staged(classes.join(stays, "root").select("node", "stays"), "copy-groups")
    judged = rows.select("id", "h", "node").join(of, "node").select("id", "h", (F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("h") == F.col("stays.h"))).alias("stays"))
    counted = judged.groupBy("id", "h").agg(F.max("stays").alias("stays"), F.count("*").alias("n"))
    touched = staged(counted.where("not stays or n > 1").withColumnsRenamed({"id": "loser_id", "h": "loser_h"}), "copy-losers")
    own = "copy_of" + "_" * max(map(len, names))  # a name that no column has
    named = docs.withColumn(own, row_hash)
    touched = touched.withColumnsRenamed({"loser_id": own + "i", "loser_h": own + "h"})
    same = F.col(own + "i").eqNullSafe(F.col(f"`{doc_id}`")) & (F.col(own + "h") == F.col(own))
    alone = named.join(touched, same, "left_anti")
    repeated = named.join(touched.where("stays"), same, "left_semi").dropDuplicates([doc_id, own])
    return alone.unionByName(repeated).select(*[F.col(f"`{c}`") for c in names])
