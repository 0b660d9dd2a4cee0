"""Periodic runs of words: stretches that repeat with a period at least four times over.

A run is a stretch of consecutive words with smallest period q, at least ``max(6, 4 * q)``
words long, that no neighbouring word extends keeping period q. Texts are taken in groups,
their words numbered and laid one after another, each text closed by a number of its own, so
that nothing repeats across texts.

Longest common extensions come from a difference cover. Of the places modulo ``V`` only those
in a cover are sampled, about ``2 * sqrt(V)`` of ``V``; only their suffixes are sorted, by blocks
of ``V`` words and then by doubling. Any two places reach sampled places together within ``V``
words: so many words are compared, and the rest is the least of a range of the sorted suffixes'
common prefixes, read from a sparse table.

Every run of period q holds four places in a row of the grid of multiples of q, and all grids
together have about ``n * log(n)`` places. Places whose next three equal them get an extension
to the place q later. That ends the stretch; its start is found by bisection with extensions
of earlier places. A stretch with the same ends under several periods has the least of them.

Null texts have no words. Empty texts, texts of any length, repeated rows and an empty table need
nothing special: each row's result depends on its text only. Long texts are worked on in blocks of
``ANCHORS`` grid places, so memory grows with the words of the longest text, not with its grid. Only the text and the kept columns are
read; kept columns may have any name but ``runs`` and ``collapsed``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

V, GROUP_WORDS, ANCHORS = 32, 150_000, 1 << 20
LEAST, TIMES = 6, 4


@cache
def cover(v: int = V) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Residues whose differences are all residues; each one's number (or -1); and by i and j - i, modulo v, the words to the next sampled places of both."""
    chosen, missing = [0], set(range(1, v))
    while missing:
        gain = lambda r: len({(r - c) % v for c in chosen} & missing | {(c - r) % v for c in chosen} & missing)
        best = max(range(v), key=lambda r: (gain(r), -r))
        missing -= {(best - c) % v for c in chosen} | {(c - best) % v for c in chosen}
        chosen.append(best)
    residues = np.array(sorted(chosen))
    number = np.full(v, -1)
    number[residues] = np.arange(len(residues))
    ahead = np.array([[next(h for h in range(v) if number[(i + h) % v] >= 0 and number[(i + d + h) % v] >= 0) for d in range(v)] for i in range(v)])
    return residues, number, ahead


def _numbered(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    return np.unique(keys, return_inverse=True)[1]


class Extensions:
    """Longest common extensions of places of ``x``, whose last number occurs once."""

    def __init__(self, x: np.ndarray, v: int = V):
        self.v, (residues, self.number, self.ahead) = v, cover(v)
        self.per = len(residues)
        self.x = np.concatenate((x, np.zeros(2 * v, x.dtype)))
        blocks = np.arange(-(-len(x) // v))
        at = (blocks[:, None] * v + residues).ravel()  # sampled places; those past the end come last in each block and are never asked for
        levels = [self._blocks(at)]
        while levels[-1].max() + 1 < len(at):  # names of blocks of v, 2v, 4v, ... words
            step, own = self.per << (len(levels) - 1), levels[-1]
            later = np.zeros(len(at), np.int64)
            later[: max(0, len(at) - step)] = own[step:] + 1
            named = _numbered(own * (len(at) + 1) + later)
            if named.max() == own.max():  # only places past the end still agree
                break
            levels.append(named)
        order = np.argsort(levels[-1], kind="stable")
        self.rank = np.empty(len(at), np.int64)
        self.rank[order] = np.arange(len(at))
        self.table = [self._prefixes(at, order, levels)]
        while 2 << (len(self.table) - 1) <= len(self.table[0]):  # least of 1, 2, 4, ... common prefixes
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """Names of the blocks of v words at the sampled places, in the order of their words."""
        x = np.concatenate((self.x, np.zeros(self.v, self.x.dtype)))
        pair = lambda at, k: x[at + k] << 32 | x[at + k + 1]
        first = min(8, self.v)
        keys = np.stack([pair(at, k) for k in range(0, first, 2)])
        order = np.lexsort(keys[::-1])
        new = np.concatenate(([True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)))
        start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        name = np.empty(len(at), np.int64)
        name[order] = start
        tied = np.flatnonzero(np.bincount(start, minlength=len(at))[name] > 1)
        if self.v > first and len(tied):  # the rest of the block, only where its beginning occurs twice
            keys = np.stack([name[tied], *(pair(at[tied], k) for k in range(first, self.v, 2))])
            order = np.lexsort(keys[::-1])
            new = np.concatenate(([True], (keys[:, order[1:]] != keys[:, order[:-1]]).any(axis=0)))
            place = np.arange(len(tied))
            group = keys[0, order]
            head = np.searchsorted(group, group)  # of the beginning's first member
            name[tied[order]] = group + np.maximum.accumulate(np.where(new, place, 0)) - head
        return _numbered(name)

    def _prefixes(self, at: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that neighbours in the order of sampled suffixes have in common."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            step = self.per << k
            inside = np.maximum(a, b) < len(at)
            same = np.flatnonzero(inside)[levels[k][a[inside]] == levels[k][b[inside]]]
            a[same] += step
            b[same] += step
            common[same] += self.v << k
        live = np.flatnonzero(np.maximum(a, b) < len(at))
        for k in range(self.v):
            live = live[self.x[at[a[live]] + k] == self.x[at[b[live]] + k]]
            if not len(live):
                break
            common[live] += 1
        return common

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The number of words from each i on that equal those from j on; i and j differ."""
        h = self.ahead[i % self.v, (j - i) % self.v]
        out = h.copy()
        live, k = np.arange(len(i)), 0
        apart = np.zeros(len(i), bool)
        while len(live := live[h[live] > k]):
            same = self.x[i[live] + k] == self.x[j[live] + k]
            out[live[~same]], apart[live[~same]] = k, True
            live, k = live[same], k + 1
        far = np.flatnonzero(~apart)
        if len(far):
            rank = [self.rank[(p // self.v) * self.per + self.number[p % self.v]] for p in (i[far] + h[far], j[far] + h[far])]
            lo, hi = np.minimum(*rank), np.maximum(*rank)
            level = np.frexp((hi - lo).astype(float))[1] - 1
            for k in np.unique(level).tolist():
                m = level == k
                out[far[m]] += np.minimum(self.table[k][lo[m]], self.table[k][hi[m] - (1 << k)])
        return out


def _grid(start: np.ndarray, n: np.ndarray, block: int = ANCHORS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the places of every grid that have three more places of it within their text, a block of places at a time."""
    most = n // TIMES
    text = np.repeat(np.arange(len(n)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    places = (n[text] - 1) // q - (TIMES - 2)
    upto = np.cumsum(places)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block, "right")))
        c = places[at:end]
        k = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        period = np.repeat(q[at:end], c)
        yield np.repeat(start[text[at:end]], c) + k * period, period
        at = end


def _equal_places(x: np.ndarray, start: np.ndarray, n: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid places that the next three of the grid equal."""
    for i, q in _grid(start, n, block):
        for k in range(1, TIMES):
            m = np.flatnonzero(x[i] == x[i + k * q])
            i, q = i[m], q[m]
        if len(i):
            yield i, q


def runs_of(ids: list[np.ndarray], block: int = ANCHORS) -> list[np.ndarray]:
    """Of each text, given as numbers of its words, the runs as rows of start, length, period, by start and then period."""
    n = np.array([len(t) for t in ids], np.int64)
    none = np.zeros((0, 3), np.int64)
    out = [none] * len(ids)
    joined = np.concatenate([*ids, np.zeros(0, np.int64)]).astype(np.int64)
    first = np.cumsum(n) - n
    some = {int(t) for i, _ in _equal_places(joined, first[n >= LEAST], n[n >= LEAST], block) for t in np.unique(np.searchsorted(first, i, "right") - 1)}
    if not some:
        return out
    mine = np.array(sorted(some))  # texts in which anything can be a run
    size = n[mine]
    top = int(joined.max()) + 1
    x = np.concatenate([part for k, t in enumerate(mine.tolist()) for part in (ids[t], [top + k])]).astype(np.int64)
    start = np.cumsum(size + 1) - size - 1
    longest = Extensions(x)
    found = []
    for i, q in _equal_places(x, start, size, block):
        f = longest.of(i, i + q)
        m = f > (TIMES - 2) * q  # as the first grid place of a run has
        i, q, end = i[m], q[m], (i + q + f)[m]
        order = np.lexsort((i, end, q))
        i, q, end = i[order], q[order], end[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (end[1:] != end[:-1])))[: len(i)]
        found.append(np.stack((i[new], q[new], end[new])))
    i, q, end = np.concatenate(found, axis=1)
    order = np.lexsort((i, end, q))  # blocks may have parted a stretch
    i, q, end = i[order], q[order], end[order]
    new = np.concatenate(([True], (q[1:] != q[:-1]) | (end[1:] != end[:-1])))[: len(i)]
    i, q, end = i[new], q[new], end[new]
    text = np.searchsorted(start, i, "right") - 1
    lo, hi = np.maximum(start[text], i - q + 1), i.copy()  # the stretch starts after the grid place before
    while len(live := np.flatnonzero(lo < hi)):
        mid = (lo[live] + hi[live]) // 2
        reaches = longest.of(mid, mid + q[live]) >= i[live] - mid
        hi[live] = np.where(reaches, mid, hi[live])
        lo[live] = np.where(reaches, lo[live], mid + 1)
    long = end - lo >= np.maximum(LEAST, TIMES * q)
    s, e, q, text = lo[long], end[long], q[long], text[long]
    order = np.lexsort((q, e, s))
    s, e, q, text = s[order], e[order], q[order], text[order]
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])))[: len(s)]
    rows = np.stack((s - start[text], e - s, q), axis=1)[new]
    rows, text = rows[np.lexsort((rows[:, 2], rows[:, 0], text[new]))], np.sort(text[new])
    for k, t in enumerate(mine.tolist()):
        out[t] = rows[np.searchsorted(text, k) : np.searchsorted(text, k, "right")]
    return out


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words stays: none stays that lies in a run after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, runs (start, length, period of each, by start and then period) and collapsed (the text's words with only one period of each run, joined by a space)."""

    def found(group: list[list[bytes]]) -> tuple[pa.Array, pa.Array]:
        number: defaultdict[bytes, int] = defaultdict(count().__next__)
        runs = runs_of([np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in group])
        texts = []
        for w, r in zip(group, runs, strict=True):
            stay = np.flatnonzero(kept_words(len(w), r)).tolist() if len(r) else None
            texts.append(b" ".join(w if stay is None else [w[k] for k in stay]))
        ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        every = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
        rows = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], ["start", "length", "period"])
        return pa.ListArray.from_arrays(ends, rows), pa.array(texts, pa.binary()).cast(pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [(t or b"").split() for t in b.column("__text").to_pylist()]  # bytes are parted at the six blanks of ASCII
            at = 0
            while at < len(words):
                end, n = at, 0
                while end < len(words) and (end == at or n + len(words[end]) <= GROUP_WORDS):
                    n, end = n + len(words[end]), end + 1
                yield pa.RecordBatch.from_arrays([*b.slice(at, end - at).columns[:-1], *found(words[at:end])], [*b.schema.names[:-1], "runs", "collapsed"])
                at = end

    chosen = docs.select(*keep, F.encode(F.col(text), "UTF-8").alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"])
    return chosen.mapInArrow(run, ddl)
