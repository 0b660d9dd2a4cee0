"""Language-model scores: a unigram base and a log-bilinear model trained with noise contrast.

Tokens are the words of a text, A-Z lowered, then one end. Over the training rows Spark
counts every token. The ``own`` most frequent tokens (fewer, where counts tie) have vectors of
their own; the others are dealt by hash to ``RARE`` classes, and share the vectors of theirs.

The model has two levels. A context vector is made of the vectors of the two tokens before,
each passed through a matrix of its place. It is multiplied with the vectors of all classes,
which gives the class of the next token, and with the vectors of the tokens of that class,
which gives the token; both are normalised. Classes hold ``WIDTH`` tokens each in order of
frequency. In a rare class a token has its smoothed share of the class's counts.

It is trained in numpy by noise-contrastive estimation, on every position of every training
document once, so what is learnt from grows with the corpus. A hash of a row gives its round and
its share of the round; the number of shares follows the tokens, and rows of a share are
sorted by that hash, so what is learnt doesn't depend on cores or splits. A round's shares all
start from the model so far. AdaGrad divides a gradient by the root of the squares so far; moves
of a row of parameters are averaged with these roots as weights, over the shares that met it
only, so a token met by one share isn't averaged away, and stretched by up to ``BOOST`` where
several met it, as their noise partly cancels. Spark adds the moves in small groups.

Once the vocabulary is known, every text is written as its token ids, two bytes each; training
and scoring read these. Scoring multiplies in batches and reads each token's normalised
log-probability. Counts of the
``FREQUENT`` most frequent tokens are sent along (a bounded table); the other tokens of a text
are joined with their counts by a 64-bit hash of the token, so every count is exact but for
hash collisions (about rows**2 / 2**65). To the driver come only these bounded tables, found by
a threshold on counts from a histogram of their logarithms, and the averaged parameters.

Null texts count as empty: just the end. Without training rows every token has base
probability one, by the formula. A null id counts as the empty string for the split.
Repeated rows get equal scores; an empty table gives an empty one; only id and text are read. Kept columns may have any name
but those of the results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

OWN, WIDTH, RARE, FREQUENT, DIM, SEED = 1 << 15, 192, 64, 1 << 17, 16, 5
ROUNDS, SHARE_TOKENS, RATE, BOOST = 16, 4_000_000, 0.15, 1.5
ADD, LONGEST = 0.1, 64


def words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of some texts; of every word, in order, its number there and the place of its text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # spaces are those of ASCII; other characters stay
    word, text = pc.list_flatten(split), pc.list_parent_indices(split)
    some = pc.greater(pc.binary_length(word), 0)
    coded = word.filter(some).dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), text.filter(some).to_numpy()


def token_hash(token: bytes) -> int:
    """Spark's xxhash64 of the token, signed."""
    return xxhash.xxh64_intdigest(token, 42) - (1 << 63) ^ -(1 << 63)


@dataclass
class Vocabulary:
    """Ids: tokens with vectors in order of frequency, the end among them; then a number for each rare class."""

    ids: dict[bytes, int]
    share: np.ndarray  # of each token with vectors, in its class
    log_class: np.ndarray  # log frequency of each class
    mass: np.ndarray  # log10 of each rare class's smoothed counts

    @property
    def own(self) -> int:
        return len(self.share)

    @property
    def kind(self) -> type:
        """Of an id in a table."""
        return np.uint16 if self.own + RARE <= 1 << 16 else np.uint32

    def id_of(self, token: bytes) -> int:
        i = self.ids.get(token)
        return self.own + token_hash(token) % RARE if i is None else i

    def class_of(self, ids: np.ndarray) -> np.ndarray:
        first = -(-self.own // WIDTH)
        return np.where(ids < self.own, ids // WIDTH, first + ids - self.own)


def vocabulary(known: list[tuple[bytes, int]], rare: dict[int, tuple[int, int]]) -> Vocabulary:
    """From (token, count) of the tokens with vectors, most frequent first, and (count, tokens) of the rare classes."""
    count = np.array([n for _, n in known], float)
    first = -(-len(known) // WIDTH)
    by_class = np.bincount(np.arange(len(known)) // WIDTH, count, minlength=first) if first else np.zeros(0)
    rest = np.array([rare.get(k, (0, 0)) for k in range(RARE)], float)
    every = np.concatenate((by_class, rest[:, 0])) + 1
    share = count / by_class[np.arange(len(known)) // WIDTH] if first else count
    return Vocabulary({t: i for i, (t, _) in enumerate(known)}, share, np.log(every / every.sum()), np.log10(rest[:, 0] + ADD * (rest[:, 1] + 1)))


def _log_sum(x: np.ndarray) -> np.ndarray:
    """The logarithm of each row's sum of exponentials; ``x`` is used up."""
    top = np.float32(0) if x.max() < 60 else x.max(axis=1, keepdims=True)
    np.exp(x - top if np.ndim(top) else x, out=x)
    return np.log(x.sum(axis=1)) + np.reshape(top, -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.exp(np.negative(x, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """Score of class or token v after tokens a, b: (A[a] @ M0 + A[b] @ M1) . V[v] + bias[v]."""

    def __init__(self, parts: list[np.ndarray]):
        self.parts = parts
        self.a, self.places, self.classes, self.class_bias, self.tokens, self.token_bias = parts
        #: Squares of gradients so far: a mean for each row of vectors, else one for each number.
        self.seen = [np.full((len(p), 1) if p.ndim == 2 else p.shape, 1e-8, np.float32) for p in parts]

    @staticmethod
    def start(v: Vocabulary, dim: int = DIM, seed: int = SEED) -> LogBilinear:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
        places = np.stack([np.eye(dim) * 0.5, np.eye(dim)]).astype(np.float32)
        bias = [v.log_class.astype(np.float32), np.log(v.share).astype(np.float32)]
        return LogBilinear([draw(v.own + RARE, dim), places, draw(len(v.log_class), dim), bias[0], draw(v.own, dim), bias[1]])

    def copy(self) -> LogBilinear:
        other = LogBilinear([p.copy() for p in self.parts])
        other.seen = [s.copy() for s in self.seen]
        return other

    def moves(self, start: LogBilinear) -> np.ndarray:
        """What was learnt since ``start``: by row the roots of the squares times the moves, those roots, the squares added, and one; all zero for rows not met."""
        grown = [s - t for s, t in zip(self.seen, start.seen, strict=True)]
        met = [(g > 0).astype(np.float32) for g in grown]
        root = [np.sqrt(s) * m for s, m in zip(self.seen, met, strict=True)]
        far = [(p - q) * r for p, q, r in zip(self.parts, start.parts, root, strict=True)]
        return np.concatenate([x.ravel() for x in (*far, *root, *grown, *met)])

    def moved(self, total: np.ndarray) -> LogBilinear:
        """The model after the sum of all shares' moves."""
        n = len(self.parts)
        every = [*self.parts, *self.seen * 3]
        at = np.cumsum([0, *(p.size for p in every)])
        each = [total[s:e].reshape(p.shape).astype(np.float32) for p, s, e in zip(every, at, at[1:], strict=False)]
        far, root, grown, met = (each[k * n : k * n + n] for k in range(4))
        most = [np.maximum(m, 1) for m in met]
        out = LogBilinear([p + f / np.maximum(r, 1e-12) * np.minimum(np.sqrt(m), BOOST) for p, f, r, m in zip(self.parts, far, root, most, strict=True)])
        out.seen = [s + g / m for s, g, m in zip(self.seen, grown, most, strict=True)]
        return out

    def log10(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, v: Vocabulary, chunk: int = 512) -> np.ndarray:
        """log10 of each target's class and, of tokens with vectors, of the token in it; normalised."""
        if not hasattr(self, "tables"):
            q = [self.a @ m for m in self.places]
            x = [q[0] @ self.classes.T + self.class_bias, q[1] @ self.classes.T]
            top = [c.max(axis=1, keepdims=True) for c in x]
            self.tables = q, [np.exp(c - t) for c, t in zip(x, top, strict=True)], [t[:, 0] for t in top]
            self.wide = np.concatenate((self.tokens, self.token_bias[:, None]), axis=1)
            self.longest = float(np.sqrt(np.square(self.wide).sum(axis=1).max())) if len(self.wide) else 0.0
        out = np.empty(len(target))
        for at in range(0, len(target), 1 << 17):
            s = slice(at, at + (1 << 17))
            out[s] = self._log(two[s], one[s], target[s], v, chunk)
        return out / math.log(10)


    def _log(self, two: np.ndarray, one: np.ndarray, target: np.ndarray, v: Vocabulary, chunk: int) -> np.ndarray:
        (q0, q1), (e0, e1), (top0, top1) = self.tables  # the normaliser of classes is an inner product of two rows of exponentials
        cls = v.class_of(target)
        q = np.ones((len(target), q0.shape[1] + 1), np.float32)  # the last column takes the bias
        np.add(q0[two], q1[one], out=q[:, :-1])
        total = np.empty(len(target), np.float32)
        for at in range(0, len(target), chunk):
            s = slice(at, at + chunk)
            total[s] = np.einsum("ij,ij->i", e0[two[s]], e1[one[s]])
        with np.errstate(divide="ignore"):
            log = np.log(total) + top0[two] + top1[one]
        low = np.flatnonzero(total < 1e-25)  # where the exponentials hardly overlap
        for at in range(0, len(low), chunk):
            k = low[at : at + chunk]
            log[k] = _log_sum(q[k, :-1] @ self.classes.T + self.class_bias)
        out = np.einsum("ij,ij->i", q[:, :-1], self.classes[cls]) + self.class_bias[cls] - log
        order = np.argsort(cls.astype(np.uint16) if len(self.classes) < 1 << 16 else cls, kind="stable")
        order = order[target[order] < v.own]
        if not len(order):
            return out
        q, mine = q[order], target[order]
        small = self.longest * float(np.sqrt(np.square(q).sum(axis=1).max())) < 60  # no exponential overflows
        log, ones, space = np.empty(len(order), np.float32), np.ones(WIDTH, np.float32), np.empty(chunk * WIDTH, np.float32)
        cuts = [0, *(np.flatnonzero(np.diff(cls[order])) + 1).tolist(), len(order)]
        for first, end in zip(cuts, cuts[1:], strict=False):
            lo = int(mine[first]) // WIDTH * WIDTH
            w = self.wide[lo : min(lo + WIDTH, v.own)]
            for k in range(first, end, chunk):
                e = min(k + chunk, end)
                x = np.matmul(q[k:e], w.T, out=space[: (e - k) * len(w)].reshape(e - k, len(w)))
                log[k:e] = np.log(np.exp(x, out=x) @ ones[: len(w)]) if small else _log_sum(x)
        out[order] += np.einsum("ij,ij->i", q, self.wide[mine]) - log
        return out


def _alias(share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables to draw tokens of a class in constant time: what of each slot is its own token's, the token of the rest, and the slots of each class."""
    keep, other = np.ones(len(share)), np.arange(len(share))
    for lo in range(0, len(share), WIDTH):
        p = (share[lo : lo + WIDTH] * len(share[lo : lo + WIDTH])).tolist()
        low, high = [k for k, x in enumerate(p) if x < 1], [k for k, x in enumerate(p) if x >= 1]
        while low and high:
            a, b = low.pop(), high[-1]
            keep[lo + a], other[lo + a] = p[a], lo + b
            p[b] -= 1 - p[a]
            if p[b] < 1:
                low.append(high.pop())
    return keep, other, np.array([len(share[lo : lo + WIDTH]) for lo in range(0, len(share), WIDTH)])


class Trainer:
    """Noise-contrastive steps with AdaGrad on batches of (two before, one before, token)."""

    def __init__(self, model: LogBilinear, v: Vocabulary, rate: float, seed: int, k: int = 64, k_token: int = 4):
        self.m, self.v, self.rate, self.k, self.k_token = model, v, rate, k, k_token
        self.rng, self.seen = np.random.default_rng(seed), model.seen
        self.p_class = np.exp(v.log_class)
        self.alias = _alias(v.share)
        self.log_noise = np.log(np.maximum(v.share, 1e-12) * k_token).astype(np.float32)
        self.log_class = (v.log_class + math.log(k)).astype(np.float32)

    @staticmethod
    def _groups(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order by place, where each place begins in it, and the places."""
        order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        return order, first, at[first]

    def _rows(self, at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places that occur, and the sums of rows of ``g`` by place."""
        order, first, places = self._groups(at)
        return places, np.add.reduceat(g.take(order, axis=0), first, axis=0)

    def _move(self, part: int, at, g: np.ndarray) -> None:
        """An AdaGrad step of the rows ``at`` of a part; the others have no gradient and stay as they are."""
        p, s = self.m.parts[part], self.seen[part]
        g = g.astype(np.float32)
        square = np.einsum("ij,ij->i", g, g)[:, None] / np.float32(g.shape[1]) if p.ndim == 2 else g * g
        if isinstance(at, slice):
            s += square
            p -= np.float32(self.rate) / np.sqrt(s) * g
        else:
            square += s.take(at, axis=0)
            s[at] = square
            p[at] = p.take(at, axis=0) - np.float32(self.rate) / np.sqrt(square) * g

    def _noise(self, cls: np.ndarray) -> np.ndarray:
        """Tokens of the classes drawn by their shares: a slot of the class, and its token or the one that fills it up."""
        keep, other, width = self.alias
        place = self.rng.random((len(cls), self.k_token)) * width[cls][:, None]
        slot = place.astype(np.int64)
        place -= slot
        slot += cls[:, None] * WIDTH
        return np.where(place < keep.take(slot), slot, other.take(slot))

    def step(self, two: np.ndarray, one: np.ndarray, t: np.ndarray) -> None:
        m, v, size = self.m, self.v, len(t)
        a0, a1 = m.a.take(two, axis=0), m.a.take(one, axis=0)
        q = a0 @ m.places[0] + a1 @ m.places[1]
        cls = v.class_of(t)
        drawn = self.rng.choice(len(self.p_class), self.k, p=self.p_class)
        off = self.log_class
        near = m.classes.take(cls, axis=0)
        real = np.einsum("ij,ij->i", q, near) + m.class_bias[cls] - off[cls]
        false = q @ m.classes[drawn].T + m.class_bias[drawn] - off[drawn]
        g_real, g_false = (_sigmoid(real) - 1) / size, _sigmoid(false) / np.float32(size)
        dq = g_real[:, None] * near + g_false @ m.classes[drawn]
        both, g_both = np.concatenate((cls, drawn)), np.concatenate((g_real, g_false.sum(axis=0)))
        moves = [(2, *self._rows(both, np.concatenate((g_real[:, None] * q, g_false.T @ q)))), (3, slice(None), np.bincount(both, g_both, minlength=len(m.classes)))]
        own = np.flatnonzero(t < v.own)
        if len(own):
            c, mine = cls[own], q[own]
            at = np.concatenate((t[own][:, None], self._noise(c)), axis=1)
            vec = m.tokens.take(at, axis=0)
            g = _sigmoid(np.einsum("id,ikd->ik", mine, vec) + m.token_bias.take(at) - self.log_noise.take(at))
            g[:, 0] -= 1
            g /= size
            dq[own] += np.einsum("ik,ikd->id", g, vec)
            order, first, places = self._groups(at.ravel())
            each = g.ravel().take(order)
            rows = mine.take(order // at.shape[1], axis=0)
            rows *= each[:, None]
            moves += [(4, places, np.add.reduceat(rows, first, axis=0)), (5, places, np.add.reduceat(each, first))]
        moves.append((0, *self._rows(np.concatenate((two, one)), np.concatenate((dq @ m.places[0].T, dq @ m.places[1].T)))))
        moves.append((1, slice(None), np.stack([a0.T @ dq, a1.T @ dq])))
        for move in moves:
            self._move(*move)


def count_tokens(training: DataFrame, text: str, most: int = 400_000) -> DataFrame:
    """(token, n) over all rows; the end is the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            t, n = list(seen.keys()), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(n, pa.int64())], ["token", "n"])

        for b in slices(batches):
            tokens, number, _ = words(b.column(0))
            for t, n in zip(tokens, np.bincount(number, minlength=len(tokens)).tolist(), strict=True):
                seen[t] += n
            seen[b""] += b.num_rows
            if len(seen) > most:
                yield out()
        if seen:
            yield out()

    return training.select(text).mapInArrow(run, "token binary, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _binary(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    """Consecutive runs of ``n`` numbers as bytes."""
    ends = np.concatenate(([0], np.cumsum(n) * flat.itemsize))
    if ends[-1] >= 1 << 31:
        raise ValueError("a slice of texts holds over 2 GB of token ids")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])


def encode(texts: pa.Array, v: Vocabulary, log: dict[bytes, float]) -> dict[str, pa.Array]:
    """Of each text its ids and number of words, the known tokens' number and sum of logarithms of counts (all, and
    those outside the vocabulary), and hash and number of the unknown ones; without the end."""
    tokens, number, at = words(texts)
    n, m = len(texts), len(tokens)
    ids = np.array([v.ids.get(t, -1) for t in tokens], np.int64)
    other = np.flatnonzero(ids < 0)
    hashes = np.zeros(m, np.int64)
    hashes[other] = [token_hash(tokens[k]) for k in other.tolist()]
    ids[other] = v.own + hashes[other] % RARE
    known = np.array([log.get(t, np.nan) for t in tokens], float)
    has = ~np.isnan(known)
    known[~has] = 0.0
    per_text = lambda x: np.bincount(at, x[number], minlength=n).astype(float)
    which, times = np.unique(at[~has[number]] * m + number[~has[number]], return_counts=True)
    starts = pa.array(np.searchsorted(which, np.arange(n + 1) * m), pa.int32())
    unknown = pa.StructArray.from_arrays([pa.array(hashes[which % m] if m else hashes), pa.array(times, pa.int64())], ["h", "n"])
    size = np.bincount(at, minlength=n)
    return {
        "__size": pa.array(size, pa.int64()), "__known": pa.array(per_text(has).astype(np.int64)), "__base": pa.array(per_text(known)),
        "__inside": pa.array(per_text(known * (ids >= v.own))), "__rare": pa.ListArray.from_arrays(starts, unknown), "__ids": _binary(ids[number].astype(v.kind), size),
    }


BLOCK = 1 << 16  # parameters of a row


def train_round(learnt: DataFrame, ids: str, model: LogBilinear, v: Vocabulary, number: int, shares: int, least: int = 256, most: int = 4096) -> LogBilinear:
    """The model after a round: shares of the documents (columns __share, __order) are learnt apart, starting from ``model``, and their moves added."""
    end = v.id_of(b"")
    given = learnt.sparkSession.sparkContext.broadcast((model, replace(v, ids={})))  # bounded by OWN, RARE and DIM
    small = 3 if number == 0 else 0  # small batches first, then larger ones

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, v = given.value
        share, own, held, n, steps = None, None, [], 0, 0

        def batch() -> int:
            return min(most, least << (steps // 8)) if small else most

        def train(last: bool = False) -> None:
            nonlocal held, n, steps
            every, at = np.concatenate(held, axis=1), 0
            while n - at >= batch() or (last and n > at):
                size = min(batch(), n - at)
                own.step(*every[:, at : at + size])
                at, steps = at + size, steps + 1
            held, n = [every[:, at:]], n - at

        def done() -> Iterator[pa.RecordBatch]:
            if own is None:
                return
            train(last=True)
            flat = own.m.moves(start).astype("<f4")
            blocks = [flat[k : k + BLOCK].tobytes() for k in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array([share] * len(blocks), pa.int32()), pa.array(blocks, pa.binary())], ["block", "share", "p"])

        for b in slices(batches):
            for k, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != share:
                    yield from done()
                    share, own, held, n, steps = k, Trainer(start.copy(), v, RATE, SEED + 1000 * number + k), [], 0, 0
                run = np.concatenate(([end, end], np.frombuffer(x, v.kind), [end]))
                held.append(np.stack([run[:-2], run[1:-1], run[2:]]))
                n += len(run) - 2
                if n >= batch():
                    train()
        yield from done()

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("share")
        total = np.zeros(len(pdf["p"].iloc[0]) // 4)
        for p in pdf["p"]:
            total += np.frombuffer(p, "<f4")
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "share": [pdf["share"].iloc[0] // 16], "p": [total.astype("<f4").tobytes()]})

    kind = "block int, share int, p binary"
    dealt = learnt.select("__share", "__order", ids).repartitionById(shares, F.col("__share")).sortWithinPartitions("__share", "__order")
    got = staged(dealt.mapInArrow(learn, kind), "lm-moves")
    while shares > 16:  # sixteen shares at a time
        got, shares = staged(got.groupBy("block", F.floor(F.col("share") / 16).alias("up")).applyInPandas(added, kind), "lm-moves"), -(-shares // 16)
    rows = sorted(((r.block, bytes(r.p)) for r in got.groupBy("block").applyInPandas(added, kind).collect()), key=lambda r: r[0])  # one model
    return model.moved(np.concatenate([np.frombuffer(p, "<f4") for _, p in rows])) if rows else model


def _least_count(counts: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` tokens have it or more, from a histogram of the counts' logarithms."""
    slot = F.floor(F.log2("n") * 16).cast("int")
    hist = counts.groupBy(slot.alias("slot")).agg(F.count("*").alias("tokens"), F.min("n").alias("least")).collect()  # 16 * 63 rows at most
    total, least = 0, 1 << 62
    for r in sorted(hist, key=lambda r: -r.slot):
        total += r.tokens
        if total > most:
            break
        least = r.least
    return least


def score_texts(docs: DataFrame, training, text: str = "text", keep: tuple[str, ...] = (), own: int = OWN, frequent: int = FREQUENT) -> DataFrame:
    """``keep`` columns, n_tokens, n_known, train_tokens, base_score and score of every row; ``training`` is the condition on rows to learn from."""
    counts = staged(count_tokens(docs.where(training), text), "token-counts")
    n, v = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = n or 0, v or 0
    short = counts.where(F.octet_length("token") <= LONGEST)
    least = _least_count(short, frequent)
    top = sorted(((r.n, bytes(r.token)) for r in short.where(F.col("n") >= least).collect()), key=lambda r: (-r[0], r[1]))  # at most ``frequent``
    known = {t: c for c, t in top}
    bound = _least_count(short, own)
    mine = [(t, c) for c, t in top if c >= bound]
    rest = counts.where((F.octet_length("token") > LONGEST) | (F.col("n") < bound))
    slot = F.pmod(F.xxhash64("token"), F.lit(RARE)).cast("int")
    rare = {r.slot: (r.n, r.kinds) for r in rest.groupBy(slot.alias("slot")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}  # RARE rows
    vocab = vocabulary(mine, rare)
    context = docs.sparkSession.sparkContext
    tables = context.broadcast((vocab, known))  # bounded by own and frequent

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, known = tables.value
        log = {t: math.log10(c + ADD) for t, c in known.items()}
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches):
            found = encode(b.column("__text"), v, log)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.arange(row, row + b.num_rows)), *found.values()], [*b.schema.names[:-1], "__row", *found])
            row += b.num_rows

    shares = max(1, -(-n // (ROUNDS * SHARE_TOKENS)))
    order = F.xxhash64(*keep, text)
    chosen = docs.select(
        *keep, F.when(training, F.pmod(order, F.lit(ROUNDS)).cast("int")).otherwise(-1).alias("__round"), F.pmod(F.shiftrightunsigned(order, 16), F.lit(shares)).cast("int").alias("__share"),
        order.alias("__order"), F.col(text).alias("__text"),
    )
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]]
    ddl = "__row bigint, __size bigint, __known bigint, __base double, __inside double, __rare array<struct<h:bigint,n:bigint>>, __ids binary"
    encoded = staged(chosen.mapInArrow(written, ", ".join([*head, ddl])), "token-ids", by=("__round",))
    model = LogBilinear.start(vocab)
    for number in range(ROUNDS):
        model = train_round(encoded.where(F.col("__round") == number), "__ids", model, vocab, number, shares)
    given = context.broadcast((replace(vocab, ids={}), model.parts))  # bounded by own
    end = vocab.id_of(b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, parts = given.value
        model = LogBilinear(parts)
        for b in slices(batches):
            each = b.column(b.num_columns - 1).to_pylist()
            size = np.array([len(x) for x in each]) // np.dtype(v.kind).itemsize
            text = np.repeat(np.arange(len(size)), size)
            ids = np.full(len(text) + 3 * len(size), end, np.int32)  # of a text: end, end, its words, end
            ids[np.arange(len(text)) + 3 * text + 2] = np.frombuffer(b"".join(each), v.kind)
            size += 1
            at = np.arange(size.sum()) + 2 * np.repeat(np.arange(1, len(size) + 1), size)
            target = ids[at]
            p = model.log10(ids[at - 2], ids[at - 1], target, v)
            over = target >= v.own
            p[over] -= v.mass[target[over] - v.own]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.add.reduceat(p, np.cumsum(size) - size))], [*b.schema.names[:-1], "__model"])

    rare_rows = encoded.select("__row", F.explode("__rare").alias("r")).select("__row", "r.h", "r.n")
    c = counts.select(F.xxhash64("token").alias("hash"), F.col("n").alias("c"))
    joined = rare_rows.join(c, F.col("h") == F.col("hash"), "left").withColumn("c", F.coalesce("c", F.lit(0)))
    sums = joined.groupBy(F.col("__row").alias("__of")).agg(F.sum(F.col("n") * F.log10(F.col("c") + ADD)).alias("__log"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("__found"))
    # The end, by its count, in all logarithms; and in the model's where it has no vector.
    end_log = math.log10(known.get(b"", 0) + ADD)
    all_mass = math.log10(n + ADD * (v + 1))
    passed = [*keep, "__row", "__size", "__known", "__base", "__inside"]
    ddl = ", ".join([*head[: len(keep)], "__row bigint, __size bigint, __known bigint, __base double, __inside double, __model double"])
    got = encoded.select(*passed, "__ids").mapInArrow(run, ddl).join(sums, F.col("__row") == F.col("__of"), "left")
    rare_log, n_tokens = F.coalesce("__log", F.lit(0.0)), F.col("__size") + 1
    return got.select(
        *keep, n_tokens.alias("n_tokens"), (F.col("__known") + F.coalesce("__found", F.lit(0)) + int(b"" in known)).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("__base") + end_log + rare_log - n_tokens * all_mass).alias("base_score"), (F.col("__model") + F.col("__inside") + (0.0 if b"" in vocab.ids else end_log) + rare_log).alias("score"),
    )
