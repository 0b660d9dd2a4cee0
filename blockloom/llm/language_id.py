"""Language by averaged embeddings of hashed subwords and a linear softmax, with calibrated rejection.

A text's subwords are the runs of 1 to 4 code points inside its words, in lower case and with a
mark at both ends of a word; a word is a run of letters. They are hashed to ``BUCKETS``
vectors. The mean of the vectors of all subwords of the whole text goes through a linear layer
and a softmax over the languages. Vectors and layer are trained in numpy by stochastic gradient
descent with AdaGrad steps.

The training sample is bounded: about ``max_rows`` texts, an equal share for each of the
``MAX_LANGS`` most frequent languages, chosen by a threshold on the hash of the text, so that
equal texts count once a language and no task gathers more than the sample (twice ``max_rows`` is
its hard limit). Of a text the driver gets the numbers of its subwords by bucket, at most
``BUCKETS`` of them. All texts are scored whole, in one pass without a shuffle.

One in five of the sampled texts isn't trained on but calibrates: a temperature is set by their
likelihood, so that scores are probabilities, and a language is ``rejected`` below the least
score from which on at most ``ERRORS`` of these texts are wrong. The best language is given all
the same; whoever wants fewer errors drops rejected rows.

A text that is null or has no letter gets `und` with score 0, rejected; so does every text
where nothing was learnt from. Languages that are null or belong to no usable row aren't
learnt. With one language every text with a letter gets it, with score 1. Repeated rows get
equal results; an empty table gives an empty one. Columns other than the text, the language (in training) and
the kept ones aren't read; kept columns may have any name but those of the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

GRAMS, BUCKETS, DIM, SEED = 4, 1 << 14, 16, 3
MAX_ROWS, MAX_LANGS, ERRORS = 4_000, 1_000, 0.01
EPOCHS, BATCH, RATE = 12, 32, 0.1
UNKNOWN, LETTER = "und", regex.compile(r"\p{L}")
_MULTIPLIER, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(text: str | None) -> np.ndarray:
    """The bucket of each subword, with repeats."""
    c = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    c = np.where(_letters()[c], c, 32)
    gap = c == 32
    c, gap = (x[~(gap & np.concatenate(([False], gap[:-1])))] for x in (c, gap))
    code, inner = c.astype(np.uint64) + np.uint64(1), np.concatenate(([0], np.cumsum(gap)))
    out, h = [], code
    for n in range(1, GRAMS + 1):
        if len(c) < n:
            break
        h = code if n == 1 else h[:-1] * _MULTIPLIER + code[n - 1 :]
        # No gap but at the ends: gaps at places 1 to n - 2 from the first, and for one point nowhere.
        at = np.arange(len(h))
        whole = ~gap if n == 1 else inner[at + n - 1] == inner[at + 1]
        out.append((((h[whole] + np.uint64(n)) ^ (h[whole] >> np.uint64(29))) * _MIX) >> np.uint64(64 - BUCKETS.bit_length() + 1))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def shares(text: str | None) -> np.ndarray:
    """Each bucket's share of the subwords."""
    n = np.bincount(subwords(text), minlength=BUCKETS).astype(np.float32)
    return n / max(n.sum(), 1)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # of each bucket for each language: its vector times the layer, over the temperature
    bias: np.ndarray
    threshold: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(x @ self.weight + self.bias)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, langs: list[str]) -> Model:
    """From (buckets, shares) and language number of each text, in an order that doesn't depend on the cluster."""
    rng = np.random.default_rng(SEED)
    held = np.arange(len(x)) % 5 == 4
    vectors = (rng.standard_normal((BUCKETS, DIM)) / np.sqrt(DIM)).astype(np.float32)
    layer, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    parts = [vectors, layer, bias]
    seen = [np.full(p.shape, 1e-6, np.float32) for p in parts]

    def dense(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for k, r in enumerate(rows.tolist()):
            out[k, x[r][0]] = x[r][1]
        return out

    mine = np.flatnonzero(~held)
    for epoch in range(EPOCHS):
        rng.shuffle(mine)
        for at in range(0, len(mine), BATCH):
            rows = mine[at : at + BATCH]
            d = dense(rows)
            h = d @ vectors
            g = _softmax(h @ layer + bias)
            g[np.arange(len(rows)), y[rows]] -= 1
            g /= len(rows)
            for p, s, step in zip(parts, seen, (d.T @ (g @ layer.T), h.T @ g, g.sum(axis=0)), strict=True):
                s += step * step
                p -= np.float32(RATE * (1 - epoch / EPOCHS)) * step / np.sqrt(s)
    weight = vectors @ layer
    check = np.flatnonzero(held) if held.any() else np.arange(len(x))
    z = np.concatenate([dense(check[k : k + 256]) @ weight + bias for k in range(0, len(check), 256)])
    aim = np.full(z.shape, 1 / (len(check) + 2) / max(1, len(langs) - 1))  # as if one more text were wrong
    aim[np.arange(len(check)), y[check]] = 1 - 1 / (len(check) + 2)
    loss = lambda t: -np.mean(np.sum(aim * np.log(_softmax(z / t) + 1e-30), axis=1))
    heat = min(np.geomspace(0.05, 20, 121), key=loss)
    p = _softmax(z / heat)
    best, right = np.round(p.max(axis=1), 6), p.argmax(axis=1) == y[check]
    order = np.argsort(-best, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    ok = np.flatnonzero((wrong <= ERRORS) & np.append(np.diff(best[order]) != 0, True))  # equal scores are accepted together
    threshold = 1.0 if not len(ok) else 0.0 if ok[-1] == len(order) - 1 else float(best[order[ok[-1] : ok[-1] + 2]].mean())
    return Model(langs, (weight / heat).astype(np.float32), (bias / heat).astype(np.float32), threshold)


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> Model:
    """Train on rows for which ``usable`` holds and whose text and language aren't null."""
    known = docs.where(usable).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS).collect()
    langs = sorted(r.lang for r in counts)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0)
    share = max_rows / len(langs)
    allowed = known.sparkSession.createDataFrame([(r.lang, min(1.0, share / r.n)) for r in counts], "of string, share double")  # MAX_LANGS rows
    place = (F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))).alias("place")  # 0 to 1
    drawn = known.join(F.broadcast(allowed), F.col("lang") == F.col("of")).select("lang", "text", place, "share").where("place < share")
    sample = drawn.groupBy("lang", "place").agg(F.min("text").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for t in b.column("text").to_pylist():
                x = shares(t)
                at = np.flatnonzero(x)
                out.append((at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("place"), *(pa.array([o[k] for o in out], pa.binary()) for k in (0, 1))], ["lang", "place", "b", "s"])

    rows = sample.mapInArrow(counted, "lang string, place double, b binary, s binary").orderBy("place", "lang").limit(2 * max_rows).collect()
    rows = sorted(rows, key=lambda r: (r.place, r.lang))
    x = [(np.frombuffer(r.b, "<u2").astype(np.int64), np.frombuffer(r.s, "<f4")) for r in rows]
    return train(x, np.array([langs.index(r.lang) for r in rows]), langs)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, lang_pred, score (0 to 1) and rejected."""
    given = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS times MAX_LANGS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = given.value
        for b in slices(batches, 64):
            texts = b.column("__text").to_pylist()
            has = [bool(model.langs) and t is not None and LETTER.search(t) is not None for t in texts]
            lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
            some = [k for k, ok in enumerate(has) if ok]
            if some:
                p = model.probabilities(np.stack([shares(texts[k]) for k in some]))
                for k, best, value in zip(some, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                    lang[k], score[k] = model.langs[best], min(1.0, value)
            no = [not h or s < model.threshold for h, s in zip(has, score, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(no, pa.bool_())], [*b.schema.names[:-1], "lang_pred", "score", "rejected"])

    chosen = docs.select(*keep, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "lang_pred string, score double, rejected boolean"])
    return chosen.mapInArrow(run, ddl)
