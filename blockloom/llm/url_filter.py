"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed into one row of 64-bit words: a rule of m symbols takes m + 1
bits, one for each number of symbols matched so far. For each byte value there are two
masks, "this symbol is that byte" and "this state waits here under a wildcard". One step
of the Shift-And recurrence then moves every rule on every URL of a batch at once.

Glob syntax: ``*`` any run without ``/``; ``**`` any run; ``?`` one byte but ``/``.
Rules are matched against ``.host + path``, host in lower case, so ``*.net/**`` covers a
host ``net`` and all its subdomains. Rows are independent: no shuffle.

A null URL, or one without ``://``, has an empty host and path, matches no host rule and
gets the default verdict. A very long URL takes a step for each of its bytes, on a state of fixed size.
Repeated rows get equal verdicts; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: The part of a URL after its first ``://``: host, then path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """``label`` names the rule in results (None: the method's own pattern)."""

    glob: str
    verdict: str
    label: str | None = None


def host_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and its subdomains, where the URL's path starts with ``path``."""
    return Rule(f"*.{host}{path}**", verdict, f"{host}{path}")


class Automaton:
    def __init__(self, globs: list[str]):
        symbols = [self._symbols(g) for g in globs]
        self.width = max(1, -(-sum(len(s) + 1 for s, _ in symbols) // 64))
        bits = self.width * 64
        step, loop = np.zeros((256, bits), bool), np.zeros((256, bits), bool)
        start, self.accept = np.zeros(bits, bool), []
        at = 0
        for chars, waits in symbols:
            start[at] = True
            for j, c in enumerate(chars, 1):
                if c is None:
                    step[:, at + j] = True
                    step[ord("/"), at + j] = False
                else:
                    step[c, at + j] = True
            for j, any_byte in waits.items():
                loop[:, at + j] = True
                loop[ord("/"), at + j] |= any_byte
                if not any_byte:
                    loop[ord("/"), at + j] = False
            at += len(chars) + 1
            self.accept.append(divmod(at - 1, 64))
        pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view("<u8")
        self.step, self.loop, self.start = pack(step), pack(loop), pack(start)

    @staticmethod
    def _symbols(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        chars: list[int | None] = []
        waits: dict[int, bool] = {}
        raw, i = glob.encode(), 0
        while i < len(raw):
            if raw[i] == ord("*"):
                double = raw[i : i + 2] == b"**"
                waits[len(chars)] = waits.get(len(chars), False) or double
                i += 1 + double
                continue
            chars.append(None if raw[i] == ord("?") else raw[i])
            i += 1
        return chars, waits

    def match(self, urls: list[bytes]) -> np.ndarray:
        """A row per URL and a column per rule."""
        n = len(urls)
        size = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-size, kind="stable")  # the URLs still running stay in front
        begin = (np.cumsum(size) - size)[order]
        text, left = np.frombuffer(b"".join(urls), np.uint8), size[order]
        state = np.repeat(self.start[None, :], n, axis=0)
        running = n
        for t in range(int(left[0]) if n else 0):
            running = int(np.searchsorted(-left[:running], -t, side="left"))
            c = text[begin[:running] + t]
            now = state[:running]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:running] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.zeros((n, len(self.accept)), bool)
        for k, (word, bit) in enumerate(self.accept):
            out[order, k] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return out


def filter_urls(df: DataFrame, url: str, rules: list[Rule], default: str = "allow", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, host, path, rule (label or null), pattern (the glob that decided, or null) and verdict.

    Labelled rules come before the others; among each the longest wins, ties by text.
    """
    ranked = sorted(rules, key=lambda r: (r.label is None, -len(r.label or r.glob), r.label or r.glob))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton([r.glob for r in ranked])
        labels = [r.label for r in ranked] + [None]
        globs = [r.glob for r in ranked] + [None]
        verdicts = [r.verdict for r in ranked] + [default]
        for b in batches:
            host, path = b.column("host").to_pylist(), b.column("path").to_pylist()
            hit = auto.match([f".{h}{p}".encode() for h, p in zip(host, path, strict=True)])
            which = np.where(hit.any(axis=1), hit.argmax(axis=1), len(ranked)).tolist()
            cols = [pa.array([x[k] for k in which], pa.string()) for x in (labels, globs, verdicts)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "rule", "pattern", "verdict"])

    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), PARTS, k), F.lit(""))
    chosen = df.select(*keep, F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields), "rule string, pattern string, verdict string"])
    return chosen.mapInArrow(run, ddl)
