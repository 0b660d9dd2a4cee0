"""Token counts under a unigram model, by dynamic programming shared in a trie.

Texts are cut into pre-tokens. Each distinct pre-token is inserted once in a trie of
bytes; a node holds the unigram forward score of its prefix (the best sum of piece scores
over all segmentations of it) and that segmentation's number of pieces. Prefixes that
pre-tokens share are therefore scored once, and the count at a pre-token's last node is
its number of tokens. Ties go to fewer pieces.

The vocabulary is a rank file, which has no probabilities: the score of a piece is Zipf's,
-log(rank + 2). Every byte is a piece, so every text has a segmentation.

A task keeps one trie of at most ``max_nodes`` nodes and as many pre-tokens, none of them beyond
``max_depth`` bytes, and starts it anew beyond that, which changes no result and bounds memory;
longer pre-tokens are scored each time without being stored. A text of any length is cut and
scored by one pass. Kept columns may have any name but those of the results. Rows are independent: no shuffle. Null and empty texts have no
pre-tokens and zero tokens; repeated rows get equal counts; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Splits text before segmentation: contractions, words, numbers, other signs, white space.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A rank file has at most so many bytes: it is sent to every task.
MAX_VOCABULARY = 64 << 20


def read_ranks(path: str) -> dict[bytes, float]:
    """Piece scores from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        raw = f.read(MAX_VOCABULARY + 1)
    if len(raw) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary {path} is larger than {MAX_VOCABULARY} bytes")
    pairs = (line.split() for line in raw.splitlines() if line.strip())
    return {base64.b64decode(p): -math.log(int(r) + 2) for p, r in pairs}


class CountTrie(dict):
    """Token counts by pre-token; a missing one is inserted in the trie on first use."""

    def __init__(self, scores: dict[bytes, float], max_nodes: int = 1_000_000, max_depth: int = 256):
        self.scores, self.max_nodes, self.max_depth = scores, max_nodes, max_depth
        longest = [1] * 256
        for p in scores:
            longest[p[-1]] = max(longest[p[-1]], len(p))
        self.longest = longest
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.children: dict[int, int] = {}  # node * 256 + byte: child
        self.score, self.tokens = array("d", [0.0]), array("i", [0])

    def __missing__(self, pretoken: str) -> int:
        raw = pretoken.encode("utf-8", "surrogatepass")
        if len(raw) > self.max_depth:
            return self._insert(raw)
        if len(self.score) + len(raw) > self.max_nodes or len(self) >= self.max_nodes:
            self._reset()
        n = self[pretoken] = self._insert(raw)
        return n

    def _insert(self, raw: bytes) -> int:
        node, score, tokens = 0, [0.0], [0]
        for d in range(1, len(raw) + 1):
            child = self.children.get(node * 256 + raw[d - 1]) if 0 <= node else None
            if child is None:
                best, fewest = -math.inf, 0
                for start in range(max(0, d - self.longest[raw[d - 1]]), d):
                    piece = self.scores.get(raw[start:d])
                    if piece is not None:
                        s, t = score[start] + piece, tokens[start] + 1
                        if s > best or s == best and t < fewest:
                            best, fewest = s, t
                if 0 <= node and len(raw) <= self.max_depth:
                    child = self.children[node * 256 + raw[d - 1]] = len(self.score)
                    self.score.append(best)
                    self.tokens.append(fewest)
                else:
                    child = -1
                score.append(best)
                tokens.append(fewest)
            else:
                score.append(self.score[child])
                tokens.append(self.tokens[child])
            node = child
        return tokens[-1]


def count_tokens(df: DataFrame, text: str, vocabulary: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns, n_bytes, n_pretokens and n_tokens (long) of each whole text."""
    scores = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, trie = regex.compile(PRETOKEN).findall, CountTrie(scores.value)
        for b in slices(batches):
            size, words, tokens = [], [], []
            for t in b.column("__text").to_pylist():
                found = find(t) if t else []
                size.append(len((t or "").encode()))
                words.append(len(found))
                tokens.append(sum(map(trie.__getitem__, found)))
            cols = [pa.array(x, pa.int64()) for x in (size, words, tokens)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "n_bytes", "n_pretokens", "n_tokens"])

    chosen = df.select(*keep, F.col(text).alias("__text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), "n_bytes bigint, n_pretokens bigint, n_tokens bigint"])
    return chosen.mapInArrow(run, ddl)
