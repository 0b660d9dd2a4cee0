"""Packing documents into fixed token windows, with bounded space.

A task keeps ``open_windows`` windows. A document's full windows leave at once; what is
left of it goes to the open window that it fits best. When it fits none, the fullest
window leaves: if at least ``min_cut`` places are free there, they take the head of the
piece first. At the end of a partition its open windows stay as leftovers, with their ids; the leftovers of each
``merge_partitions`` partitions are then merged in the same way with one open window,
longest piece first, so only the last window of a merge holds much padding.

Tokenising and placing is one pass without a shuffle; only leftovers are shuffled, and a
merge holds ``open_windows * merge_partitions`` windows at most. Sequences are numbered by
partition and window, which a rerun over the same partitions repeats.

Null and empty texts have just the end id. Repeated rows are packed each on its own. Very
long texts are cut in full windows like any other; a task holds the ids of one text at a
time. An empty table gives no piece. Kept columns may have any name but those of ``PIECES``.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, staged

_NUMBERS = 33  # bits of a sequence id below the partition's number
_MERGED = 1 << 62
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def _byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, the others as signs from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by a byte-level BPE file of the tokenizers library.

    Where the ids of its merges count up in merge order the file is the same as a rank
    table, and the faster tiktoken gives the same ids; else, and for texts that tiktoken
    refuses (a million blanks or line ends in a row), the tokenizers library runs.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    made = [vocab[a + b] for a, b in merges]
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)

    def by_library(text: str) -> np.ndarray:
        return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    if not plain or made != sorted(made) or spec["model"].get("dropout") or spec["model"].get("ignore_merges"):
        return by_library
    import tiktoken

    from .token_counts import PRETOKEN

    signs = _byte_of_sign()
    ranks = {bytes(signs[c] for c in t): i for t, i in vocab.items() if t not in special}
    coder = tiktoken.Encoding("packing", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens=special)

    def by_ranks(text: str) -> np.ndarray:
        try:
            return coder.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except ValueError:  # its regular expression takes a stack that very long runs of white space exhaust
            return by_library(text)

    return by_ranks


class Packer:
    """Rows (key, start, ids, tokens of the document, sequence, offset, left over)."""

    def __init__(self, first: int, window: int, open_windows: int, min_cut: int):
        self.next, self.window, self.most, self.min_cut = first, window, open_windows, min_cut
        self.open: list[tuple[int, int, list]] = []  # (free places, sequence, rows), by free places
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, key: int, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.window:
            self.rows.append((key, at, ids[at : at + self.window], n, self._new(), 0, False))
            at += self.window
        if at < n:
            self._place(key, at, ids[at:], n)

    def _place(self, key: int, start: int, ids: np.ndarray, n: int) -> None:
        while len(ids):
            k = bisect.bisect_left(self.open, (len(ids),))
            if k == len(self.open):
                if len(self.open) < self.most:
                    free, sequence, held = self.window, self._new(), []
                else:
                    free, sequence, held = self.open.pop(0)
                    if free < self.min_cut:
                        self._leave(held, False)
                        continue
            else:
                free, sequence, held = self.open.pop(k)
            head = ids[:free]
            held.append((key, start, head, n, sequence, self.window - free))
            if free == len(head):
                self._leave(held, False)
            else:
                bisect.insort(self.open, (free - len(head), sequence, held))
            start, ids = start + len(head), ids[free:]

    def _leave(self, held: list, left_over: bool) -> None:
        self.rows += [(*row, left_over) for row in held]

    def finish(self) -> None:
        for _, _, held in self.open:
            self._leave(held, True)
        self.open = []


def pack_documents(df: DataFrame, text: str, tokenizer: str, keep: tuple[str, ...] = (), window: int = 2048, open_windows: int = 16, end_id: int = 1, min_cut: int = 64, merge_partitions: int = 16, with_ids: bool = False) -> DataFrame:
    """A row per piece: ``keep`` columns, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids (little-endian, 32 bits) if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = load_encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << _NUMBERS, window, open_windows, min_cut)
        waiting: dict[int, tuple] = {}  # kept columns of documents with pieces in open windows
        number = 0

        def out(schema: pa.Schema) -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            keys, start, ids, tokens, sequence, offset, left = zip(*rows, strict=True)
            raw = [x.astype("<u4").tobytes() for x in ids]
            kept = [pa.array([waiting[k][c] for k in keys], schema.field(c).type) for c in range(len(schema) - 1)]
            numbers = [start, [len(x) for x in ids], [zlib.crc32(r) for r in raw], tokens, sequence, offset]
            cols = [*kept, *(pa.array(x, pa.int64()) for x in numbers), pa.array(left, pa.bool_()), pa.array([r if with_ids or o else None for r, o in zip(raw, left, strict=True)], pa.binary())]
            open_keys = {row[0] for _, _, held in packer.open for row in held}
            for k in [k for k in waiting if k not in open_keys]:
                del waiting[k]
            return pa.RecordBatch.from_arrays(cols, [*schema.names[:-1], "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "left_over", "ids"])

        schema = None
        for b in slices(batches):
            schema = b.schema
            rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            for *kept, t in rows:
                waiting[number] = tuple(kept)
                packer.add(number, np.append(encode(t), np.uint32(end_id)).astype(np.uint32) if t else np.array([end_id], np.uint32))
                number += 1
            if packer.rows:
                yield out(schema)
        packer.finish()
        if packer.rows:
            yield out(schema)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], kind="stable")
        packer = Packer(_MERGED | int(pdf["__group"].iloc[0]) << _NUMBERS, window, 1, min_cut)
        for k, (start, ids, n) in enumerate(zip(pdf["start"], pdf["ids"], pdf["doc_tokens"], strict=True)):
            packer._place(k, int(start), np.frombuffer(bytes(ids), "<u4"), int(n))
        packer.finish()
        row, start, ids, _, sequence, offset, _ = zip(*packer.rows, strict=True)
        raw = [x.tobytes() for x in ids]
        out = pdf.iloc[list(row)].drop(columns="__group")
        own = {"start": start, "length": [len(x) for x in ids], "ids_crc32": [zlib.crc32(r) for r in raw], "sequence_id": sequence, "offset": offset, "ids": raw}
        return out.assign(**own) if with_ids else out.assign(**own).drop(columns="ids")

    chosen = df.select(*(F.col(f"`{k}`").alias(f"__keep{i}") for i, k in enumerate(keep)), F.col(text).alias("__text"))  # whatever they are called
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[:-1])
    tail = ", ids binary" if with_ids else ""
    pieces = staged(chosen.mapInArrow(run, f"{kept}{PIECES}, left_over boolean, ids binary"), "pieces")
    whole = pieces.where(~F.col("left_over")).drop("left_over", *([] if with_ids else ["ids"]))
    left = pieces.where("left_over").drop("left_over")
    group = F.floor(F.shiftright("sequence_id", _NUMBERS) / merge_partitions).cast("long")
    merged = left.withColumn("__group", group).groupBy("__group").applyInPandas(merge, f"{kept}{PIECES}{tail}")
    own = [c for c in whole.columns if not c.startswith("__keep")]
    return whole.unionByName(merged).select(*(F.col(f"__keep{i}").alias(k) for i, k in enumerate(keep)), *own)
