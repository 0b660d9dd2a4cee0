"""Native log and change-set files made of the fixtures' rows, as inputs for the readers' queries and tests; not part of the library. One group is one file of few packs."""

from __future__ import annotations

import struct
import zlib
from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.functions.checksum import sum_words
from blockloom.sources import binary as b

SALT, PBS = 77, 512


def closed(raw: bytes, at: int = 0, salt: int = 0) -> bytes:
    """The bytes with the 32-bit sum at ``at`` set so that the whole sums to zero."""
    cleared = raw[:at] + bytes(4) + raw[at + 4 :]
    return cleared[:at] + struct.pack("<I", sum_words(cleared, salt)) + cleared[at + 4 :]


def payload(token: str, blocks: int) -> bytes:
    """What a token stands for: each block is the token and its number; Z is all zero."""
    if token == "Z":
        return bytes(blocks * b.BLOCK)
    return b"".join(f"{token}:{k}".encode().ljust(b.BLOCK, b"\0") for k in range(blocks))


def log_file(rows: list) -> bytes:
    """A log of one record a pack, of rows in order of lsid."""
    head = b.LOG_HEADER.pack(b.LOG_HEADER_KIND, 2, b.LOG_HEADER_BYTES, 0, 0, SALT, 512, PBS, bytes(range(16)), rows[0].pack_lsid, rows[-1].next_lsid)
    out = [closed(head + bytes(b.LOG_HEADER_BYTES - len(head)), 8)]
    for r in rows:
        data = b"" if r.is_discard else bytes(r.blocks * b.BLOCK) if r.is_padding else payload(r.token, r.blocks)
        flags = b.EXIST | (b.PADDING if r.is_padding else 0) | (b.DISCARD if r.is_discard else 0)
        csum = 0 if r.is_padding or r.is_discard else sum_words(data, SALT)
        pack = b.PACK.pack(0, b.PACK_KIND, len(data) // PBS, r.pack_lsid, 1, int(r.is_padding), 0) + b.RECORD.pack(csum, flags, r.addr, r.blocks, 1, 0, r.lsid)
        out += [closed(pack + bytes(PBS - len(pack)), 0, SALT), data]
    return b"".join(out)


def change_file(rows: pd.DataFrame | list, indexed: bool) -> bytes:
    """A change set, its normal records compressed: in packs, or with an index at the tail."""
    flag = {"Normal": 1, "Allzero": 3, "Discard": 5}
    rows = list(rows.itertuples()) if isinstance(rows, pd.DataFrame) else rows
    rows = sorted(rows, key=lambda r: (r.addr, r.ev))
    data = [zlib.compress(payload(r.token, r.blocks), 1) if r.rec_type == "Normal" else b"" for r in rows]
    codec = [1 if d else 0 for d in data]
    head = b.DIFF_HEADER.pack(0, 2, int(indexed), 0, 0, 0, bytes(range(16)))
    if indexed:
        body, index = head, b""
        for r, d, c in zip(rows, data, codec, strict=True):
            index += b.INDEX_RECORD.pack(r.addr, r.blocks, flag[r.rec_type], c, 0, len(body), len(d), 0, r.blocks, 0, sum_words(d), 0)
            body += d
        body += bytes(-len(body) % 8)
        return body + index + b.INDEX_SUPER.pack(len(body), len(rows), 1, 0, 0)
    out, most = [head], (b.DIFF_PACK_BYTES - b.DIFF_PACK.size) // b.DIFF_RECORD.size
    every = list(zip(rows, data, codec, strict=True))
    for at in range(0, len(every), most):
        part, records, used = every[at : at + most], b"", 0
        for r, d, c in part:
            records += b.DIFF_RECORD.pack(r.addr, r.blocks, flag[r.rec_type], c, 0, used, len(d), sum_words(d), 0)
            used += len(d)
        pack = b.DIFF_PACK.pack(0, len(part), 0, 0, used, 0) + records
        out += [closed(pack + bytes(b.DIFF_PACK_BYTES - len(pack))), *(d for _, d, _ in part)]
    end = b.DIFF_PACK.pack(0, 0, b.DIFF_END, 0, 0, 0)
    return b"".join([*out, closed(end + bytes(b.DIFF_PACK_BYTES - len(end)))])


def shared_file(rows: pd.DataFrame | list) -> bytes:
    """An indexed change set of runs (addr, blocks, off of a record of ``orig`` blocks): runs of one record point into its one image."""
    flag = {"Normal": 1, "Allzero": 3, "Discard": 5}
    body, index, at = b.DIFF_HEADER.pack(0, 2, 1, 0, 0, 0, bytes(range(16))), b"", {}
    rows = list(rows.itertuples()) if isinstance(rows, pd.DataFrame) else rows
    for r in sorted(rows, key=lambda r: r.addr):
        normal = r.rec_type == "Normal"
        if normal and r.ev not in at:
            data = zlib.compress(payload(r.token, r.orig), 1)
            at[r.ev] = len(body), len(data), sum_words(data)
            body += data
        off, size, csum = at[r.ev] if normal else (0, 0, 0)
        index += b.INDEX_RECORD.pack(r.addr, r.blocks, flag[r.rec_type], int(normal), 0, off, size, r.off if normal else 0, r.orig, 0, csum, 0)
    body += bytes(-len(body) % 8)
    return body + index + b.INDEX_SUPER.pack(len(body), len(rows), len(at), 0, 0)


def made(rows: DataFrame, keys: list[str], order: str, make: Callable[[list], Iterator[tuple[str, bytes]]], most: int = 1 << 24) -> DataFrame:
    """(path, content) of the files that ``make`` gives for the rows of each key, in order.

    Keys are many and of few rows: they are streamed, not handed to Python one by one. Rows are small and files
    large, so the number of tasks is named. A task holds one key's rows and ``most`` bytes of files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, held, at = [], 0, [], None
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], ["path", "content"])
        for batch in batches:
            row, n = namedtuple("row", batch.schema.names), len(keys)  # noqa: PYI024
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if values[:n] != at and held:
                    for p, c in make(held):
                        out.append((p, c))
                        size += len(c)
                        if size > most:
                            yield flush()
                            out, size = [], 0
                    held = []
                at = values[:n]
                held.append(row(*values))
        out += make(held) if held else []
        yield flush()

    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(width, F.xxhash64(*keys)).sortWithinPartitions(*keys, order)
    return dealt.select(*keys, *[c for c in rows.columns if c not in keys]).mapInArrow(run, "path string, content binary")


def shared_files(runs: DataFrame) -> DataFrame:
    """(path, content): an indexed file of the runs of each change set."""
    runs = runs.select("vol_id", "gid", "ev", "addr", "blocks", "off", "orig", "rec_type", "token")
    return made(runs, ["vol_id", "gid"], "addr", lambda rows: [(f"{rows[0].vol_id}/{rows[0].gid}.wdiff", shared_file(rows))])


def write_files(files: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files under a folder that all share; their number."""
    from blockloom.sources.ranges import file_system

    def write(batches):
        import pyarrow as pa

        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                fs, at = file_system(f"{folder}/{name}")
                fs.create_dir(at.rpartition("/")[0])
                with fs.open_output_stream(at) as out:
                    out.write(raw)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    return files.mapInArrow(write, "n bigint").groupBy().sum("n").first()[0] or 0


def log_files(records: DataFrame, per_file: int = 64) -> DataFrame:
    """(path, content): a file of up to ``per_file`` records that follow each other in a volume."""

    def make(rows: list) -> Iterator[tuple[str, bytes]]:
        # Records of other volumes lie between, so a file is cut where the next pack doesn't follow.
        cuts = [0, *(k for k in range(1, len(rows)) if rows[k].pack_lsid != rows[k - 1].next_lsid), len(rows)]
        return ((f"{rows[s].vol_id}/{rows[s].pack_lsid}.log", log_file(rows[s:e])) for s, e in zip(cuts, cuts[1:]))

    part = F.expr(f"ev div {per_file}").alias("part")
    return made(records.select("vol_id", part, "pack_lsid", "lsid", "next_lsid", "addr", "blocks", "is_padding", "is_discard", "token"), ["vol_id", "part"], "pack_lsid", make)


def change_files(changes: DataFrame, per_file: int = 64) -> DataFrame:
    """(path, content): a file of a part of each change set, indexed where the volume is odd."""
    part = F.expr(f"ev div {per_file}").alias("part")
    rows = changes.select("vol_id", "gid", part, "ev", "addr", "blocks", "rec_type", "token")
    return made(rows, ["vol_id", "gid", "part"], "addr", lambda rows: [(f"{rows[0].vol_id}/{rows[0].gid}-{rows[0].part}.wdiff", change_file(rows, bool(rows[0].vol_id % 2)))])
