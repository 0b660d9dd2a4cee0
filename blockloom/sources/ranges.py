"""Byte ranges of files, read by tasks through Arrow's file systems: raw images, and payloads of indexed change sets after their winners are known.

Files must lie where Arrow can open them: a local or mounted folder, or a store that it knows.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.checksum import sum_words
from . import binary as b

STEP = 1 << 23  # bytes held at a time
PACKED = ".gz"  # files compressed whole, which a task unpacks from the start


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def list_tree(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) of the files under a folder, as ``binaryFile`` lists them: no empty or hidden ones. Each level's folders are listed by all tasks."""
    from ..plans.stage import staged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("path").to_pylist():
                fs, at = file_system(name)
                lead = "file:" if name.startswith("file:") else name[: -len(at)]
                found = fs.get_file_info(pafs.FileSelector(at))
                found = [x for x in found if not x.base_name.startswith(".") and (not x.base_name.startswith("_") or "=" in x.base_name)]
                for k in range(0, len(found), 65_536):
                    part = found[k : k + 65_536]
                    folder = [x.type == pafs.FileType.Directory for x in part]
                    cols = [[lead + x.path for x in part], [x.size or 0 for x in part], [(x.mtime_ns or 0) // 1_000_000 for x in part], folder]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["path", "length", "ms", "folder"])

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = "file:" + file_system(path)[1] if path.startswith("file:") or "://" not in path else path
    level, out = spark.createDataFrame([(root.rstrip("/"),)], "path string"), None
    while out is None or not level.isEmpty():
        seen = staged(level.repartition(width, "path").mapInArrow(run, "path string, length bigint, ms bigint, folder boolean"), "listing")
        files = seen.where("not folder and length > 0").select("path", "length", F.timestamp_millis("ms").alias("modificationTime"))
        level, out = seen.where("folder").select("path"), files if out is None else out.unionByName(files)
    return out


def _binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.tobytes())])


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int


class BlockImages(DataSource):
    """Raw image files as blocks. Options: files (JSON of path and length), block_size, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "block_images"

    def schema(self) -> str:
        return "path string, addr bigint, data binary"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)


class _BlockReader(DataSourceReader):
    def __init__(self, options):
        self.files, self.block, self.most = json.loads(options["files"]), int(options["block_size"]), int(options["range_bytes"])

    def partitions(self) -> list[_Range]:
        step = max(1, self.most // self.block) * self.block
        cut = lambda path, length: [(0, length)] if path.endswith(PACKED) else [(at, min(at + step, length)) for at in range(0, length, step)]
        return [_Range(path, *r) for path, length in self.files for r in cut(path, length)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, at = file_system(part.path)
        step = max(1, STEP // self.block) * self.block
        with self._open(fs, at, part, step) as pieces:
            for start, piece in pieces:
                if len(piece) % self.block:
                    raise ValueError(f"not a multiple of {self.block} bytes: {part.path}")
                rows = np.frombuffer(piece, np.uint8).reshape(-1, self.block)
                some = np.flatnonzero((rows.view("<u8") if self.block % 8 == 0 else rows).any(axis=1))
                cols = [pa.array([part.path]).take(pa.array(np.zeros(len(some), np.int64))), pa.array(start // self.block + some), _binary(rows[some], np.arange(len(some) + 1) * self.block)]
                yield pa.RecordBatch.from_arrays(cols, ["path", "addr", "data"])

    @contextmanager
    def _open(self, fs: pafs.FileSystem, at: str, part: _Range, step: int) -> Iterator[Iterator[tuple[int, bytes]]]:
        """The range's (start, bytes) in pieces of ``step``; a compressed file's are those of what it unpacks to."""
        if part.path.endswith(PACKED):
            with fs.open_input_stream(at, compression="gzip") as f:
                yield zip(count(0, step), iter(lambda: f.read(step), b""))
        else:
            with fs.open_input_file(at) as f:
                yield ((start, f.read_at(min(step, part.end - start), start)) for start in range(part.start, part.end, step))


def read_blocks(spark: SparkSession, files: list[tuple[str, int]], block_size: int, range_bytes: int) -> DataFrame:
    """Blocks (path, addr, data) that aren't zero, of all files in one scan."""
    spark.dataSource.register(BlockImages)
    return spark.read.format("block_images").options(files=json.dumps(files), block_size=block_size, range_bytes=range_bytes).load()


_INDEX = np.dtype([("addr", "<u8"), ("blocks", "<u4"), ("flags", "u1"), ("codec", "u1"), ("-", "<u2"), ("data_offset", "<u8"), ("data_size", "<u4"), ("io_offset", "<u4"), ("orig_blocks", "<u4"), ("--", "<u4"), ("checksum", "<u4"), ("own", "<u4")])
_LONGS = ("addr", "blocks", "codec", "data_offset", "data_size", "io_offset", "orig_blocks", "checksum")


def read_index(files: DataFrame) -> DataFrame:
    """The records of indexed change-set files (path, length), without payload: only heads, tails and indexes are read.

    ``idx`` is a record's place in its file. Files with packs instead of an index give no rows. Files are opened once, whatever follows.
    """
    from ..plans.stage import staged

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist(), strict=True):
                fs, at = file_system(path)
                with fs.open_input_file(at) as f:
                    head = f.read_at(b.DIFF_HEADER.size, 0)
                    if len(head) < b.DIFF_HEADER.size or b.DIFF_HEADER.unpack(head)[2] != 1 or length < b.DIFF_HEADER.size + b.INDEX_SUPER.size:
                        continue
                    start, n, *_ = b.INDEX_SUPER.unpack(f.read_at(b.INDEX_SUPER.size, length - b.INDEX_SUPER.size))
                    for k in range(0, n, 65_536):
                        rows = np.frombuffer(f.read_at(min(65_536, n - k) * _INDEX.itemsize, start + k * _INDEX.itemsize), _INDEX)
                        kind = np.where(rows["flags"] & 2, "Allzero", np.where(rows["flags"] & 4, "Discard", "Normal"))
                        cols = [pa.array([path]).take(pa.array(np.zeros(len(rows), np.int64))), pa.array(k + np.arange(len(rows))), pa.array(kind.tolist(), pa.string()), *(pa.array(rows[c].astype(np.int64)) for c in _LONGS)]
                        yield pa.RecordBatch.from_arrays(cols, ["path", "idx", "rec_type", *_LONGS])

    width = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(files.select("path", "length").repartition(width, "path").mapInArrow(run, "path string, idx bigint, rec_type string, " + ", ".join(f"{c} bigint" for c in _LONGS)), "index")


def late_payload(index: DataFrame, cache_bytes: int = 1 << 26) -> DataFrame:
    """The surviving runs of index records (with vol_id and ``seq``, their order), and the payloads of these only.

    Winners are found without payload. Then records that point into one image meet in a task, by
    file and range, in order: an image is read and decompressed once while it stays among the
    latest ``cache_bytes``. ``read_bytes`` is what a row had read from its file; ``ok`` is false
    where the stored bytes don't add up to their sum, and payload null then.
    """
    from ..operators.extent import latest_wins

    own = index.select("vol_id", "seq", "path", "rec_type", "codec", "data_offset", "data_size", "io_offset", "orig_blocks", "checksum")
    won = latest_wins(index).join(own, ["vol_id", "seq"])
    width = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = won.repartition(width, "path", F.shiftright("data_offset", 26)).sortWithinPartitions("path", "data_offset")
    kept = ["vol_id", "addr", "blocks", "seq", "off", "rec_type"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: OrderedDict[tuple[str, int], tuple[bytes | None, int]] = OrderedDict()
        held, path, f = 0, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                payload, ok, read = [], [], []
                for r in part.to_pylist():
                    if r["rec_type"] != "Normal":
                        payload, ok, read = [*payload, None], [*ok, True], [*read, 0]
                        continue
                    key, got = (r["path"], r["data_offset"]), 0
                    if key in cache:
                        cache.move_to_end(key)
                    else:
                        if path != r["path"]:
                            path, (fs, name) = r["path"], file_system(r["path"])
                            f = fs.open_input_file(name)
                        raw = f.read_at(r["data_size"], r["data_offset"])
                        got = len(raw)
                        image = b.unpack(r["codec"], raw, r["orig_blocks"] * b.BLOCK) if sum_words(raw) == r["checksum"] else None
                        cache[key] = image, len(image or b"")
                        held += len(image or b"")
                        while held > cache_bytes and len(cache) > 1:
                            held -= cache.popitem(last=False)[1][1]
                    image, start = cache[key][0], (r["io_offset"] + r["off"]) * b.BLOCK
                    payload.append(None if image is None else image[start : start + r["blocks"] * b.BLOCK])
                    ok.append(image is not None)
                    read.append(got)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(payload, pa.binary()), pa.array(ok), pa.array(read, pa.int64())], [*kept, "payload", "ok", "read_bytes"])

    return dealt.mapInArrow(run, "vol_id bigint, addr bigint, blocks bigint, seq bigint, off bigint, rec_type string, payload binary, ok boolean, read_bytes bigint")
