"""Media columns: byte payloads in Ogg, written and read back.

``encode_ogg`` deals a payload of 8-bit samples out to logical streams in packets and
multiplexes their pages. ``decode_ogg`` reads any such column: it finds pages, verifies
each page's checksum, reassembles packets from the lacing values (also across pages),
demultiplexes the logical streams by serial number and derives each packet's time from
the granule positions. Pages with a wrong checksum are
skipped and counted, and so are missing pages and ends.

Rows are independent: no shuffle. Null media gives null results; an empty payload gives
a stream without data packets; an empty table gives an empty one. Other columns of the input, whatever their names, aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

RATE, PACKET, STREAMS = 8000, 8192, 2
_HEAD = struct.Struct("<4sBBqIIIB")  # capture, version, flags, granule, serial, sequence, checksum, segments
_IDENT = struct.Struct("<8sIHH")  # magic, samples a second, stream index, streams
_MAGIC = b"\x7fU8MONO\x00"
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, most significant bit first, from zero, not inverted.

    It is the mirror image of zlib's CRC (same polynomial, bits reversed), which runs in C.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    raw = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return raw[:22] + struct.pack("<I", page_checksum(raw)) + raw[26:]


def _stream_pages(serial: int, index: int, of: int, packets: list[bytes], rate: int) -> list[bytes]:
    ident = _IDENT.pack(_MAGIC, rate, index, of)
    pages = [_page(_FIRST | (0 if packets else _LAST), 0, serial, 0, bytes([len(ident)]), ident)]
    segments: list[tuple[int, int]] = []  # lacing value, granule at the packet's end or -1
    at = 0
    for p in packets:
        at += len(p)
        segments += [(255, -1)] * (len(p) // 255) + [(len(p) % 255, at)]
    body, used, inside = b"".join(packets), 0, False
    for k in range(0, len(segments), 255):
        part = segments[k : k + 255]
        size = sum(v for v, _ in part)
        ends = [g for _, g in part if g >= 0]
        flags = (_CONTINUED if inside else 0) | (_LAST if k + 255 >= len(segments) else 0)
        pages.append(_page(flags, ends[-1] if ends else -1, serial, len(pages), bytes(v for v, _ in part), body[used : used + size]))
        used, inside = used + size, part[-1][1] < 0
    return pages


def write_ogg(payload: bytes, rate: int = RATE, packet: int = PACKET, streams: int = STREAMS) -> bytes:
    """One Ogg file: packet k of the payload goes to logical stream k modulo ``streams``."""
    cut = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    count = max(1, min(streams, len(cut)))
    each = [_stream_pages(0x10000 + s, s, count, cut[s::count], rate) for s in range(count)]
    order = sorted((k, s) for s, pages in enumerate(each) for k in range(len(pages)))
    return b"".join(each[s][k] for k, s in order)


def read_pages(media: bytes) -> tuple[list[tuple], int]:
    """(flags, granule, serial, number, lacing, body) of each sound page in file order, and the number of broken ones."""
    found, broken, at = [], 0, media.find(b"OggS")
    while 0 <= at:
        end = at + 27
        if end <= len(media):
            _, version, flags, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
            lacing = media[end : end + n]
            size = 27 + n + sum(lacing)
            raw = media[at : at + size]
            if version == 0 and len(raw) == size and page_checksum(raw[:22] + bytes(4) + raw[26:]) == crc:
                found.append((flags, granule, serial, number, lacing, raw[27 + n :]))
                at = media.find(b"OggS", at + size)
                continue
        broken += 1
        at = media.find(b"OggS", at + 4)
    return found, broken


def read_ogg(media: bytes) -> dict:
    """Packets by time with their streams; a packet that a lost page interrupts is dropped.

    ``lost`` counts such packets, the pages that numbers skip, and streams without their last page.
    """
    pages, broken = read_pages(media)
    rate, heads, partial, expected, ended = {}, {}, {}, {}, {}
    packets: list[tuple[int, int, bytes]] = []  # first sample, serial, bytes
    lost = 0
    for flags, granule, serial, number, lacing, body in pages:
        gap = number != expected.get(serial, 0)
        lost += max(0, number - expected.get(serial, 0))
        expected[serial] = number + 1
        ended[serial] = bool(flags & _LAST)
        open_part = partial.pop(serial, None)
        if open_part is not None and (gap or not flags & _CONTINUED):
            lost, open_part = lost + 1, None
        drop_first = bool(flags & _CONTINUED) and open_part is None
        parts, done, at = ([open_part] if open_part else []), [], 0
        for v in lacing:
            parts.append(body[at : at + v])
            at += v
            if v < 255:
                if drop_first:
                    drop_first = False
                else:
                    done.append(b"".join(parts))
                parts = []
        if parts and not drop_first:
            partial[serial] = b"".join(parts)
        if flags & _FIRST and done and done[0][:8] == _MAGIC:
            _, rate[serial], heads[serial], _ = _IDENT.unpack(done.pop(0))
        end = granule
        for p in reversed(done):  # the page's granule is its last packet's end
            packets.append((end - len(p), serial, p))
            end -= len(p)
    packets.sort(key=lambda x: (x[0], heads.get(x[1], x[1])))
    return {"packets": packets, "rate": rate, "pages": len(pages), "broken": broken, "lost": lost + len(partial) + sum(not e for e in ended.values())}


def encode_ogg(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``media``, the payload as an Ogg file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media = [None if p is None else write_ogg(p) for p in b.column("__payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(media, pa.binary())], [*b.schema.names[:-1], "media"])

    chosen = df.select(*keep, F.col(payload).alias("__payload"))
    return chosen.mapInArrow(run, chosen.drop("__payload").withColumn("media", F.lit(None).cast("binary")).schema)


def decode_ogg(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and ``payload`` (packets joined by time), pages, streams, packets (stream, first sample, seconds, bytes), broken, lost, seconds (the latest packet's end)."""
    kinds = "payload binary, pages int, streams int, broken int, lost int, seconds double, packets array<struct<serial:bigint,sample:bigint,seconds:double,bytes:int>>"
    packet_type = pa.list_(pa.struct([("serial", pa.int64()), ("sample", pa.int64()), ("seconds", pa.float64()), ("bytes", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for m in b.column("__media").to_pylist():
                if m is None:
                    out.append((None,) * 7)
                    continue
                x = read_ogg(m)
                times = [{"serial": s, "sample": t, "seconds": t / x["rate"].get(s, RATE), "bytes": len(p)} for t, s, p in x["packets"]]
                seconds = max(((t + len(p)) / x["rate"].get(s, RATE) for t, s, p in x["packets"]), default=0.0)
                out.append((b"".join(p for _, _, p in x["packets"]), x["pages"], len(x["rate"]), x["broken"], x["lost"], seconds, times))
            kind = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), packet_type]
            cols = [pa.array(c, k) for c, k in zip(zip(*out), kind, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], "payload", "pages", "streams", "broken", "lost", "seconds", "packets"])

    chosen = df.select(*keep, F.col(media).alias("__media"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1]), kinds])
    return chosen.mapInArrow(run, ddl)
