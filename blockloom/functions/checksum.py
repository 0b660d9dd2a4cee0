"""The additive block sum: little-endian 32-bit words plus a salt, modulo 2**32, negated. Short tails are padded with zeros."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


def sum_words(raw: bytes, salt: int = 0) -> int:
    words = np.frombuffer(raw + bytes(-len(raw) % 4), "<u4")
    return int(-(int(words.sum(dtype=np.uint64)) + salt)) & 0xFFFFFFFF


def word_sums(payload: pa.Array) -> np.ndarray:
    """The sum of each payload's words, neither salted nor negated: one segmented sum over the batch's buffer."""
    payload = payload.cast(pa.large_binary())
    ends = np.frombuffer(payload.buffers()[1], "<i8")[payload.offset : payload.offset + len(payload) + 1]
    size = np.diff(ends)
    if not size.sum():
        return np.zeros(len(size), np.uint64)
    raw = np.frombuffer(payload.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    words = -(-size // 4)
    starts = np.cumsum(words) - words
    if (size % 4).any():  # payloads are moved to whole words
        whole = np.zeros(words.sum() * 4, np.uint8)
        whole[np.arange(len(raw)) + np.repeat(starts * 4 - (ends[:-1] - ends[0]), size)] = raw
        raw = whole
    some = size > 0
    out = np.zeros(len(size), np.uint64)
    out[some] = np.add.reduceat(np.frombuffer(raw.tobytes(), "<u4"), starts[some], dtype=np.uint64)
    return out


@F.arrow_udf(LongType())
def _plain_sum(payload: pa.Array) -> pa.Array:
    sums = (-word_sums(payload).astype(np.int64)) & 0xFFFFFFFF
    return pa.array(sums, mask=payload.is_null().to_numpy(zero_copy_only=False))


def plain_sum(payload: Column) -> Column:
    """The sum with salt 0."""
    return _plain_sum(payload)


def salted(plain: Column, salt: Column) -> Column:
    """The sum with a salt, from the one without."""
    return F.pmod(plain - salt, F.lit(1 << 32))


def block_sum(payload: Column, salt: Column) -> Column:
    return salted(plain_sum(payload), salt)
