"""The segmented sum against one payload at a time."""

import random

import pyarrow as pa

from blockloom.functions.checksum import sum_words, word_sums


def test_segmented_sums():
    r = random.Random(1)
    for whole in (True, False):
        rows = [None if r.random() < 0.1 else r.randbytes(r.choice([0, 0, 4, 512, 2048]) if whole else r.randrange(40)) for _ in range(300)]
        for at, n in ((0, 300), (17, 200), (299, 1), (5, 0)):
            got = word_sums(pa.array(rows, pa.binary()).slice(at, n))
            assert [-int(s) & 0xFFFFFFFF for s in got] == [sum_words(b or b"") for b in rows[at : at + n]]
    assert word_sums(pa.array([None, b""], pa.binary())).tolist() == [0, 0]


def test_salt_follows_from_the_plain_sum():
    for salt in (0, 1, 77, 0xFFFFFFFF):
        assert (sum_words(b"abcdefg", 0) - salt) % (1 << 32) == sum_words(b"abcdefg", salt)
