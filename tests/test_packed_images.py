"""Images that are compressed whole are read as what they unpack to."""

import gzip

import pytest
from pyspark.sql import functions as F

from blockloom.file_queries import write_images
from blockloom.sources import ingest


def test_compressed_images_hold_the_blocks_of_plain_ones(spark, tmp_path):
    raw = bytearray(20 << 20)  # beyond what is held at a time
    for at in (0, 64, 8 << 20, (20 << 20) - 64):
        raw[at : at + 3] = b"abc"
    (tmp_path / "a.img").write_bytes(raw)
    (tmp_path / "b.img.gz").write_bytes(gzip.compress(bytes(raw) + b"z" * 64))
    got = ingest.read_image(spark, str(tmp_path), 64)
    rows = {n: sorted((x.addr, bytes(x.data)) for x in got.collect() if x.path.endswith(n)) for n in ("img", "gz")}
    assert len(rows["img"]) == 4
    assert rows["gz"] == [*rows["img"], ((20 << 20) // 64, b"z" * 64)]
    (tmp_path / "odd.img.gz").write_bytes(gzip.compress(bytes(65)))
    with pytest.raises(Exception, match="odd.img.gz"):
        ingest.read_image(spark, str(tmp_path), 64).count()


def test_written_images_take_the_room_of_what_they_hold(spark, tmp_path):
    rows = spark.range(64).select((F.col("id") % 2).alias("file"), (F.col("id") * 500).alias("addr"), F.sha2(F.col("id").cast("string"), 224).alias("content"))
    write_images(rows, str(tmp_path / "images"))
    assert sum(f.stat().st_size for f in (tmp_path / "images").rglob("part-*")) < 1 << 20  # 32 MB of blocks
    got = ingest.read_image(spark, str(tmp_path / "images" / "*"))
    text = F.expr("rtrim('\\0', cast(data as string))")
    assert sorted((x.addr, x.t) for x in got.select("addr", text.alias("t")).collect()) == sorted((x.addr, x.content) for x in rows.collect())
