"""Digests of folders against plain Python, timed snapshots of a quiet log, a copy that starts again."""

import hashlib
import os
import random
import time

import pytest

from blockloom.operators import archive, image
from blockloom.plans.commits import Store
from blockloom.streaming import jobs


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def folded(digests):
    for _ in range(3):  # three levels, each of one node here
        digests = [sha(",".join(digests))]
    return digests[0]


def plain(root, times, piece):
    out = {}

    def walk(path, rel):
        if os.path.isfile(path):
            raw = open(path, "rb").read()
            parts = [hashlib.sha256(raw[k : k + piece]).hexdigest() for k in range(0, max(len(raw), 1), piece)]
            out[rel] = parts[0] if len(parts) == 1 else folded(parts)
            micros = os.stat(path).st_mtime_ns // 1_000_000 * 1000
            return f"{out[rel]}@{micros}" if times else out[rel]
        own = [sha(f"{n}={walk(f'{path}/{n}', f'{rel}/{n}'.lstrip('/'))}") for n in sorted(os.listdir(path), key=str.encode)]
        out[rel] = folded(own)
        return out[rel]

    walk(root, "")
    return out


@pytest.mark.parametrize("times", [False, True])
def test_folder_digests(spark, tmp_path, times):
    r = random.Random(1)
    for name in ("a", "b/c/d/e.txt", "b/c/x", "b/c/big", "b/B", "z z/1", "z z/ü", "b/c2/deep/er/f"):
        p = tmp_path / "t.r+ee" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(r.randbytes(1000 if name.endswith("big") else r.randrange(1, 90)))
    root = str(tmp_path / "t.r+ee")
    want = plain(root, times, 300)
    (tmp_path / "t.r+ee" / "empty").write_bytes(b"")  # not listed
    assert {x.path: x.digest for x in image.folder_digests(spark, root, times, piece=300).collect()} == want


def test_a_quiet_log_gets_its_snapshot(spark, tmp_path):
    kind = "vol_id bigint, next_lsid bigint"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 50), (1, 120), (2, 7)], kind).coalesce(1).write.parquet(inbox)
    stream = jobs.stream_timed_snapshots(spark.readStream.schema(kind).parquet(inbox), seconds=2, max_send=100)
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()

    def seen(n):
        for _ in range(120):
            time.sleep(0.5)
            if os.path.isdir(f"{out}/_spark_metadata") and len(rows := spark.read.schema("vol_id bigint, lsid bigint, gid bigint").parquet(out).collect()) >= n:
                return sorted(map(tuple, rows))
        raise AssertionError("no snapshot came")

    try:
        assert seen(2) == [(1, 120, 2), (2, 7, 1)]  # without any later record
        spark.createDataFrame([(1, 130)], kind).coalesce(1).write.mode("append").parquet(inbox)
        assert seen(3) == [(1, 120, 2), (1, 130, 3), (2, 7, 1)]  # nothing for the volume that stood still
    finally:
        job.stop()


def test_a_copy_goes_on_where_it_stopped(spark, tmp_path):
    blocks = spark.range(3000).selectExpr("id % 7 as vol_id", "id * 997 as addr", "concat('c', id) as content")
    empty = {t: spark.createDataFrame([], layout.ddl) for t, layout in archive.LAYOUTS.items()}
    source = archive.create(spark, str(tmp_path / "s"), empty["state"], empty["diff"], empty["record"], blocks, buckets=8)
    Store(spark, str(tmp_path / "t"), archive.COPY_LAYOUTS, 8)
    target = lambda: Store(spark, str(tmp_path / "t"), archive.COPY_LAYOUTS)
    assert archive.copy_image(source, target(), "u", 5, 5, at_once=2, most=4) == [0, 1, 2, 3]
    first = target().manifest()["tables"]["image"]
    assert 0 < target().read("image").count() < 3000
    assert archive.copy_image(source, target(), "u", 5, 5) == [4, 5, 6, 7]  # only the rest is written
    assert all(target().manifest()["tables"]["image"][b] == f for b, f in first.items())
    rows = lambda df: sorted(map(tuple, df.select("vol_id", "addr", "content").collect()))
    assert rows(target().read("image")) == rows(blocks) and archive.copy_image(source, target(), "u", 5, 5) == []
    assert archive.copy_image(source, target(), "u", 6, 6, at_once=8, most=1) == [0]  # another state: anew
    assert target().read("image").count() < 3000
