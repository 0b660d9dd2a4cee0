"""Images and indexed change sets read by byte ranges, against whole files."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

import fixture_files
from blockloom.sources import binary, ingest, ranges


def test_images_are_one_scan_of_ranges(spark, tmp_path):
    r = random.Random(3)
    want = []
    for k in range(60):
        blocks = [bytes(64) if r.random() < 0.4 else r.randbytes(64) for _ in range(r.randrange(1, 40))]
        (tmp_path / f"{k} x.img").write_bytes(b"".join(blocks))
        want += [(f"{k} x.img", a, b) for a, b in enumerate(blocks) if any(b)]
    (tmp_path / "empty.img").write_bytes(b"")
    for most in (64, 500, 1 << 20):
        got = ingest.read_image(spark, str(tmp_path), 64, range_bytes=most)
        assert sorted((x.path.rpartition("/")[2], x.addr, bytes(x.data)) for x in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    (tmp_path / "odd.img").write_bytes(bytes(65))
    assert [x.length for x in ingest.odd_images(spark, str(tmp_path), 64).collect()] == [65]
    with pytest.raises(ValueError, match="odd.img"):
        ingest.read_image(spark, str(tmp_path), 64)
    assert ingest.read_image(spark, str(tmp_path), 64, odd="skip").count() == len(want)


def test_late_payload_against_whole_files(spark, tmp_path):
    r = random.Random(4)
    files, sets = [], []
    for gid in range(1, 7):
        at, rows = 0, []
        for ev in range(gid * 100, gid * 100 + 12):  # disjoint runs; some are parts of one record
            orig, off = r.choice([4, 9]), 0
            kind = r.choice(["Normal"] * 5 + ["Allzero", "Discard"])
            while off < orig:
                n = r.randrange(1, orig - off + 1)
                at += r.choice([0, 0, 3])
                rows.append((at, n, off, orig, ev, kind, f"t{ev}"))
                at, off = at + n, off + n
        pdf = pd.DataFrame(rows, columns=["addr", "blocks", "off", "orig", "ev", "rec_type", "token"])
        raw = fixture_files.shared_file(pdf)
        (tmp_path / f"{gid}.wdiff").write_bytes(raw)
        files.append((f"{gid}.wdiff", raw))
        sets.append(list(binary.diff_rows(f"{gid}.wdiff", raw)))
    packed = fixture_files.change_file(pd.DataFrame([(1, 2, 5, "Normal", "t")], columns=["addr", "blocks", "ev", "rec_type", "token"]), False)
    (tmp_path / "packs.wdiff").write_bytes(packed)  # no index: no rows
    won = {}
    for gid, rows in enumerate(sets, 1):
        for x in rows:
            won |= {x["addr"] + k: (gid, x["rec_type"], x["payload"] and x["payload"][k * 512 : k * 512 + 512]) for k in range(x["blocks"])}
    index = ranges.read_index(ingest.list_folder(spark, str(tmp_path)))
    gid = F.regexp_extract("path", r"(\d+).wdiff$", 1).cast("long")
    index = index.withColumns({"vol_id": F.lit(1).cast("long"), "gid": gid}).withColumn("seq", F.col("gid") * 1000 + F.col("idx"))
    assert index.count() == sum(map(len, sets))
    for cache in (1 << 20, 1):
        rows = ranges.late_payload(index, cache).collect()
        got = {x.addr + k: (x.seq // 1000, x.rec_type, x.payload and bytes(x.payload[k * 512 : k * 512 + 512])) for x in rows for k in range(x.blocks)}
        assert got == won and all(x.ok for x in rows)
        stored = {(i.path, i.data_offset): i.data_size for i in index.collect()}
        used = {(i.path, i.data_offset): i.data_size for i in index.join(spark.createDataFrame(rows).select("seq"), "seq", "left_semi").where("rec_type = 'Normal'").collect()}
        if cache > 1:  # each image of a winner once, others never
            assert sum(x.read_bytes for x in rows) == sum(used.values()) < 0.6 * sum(stored.values())
    broken = bytearray(files[5][1])
    broken[binary.DIFF_HEADER.size + 3] ^= 1
    (tmp_path / "6.wdiff").write_bytes(bytes(broken))
    bad = [x for x in ranges.late_payload(index).collect() if not x.ok]
    assert bad and all(x.payload is None and x.seq // 1000 == 6 for x in bad)


def test_an_index_is_read_from_its_files_once(spark, tmp_path):
    (tmp_path / "a.wdiff").write_bytes(fixture_files.change_file([], True))
    index = ranges.read_index(ranges.list_tree(spark, str(tmp_path)))
    assert "MapInArrow" not in index._jdf.queryExecution().executedPlan().toString()
