"""Equivalences between operators, binary formats, literal catalogues and streams."""

import random
import struct
import zlib

import pytest

from blockloom.functions.checksum import sum_words
from blockloom.operators import catalog as cat
from blockloom.operators import changes as chg
from blockloom.operators import extent, image, policy
from blockloom.sources import binary
from blockloom.streaming import jobs

RECORD = "vol_id bigint, addr bigint, blocks bigint, seq bigint, gid bigint, lsid bigint, rec_type string, token string"


def random_changes(spark, n, seed, span=600, vols=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        kind = r.choices(["Normal", "Discard", "Allzero"], [8, 1, 1])[0]
        rows.append((r.randrange(vols), r.randrange(span), r.randint(1, 15), i, i // 10, i, kind, f"t{i}" if kind == "Normal" else None))
    return rows, spark.createDataFrame(rows, RECORD)


def model(rows):
    """Block by block, one record after another."""
    disk = {}
    for vol, addr, n, seq, _, _, kind, token in rows:
        for k in range(n):
            disk[vol, addr + k] = (seq, k, kind, token)
    return disk


@pytest.mark.parametrize(("seed", "crowd"), [(0, 32_768), (1, 40), (2, 2)])
def test_latest_wins_is_the_sequential_result(spark, seed, crowd):
    rows, df = random_changes(spark, 120, seed)
    got = {}
    for r in chg.with_payload(extent.latest_wins(df, crowd=crowd, part=16), df).collect():
        for k in range(r.blocks):
            assert (r.vol_id, r.addr + k) not in got
            got[r.vol_id, r.addr + k] = (r.seq, r.off + k, r.rec_type, r.token)
    assert got == model(rows)


def test_huge_discard_is_never_exploded(spark):
    rows = [(0, 0, 4_294_967_295, 1, 0, 1, "Discard", None), (0, 70_000, 10, 2, 0, 2, "Normal", "x"), (0, 5, 3, 0, 0, 0, "Normal", "y")]
    got = chg.winners(spark.createDataFrame(rows, RECORD)).collect()
    assert sum(r.blocks for r in got) == 4_294_967_295
    assert {(r.addr, r.blocks) for r in got if r.rec_type == "Normal"} == {(70_000, 10)}
    assert len(got) == 3


def test_apply_merged_is_apply_one_by_one(spark):
    _, df = random_changes(spark, 80, 7, span=200)
    empty = spark.createDataFrame([], "vol_id bigint, addr bigint, content string")
    at_once = image.apply_changes(empty, df, "zero")
    step = empty
    for g in range(8):
        step = image.apply_changes(step, df.where(f"gid = {g}"), "zero")
        step = spark.createDataFrame(step.collect(), step.schema)
    assert sorted(at_once.collect()) == sorted(step.collect())


def test_resync_makes_equal(spark):
    a = spark.createDataFrame([(i, f"a{i}") for i in range(0, 300, 2)], "addr bigint, content string")
    b = spark.createDataFrame([(i, f"a{i}" if i % 10 else "z") for i in range(0, 250)], "addr bigint, content string")
    assert image.image_diff(image.resync(a, b, 16), a).count() == 0


def test_aligned_split(spark):
    df = spark.createDataFrame([(0, 13), (4, 4), (3, 6), (64, 200)], "addr bigint, blocks bigint")
    got = sorted((r.addr, r.blocks) for r in extent.split_aligned(df, 64).collect())
    want = [(0, 8), (8, 4), (12, 1), (4, 4), (3, 1), (4, 4), (8, 1), (64, 64), (128, 64), (192, 64), (256, 8)]
    assert got == sorted(want)
    wide = spark.createDataFrame([(3, 4_294_967_295)], "addr bigint, blocks bigint")
    assert extent.split_aligned(wide, 64).where("addr % blocks = 0").selectExpr("sum(blocks)", "max(blocks)").first()[:] == (4_294_967_295, 64)


DIFF = "vol_id bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, ts timestamp, data_size bigint"


def diffs(spark, *pairs, comp=()):
    return spark.createDataFrame([(0, b, b, e, e, True, (b, e) in comp, None, 1) for b, e in pairs], DIFF)


def test_gc_range_literal(spark):
    got = cat.gc_range(diffs(spark, (0, 1), (0, 2), (1, 2), (1, 3), (2, 3), (2, 4)), 1, 3)
    assert sorted((r.b_b, r.e_b) for r in got.collect()) == [(1, 2), (2, 3)]


def test_chain_prefers_progress_and_exact_compared_diffs(spark):
    base = spark.createDataFrame([(0, 0, 0, False, None)], "vol_id bigint, b_b bigint, b_e bigint, is_applying boolean, e_b bigint")
    got = cat.applicable_chain(diffs(spark, (0, 1), (0, 3), (1, 2), (2, 9), (3, 5), comp={(2, 9)}), base).orderBy("pos").collect()
    assert [(r.b_b, r.e_b) for r in got] == [(0, 3), (3, 5)]


def _closed(raw, at=0, salt=0):
    """The bytes with the 32-bit sum at ``at`` set so that the whole sums to zero."""
    cleared = raw[:at] + bytes(4) + raw[at + 4 :]
    return cleared[:at] + struct.pack("<I", sum_words(cleared, salt)) + cleared[at + 4 :]


def test_binary_log(spark, tmp_path):
    salt, pbs = 77, 512
    head = binary.LOG_HEADER.pack(4, 2, 4096, 0, 0, salt, 512, pbs, bytes(range(16)), 10, 14)
    head = _closed(head + bytes(4096 - len(head)), 8)
    data = bytes(range(256)) * 4
    recs = binary.RECORD.pack(sum_words(data, salt), 1, 100, 2, 1, 0, 11) + binary.RECORD.pack(0, 5, 500, 4000, 3, 0, 13)
    pack = binary.PACK.pack(0, 3, 2, 10, 2, 0, 0) + recs
    pack = _closed(pack + bytes(pbs - len(pack)), 0, salt)
    (tmp_path / "a.log").write_bytes(head + pack + data)
    files, packs, records = binary.read_log_files(spark, str(tmp_path))
    assert [(f.salt, f.begin_lsid) for f in files.collect()] == [(salt, 10)]
    assert [(p.pack_lsid, p.next_lsid) for p in packs.collect()] == [(10, 13)]
    got = sorted(records.collect(), key=lambda r: r.rec_idx)
    assert [(r.addr, r.blocks, r.is_discard, r.ok) for r in got] == [(100, 2, False, True), (500, 4000, True, True)]
    assert bytes(got[0].payload) == data


def test_binary_change_sets(spark, tmp_path):
    data = b"ab" * 512
    squeezed = zlib.compress(data)
    head = binary.DIFF_HEADER.pack(0, 2, 0, 0, 0, 0, bytes(16))
    rec = binary.DIFF_RECORD.pack(8, 2, 1, 1, 0, 0, len(squeezed), sum_words(squeezed), 0) + binary.DIFF_RECORD.pack(20, 9, 5, 0, 0, len(squeezed), 0, 0, 0)
    pack = binary.DIFF_PACK.pack(0, 2, 0, 0, len(squeezed), 0) + rec
    end = binary.DIFF_PACK.pack(0, 0, 1, 0, 0, 0)
    (tmp_path / "sorted").write_bytes(head + _closed(pack + bytes(4096 - len(pack))) + squeezed + _closed(end + bytes(4096 - len(end))))
    head = binary.DIFF_HEADER.pack(0, 2, 1, 0, 0, 0, bytes(16))
    body = head + squeezed
    body += bytes(-len(body) % 8)
    index = binary.INDEX_RECORD.pack(30, 1, 1, 1, 0, len(head), len(squeezed), 1, 2, 0, sum_words(squeezed), 0)
    (tmp_path / "indexed").write_bytes(body + index + binary.INDEX_SUPER.pack(len(body), 1, 1, 0, 0))
    got = sorted((r.addr, r.blocks, r.rec_type, bytes(r.payload or b""), r.ok) for r in binary.read_diff_files(spark, str(tmp_path)).collect())
    assert got == [(8, 2, "Normal", data, True), (20, 9, "Discard", b"", True), (30, 1, "Normal", data[512:], True)]


def test_stream_accept_holds_early_and_drops_late_diffs(spark, tmp_path):
    from pyspark.sql import functions as F

    own = [F.lit(u).alias(n) for n, u in (("uuid", "u"), ("size", 5), ("from_proxy", True))]
    for k, pairs in enumerate([[(3, 4), (5, 6)], [(2, 3)], [(2, 3), (4, 5)]]):
        diffs(spark, *pairs).select("*", *own).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(DIFF + ", uuid string, size int, from_proxy boolean").option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    base = spark.createDataFrame([(0, 2, "u", 9)], "vol_id bigint, gid bigint, uuid string, size bigint")
    q = jobs.stream_accept(stream, base).writeStream.format("memory").queryName("accepted").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = sorted((r.verdict, r.b_b, r.e_b) for r in spark.table("accepted").collect())
    assert got == [("accepted", 2, 3), ("accepted", 3, 4), ("accepted", 4, 5), ("accepted", 5, 6), ("too_old", 2, 3)]


def test_a_record_beyond_the_device_is_an_error(spark):
    df = spark.createDataFrame([(0, 90, 20, 1, 0, 1, "Normal", "x")], RECORD)
    empty = spark.createDataFrame([], "vol_id bigint, addr bigint, content string")
    assert image.apply_changes(empty, df, size=110).count() == 20
    with pytest.raises(Exception, match="beyond the device"):
        image.apply_changes(empty, df, size=109).collect()


def chain_of(spark, lines):
    """Rows (b, e, flags, size) as a chain."""
    rows = [(0, i, b, b, e, e, f[0] == "M", f[1] == "C", None, n, e, e) for i, (b, e, f, n) in enumerate(lines, 1)]
    return spark.createDataFrame(rows, "vol_id bigint, pos bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, ts timestamp, data_size bigint, s_b bigint, s_e bigint")


P0 = [(0, 1, "--", 1000), (1, 2, "M-", 1000), (2, 3, "MC", 1000), (3, 4, "M-", 900), (4, 5, "M-", 1000), (5, 6, "MC", 1000), (6, 7, "M-", 90), (7, 8, "M-", 100), (8, 9, "M-", 100), (9, 10, "M-", 100)]
FROM_FIRST = [(0, 1, "--", 100), (1, 2, "M-", 1), (2, 3, "M-", 1), (3, 4, "--", 1)]
GUARDED = [(0, 1, "M-", 1), (1, 5, "M-", 1), (5, 6, "M-", 1), (6, 7, "--", 1), (7, 8, "--", 1)]


@pytest.mark.parametrize(("lines", "most", "protected", "want"), [
    (P0, 2, [], (6, 9)), (P0, 1_000_000, [], (3, 5)), ([], 9, [], None), (P0[:1], 9, [], None), (FROM_FIRST, 99, [], (0, 3)), (GUARDED, 99, [3], None), (GUARDED, 99, [], (0, 6)),
    ([(0, 1, "--", 4120), (1, 2, "MC", 8728), (2, 5, "M-", 3728), (5, 6, "M-", 8726), (6, 7, "MC", 1728), (7, 8, "M-", 9728), (8, 9, "M-", 2728), (9, 10, "M-", 4728)], 99, [], (2, 6)),
])
def test_best_merge_range_literal(spark, lines, most, protected, want):
    guard = spark.createDataFrame([(0, g) for g in protected], "vol_id bigint, gid bigint")
    got = policy.best_merge_range(chain_of(spark, lines), guard, 10**9, most).collect()
    assert [(r.gid_b, r.gid_e) for r in got] == ([want] if want else [])


def test_replication_target_literal(spark):
    chain = chain_of(spark, [(i, i + 1, "M-", 100) for i in range(9)])
    stop = lambda gid, size: [r.stop_gid for r in policy.replication_target(chain, spark.createDataFrame([(0, gid)], "vol_id bigint, gid bigint"), size).collect()]
    assert [stop(0, n) for n in (0, 200, 400, 800, 1000)] == [[], [3], [5], [9], [9]]
    assert [stop(g, 200) for g in (0, 1, 2, 5, 6, 7, 8)] == [[3], [4], [5], [8], [9], [9], []]


def test_merged_end_is_folded_from_the_first_diff(spark):
    """Clean and dirty diffs, after a base whose own end plays no part."""
    base = spark.createDataFrame([(0, 0, 50)], "vol_id bigint, b_b bigint, b_e bigint")
    for (d0, d1), want in {((0, 0, 1, 1), (1, 1, 2, 2)): (2, 2), ((0, 0, 1, 5), (1, 1, 2, 2)): (2, 5), ((0, 0, 1, 5), (1, 1, 3, 4)): (3, 4), ((0, 0, 1, 1), (1, 2, 3, 9)): (3, 9)}.items():
        rows = [(0, *d, True, False, None, 1) for d in (d0, d1)]
        got = cat.merge_meta(cat.applicable_mergeable_chain(spark.createDataFrame(rows, DIFF), base)).collect()
        assert [(r.e_b, r.e_e) for r in got] == [want]


def test_chain_against_a_plain_walk(spark):
    r = random.Random(3)
    rows, base = [], []
    for v in range(40):
        base.append((v, r.randint(0, 3), r.randint(3, 5)))
        for _ in range(r.randint(0, 25)):
            b = r.randint(0, 20)
            e = b + r.randint(1, 6)
            rows.append((v, b, b + r.randint(0, 1), e, e + r.randint(0, 2), True, r.random() < 0.2, None, 1))
    rows = list({x[:5]: x for x in rows}.values())
    got = cat.applicable_chain(spark.createDataFrame(rows, DIFF), spark.createDataFrame(base, "vol_id bigint, b_b bigint, b_e bigint")).collect()
    want = []
    for v, g, e in base:
        pos = 0
        while True:
            fit = [x for x in rows if x[0] == v and x[3] > g and (x[1] == g if x[6] else x[1] <= g)]
            if not fit:
                break
            d = max(fit, key=lambda x: (x[3], x[1], -x[4], -x[2]))
            clean = d[1] == d[2] and d[3] == d[4]
            g, e, pos = d[3], (max(d[3], e) if clean else d[4]), pos + 1
            want.append((v, pos, d[1], d[3], g, e))
    assert sorted((r.vol_id, r.pos, r.b_b, r.e_b, r.s_b, r.s_e) for r in got) == sorted(want)


def test_overlaps_and_holes_of_every_length(spark):
    r = random.Random(5)
    rows = [(r.randrange(2), r.randrange(5000), r.choice([1, 2, 3, 17, 300, 4000]), i) for i in range(120)]
    rows.append((0, 0, 4_294_967_295, 120))
    df = spark.createDataFrame(rows, "vol_id bigint, addr bigint, blocks bigint, seq bigint")
    left, right = df.where("seq % 2 = 0"), df.where("seq % 2 = 1")
    want = [(a[3], b[3]) for a in rows for b in rows if a[3] % 2 == 0 and b[3] % 2 == 1 and a[0] == b[0] and a[1] < b[1] + b[2] and b[1] < a[1] + a[2]]
    assert sorted((x.l_seq, x.r_seq) for x in extent.overlap_join(left, right).collect()) == sorted(want)
    over = {(v, k) for v, a, n, s in rows if s % 2 for k in range(a, a + n)}
    kept = chg.changes_minus(left, right).where("seq < 120").collect()
    assert sorted((x.vol_id, x.seq, k) for x in kept for k in range(x.addr, x.addr + x.blocks)) == sorted((v, s, k) for v, a, n, s in rows[:-1] if s % 2 == 0 for k in range(a, a + n) if (v, k) not in over)


def test_stream_compact_equals_batch(spark, tmp_path):
    from blockloom.fixtures import Inputs

    log = Inputs(spark, "/root/testdata/sf0.001").log_record.where("vol_id = 0")
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "log"))
    jobs.stream_compact(stream, str(tmp_path / "out"), str(tmp_path / "cp"), max_send=1 << 40).awaitTermination(120)
    cols = ["addr", "blocks", "off", "token"]
    got = spark.read.parquet(str(tmp_path / "out/changes")).select(*cols)
    assert sorted(map(str, got.collect())) == sorted(map(str, chg.compact_log(log).select(*cols).collect()))


def test_retry_delay_doubles_to_a_cap():
    d, seen = 0.0, []
    for _ in range(8):
        d = jobs.next_delay(d)
        seen.append(d)
    assert seen == [1, 2, 4, 8, 16, 32, 60, 60]
