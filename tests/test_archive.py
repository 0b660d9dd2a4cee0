"""Stored tables against a plain model: apply, merge, restore, expire; jobs that stop anywhere; readers of old versions."""

import random

import pytest

from blockloom.operators import archive
from blockloom.plans.commits import Conflict, Store

STATE = "vol_id bigint, is_applying boolean, b_b bigint, b_e bigint, e_b bigint, e_e bigint"
TOP = 7


def model(vol, seed=1):
    """Image and the records of each gid of a volume."""
    r = random.Random(seed * 100 + vol)
    image = {a: f"i{a}" for a in range(0, 200_000, 1 if vol < 0 else 997)} | {a: f"i{a}" for a in range(40)}
    sets = []
    for gid in range(1, TOP + 1):
        sets.append([(r.choice([r.randrange(50), 65_500 + r.randrange(60), r.randrange(190_000)]), r.choice([1, 3, 15, 90]), r.choice(["Normal"] * 6 + ["Allzero", "Discard"]), f"t{vol}.{gid}.{k}") for k in range(12)])
    return image, sets


def laid(image, sets, discard):
    """The image after merged sets: the newest record of a block counts."""
    won = {}
    for records in sets:
        for addr, blocks, kind, token in records:
            won |= {addr + k: (kind, f"{token}:{k}") for k in range(blocks)}
    out = dict(image)
    for a, (kind, content) in won.items():
        if kind == "Normal":
            out[a] = content
        elif kind == "Allzero" or discard == "zero":
            out.pop(a, None)
    return out


VOLS = range(3)


@pytest.fixture
def store(spark, tmp_path):
    diffs = [(v, g - 1, g - 1, g, g, g not in (3, 6), False, g * 10) for v in VOLS for g in range(1, TOP + 1)]
    records = [(v, g - 1, g - 1, g, g, k, a, n, 0, kind, t if kind == "Normal" else None) for v in VOLS for g, s in enumerate(model(v)[1], 1) for k, (a, n, kind, t) in enumerate(s)]
    image = [(v, a, c) for v in VOLS for a, c in model(v)[0].items()]
    return archive.create(
        spark, str(tmp_path / "store"), spark.createDataFrame([(v, False, 0, 0, None, None) for v in VOLS], STATE),
        spark.createDataFrame(diffs, "vol_id bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, data_size bigint").selectExpr("*", "timestamp_seconds(e_b) as ts"),
        spark.createDataFrame(records, archive.LAYOUTS["record"].ddl), spark.createDataFrame(image, archive.LAYOUTS["image"].ddl), buckets=5,
    )


def at(spark, gid, vols=VOLS):
    return spark.createDataFrame([(v, gid) for v in vols], "vol_id bigint, gid bigint")


def blocks(df):
    rows = [tuple(r) for r in df.select("vol_id", "addr", "content").collect()]
    assert len(rows) == len({r[:2] for r in rows})
    return {v: {a: c for w, a, c in rows if w == v} for v in VOLS}


def scans(spark, store, gids, version=None):
    return {g: blocks(archive.scan(store, at(spark, g), version)) for g in gids}


def want_scan(gid):
    return {v: laid(model(v)[0], model(v)[1][:gid], "zero") for v in VOLS}


def ends(store):
    return sorted((r.vol_id, r.b_b, r.e_b) for r in store.read("diff").collect())


def test_apply_and_versions(spark, store):
    before = store.latest()
    archive.apply_to_gid(store, at(spark, 4, [0, 1]))
    assert blocks(store.read("image")) == {v: laid(model(v)[0], model(v)[1][:4] if v < 2 else [], "ignore") for v in VOLS}
    assert sorted(tuple(r)[:5] for r in store.read("state").collect()) == [(0, False, 4, 4, None), (1, False, 4, 4, None), (2, False, 0, 0, None)]
    assert ends(store) == [(v, g - 1, g) for v in VOLS for g in range(5 if v < 2 else 1, TOP + 1)]
    assert scans(spark, store, [3], before)[3] == want_scan(3)  # a reader keeps its version
    assert archive.apply_to_gid(store, at(spark, 4, [0, 1])) == store.latest() == before + 2  # nothing left to do
    assert store.vacuum(1) and blocks(store.read("image"))[2] == model(2)[0]


@pytest.mark.parametrize("died", ["after begin", "in end", "before begin"])
def test_killed_and_repeated(spark, store, died, monkeypatch):
    if died == "after begin":
        archive.begin(store, at(spark, 5))
    else:
        commit, left = Store.commit, [1 if died == "in end" else 0]

        def dying(self, *a, **b):
            left[0] -= 1
            if left[0] < 0:
                raise SystemError("killed")
            return commit(self, *a, **b)

        monkeypatch.setattr(Store, "commit", dying)
        with pytest.raises(SystemError):
            archive.apply_to_gid(store, at(spark, 5))
        monkeypatch.setattr(Store, "commit", commit)
    assert blocks(store.read("image")) == {v: model(v)[0] for v in VOLS}
    opened = archive.open_store(spark, store.path)  # another job
    assert [r.is_applying for r in opened.read("state").collect()] == [died != "before begin"] * 3
    if died == "before begin":
        archive.apply_to_gid(opened, at(spark, 5))
    elif died == "in end":
        archive.recover(opened)
    else:
        assert archive.merge_range(opened, 0, TOP).count() == 0  # not while applying
        archive.apply_to_gid(opened, at(spark, 2))  # rolls on to 5 all the same
    assert blocks(opened.read("image")) == {v: laid(model(v)[0], model(v)[1][:5], "ignore") for v in VOLS}
    assert {(r.b_b, r.is_applying) for r in opened.read("state").collect()} == {(5, False)} and ends(opened) == [(v, g - 1, g) for v in VOLS for g in (6, 7)]


def test_scans_equal_before_and_after_merge(spark, store):
    before = store.latest()
    merged = archive.merge_range(store, 3, 6).collect()
    assert sorted((r.vol_id, r.b_b, r.e_b) for r in merged) == [(v, 3, 5) for v in VOLS]  # the diff to gid 6 isn't mergeable
    for r in merged:
        won = {}
        for addr, n, kind, _ in [x for s in model(r.vol_id)[1][3:5] for x in s]:
            won |= {addr + k: kind for k in range(n)}
        assert r.data_size == 512 * sum(kind == "Normal" for kind in won.values())
    assert ends(store) == sorted((v, a, b) for v in VOLS for a, b in [(0, 1), (1, 2), (2, 3), (3, 5), (5, 6), (6, 7)])
    reachable = [0, 2, 3, 5, 7]
    now = scans(spark, store, reachable)
    assert now == scans(spark, store, reachable, before) == {g: want_scan(g) for g in reachable}
    assert scans(spark, store, [4])[4] == {v: {} for v in VOLS}  # no longer reached
    archive.clean_records(store)
    store.vacuum(1)
    assert scans(spark, store, [5, 7]) == {g: want_scan(g) for g in (5, 7)}
    assert archive.merge_range(store, 5, 6).count() == 0
    archive.apply_to_gid(store, at(spark, 7), discard="zero", max_nr=2)
    assert blocks(store.read("image")) == want_scan(7)


def test_restored_images_serve(spark, store):
    archive.restore(store, at(spark, 2))
    archive.restore(store, at(spark, 4, [0, 1]))
    archive.restore(store, at(spark, 4))  # kept ones aren't kept twice
    archive.restore(store, at(spark, 9, [1]))  # not reached
    assert sorted(map(tuple, store.read("cold").collect())) == [(v, g) for v in VOLS for g in (2, 4)]
    assert scans(spark, store, [2, 3, 4, 6]) == {g: want_scan(g) for g in (2, 3, 4, 6)}
    archive.apply_to_gid(store, at(spark, 4, [0]))  # just the restored image
    archive.apply_to_gid(store, at(spark, 5, [1]))
    base = {0: want_scan(4)[0], 1: laid(want_scan(4)[1], model(1)[1][4:5], "ignore"), 2: model(2)[0]}
    assert blocks(store.read("image")) == base
    archive.expire_before(store, at(spark, 5))
    assert store.read("cold").count() == store.read("cold_image").count() == 0 and ends(store) == [(v, g - 1, g) for v in VOLS for g in (6, 7)]


def test_the_second_writer_is_told(spark, store):
    seen = store.manifest()
    archive.apply_to_gid(store, at(spark, 1))
    with pytest.raises(Conflict):
        store.commit(seen, "late")
    archive.add_diffs(store, store.read("diff").limit(0), store.read("record").limit(0))
    assert store.manifest()["note"] == "diffs"
