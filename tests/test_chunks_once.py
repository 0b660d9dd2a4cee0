"""Syncs by chunk digests deal each image once."""

from blockloom.operators import image


def test_each_side_is_dealt_once(spark):
    side = lambda f: spark.range(500).selectExpr("id % 3 as vol_id", "id * 3 % 700 as addr", f"{f} as content")
    a, b = side("md5(cast(id as string))").where("addr < 600"), side("if(id % 90 = 4, 'x', md5(cast(id as string)))").where("addr > 100")
    for got in (image.resync(a, b, 16, ["vol_id"]), image.hash_sync(a, b, 16, ["vol_id"])):
        assert got._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    rows = lambda df: sorted(map(tuple, df.select("vol_id", "addr", "content").collect()), key=str)
    assert rows(image.resync(a, b, 16, ["vol_id"])) == rows(a) == rows(image.patch(b, image.hash_sync(a, b, 16, ["vol_id"]), ["vol_id"]))
    sent = {(r.vol_id, r.addr // 16) for r in image.hash_sync(a, b, 16, ["vol_id"]).collect()}
    assert sent == {tuple(r) for r in image.differing_chunks(a, b, 16, ["vol_id"]).selectExpr("vol_id", "chunk div 16").collect()}
