"""Overlaps of a hot volume are far more than its rows: they must be whole, and take little room."""

from pyspark.sql import functions as F

from blockloom.operators.extent import TOGETHER, overlap_join


def test_pairs_of_a_hot_volume_take_little_room(spark, tmp_path):
    """As they were made before, a pair took 1.5 bytes here; equal rows, in an order that columns store well, take far less."""
    rows = spark.range(0, 8_000, 1, 4).selectExpr("0L as vol_id", "id * 7919 % 509 as addr", "1 + id * 31 % 15 as blocks", "id as seq")
    long = rows.where("seq % 5 = 0").withColumn("blocks", F.col("blocks") * 16)
    overlap_join(long, rows).write.parquet(str(tmp_path / "pairs"))
    got = spark.read.parquet(str(tmp_path / "pairs"))
    a, b = long.alias("a"), rows.alias("b")
    want = a.join(b, F.expr("a.addr < b.addr + b.blocks and b.addr < a.addr + a.blocks"))
    want = want.selectExpr("a.vol_id", "a.seq as l_seq", "b.seq as r_seq", "greatest(a.addr, b.addr) as addr", "least(a.addr + a.blocks, b.addr + b.blocks) - greatest(a.addr, b.addr) as blocks")
    sums = [F.count("*"), F.sum(F.hash("vol_id", "l_seq", "r_seq", "addr", "blocks")), F.sum(F.xxhash64("vol_id", "l_seq", "r_seq", "addr", "blocks").cast("decimal(38)"))]
    assert (found := got.agg(*sums).first()) == want.agg(*sums).first()
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.6 * found[0]


def test_equal_extents_beyond_one_row_meet_all(spark):
    n = 2 * TOGETHER + 44
    rows = spark.range(n).selectExpr("0L as vol_id", "100L as addr", "40L as blocks", "id as seq").unionByName(spark.range(1).selectExpr("0L as vol_id", "0L as addr", "4294967295L as blocks", f"{n}L as seq"))
    got = overlap_join(rows, rows)
    assert got.count() == got.distinct().count() == (n + 1) ** 2
    assert got.where("blocks <> 40 or addr <> 100").select("l_seq", "r_seq", "addr", "blocks").collect() == [(n, n, 0, 4_294_967_295)]
