"""One discard of 4,294,967,295 blocks: cut without a long list in a row, pieces over many tasks."""

import pytest
from pyspark.sql import functions as F

from blockloom.operators import changes, extent

FAR = 4_294_967_295
ROW = "vol_id bigint, ev bigint, addr bigint, blocks bigint, is_padding boolean, is_discard boolean, token string"


def log(spark):
    return spark.createDataFrame([(1, 1, 5, FAR, False, True, None), (1, 2, 100, 7, False, False, "t")], ROW)


def spread(df):
    """(rows, tasks that made rows, blocks) of a result."""
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.sum("blocks").alias("b")).collect()
    return sum(r.n for r in per), len(per), sum(r.b for r in per), max(r.n for r in per)


@pytest.mark.parametrize("layout", ["fragment", "aligned"])
def test_compact_log_of_a_long_discard(spark, layout):
    rows, tasks, blocks, most = spread(changes.compact_log(log(spark), 8, layout))
    assert blocks == FAR and rows >= FAR // 8 and tasks >= 4 and most < 0.6 * rows


def test_split_max_of_a_long_discard(spark):
    df = log(spark).limit(1).select("vol_id", "addr", "blocks")
    rows, tasks, blocks, most = spread(changes.split_max(df, 4))
    assert (rows, blocks) == (1 << 30, FAR) and tasks >= 4 and most < 0.6 * rows


def test_split_aligned_is_dealt(spark):
    df = log(spark).limit(1).select("vol_id", "addr", "blocks")
    rows, tasks, blocks, most = spread(extent.split_aligned(df, 64))
    assert blocks == FAR and tasks >= 4 and most < 0.6 * rows
    assert extent.split_aligned(df, 1 << 20).where("addr % blocks <> 0 or blocks > 1048576").count() == 0


def test_cuts_equal_plain_ones(spark):
    runs = spark.createDataFrame([(1, 7, 1000, 3), (1, 70_000, 300_001, 11), (2, 5, 65_536, 0)], "vol_id bigint, addr bigint, blocks bigint, off bigint")
    for n in (7, 1000, 65_536, 65_537, 100_000):
        want = []
        for vol, addr, blocks, off in [(1, 7, 1000, 3), (1, 70_000, 300_001, 11), (2, 5, 65_536, 0)]:
            at = off
            while at < off + blocks:
                end = min(off + blocks, (at // n + 1) * n)
                want.append((vol, addr + at - off, end - at, at))
                at = end
        got = extent.cut_from_start(runs, n).select("vol_id", "addr", "blocks", "off").collect()
        assert sorted(map(tuple, got)) == sorted(want)
