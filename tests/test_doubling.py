"""Chains by pointer doubling against the walk."""

import random

import pytest

from blockloom.plans import doubling
from blockloom.plans.chain import applicable_chain
from blockloom.plans.doubling import chain_by_doubling, chain_of_all

DIFF = "vol_id bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, data_size bigint"
KEY = ["vol_id", "pos", "b_b", "b_e", "e_b", "e_e", "s_b", "s_e"]


def rows(df):
    return sorted(map(tuple, df.select(*KEY).collect()))


@pytest.mark.parametrize("width", [3, 16, 1 << 16])
def test_doubling_equals_the_walk(spark, width):
    r = random.Random(width)
    diffs, base = [], []
    for v in range(25):
        base.append((v, r.randrange(4), r.randrange(4, 8)) if v % 3 else (v, 0, 0))
        for _ in range(r.choice([0, 5, 150])):
            b, n = r.randrange(60), r.choice([1, 1, 2, 5])
            b_e, e_e = b + r.choice([0, 0, 2]), b + n + r.choice([0, 0, 3])
            diffs.append((v, b, b_e, b + n, max(e_e, b_e), r.random() < 0.7, r.random() < 0.15, 5))
    d = spark.createDataFrame(list({x[:5]: x for x in diffs}.values()), DIFF).selectExpr("*", "timestamp_seconds(0) as ts")
    base = spark.createDataFrame(base, "vol_id bigint, b_b bigint, b_e bigint")
    want = rows(applicable_chain(d, base))
    assert len(want) > 25 and rows(chain_by_doubling(d, base, width)) == want == rows(chain_of_all(d, base, 20, width)) == rows(chain_of_all(d, base, 1000, width))


def test_a_long_chain_over_many_slices(spark):
    d = spark.range(40_000).selectExpr("1L as vol_id", "id as b_b", "id as b_e", "id + 1 as e_b", "id + 1 + if(id % 1000 = 7, 2, 0) as e_e", "true as is_mergeable", "false as is_comp_diff", "1L as data_size", "timestamp_seconds(0) as ts")
    base = spark.createDataFrame([(1, 3, 5)], "vol_id bigint, b_b bigint, b_e bigint")
    got = rows(chain_by_doubling(d, base, 256))
    assert len(got) == 39_997 and got == rows(applicable_chain(d, base))


def test_leaps_start_only_where_a_chain_can_enter_a_slice(spark):
    d = spark.range(6_400).selectExpr("1L as vol_id", "id as b_b", "id as b_e", "id + 1 as e_b", "id + 1 as e_e", "true as is_mergeable", "false as is_comp_diff", "1L as data_size", "timestamp_seconds(0) as ts")
    base = spark.createDataFrame([(1, 3, 3)], "vol_id bigint, b_b bigint, b_e bigint")
    got = doubling.leaps(doubling.pointers(d, base, 64), base, 64)
    assert sorted(map(tuple, got.collect())) == sorted([(1, 3, 64), *((1, g, g + 64) for g in range(64, 6_400, 64))])
