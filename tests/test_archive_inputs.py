"""The store's inputs made in parts equal the fixtures, and no task holds a volume."""

import re

import pytest

from blockloom import fixtures, store_queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    t = fixtures.Inputs(spark, SF)
    t.spread()
    return t


def same(a, b):
    b = b.select(*a.columns)
    assert [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stored_inputs_equal_the_fixtures(spark, inputs):
    plain = fixtures.Inputs(spark, SF)
    for name in ("change_input", "change_meta", "restore_target"):
        same(getattr(plain, name), inputs.stored(name))
    same(plain.diff_record, store_queries._records(inputs))


def test_records_join_by_volume_and_change_set(spark, inputs):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = store_queries._records(inputs)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert re.search(r"SortMergeJoin \[vol_id#\d+L, gid#\d+L\]", plan)
