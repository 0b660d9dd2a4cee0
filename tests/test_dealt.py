"""Sorted scans see whole keys, also where what they read is dealt by these keys already and adaptive execution regroups its tasks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.operators.extent import latest_wins, overlap_join
from blockloom.plans.chain import applicable_chain


def test_a_volume_meets_its_base(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "16")
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256KB")
    own.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    rows = own.range(60_000).select((F.col("id") % 300).alias("vol_id"), "id", F.sha2(F.col("id").cast("string"), 256).alias("wide"))
    n = (F.row_number().over(Window.partitionBy("vol_id").orderBy("id", "wide")) - 1).cast("long")
    diffs = rows.select("vol_id", n.alias("b_b"), n.alias("b_e"), (n + 1).alias("e_b"), (n + 1).alias("e_e"), F.lit(True).alias("is_mergeable"), F.lit(False).alias("is_comp_diff"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.length("wide").cast("long").alias("data_size"))
    base = rows.groupBy("vol_id").agg((F.count("wide") - 50).alias("b_b")).withColumn("b_e", F.col("b_b"))
    assert applicable_chain(diffs, base).count() == 300 * 50


def test_a_stripe_is_swept_whole_when_its_join_turns_into_a_broadcast(spark):
    """No stripe is crowded, so adaptive execution drops that side of the union, and may read the other side's shuffle by its local files."""
    own = spark.newSession()
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")  # below what the sides are estimated at, above what the smaller has
    own.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = own.range(0, 20_000, 1, 8).selectExpr("id % 50 as vol_id", "id * 37 % 997 as addr", "1 + id % 9 as blocks", "id as seq")
    each = "explode(sequence(addr, addr + blocks - 1)) as block"
    want = rows.selectExpr("vol_id", each, "seq").groupBy("vol_id", "block").agg(F.max("seq"))
    assert sorted(latest_wins(rows).selectExpr("vol_id", each, "seq").collect()) == sorted(want.collect())


def test_overlaps_of_a_hot_volume_are_found_by_many_tasks(spark):
    """Few rows that have many pairs: a join that sends one side to all tasks would leave the other in the task that it came in."""
    rows = spark.range(0, 3000, 1, 1).selectExpr("0L as vol_id", "id * 131 % 4096 as addr", "1 + id % 15 as blocks", "id as seq")
    long = rows.where("seq % 10 = 0").withColumn("blocks", F.col("blocks") * 16)
    got = overlap_join(long, rows).cache()
    each = got.groupBy(F.spark_partition_id()).count().collect()
    a, b = ([(r.addr, r.addr + r.blocks, r.seq) for r in x.collect()] for x in (long, rows))
    want = {(0, i, j, max(s, u), min(e, v) - max(s, u)) for s, e, i in a for u, v, j in b if max(s, u) < min(e, v)}
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want
    assert max(r["count"] for r in each) < 0.4 * len(found)
