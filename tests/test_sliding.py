"""Moving rates equal Spark's range windows, and work that doesn't grow with the window."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from blockloom.operators import report


def test_equal_to_range_windows(spark):
    r = random.Random(5)
    rows = [(r.randrange(3), r.choice([None, *range(60)]), r.choice([None, *range(1, 50)]), r.choice([None, *range(90)])) for _ in range(400)]
    df = spark.createDataFrame(rows, "key bigint, t bigint, bytes bigint, position bigint")
    w = Window.partitionBy("key").orderBy("t").rangeBetween(-7, 0)
    span = F.col("t") - F.min("t").over(w)
    span = F.when(span == 0, 1).otherwise(span)
    order = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert order(report.moving_bps(df, 7)) == order(df.select("key", "t", (F.sum("bytes").over(w) * 8 / span).alias("bps")))
    assert order(report.progress_rate(df, 7)) == order(df.select("key", "t", ((F.col("position") - F.min("position").over(w)) / span).alias("rate")))


def test_a_wide_window_is_linear(spark):
    df = spark.range(150_000).select(F.lit(0).cast("long").alias("key"), F.col("id").alias("t"), F.lit(1).cast("long").alias("bytes"))
    began = time.time()
    assert report.moving_bps(df, 100_000).where("t = 149999").first().bps == 100_001 * 8 / 100_000
    assert time.time() - began < 30  # a sum anew for each row adds 10**10 numbers
