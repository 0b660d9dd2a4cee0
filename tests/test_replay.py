"""A replay's large steps are written by all tasks, and each is one batch."""

from pyspark.sql import functions as F

from blockloom import stream_queries
from blockloom.fixtures import Inputs


def test_steps_are_batches_of_many_files(spark, monkeypatch):
    monkeypatch.setattr(stream_queries, "_LARGE", 100, raising=False)
    t = Inputs(spark, "/root/testdata/sf0.001")
    rows = spark.range(900).select((F.col("id") * 7 % 900).alias("ev"))
    seen = []

    def work(df, batch):
        got = df.select("ev", F.input_file_name().alias("file")).collect()
        ev = [r.ev for r in got]
        seen.append((min(ev), max(ev), len(ev), len({r.file for r in got})))

    out = stream_queries._out(t, "batches")[1]
    stream_queries._done(stream_queries._replay(t, rows, "ev").writeStream.foreachBatch(work).option("checkpointLocation", out).trigger(availableNow=True).start())
    assert [s[:3] for s in seen] == [(0, 299, 300), (300, 599, 300), (600, 899, 300)]
    assert all(s[3] == 4 for s in seen)
