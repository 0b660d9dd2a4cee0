"""Registered queries of the streaming jobs: a static replay of the fixtures in three steps, each run to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import changes as chg
from .plans.stage import new_path, staged
from .queries import _DATA, _LAID, WIN, Inputs, query, sum_sql, walk_sql
from .streaming import jobs

_STEPS = 3


_LARGE = 100_000  # rows of a step that are worth a file from every task


def _replay(t: Inputs, rows: DataFrame, order: str, steps: int = _STEPS) -> DataFrame:
    """A stream over the whole of ``rows``, a step at a time in ``order``.

    Rows are made once. A large step is written by all tasks, and a batch takes all files of a step: as many in each.
    """
    spark = t.spark
    path, rows = new_path(spark, "replay"), staged(rows, "replayed")
    low, high = rows.agg(F.min(order), F.max(order)).first()
    step = F.expr(f"least(cast(({order} - {low}) * {steps} div {high - low + 1} as int), {steps - 1})") if low is not None else F.lit(0)
    sizes = {r.step: r["count"] for r in rows.groupBy(step.alias("step")).count().collect()}  # a number a step
    files = int(spark.conf.get("spark.sql.shuffle.partitions")) if min([sizes.get(k, 0) for k in range(steps)]) >= _LARGE else 1
    for k in range(steps):
        own = rows.where(step == k)
        (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
    if files > 1 and (held := len(spark.read.schema(rows.schema).parquet(path).inputFiles())) != files * steps:
        raise AssertionError(f"{held} files for {steps} steps of {files}")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def _done(job, seconds: int = 600) -> None:
    if not job.awaitTermination(seconds):
        job.stop()
        raise TimeoutError(f"a replay took over {seconds} s")


def _out(t: Inputs, label: str) -> tuple[str, str]:
    path = new_path(t.spark, label)
    return f"{path}/tables", f"{path}/checkpoint"


@query("""WITH perm AS (SELECT vol_id, max(next_lsid) - 40 AS perm_lsid FROM log_record GROUP BY vol_id),
ready AS (SELECT r.* FROM log_record r JOIN perm p ON p.vol_id = r.vol_id AND r.next_lsid <= p.perm_lsid WHERE NOT is_padding),
blk AS (SELECT *, addr + k AS block, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY ev DESC) AS rn FROM (SELECT *, unnest(range(blocks)) AS k FROM ready) x)
SELECT vol_id, block, CASE WHEN NOT is_discard AND token <> 'Z' THEN concat(token, ':', k) ELSE '0' END AS content FROM blk WHERE rn = 1""")
def s1_stream_compact(t):
    """The blocks of all change sets that the stream made, a newer set over an older one: those of the log up to its permanent lsid."""
    out, checkpoint = _out(t, "s1")
    perm = t.log_record.groupBy("vol_id").agg((F.max("next_lsid") - 40).alias("perm_lsid"))
    _done(jobs.stream_compact(_replay(t, t.log_record, "ev"), out, checkpoint, max_send=300, permanent=lambda spark: perm))
    return _latest(t.spark.read.parquet(f"{out}/changes"))


def _latest(sets: DataFrame) -> DataFrame:
    rows = sets.withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)")))
    content = F.when(F.col("rec_type") == "Normal", chg.block_content(k=F.col("off") + F.col("k"))).otherwise("0")
    rows = rows.select("vol_id", (F.col("addr") + F.col("k")).alias("block"), "gid", content.alias("content"))
    return rows.groupBy("vol_id", "block").agg(F.max_by("content", "gid").alias("content"))


@query("""WITH perm AS (SELECT vol_id, max(next_lsid) - 40 AS perm_lsid FROM log_record GROUP BY vol_id)
SELECT r.vol_id, max(next_lsid) AS sent_lsid FROM log_record r JOIN perm p ON p.vol_id = r.vol_id AND r.next_lsid <= p.perm_lsid GROUP BY r.vol_id""")
def s1_stream_catalog(t):
    """How far the transfers of each volume go, from a catalogue whose gids have no gap."""
    out, checkpoint = _out(t, "s1")
    perm = t.log_record.groupBy("vol_id").agg((F.max("next_lsid") - 40).alias("perm_lsid"))
    _done(jobs.stream_compact(_replay(t, t.log_record, "ev"), out, checkpoint, max_send=300, permanent=lambda spark: perm))
    sets = t.spark.read.parquet(f"{out}/catalog").groupBy("vol_id").agg(F.max("lsid").alias("sent_lsid"), F.count("*").alias("n"), F.max("gid_e").alias("top"))
    return sets.where("n = top").select("vol_id", "sent_lsid")


@query("""WITH top AS (SELECT vol_id, max(e_b) AS e_b FROM change_meta GROUP BY vol_id)
SELECT vol_id, CAST(0 AS bigint) AS first_gid, e_b AS reached FROM top""")
def s2_stream_fanout(t):
    """Where each destination's merged diffs and pending ones together begin and end."""
    path = new_path(t.spark, "s2")
    diffs = _replay(t, t.change_meta, "e_b")
    for job in jobs.stream_fanout(diffs, t.change_input, {"a": f"{path}/a", "b": f"{path}/b"}, max_nr=3):
        _done(job)
    sides = []
    for name in "ab":
        sent = t.spark.read.parquet(f"{path}/{name}/tables/sent").select("vol_id", "b_b", "e_b")
        left = t.spark.read.parquet(f"{path}/{name}/tables/pending/batch={_STEPS - 1}").select("vol_id", "b_b", "e_b")
        sides.append(sent.unionByName(left).groupBy("vol_id").agg(F.min("b_b").alias("first_gid"), F.max("e_b").alias("reached")))
    return sides[0].intersect(sides[1])


@query(WIN.format(order="gid DESC, lsid", where="") + "SELECT vol_id, block, CASE WHEN rec_type = 'Normal' THEN concat(token, ':', k) ELSE '0' END AS content FROM win")
def s2_sent_data(t):
    """The blocks of all merged diffs that a destination was sent, of which the farthest holds a block's newest content; nothing stays pending."""
    path = new_path(t.spark, "s2")
    for job in jobs.stream_fanout(_replay(t, t.change_meta, "e_b"), t.change_input, {"a": path}, max_nr=3):
        _done(job)
    left = t.spark.read.parquet(f"{path}/tables/pending/batch={_STEPS - 1}")
    if not left.isEmpty():
        raise AssertionError("diffs are still pending")
    sent = t.spark.read.parquet(f"{path}/tables/sent").select("vol_id", "round", "batch", "e_b")
    rows = t.spark.read.parquet(f"{path}/tables/data").join(sent, ["vol_id", "round", "batch"]).withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)")))
    content = F.when(F.col("rec_type") == "Normal", chg.block_content(k=F.col("off") + F.col("k"))).otherwise("0")
    return rows.groupBy("vol_id", (F.col("addr") + F.col("k")).alias("block")).agg(F.max_by(content, "e_b").alias("content"))


_OWN = "SELECT vol_id, b_b AS gid, concat('u', vol_id) AS uuid, CASE WHEN vol_id % 9 = 4 THEN 10 ELSE 100 END AS size FROM base_state"
_ARRIVING = "SELECT vol_id, b_b, e_b, is_comp_diff, CASE WHEN b_b % 10 = 3 THEN 'x' ELSE concat('u', vol_id) END AS uuid, 50 AS size, b_b % 20 < 10 AS from_proxy FROM meta_diff"


@query(f"""WITH a AS ({_ARRIVING}), o AS ({_OWN}) SELECT a.vol_id, b_b, e_b, CASE WHEN from_proxy AND a.uuid <> o.uuid THEN 'different_uuid' WHEN o.size < a.size THEN 'smaller_size' ELSE 'judged' END AS verdict
FROM a JOIN o ON o.vol_id = a.vol_id""")
def s3_stream_accept(t):
    """The verdict on each arriving diff, that by gid as ``judged`` (or held); its order is tested apart."""
    out, checkpoint = _out(t, "s3")
    got = jobs.stream_accept(_replay(t, t.sql(_ARRIVING), "b_b"), t.sql(_OWN))
    _done(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    seen = t.spark.read.parquet(out).withColumn("verdict", F.expr("if(verdict in ('different_uuid', 'smaller_size'), verdict, 'judged')"))
    held = t.sql(_ARRIVING).join(seen.select("vol_id", "b_b", "e_b"), ["vol_id", "b_b", "e_b"], "left_anti").select("vol_id", "b_b", "e_b", F.lit("judged").alias("verdict"))
    return seen.unionByName(held)


_LET_IN = f"SELECT a.*, d.b_e, d.e_e, d.is_mergeable, d.ts, d.data_size FROM ({_ARRIVING}) a JOIN ({_OWN}) o ON o.vol_id = a.vol_id JOIN meta_diff d ON d.vol_id = a.vol_id AND d.b_b = a.b_b AND d.e_b = a.e_b WHERE NOT (from_proxy AND a.uuid <> o.uuid) AND o.size >= a.size"
_VERDICTS = walk_sql().replace("meta_diff", "let_in").replace("WITH RECURSIVE ", f"WITH RECURSIVE let_in AS ({_LET_IN}), ")


@query(_VERDICTS + """, reached AS (SELECT vol_id, max(g) AS g FROM (SELECT vol_id, b_b AS g FROM base_state UNION ALL SELECT vol_id, e_b FROM walk) x GROUP BY vol_id),
at AS (SELECT vol_id, b_b AS g FROM base_state UNION ALL SELECT vol_id, e_b FROM walk)
SELECT l.vol_id, l.b_b, l.e_b, CASE WHEN EXISTS (SELECT 1 FROM walk w WHERE w.vol_id = l.vol_id AND w.b_b = l.b_b AND w.e_b = l.e_b) THEN 'accepted' WHEN l.b_b > r.g THEN 'held'
  WHEN l.is_comp_diff AND l.e_b > (SELECT min(a.g) FROM at a WHERE a.vol_id = l.vol_id AND a.g > l.b_b)
    AND (l.b_b < (SELECT b_b FROM base_state b WHERE b.vol_id = l.vol_id) OR NOT EXISTS (SELECT 1 FROM at a WHERE a.vol_id = l.vol_id AND a.g = l.b_b)) THEN 'not_applicable'
  ELSE 'too_old' END AS verdict FROM let_in l JOIN reached r ON r.vol_id = l.vol_id""".replace("at AS (", "gone AS (").replace("FROM at a", "FROM gone a"))
def s3_stream_verdicts(t):
    """All verdicts by gid where everything comes at once; what is neither accepted nor dropped is held."""
    out, checkpoint = _out(t, "s3")
    got = jobs.stream_accept(_replay(t, t.sql(_ARRIVING), "b_b", steps=1), t.sql(_OWN))
    _done(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    seen = t.spark.read.parquet(out)
    held = t.sql(_ARRIVING).join(seen.select("vol_id", "b_b", "e_b"), ["vol_id", "b_b", "e_b"], "left_anti").join(t.sql(_OWN).select("vol_id"), "vol_id")
    by_gid = seen.where("verdict not in ('different_uuid', 'smaller_size')").withColumn("verdict", F.expr("if(verdict = 'retry', 'held', verdict)"))
    return by_gid.unionByName(held.select("vol_id", "b_b", "e_b", F.lit("held").alias("verdict")))


@query("""WITH blk AS (SELECT *, addr + k AS block, row_number() OVER (PARTITION BY vol_id, addr + k ORDER BY gid DESC, lsid DESC) AS rn FROM (SELECT *, unnest(range(blocks)) AS k FROM change_input) x),
win AS (SELECT * FROM blk WHERE rn = 1), img AS (SELECT vol_id, addr, content FROM volume_image)""" + _LAID)
def s4_stream_sync_image(t):
    """The image after all diffs have come, those of each step before the next: the source's."""
    out, checkpoint = _out(t, "s4")
    base, changes = t.volume_image, t.change_input.withColumn("seq", chg.order_key())
    state = t.restore_target.select("vol_id", F.lit(0).cast("long").alias("b_b"), F.lit(0).cast("long").alias("b_e"))
    _done(jobs.stream_sync_image(_replay(t, t.change_meta, "e_b"), changes, base, state, out, checkpoint))
    return jobs.synced_image(base, out)


@query("""WITH s AS (SELECT vol_id, CAST(floor(epoch(ts) / 3600) AS bigint) AS slot, max(next_lsid) AS lsid FROM log_record GROUP BY 1, 2),
d AS (SELECT *, coalesce(lag(lsid) OVER (PARTITION BY vol_id ORDER BY slot), 0) AS before FROM s WHERE slot < (SELECT max(slot) FROM s))
SELECT vol_id, slot + 1 AS hour, lsid, CAST(sum(1 + (lsid - before) // 50) OVER (PARTITION BY vol_id ORDER BY slot) AS bigint) AS gid FROM d""")
def s5_stream_implicit_snapshots(t):
    out, checkpoint = _out(t, "s5")
    _done(jobs.stream_implicit_snapshots(_replay(t, t.log_record, "ev"), out, checkpoint, seconds=3600, max_send=50))
    return t.spark.read.parquet(f"{out}/snapshots").select("vol_id", F.expr("unix_timestamp(ts) div 3600").alias("hour"), "lsid", "gid")


def _checked(t: Inputs) -> str:
    from .functions.checksum import block_sum

    rows = t.log_record_gappy.withColumns({"payload": F.encode(F.expr("repeat(token, cast(blocks as int))"), "UTF-8"), "salt": F.col("vol_id") * 3})
    rows = rows.withColumn("checksum", F.when(F.col("ev") % 83 != 7, block_sum(F.col("payload"), F.col("salt"))).otherwise(-1))
    out, checkpoint = _out(t, "s6")
    _done(jobs.stream_log_check(_replay(t, rows, "ev"), out, checkpoint, pbs=32))
    return out


@query("""WITH g AS (SELECT *, lag(next_lsid) OVER (PARTITION BY vol_id ORDER BY pack_lsid) AS b FROM log_record_gappy)
SELECT vol_id, pack_lsid, 'gap' AS what FROM g WHERE b <> pack_lsid UNION ALL SELECT vol_id, pack_lsid, 'padding' FROM log_record_gappy WHERE is_padding
UNION ALL SELECT vol_id, pack_lsid, 'checksum' FROM log_record_gappy WHERE ev % 83 = 7 AND NOT is_padding AND NOT is_discard""")
def s6_stream_log_check(t):
    return t.spark.read.parquet(f"{_checked(t)}/found").select("vol_id", "pack_lsid", "what")


@query(f"""SELECT vol_id, lsid, CAST(k AS bigint) AS k, {sum_sql('part')} AS sum FROM (
  SELECT vol_id, lsid, k, substring(payload, CAST(k * 32 + 1 AS int), 32) AS part FROM (SELECT *, unnest(range((length(payload) + 31) // 32)) AS k FROM {_DATA.format('log_record_gappy')} WHERE NOT is_padding AND NOT is_discard) x) y""")
def s6_stream_block_sums(t):
    return t.spark.read.parquet(f"{_checked(t)}/sums").select("vol_id", "lsid", "k", "sum")


_SIDES = "SELECT vol_id, ev, CAST(ts AS timestamp) AS ts, CASE WHEN ev % 4 = 1 AND vol_id % 7 <> 3 THEN 'dest' ELSE 'source' END AS node_kind FROM log_record"


@query(f"""WITH s AS ({_SIDES}), w AS (SELECT vol_id, CAST(floor(epoch(ts) / 86400) AS bigint) + 1 AS day, max(ts) FILTER (node_kind = 'source') AS a, max(ts) FILTER (node_kind = 'dest') AS b FROM s GROUP BY 1, 2)
SELECT vol_id, day, CAST(floor(epoch(a)) - floor(epoch(b)) AS bigint) AS ts_delta FROM w WHERE a IS NOT NULL AND day * 86400 <= (SELECT max(epoch(ts)) FROM s)""")
def s7_stream_ts_delta(t):
    """The lag of every interval that is over at the end of the replay."""
    out, checkpoint = _out(t, "s7")
    got = jobs.stream_ts_delta(_replay(t, t.sql(_SIDES), "ev"), late="0 seconds", interval="1 day")
    _done(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    return t.spark.read.parquet(out).select("vol_id", F.expr("unix_timestamp(ts) div 86400").alias("day"), "ts_delta")


_RESULTS = "SELECT concat('d', user_id % 40) AS dst_id, CAST(floor(event_id * 7) AS bigint) AS t, event_id AS n, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'too_new' WHEN 'view' THEN 'stopped' ELSE 'ok' END AS result, CAST(floor(event_id * 7) - (event_id % 9) * 90 AS bigint) AS last_received FROM events"


@query(f"""WITH s AS ({_RESULTS}), k AS (SELECT *, result = 'ok' OR (result <> 'too_new' AND t - last_received > 600) AS ends FROM s),
g AS (SELECT *, CAST(coalesce(sum(CAST(ends AS int)) OVER (PARTITION BY dst_id ORDER BY t, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS run FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY dst_id, run ORDER BY t, n) AS tries FROM g)
SELECT dst_id, t, n, CASE WHEN ends THEN 0.0 ELSE least(60.0, power(2, least(tries, 10) - 1)) END AS delay, CASE WHEN result = 'ok' THEN 'done' WHEN ends THEN 'give_up' ELSE 'retry' END AS what FROM c""".replace("THEN 0.0 ELSE least(60.0,", "THEN CAST(0 AS double) ELSE least(CAST(60 AS double),"))
def s8_stream_retry_state(t):
    """What follows each send; timers, whose rows depend on when they run, are off."""
    out, checkpoint = _out(t, "s8")
    got = jobs.stream_retry_state(_replay(t, t.sql(_RESULTS), "n"), timers=False)
    _done(got.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    return t.spark.read.parquet(out)
