"""Continuous paths as Structured Streaming.

Jobs with tables of their own write everything of a micro-batch under its batch id with
overwrite, and read only what the batch before left; so a retried batch replaces itself and
results are those of exactly one run. Tables `pending`, `state`, `open`, `clock`, `run` and `left` are read by the next batch only, so folders
older than the last two batches may be deleted; the others are results. Late data is judged by gid, not by time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.catalog import merge_meta
from ..operators.changes import compact_log, merge_changes
from ..operators.extent import STRIPE, cut_at_stripes
from ..operators.image import apply_changes
from ..operators.log import log_block_checksums, log_checksum_audit
from ..operators.policy import proxy_send_list
from ..plans.chain import applicable_chain

_KEY = ["vol_id", "b_b", "b_e", "e_b", "e_e"]


class Tables:
    """Tables of a job under ``out``, a folder per micro-batch."""

    def __init__(self, out: str, spark: SparkSession, batch: int):
        self.out, self.spark, self.batch = out, spark, batch

    def before(self, name: str, schema) -> DataFrame:
        """What the batch before left; nothing at first."""
        if self.batch == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.out}/{name}/batch={self.batch - 1}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.out}/{name}/batch={self.batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, Tables], None], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run ``work`` on each micro-batch, which is kept while it is used several times."""

    def run(df: DataFrame, batch: int) -> None:
        kept = df.persist()
        try:
            work(kept, Tables(out, df.sparkSession, batch))
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_compact(log_stream: DataFrame, out: str, checkpoint: str, max_blocks: int = 65_535, max_send: int = 1 << 18, permanent: Callable[[SparkSession], DataFrame] | None = None) -> StreamingQuery:
    """Logs to change sets: tables ``changes`` and ``catalog`` (vol_id, gid_b, gid_e, lsid, ts).

    A transfer spans ``max_send`` physical blocks at most, and each makes a change set with the
    volume's next gid. Records beyond the permanent lsid of their volume (``permanent``:
    vol_id, perm_lsid) wait for a later batch.
    """

    def work(df: DataFrame, t: Tables) -> None:
        rows = t.before("pending", df.schema).unionByName(df)
        if permanent is not None:
            rows = rows.join(permanent(t.spark).select("vol_id", "perm_lsid"), "vol_id", "left").withColumn("waits", F.coalesce(F.col("next_lsid") > F.col("perm_lsid"), F.lit(True)))
        else:
            rows = rows.withColumn("waits", F.lit(False))
        t.write("pending", rows.where("waits").select(*df.columns))
        ready = rows.where("not waits").select(*df.columns)
        begin = ready.groupBy("vol_id").agg(F.min("pack_lsid").alias("begin"))
        ready = ready.join(begin, "vol_id").withColumn("part", F.expr(f"(pack_lsid - begin) div {max_send}")).drop("begin")
        sent = ready.groupBy("vol_id", "part").agg(F.max("next_lsid").alias("lsid"), F.max("ts").alias("ts"))
        gids = t.before("state", "vol_id bigint, gid bigint")
        at = F.coalesce("gid", F.lit(0).cast("long")) + F.row_number().over(Window.partitionBy("vol_id").orderBy("part"))
        sent = sent.join(gids, "vol_id", "left").withColumn("gid_e", at.cast("long")).withColumn("key", F.xxhash64("vol_id", "gid_e"))
        sent = t.write("catalog", sent.select("vol_id", (F.col("gid_e") - 1).alias("gid_b"), "gid_e", "lsid", "ts", "part", "key"))
        keyed = ready.join(sent.select("vol_id", "part", "key"), ["vol_id", "part"]).withColumn("vol_id", F.col("key"))
        changes = compact_log(keyed, max_blocks).withColumnRenamed("vol_id", "key")
        t.write("changes", changes.join(sent.select("key", "vol_id", F.col("gid_e").alias("gid")), "key").drop("key"))
        now = sent.select("vol_id", F.col("gid_e").alias("gid")).unionByName(gids).groupBy("vol_id").agg(F.max("gid").alias("gid"))
        t.write("state", now)

    return each_batch(log_stream, work, out, checkpoint)


def stream_fanout(catalog_stream: DataFrame, changes: DataFrame, destinations: dict[str, str], max_size: int = 128 << 20, max_nr: int = 1000) -> list[StreamingQuery]:
    """One query and checkpoint per destination (name: folder); each batch sends merged diffs in rounds, one a volume in each, until nothing is left to send.

    Tables ``sent`` (the merged diffs, with their round) and ``data`` (their changes). Rounds are as many as the volume
    with most diffs has runs of ``max_nr`` or ``max_size``. ``catalog_stream``: diffs with uuid.
    """

    def work(df: DataFrame, t: Tables) -> None:
        pending = t.before("pending", df.schema).unionByName(df)
        merged: list[DataFrame] = []
        while True:
            at = f"round={len(merged)}"
            run = t.write(f"run/{at}", proxy_send_list(pending, max_size, max_nr))
            if run.isEmpty():
                break
            merged.append(merge_meta(run).withColumn("round", F.lit(len(merged))))
            pending = t.write(f"left/{at}", pending.join(run.select(*_KEY), _KEY, "left_anti"))
        t.write("pending", pending)
        if not merged:
            return
        sent = t.write("sent", reduce(DataFrame.unionByName, merged)).withColumn("key", F.xxhash64("vol_id", "round"))
        own = changes.join(sent.select("vol_id", "b_b", "e_b", "round", "key"), "vol_id").where("gid > b_b and gid <= e_b").drop("b_b", "e_b")
        data = merge_changes(own.withColumn("vol_id", F.col("key"))).withColumnRenamed("vol_id", "key")  # each sent diff by itself
        t.write("data", data.join(sent.select("key", "vol_id", "round"), "key").drop("key"))

    return [each_batch(catalog_stream, work, f"{path}/tables", f"{path}/checkpoint") for path in destinations.values()]


MAX_HELD = 1000


MAX_OUT = 10_000  # verdicts a frame
_BY_GID = ["held", "accepted", "too_old", "not_applicable"]


def judged(gid: int, b: np.ndarray, e: np.ndarray, comp: np.ndarray) -> tuple[int, np.ndarray]:
    """The gid that diffs (start, end, compared), in order of start, lead to, and a place in ``_BY_GID`` for each.

    At a gid the farthest diff that applies is accepted, of equal ones the first; compared diffs that would go farther are not applicable.
    """
    what, n, at = np.zeros(len(b), np.int8), len(b), 0

    def rows(start: int) -> Iterator[tuple[int, int, int, bool]]:
        for k in range(start, n, 1 << 16):
            part = slice(k, k + (1 << 16))
            yield from zip(range(k, n), b[part].tolist(), e[part].tolist(), comp[part].tolist())

    best, best_at, apart = None, -1, []  # apart: compared diffs that don't begin at the gid

    def step() -> bool:
        nonlocal gid, best, best_at
        for rank, k in apart:
            what[k] = 3 if best is None or (rank, -k) > (best, -best_at) else 2
        apart.clear()
        if best is None:
            return False
        what[best_at], gid, best, best_at = 1, best[0], None, -1
        return True

    for at, start, end, compared in rows(0):
        moved = True
        while start > gid and (moved := step()):
            pass
        if not moved:
            break
        what[at] = 2
        if end <= gid:
            continue
        if compared and start < gid:
            apart.append(((end, start), at))
        elif best is None or (end, start) > best:
            best, best_at = (end, start), at
    step()
    what[(what == 0) & (e <= gid)] = 2
    return gid, what


def _accept(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A volume's diffs are held as arrays, 17 bytes each, not as rows; verdicts leave a frame at a time."""
    gid, held = (state.get[0], json.loads(state.get[1])) if state.exists else (None, [])
    names = ["vol_id", "b_b", "e_b", "verdict"]
    arrays = lambda rows: (*(np.array([r[k] for r in rows], np.int64) for k in (0, 1)), np.array([r[2] for r in rows], bool))
    parts = [arrays(held)]
    for pdf in batches:
        out, more = [], []
        for b, e, comp, uuid, size, proxy, start, own_uuid, own_size in pdf[["b_b", "e_b", "is_comp_diff", "uuid", "size", "from_proxy", "base_gid", "base_uuid", "base_size"]].itertuples(index=False, name=None):
            gid = int(start) if gid is None else gid
            if proxy and uuid != own_uuid:
                out.append((key[0], int(b), int(e), "different_uuid"))
            elif own_size < size:
                out.append((key[0], int(b), int(e), "smaller_size"))
            else:
                more.append((int(b), int(e), bool(comp)))
        parts.append(arrays(more))
        if out:
            yield pd.DataFrame(out, columns=names)
    b, e, comp = (np.concatenate(c) for c in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(b, kind="stable")
    b, e, comp = b[order], e[order], comp[order]
    gid, what = judged(gid, b, e, comp)
    left = np.flatnonzero(what == 0)
    left = left[np.lexsort((comp[left], e[left], b[left]))]
    told, late = np.flatnonzero(what), left[MAX_HELD:]
    state.update((gid, json.dumps([[int(b[k]), int(e[k]), bool(comp[k])] for k in left[:MAX_HELD]])))
    for picked in (told, late):
        for k in range(0, len(picked), MAX_OUT):
            own = picked[k : k + MAX_OUT]
            verdict = np.array(_BY_GID, object)[what[own]] if picked is told else "retry"
            yield pd.DataFrame({"vol_id": key[0], "b_b": b[own], "e_b": e[own], "verdict": verdict}, columns=names)


def stream_accept(diff_stream: DataFrame, base: DataFrame) -> DataFrame:
    """Arriving diffs (with uuid, size, from_proxy) with their verdict, from each volume's base (vol_id, gid, uuid, size) on.

    accepted; too_old or not_applicable (dropped); different_uuid (from a proxy; dropped);
    smaller_size (the image is smaller than the source: an error). Diffs that are too new wait, up
    to ``MAX_HELD`` a volume; beyond that their sender is told to retry later, so none is lost.
    """
    own = base.select("vol_id", F.col("gid").alias("base_gid"), F.col("uuid").alias("base_uuid"), F.col("size").alias("base_size"))
    rows = diff_stream.join(own, "vol_id")
    return rows.groupBy("vol_id").applyInPandasWithState(_accept, "vol_id bigint, b_b bigint, e_b bigint, verdict string", "gid bigint, held string", "append", GroupStateTimeout.NoTimeout)


def _stripe() -> Column:
    return F.shiftright("addr", STRIPE.bit_length() - 1).cast("long")


def synced_image(base: DataFrame, out: str, before: int | None = None) -> DataFrame:
    """The image that ``stream_sync_image`` keeps: each stripe of its newest batch, or of the base."""
    spark = base.sparkSession
    touched = spark.read.schema("vol_id bigint, stripe bigint, batch int").parquet(f"{out}/touched")
    blocks = spark.read.schema("vol_id bigint, addr bigint, content string, stripe bigint, batch int").parquet(f"{out}/blocks")
    if before is not None:
        touched, blocks = touched.where(F.col("batch") < before), blocks.where(F.col("batch") < before)
    newest = touched.groupBy("vol_id", "stripe").agg(F.max("batch").alias("batch"))
    own = base.select("vol_id", "addr", "content", _stripe().alias("stripe")).join(newest, ["vol_id", "stripe"], "left_anti")
    return own.select("vol_id", "addr", "content").unionByName(blocks.join(newest, ["vol_id", "stripe", "batch"], "left_semi").select("vol_id", "addr", "content"))


def stream_sync_image(diff_stream: DataFrame, changes: DataFrame, base: DataFrame, state: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """A destination image that follows its source; read it with ``synced_image``.

    Of the diffs at hand those on the chain from each volume's snapshot (``state``: vol_id, b_b,
    b_e) are applied; older ones go, newer ones wait. A batch writes the stripes that it touches and no others.
    """
    kinds = "vol_id bigint, b_b bigint, b_e bigint"

    def work(df: DataFrame, t: Tables) -> None:
        pending = t.before("pending", df.schema).unionByName(df)
        at = t.before("state", kinds) if t.batch else state.select("vol_id", "b_b", "b_e")
        chain = t.write("accepted", applicable_chain(pending, at))
        span = chain.groupBy("vol_id").agg(F.min("b_b").alias("from_gid"), F.max("e_b").alias("to_gid"))
        own = changes.join(span, "vol_id").where("gid > from_gid and gid <= to_gid").drop("from_gid", "to_gid")
        touched = t.write("touched", cut_at_stripes(own.select("vol_id", "addr", "blocks")).select("vol_id", "stripe").distinct())
        image = base if t.batch == 0 else synced_image(base, t.out, t.batch)
        under = image.withColumn("stripe", _stripe()).join(touched, ["vol_id", "stripe"], "left_semi").select("vol_id", "addr", "content")
        t.write("blocks", apply_changes(under, own, "zero").withColumn("stripe", _stripe()))
        end = chain.groupBy("vol_id").agg(F.max_by(F.struct("s_b", "s_e"), "pos").alias("l"))
        now = at.join(end, "vol_id", "left").select("vol_id", F.coalesce("l.s_b", "b_b").alias("b_b"), F.coalesce("l.s_e", "b_e").alias("b_e"))
        now = t.write("state", now)
        gids = now.select("vol_id", F.col("b_b").alias("gid"))
        t.write("pending", pending.join(gids, "vol_id", "left").where("gid is null or e_b > gid").select(*df.columns))

    return each_batch(diff_stream, work, out, checkpoint)


def stream_implicit_snapshots(log_stream: DataFrame, out: str, checkpoint: str, seconds: int = 10, max_send: int = 1 << 18) -> StreamingQuery:
    """Table ``snapshots`` (vol_id, ts, lsid, gid): one at the end of each interval in which a volume's log advanced.

    The clock is the newest time seen in the log, of any volume: an interval ends when it is past.
    Gids follow the ledger's rule, 1 plus the sends that the lsids since the last one need.
    """

    def work(df: DataFrame, t: Tables) -> None:
        kinds = "vol_id bigint, slot bigint, lsid bigint"
        seen = df.select("vol_id", F.floor(F.unix_timestamp("ts") / seconds).alias("slot"), F.col("next_lsid").alias("lsid"))
        slots = seen.unionByName(t.before("open", kinds)).groupBy("vol_id", "slot").agg(F.max("lsid").alias("lsid"))
        clock = t.write("clock", df.agg(F.floor(F.max(F.unix_timestamp("ts")) / seconds).alias("now")).unionByName(t.before("clock", "now bigint")).agg(F.max("now").alias("now")))
        slots = slots.join(F.broadcast(clock), F.lit(True), "left")  # one row: the clock
        last = t.before("state", "vol_id bigint, last bigint, gid bigint")
        w = Window.partitionBy("vol_id").orderBy("slot")
        done = slots.where("slot < now").join(last, "vol_id", "left")
        before = F.greatest(F.coalesce("last", F.lit(0).cast("long")), F.coalesce(F.max("lsid").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
        done = done.withColumn("before", before).where("lsid > before")
        step = F.expr(f"1 + (lsid - before) div {max_send}")
        gid = F.coalesce("gid", F.lit(0).cast("long")) + F.sum(step).over(w)
        snaps = t.write("snapshots", done.select("vol_id", F.timestamp_seconds((F.col("slot") + 1) * seconds).alias("ts"), "lsid", gid.alias("gid")))
        t.write("open", slots.where("now is null or slot >= now").select("vol_id", "slot", "lsid"))
        now = snaps.groupBy("vol_id").agg(F.max("lsid").alias("last"), F.max("gid").alias("gid")).unionByName(last)
        t.write("state", now.groupBy("vol_id").agg(F.max("last").alias("last"), F.max("gid").alias("gid")))

    return each_batch(log_stream, work, out, checkpoint)


def _interval(seconds: int, max_send: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def rule(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lsid, last, gid, due = state.get if state.exists else (0, 0, 0, 0)
        for pdf in batches:
            lsid = max([lsid, *pdf["next_lsid"].tolist()])  # no rows where only the timer calls
        now, out = state.getCurrentProcessingTimeMs(), []
        if due and now >= due:
            if lsid > last:
                gid, last = gid + 1 + (lsid - last) // max_send, lsid
                out.append((key[0], lsid, gid, pd.Timestamp(now, unit="ms")))
            due = 0
        elif not due and lsid > last:
            due = now + seconds * 1000
        state.update((lsid, last, gid, due))
        if due:  # each call sets the timer anew, for what is left of the interval
            state.setTimeoutDuration(max(1, due - now))
        yield pd.DataFrame(out, columns=["vol_id", "lsid", "gid", "ts"])

    return rule


def stream_timed_snapshots(log_stream: DataFrame, seconds: int = 10, max_send: int = 1 << 18) -> DataFrame:
    """(vol_id, lsid, gid, ts): a snapshot at the end of each interval of the clock on the wall in which a volume's log advanced.

    An interval begins with a volume's first record after its last snapshot and ends by a timer, so a
    log that falls quiet gets its snapshot too. Gids follow the ledger's rule. To run with a processing-time trigger.
    """
    kinds = "vol_id bigint, lsid bigint, gid bigint, ts timestamp"
    rows = log_stream.select("vol_id", "next_lsid")
    return rows.groupBy("vol_id").applyInPandasWithState(_interval(seconds, max_send), kinds, "lsid bigint, last bigint, gid bigint, due bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_log_check(log_stream: DataFrame, out: str, checkpoint: str, pbs: int = 512) -> StreamingQuery:
    """Tables ``found`` (vol_id, pack_lsid, what: gap, record, padding, checksum) and ``sums`` (of each physical block).

    A gap is a pack that doesn't begin where the one before it ended, also across batches. A
    record is invalid without blocks, or with an lsid not after its pack's. Needs payload, checksum and salt.
    """

    def work(df: DataFrame, t: Tables) -> None:
        last = t.before("state", "vol_id bigint, at bigint")
        packs = df.groupBy("vol_id", "pack_lsid").agg(F.max("next_lsid").alias("next_lsid")).join(last, "vol_id", "left")
        before = F.coalesce(F.lag("next_lsid").over(Window.partitionBy("vol_id").orderBy("pack_lsid")), F.col("at"))
        what = lambda rows, name: rows.select("vol_id", "pack_lsid", F.lit(name).alias("what"))
        found = what(packs.withColumn("before", before).where("before <> pack_lsid"), "gap")
        found = found.unionByName(what(df.where("(not is_padding and blocks <= 0) or lsid <= pack_lsid"), "record")).unionByName(what(df.where("is_padding"), "padding"))
        found = found.unionByName(what(log_checksum_audit(df, "checksum", salt="salt").where("not ok"), "checksum"))
        t.write("found", found.distinct())
        t.write("sums", log_block_checksums(df, pbs))
        now = packs.select("vol_id", F.col("next_lsid").alias("at")).unionByName(last)
        t.write("state", now.groupBy("vol_id").agg(F.max("at").alias("at")))

    return each_batch(log_stream, work, out, checkpoint)


def stream_ts_delta(snap_stream: DataFrame, late: str = "1 minute", interval: str = "60 seconds") -> DataFrame:
    """(vol_id, ts, source_ts, dest_ts, ts_delta in seconds) at each interval's end: the latest of the two sides that report in it; null lag without a destination."""
    side = lambda kind: F.max(F.when(F.col("node_kind") == kind, F.col("ts")))
    got = snap_stream.withWatermark("ts", late).groupBy("vol_id", F.window("ts", interval)).agg(side("source").alias("source_ts"), side("dest").alias("dest_ts"))
    lag = (F.unix_timestamp("source_ts") - F.unix_timestamp("dest_ts")).cast("long")
    return got.where("source_ts is not null").select("vol_id", F.col("window.end").alias("ts"), "source_ts", "dest_ts", lag.alias("ts_delta"))


FIRST_DELAY, MOST_DELAY, RETRY_TIMEOUT = 1.0, 60.0, 600
_BUSY = ("too_new", "syncing")


def next_delay(delay: float, first: float = FIRST_DELAY, most: float = MOST_DELAY) -> float:
    """The wait before another try: doubling up to ``most``."""
    return min(most, delay * 2) if delay else first


def _retry(timers: bool) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def rule(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        delay, at, n = state.get if state.exists else (0.0, 0, 0)
        out = []
        if state.hasTimedOut:  # the wait is over: send again
            out.append((key[0], at + int(delay), n, delay, "due"))
        else:
            rows = sorted((r for pdf in batches for r in pdf[["t", "n", "result", "last_received"]].itertuples(index=False, name=None)), key=lambda r: r[:2])
            for t, k, result, received in rows:
                at, n = int(t), int(k)
                if result == "ok":
                    delay, what = 0.0, "done"
                elif result not in _BUSY and received == received and received is not None and at - int(received) > RETRY_TIMEOUT:
                    delay, what = 0.0, "give_up"
                else:
                    delay, what = next_delay(delay), "retry"
                out.append((key[0], at, n, delay, what))
            state.update((delay, at, n))
            if timers and delay:
                state.setTimeoutDuration(int(delay * 1000))
        yield pd.DataFrame(out, columns=["dst_id", "t", "n", "delay", "what"])

    return rule


def stream_retry_state(sends: DataFrame, timers: bool = True) -> DataFrame:
    """Per destination what follows each send (t in seconds, n in order, result, last_received in seconds): done, retry after ``delay``, or give_up.

    It gives up when nothing was received for ``RETRY_TIMEOUT`` seconds, but never where the
    destination is only busy or behind. ``timers`` add a row ``due`` when a delay is over; such a
    query runs on and on, so a replay that shall end goes without.
    """
    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return sends.groupBy("dst_id").applyInPandasWithState(_retry(timers), "dst_id string, t bigint, n bigint, delay double, what string", "delay double, at bigint, n bigint", "append", timeout)
