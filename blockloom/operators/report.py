"""Reports and aggregations."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chain import applicable_chain
from ..plans.scan import scan_sorted
from .ledger import ledger_bounds


def archive_status(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """Base, latest gid, restorable snapshots (explicit and all), diffs and their size of each volume. The chain is walked once."""
    totals = diffs.groupBy("vol_id").agg(F.count("*").alias("n_diffs"), F.sum("data_size").cast("long").alias("total_size"))
    w = Window.partitionBy("vol_id").orderBy("pos")
    chain = applicable_chain(diffs, base).withColumns({"explicit": ~F.coalesce(F.lead("is_mergeable").over(w), F.lit(False)), "clean": F.col("s_b") == F.col("s_e")})
    walked = chain.groupBy("vol_id").agg(F.max_by("s_b", "pos").alias("latest_gid"), F.count_if(F.col("clean") & F.col("explicit")).alias("explicit"), F.count_if("clean").alias("clean"))
    got = base.select("vol_id", F.col("b_b").alias("base_gid"), (~F.col("is_applying") & (F.col("b_b") == F.col("b_e"))).cast("long").alias("base_clean"))
    got = got.join(walked, "vol_id", "left").join(totals, "vol_id", "left").fillna(0, ["n_diffs", "total_size", "explicit", "clean"])
    return got.select(
        "vol_id", "base_gid", F.coalesce("latest_gid", "base_gid").alias("latest_gid"), "n_diffs", "total_size",
        (F.col("explicit") + F.col("base_clean")).alias("n_restorable"), (F.col("clean") + F.col("base_clean")).alias("n_clean"),
    )


def storage_status(ledger: DataFrame, log: DataFrame, capacity: int) -> DataFrame:
    ends = log.groupBy("vol_id").agg(F.max("next_lsid").alias("end_lsid"))
    oldest = ledger.groupBy("vol_id").agg(F.min("lsid").alias("oldest_lsid"))
    got = ledger_bounds(ledger).join(ends, "vol_id").join(oldest, "vol_id")
    return got.withColumn("used", F.col("end_lsid") - F.col("oldest_lsid")).withColumn("capacity", F.lit(capacity).cast("long"))


def proxy_status(pending: DataFrame, now: str) -> DataFrame:
    """Pending diffs per (vol_id, dst_id): number, size, delay of the oldest, latest gid."""
    delay = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.min("ts"))
    return pending.groupBy("vol_id", "dst_id").agg(F.count("*").alias("n_pending"), F.sum("data_size").cast("long").alias("size"), delay.cast("long").alias("delay"), F.max("e_b").alias("latest_gid"))


def ts_delta(source: DataFrame, dest: DataFrame) -> DataFrame:
    """Source against destination of each volume; without a destination the lag is null."""
    d = dest.select("vol_id", "dst_id", F.col("gid").alias("dest_gid"), F.col("ts").alias("dest_ts"))
    got = source.select("vol_id", F.col("gid_b").alias("gid"), "ts").join(d, "vol_id", "left")
    return got.withColumn("ts_delta", (F.unix_timestamp("ts") - F.unix_timestamp("dest_ts")).cast("long"))


def log_usage(status: DataFrame) -> DataFrame:
    return status.select("vol_id", (F.col("used") * 100.0 / F.col("capacity")).alias("usage"), (F.col("used") > F.col("capacity")).alias("overflow"))


def handler_stats(calls: DataFrame) -> DataFrame:
    return calls.groupBy("protocol", "client_id").agg(F.count("*").alias("n_calls"), F.sum("latency").alias("latency_sum"), F.avg("latency").alias("latency_mean"))


def running_actions(actions: DataFrame) -> DataFrame:
    return actions.groupBy("vol_id", "action").agg(F.count_if(~F.col("is_finished")).alias("n_running"), F.max("bgn_time").alias("last_begin"))


def idle_volumes(actions: DataFrame) -> DataFrame:
    return actions.groupBy("vol_id").agg(F.count_if(~F.col("is_finished")).alias("n")).where("n = 0").select("vol_id")


def base_all(base: DataFrame) -> DataFrame:
    """State lines: ``<|b|>`` or ``<|b|-->|e|>`` while applying."""
    snap = lambda b, e: F.when(F.col(b) == F.col(e), F.concat(F.lit("|"), b, F.lit("|"))).otherwise(F.concat(F.lit("|"), b, F.lit(","), e, F.lit("|")))
    end = F.when(F.col("is_applying"), F.concat(F.lit("-->|"), "e_b", F.lit("|"))).otherwise("")
    return base.select("vol_id", F.concat(F.lit("<"), snap("b_b", "b_e"), end, F.lit(">")).alias("state"))


def _sliding(seconds: int) -> Callable[[], Callable[[tuple | None], list[tuple]]]:
    """The rule of one key, rows (key, t, value) by t: with each row the window's sum and least value and its first t. It holds the window's distinct times."""

    def make() -> Callable[[tuple | None], list[tuple]]:
        window: deque[tuple] = deque()  # (t, sum, how many aren't null)
        lows: deque[tuple] = deque()  # (t, least), rising
        peers: list[tuple] = []
        total, n = 0, 0

        def done() -> list[tuple]:
            nonlocal total, n
            if not peers or peers[0][1] is None:  # a row without a time has no window
                out = [(*r, None, None, None) for r in peers]
                peers.clear()
                return out
            at, some = peers[0][1], [r[2] for r in peers if r[2] is not None]
            window.append((at, sum(some), len(some)))
            total, n = total + sum(some), n + len(some)
            while window[0][0] < at - seconds:
                _, gone, less = window.popleft()
                total, n = total - gone, n - less
            while lows and (lows[0][0] < at - seconds):
                lows.popleft()
            if some:
                while lows and lows[-1][1] >= min(some):
                    lows.pop()
                lows.append((at, min(some)))
            out = [(*r, total if n else None, lows[0][1] if lows else None, window[0][0]) for r in peers]
            peers.clear()
            return out

        def rule(row: tuple | None) -> list[tuple]:
            out = done() if row is None or (peers and row[1] != peers[0][1]) else []
            if row is not None:
                peers.append(row)
            return out

        return rule

    return make


def _windows(rows: DataFrame, value: str, seconds: int) -> DataFrame:
    """(key, t, value, total, least, span) of the last ``seconds`` up to each row, those of equal t included; each row enters and leaves its window once."""
    key, t = rows.schema["key"].dataType.simpleString(), rows.schema["t"].dataType
    own = rows.select("key", F.col("t").cast("long").alias("t"), F.col(value).cast("long").alias("value"))
    got = scan_sorted(own, ["key"], ["t"], _sliding(seconds), f"key {key}, t bigint, value bigint, total bigint, least bigint, first bigint")
    span = F.col("t") - F.col("first")
    return got.withColumn("span", F.when(span == 0, 1).otherwise(span)).withColumn("t", F.col("t").cast(t))


def moving_bps(transfers: DataFrame, seconds: int) -> DataFrame:
    """Bits per second of each key over the last ``seconds``, by rows (key, t in seconds, bytes; whole numbers)."""
    return _windows(transfers, "bytes", seconds).select("key", "t", (F.col("total") * 8 / F.col("span")).alias("bps"))


def progress_rate(progress: DataFrame, seconds: int = 1) -> DataFrame:
    """Blocks per second of rows (key, t, position; whole numbers) against the least position of the window."""
    return _windows(progress, "position", seconds).select("key", "t", ((F.col("value") - F.col("least")) / F.col("span")).alias("rate"))
