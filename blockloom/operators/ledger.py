"""The snapshot ledger at the log side: rows (vol_id, lsid, gid, is_mergeable, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BY_GID = lambda: Window.partitionBy("vol_id").orderBy("gid")


def take_snapshots(ledger: DataFrame, max_send: int) -> DataFrame:
    """Gids of snapshots taken in lsid order: each is the one before plus 1 plus the sends that its lsids need."""
    w = Window.partitionBy("vol_id").orderBy("lsid", "gid")
    step = F.coalesce(F.expr(f"1 + (lsid - prev) div {max_send}"), F.lit(0))
    got = ledger.withColumn("prev", F.lag("lsid").over(w)).withColumn("step", step)
    return got.select("vol_id", "lsid", F.sum("step").over(w).cast("long").alias("new_gid"))


def transfer_window(ledger: DataFrame, max_send: int, permanent: DataFrame) -> DataFrame:
    """The next transfer of each volume, from its done record (its oldest row) on.

    It ends at the oldest pending row, or goes on over mergeable ends while the next row is
    within the size and the permanent lsid. ``lsid_limit`` cuts it at the size, but for a single
    row one gid on, which can't be cut.
    """
    w = _BY_GID()
    rows = ledger.join(permanent.select("vol_id", "perm_lsid"), "vol_id").withColumn("rn", F.row_number().over(w))
    done = {f"{c}_b": F.first(c).over(w) for c in ("lsid", "gid", "is_mergeable", "ts")}
    rows = rows.withColumns({**done, "end_before": F.lag("is_mergeable").over(w)}).where("rn > 1")
    may = F.col("end_before") & (F.col("lsid") <= F.col("lsid_b") + max_send) & (F.col("lsid") <= F.col("perm_lsid"))
    rows = rows.withColumn("may", F.min(((F.col("rn") == 2) | may).cast("int")).over(w)).where("may = 1")
    own = ("lsid", "gid", "is_mergeable", "ts", "perm_lsid", *done)
    last = rows.groupBy("vol_id").agg(F.max_by(F.struct(*own), "gid").alias("l"), F.count("*").alias("n")).select("vol_id", "l.*", "n")
    whole = (F.col("n") == 1) & (F.col("gid") == F.col("gid_b") + 1)
    limit = F.when(whole, F.col("lsid")).otherwise(F.least(F.col("lsid"), F.col("lsid_b") + max_send))
    return last.withColumn("lsid_limit", limit).drop("n").withColumn("later", F.col("perm_lsid") < F.col("lsid_limit"))


def transfer_meta(windows: DataFrame) -> DataFrame:
    """The diff that a transfer makes; a partial one ends at the gid after its start. It is mergeable if its start is."""
    part = F.col("lsid_limit") < F.col("lsid")
    return windows.select("vol_id", F.col("gid_b").alias("b_b"), F.when(part, F.col("gid_b") + 1).otherwise(F.col("gid")).alias("e_b"), part.alias("is_partial"), F.col("is_mergeable_b").alias("is_mergeable"), "ts")


def finish_transfer(ledger: DataFrame, windows: DataFrame) -> DataFrame:
    """The ledger after the transfers: the new done record of each (of a partial one it keeps the old time) and the rows beyond it."""
    part = F.col("lsid_limit") < F.col("lsid")
    done = windows.select(
        "vol_id", F.col("lsid_limit").alias("lsid"), F.when(part, F.col("gid_b") + 1).otherwise(F.col("gid")).alias("gid"),
        F.when(part, True).otherwise(F.col("is_mergeable")).alias("is_mergeable"), F.when(part, F.col("ts_b")).otherwise(F.col("ts")).alias("ts"),
    )
    at = done.select(F.col("vol_id").alias("v"), F.col("lsid").alias("done_lsid"), F.col("gid").alias("done_gid"))
    left = ledger.join(at, F.col("vol_id") == F.col("v"), "left").where("done_gid is null or lsid > done_lsid or (lsid = done_lsid and gid > done_gid)")
    return left.select(*done.columns).unionByName(done)


def transfer_backlog(ledger: DataFrame, current: DataFrame, pbs: int = 512) -> DataFrame:
    """Snapshots waiting, whether a transfer is needed, and MiB of log (begun ones count) from each volume's done record to its log's end."""
    got = ledger.groupBy("vol_id").agg(F.min("lsid").alias("lsid_b"), (F.count("*") - 1).alias("waiting"))
    got = got.join(current.select("vol_id", "end_lsid"), "vol_id")
    behind = F.col("lsid_b") < F.col("end_lsid")
    mb = F.when(behind, F.expr(f"(end_lsid - lsid_b) * {pbs} div 1048576 + 1")).otherwise(0)
    return got.select("vol_id", "waiting", (behind | (F.col("waiting") > 0)).alias("now"), mb.cast("long").alias("remaining_mb"))


def transfer_needed(ledger: DataFrame, lsids: DataFrame, pbs: int = 512) -> DataFrame:
    """Whether each volume needs a transfer now and later, and its MiB (begun ones count): now up to the permanent lsid, later up to the latest (``lsids``: vol_id, permanent_lsid, latest_lsid). Snapshots waiting need both."""
    now = transfer_backlog(ledger, lsids.select("vol_id", F.col("permanent_lsid").alias("end_lsid")), pbs)
    later = transfer_backlog(ledger, lsids.select("vol_id", F.col("latest_lsid").alias("end_lsid")), pbs)
    later = later.select("vol_id", F.col("now").alias("later"), F.col("remaining_mb").alias("later_mb"))
    return now.join(later, "vol_id").select("vol_id", "waiting", "now", "remaining_mb", "later", "later_mb")


def ledger_bounds(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("vol_id").agg(F.min("gid").alias("gid_b"), F.max("gid").alias("gid_e"), F.max_by("lsid", "gid").alias("latest_lsid"))
