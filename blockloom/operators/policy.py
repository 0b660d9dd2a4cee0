"""Maintenance planning: what to apply, merge or replicate next.

Candidates come with what they are ordered by and aren't numbered, so no volume waits for
all others to be sorted; ``next_task`` takes the first by partial minima.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chain import applicable_chain
from ..plans.scan import scan_sorted
from .catalog import applicable_mergeable_chain, mergeable_chain, truncate_by_size
from .changes import cut_at_uuid_change


def retention_target(restorables: DataFrame, limit: str) -> DataFrame:
    """The newest restorable (vol_id, pos, gid, ts) not after ``limit``, before the first newer one; the first entry never counts."""
    w = Window.partitionBy("vol_id").orderBy("pos")
    rows = restorables.withColumn("rank", F.row_number().over(w)).where("rank > 1")
    rows = rows.withColumn("new", F.max((F.col("ts") > F.lit(limit).cast("timestamp")).cast("int")).over(w)).where("new = 0")
    return rows.groupBy("vol_id").agg(F.max_by("gid", "pos").alias("gid"))


def _merge_run(max_size: int, max_nr: int) -> Callable[[], Callable[[tuple | None], list[tuple]]]:
    """The best run of one volume's chain, row by row: (vol_id, pos, b_b, e_b, mergeable, comp, size, protected)."""

    def make() -> Callable[[tuple | None], list[tuple]]:
        vol, first, last, total, n, best = None, None, None, 0, 0, None

        def rule(row: tuple | None) -> list[tuple]:
            nonlocal vol, first, last, total, n, best
            if row is None:
                return [] if best is None else [(vol, *best[1:])]
            vol, _, b, e, mergeable, comp, size, protected = row
            can = not comp and size <= max_size
            if first is not None:
                inside = protected is not None and protected > first  # the greatest protected gid before this diff's end
                total += size
                if mergeable and can and not inside and total <= max_size and n <= max_nr:
                    n, last = n + 1, e
                    return []
                if n >= 2 and (best is None or total // n < best[0]):
                    best = (total // n, first, last, n, total // n)
                first = None
            if can:
                first, last, total, n = b, e, size, 1
            return []

        return rule

    return make


def best_merge_range(chain: DataFrame, protected: DataFrame, max_size: int, max_nr: int) -> DataFrame:
    """Per volume the run of two or more diffs of least average size: (vol_id, gid_b, gid_e, n, average).

    A run's first diff isn't compared and the others are mergeable as well; each and all together
    are within ``max_size``, and no protected gid lies strictly inside. After a run the next
    begins at the diff that ended it. The size of that diff counts in the average (a whole
    number), the number is tested before a diff is counted, and a run that reaches the end of the
    list doesn't count: these are the rules of the tool that users know.
    """
    marks = protected.select("vol_id", F.col("gid").alias("at"), F.col("gid").alias("mark"), F.lit(1).alias("kind")).where("mark is not null").distinct()
    rows = chain.select("vol_id", F.col("e_b").alias("at"), F.lit(None).cast("long").alias("mark"), F.lit(0).alias("kind"), "pos", "b_b", "e_b", "is_mergeable", "is_comp_diff", "data_size")
    w = Window.partitionBy("vol_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True).withColumn("protected", F.max("mark").over(w)).where("kind = 0")
    return scan_sorted(both.select("vol_id", "pos", "b_b", "e_b", "is_mergeable", "is_comp_diff", "data_size", "protected"), ["vol_id"], ["pos"], _merge_run(max_size, max_nr), "vol_id bigint, gid_b bigint, gid_e bigint, n bigint, average bigint")


def replication_target(chain: DataFrame, dest: DataFrame, max_size: int) -> DataFrame:
    """(vol_id, stop_gid) to replicate to: from the diff before the first that begins after a destination's gid to the one that passes the size.

    At least one diff beyond the first goes; without a size, or where nothing begins after the
    gid, there is no stop.
    """
    if max_size == 0:
        return chain.where("false").select("vol_id", F.col("e_b").alias("stop_gid"))
    w = Window.partitionBy("vol_id").orderBy("pos")
    rows = chain.join(dest.select("vol_id", "gid"), "vol_id").withColumn("next_b", F.lead("b_b").over(w))
    begun = F.max((F.col("next_b") > F.col("gid")).cast("int")).over(w)
    rows = rows.withColumn("begun", F.coalesce(begun, F.lit(0))).where("begun = 1")
    rows = rows.withColumns({"rank": F.row_number().over(w), "upto": F.sum("data_size").over(w), "before": F.sum("data_size").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    taken = rows.where(f"rank <= 2 or before <= {max_size}")
    # The diff that passes the size is the last; of a first one that does so alone, the next still goes.
    return taken.groupBy("vol_id").agg(F.max_by("e_b", "pos").alias("stop_gid"), F.max("rank").alias("n")).where("n > 1").drop("n")


def _waited(last: str, now: str, seconds: int) -> Column:
    """Whether ``seconds`` have passed since ``last``, or there was none."""
    due = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(last) >= seconds
    return F.coalesce(due, F.lit(True))


def apply_candidates(base: DataFrame, retention: DataFrame, diffs: DataFrame, last_applied: DataFrame, now: str, interval: int) -> DataFrame:
    """(priority, vol_id, gid, size): interrupted applies (1) to their end; else (2) up to the retention gid, where ``interval`` seconds have passed.

    ``size`` is that of the diffs that begin before the gid; of priority 2 the largest comes first.
    """
    first = base.where("is_applying").select(F.lit(1).alias("priority"), "vol_id", F.col("e_b").alias("gid"), F.lit(0).cast("long").alias("size"))
    due = retention.select("vol_id", "gid").join(last_applied.select("vol_id", F.col("ts").alias("last")), "vol_id", "left")
    due = due.where(_waited("last", now, interval) if interval > 0 else F.lit(True)).select("vol_id", "gid")
    sizes = diffs.select(F.col("vol_id").alias("v"), "b_b", "data_size")
    sized = due.join(sizes, (F.col("vol_id") == F.col("v")) & (F.col("b_b") < F.col("gid")), "left").groupBy("vol_id", "gid").agg(F.coalesce(F.sum("data_size"), F.lit(0)).cast("long").alias("size"))
    return first.unionByName(sized.select(F.lit(2).alias("priority"), "vol_id", "gid", "size"))


def merge_candidates(totals: DataFrame, last_merged: DataFrame, now: str, threshold: int, interval: int) -> DataFrame:
    """(priority, vol_id, n_diffs): volumes of at least ``threshold`` diffs (3), and those where ``interval`` seconds have passed (5); most diffs come first."""
    many = totals.where(F.col("n_diffs") >= threshold).select(F.lit(3).alias("priority"), "vol_id", "n_diffs")
    due = totals.join(last_merged.select("vol_id", F.col("ts").alias("last")), "vol_id", "left").where(_waited("last", now, interval))
    return many.unionByName(due.select(F.lit(5).alias("priority"), "vol_id", "n_diffs"))


def replication_candidates(latest: DataFrame, remote: DataFrame, servers: DataFrame, active: DataFrame, last_done: DataFrame, now: str, disabled: DataFrame) -> DataFrame:
    """(vol_id, dst_id, gid, dest_gid, last): enabled servers whose copy differs, active on both ends, after the server's interval; the oldest run comes first, none before all.

    ``servers``: dst_id, enabled, interval (seconds); ``active``: vol_id, node (``source`` or a dst_id);
    ``last_done``: vol_id, dst_id, ts; ``disabled``: vol_id.
    """
    got = latest.select("vol_id", F.col("gid_b").alias("gid")).join(remote.select("vol_id", "dst_id", F.col("gid").alias("dest_gid")), "vol_id")
    got = got.join(servers.where("enabled").select("dst_id", "interval"), "dst_id").join(disabled.select("vol_id"), "vol_id", "left_anti")
    got = got.join(active.where("node = 'source'").select("vol_id"), "vol_id", "left_semi")
    got = got.join(active.select("vol_id", F.col("node").alias("dst_id")), ["vol_id", "dst_id"], "left_semi")
    got = got.join(last_done.select("vol_id", "dst_id", F.col("ts").alias("last")), ["vol_id", "dst_id"], "left")
    due = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last") >= F.col("interval")
    return got.where(F.coalesce(due, F.lit(True))).where("gid <> dest_gid").select("vol_id", "dst_id", "gid", "dest_gid", "last")


def next_task(applies: DataFrame, merges: DataFrame, ranges: DataFrame, replications: DataFrame, targets: DataFrame) -> DataFrame:
    """The one task to do now: (priority, task, vol_id, dst_id, gid_b, gid_e), or none.

    Steps in order: interrupted apply, apply of the largest, merge of the most diffs, oldest
    replication, merge after its interval. A merge step looks at its first volume only: where
    that has no range in ``ranges``, the step gives no task.
    """
    null = lambda t: F.lit(None).cast(t)
    first = lambda df, by, *cols: df.agg(F.min_by(F.struct(*cols), F.struct(*by)).alias("t")).select("t.*")
    steps = []
    for n, by in ((1, ("vol_id",)), (2, (-F.col("size"), -F.col("vol_id")))):
        t = first(applies.where(f"priority = {n}"), by, "vol_id", "gid")
        steps.append(t.select(F.lit(n).alias("priority"), F.lit("apply").alias("task"), "vol_id", null("string").alias("dst_id"), null("long").alias("gid_b"), F.col("gid").alias("gid_e")))
    for n in (3, 5):
        t = first(merges.where(f"priority = {n}"), (-F.col("n_diffs"), "vol_id"), "vol_id").join(ranges.select("vol_id", "gid_b", "gid_e"), "vol_id")
        steps.append(t.select(F.lit(n).alias("priority"), F.lit("merge").alias("task"), "vol_id", null("string").alias("dst_id"), "gid_b", "gid_e"))
    t = first(replications, (F.coalesce("last", F.lit("1970-01-01").cast("timestamp")), "vol_id", "dst_id"), "vol_id", "dst_id").join(targets.select("vol_id", "stop_gid"), "vol_id", "left")
    steps.append(t.select(F.lit(4).alias("priority"), F.lit("replicate").alias("task"), "vol_id", "dst_id", null("long").alias("gid_b"), F.col("stop_gid").alias("gid_e")))
    every = steps[0]
    for s in steps[1:]:
        every = every.unionByName(s)
    every = every.where("vol_id is not null")
    names = every.columns
    return every.agg(F.min_by(F.struct(*names), "priority").alias("t")).where("t is not null").select("t.*")


def replication_mode(latest: DataFrame, remote: DataFrame, base: DataFrame, diffs: DataFrame, by_size: bool, least: int) -> DataFrame:
    """(vol_id, mode) of each destination: none, hash, diff, or error where diffs don't lead from it to the source's latest snapshot.

    none: it has all. hash: it is older than the base. Else by size: diff if the diffs on the way
    hold more than ``least`` bytes (or that is 0); by gid: diff if the first of them begins before ``least``.
    """
    got = latest.select("vol_id", F.col("gid_b").alias("gid")).join(remote.select("vol_id", F.col("gid").alias("dest_gid")), "vol_id").join(base.select("vol_id", F.col("b_b").alias("base_gid")), "vol_id")
    start = remote.select("vol_id", F.col("gid").alias("b_b"), F.col("gid").alias("b_e"))
    way = applicable_chain(diffs, start).join(latest.select("vol_id", F.col("gid_b").alias("gid")), "vol_id").where("s_b <= gid")
    way = way.groupBy("vol_id").agg(F.max("s_b").alias("end"), F.sum("data_size").alias("total"), F.min_by("b_b", "pos").alias("first_b"))
    got = got.join(way, "vol_id", "left")
    enough = (F.lit(least == 0) | (F.col("total") > least)) if by_size else F.col("first_b") < least
    mode = F.when(F.col("dest_gid") >= F.col("gid"), "none").when(F.col("dest_gid") < F.col("base_gid"), "hash")
    mode = mode.when(~F.coalesce(F.col("end") == F.col("gid"), F.lit(False)), "error").when(enough, "diff").otherwise("none")
    return got.select("vol_id", mode.alias("mode"))


def send_list(diffs: DataFrame, dest: DataFrame, max_size: int, max_nr: int) -> DataFrame:
    """Diffs to send next to each destination (vol_id, b_b, b_e: its snapshot): the mergeable head of the chain from there, within size and number."""
    return truncate_by_size(applicable_mergeable_chain(diffs, dest), max_size, max_nr)


def send_single(diffs: DataFrame, dest: DataFrame) -> DataFrame:
    """The one diff to send next to each destination when diffs aren't merged."""
    return applicable_chain(diffs, dest).where("pos = 1")


def proxy_send_list(diffs: DataFrame, max_size: int, max_nr: int, uuid: str = "uuid") -> DataFrame:
    """Diffs that a proxy sends next: the mergeable run from its first one, within size and number, cut where ``uuid`` changes."""
    run = truncate_by_size(mergeable_chain(diffs, 0), max_size, max_nr)
    keys = ["vol_id", "b_b", "b_e", "e_b", "e_e"]
    return cut_at_uuid_change(run.join(diffs.select(*keys, F.col(uuid).alias("uuid")), keys))
