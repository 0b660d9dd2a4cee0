"""Operators over change sets. A block k of a normal record has content ``token:k``; a token stands for the payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .extent import covered, cut_at_stripes, cut_from_start, joined_runs, latest_wins, split_aligned


def block_content(token: str = "token", k: Column | None = None) -> Column:
    return F.concat(F.col(token), F.lit(":"), (F.col("k") if k is None else k).cast("string"))


def log_to_changes(records: DataFrame) -> DataFrame:
    """Padding goes; a record is Discard, Allzero (whole payload zero) or Normal."""
    kind = F.when(F.col("is_discard"), "Discard").when(F.col("token") == "Z", "Allzero").otherwise("Normal")
    return records.where(~F.col("is_padding")).withColumn("rec_type", kind)


def changes_at(changes: DataFrame, addr: int) -> DataFrame:
    return changes.where((F.col("addr") <= addr) & (F.lit(addr) < F.col("addr") + F.col("blocks")))


def change_stats(changes: DataFrame, by: list[str]) -> DataFrame:
    """Records and blocks by kind, and data blocks; sums that merge."""
    cols = []
    for kind in ("Normal", "Allzero", "Discard"):
        own = F.col("rec_type") == kind
        cols += [F.count_if(own).alias(f"n_{kind.lower()}"), F.coalesce(F.sum(F.when(own, F.col("blocks"))), F.lit(0)).cast("long").alias(f"{kind.lower()}_blocks")]
    return changes.groupBy(*by).agg(*cols)


def in_window(changes: DataFrame, addr: int, blocks: int) -> DataFrame:
    """The changes that touch an address range."""
    return changes.where((F.col("addr") < addr + blocks) & (F.col("addr") + F.col("blocks") > addr))


def merged_dump(changes: DataFrame, addr: int, blocks: int) -> DataFrame:
    """An address range of change sets (gid) block by block as merged; only changes that touch it are merged."""
    return change_dump(merge_changes(in_window(changes, addr, blocks)), addr, blocks)


def change_dump(changes: DataFrame, addr: int, blocks: int) -> DataFrame:
    """An address range block by block; Discard and Allzero give '0'. Expects disjoint changes."""
    hit = in_window(changes, addr, blocks)
    lo, hi = F.greatest("addr", F.lit(addr)), F.least(F.col("addr") + F.col("blocks"), F.lit(addr + blocks))
    rows = hit.withColumn("block", F.explode(F.sequence(lo, hi - 1)))
    off = F.col("off") if "off" in changes.columns else F.lit(0)
    content = F.when(F.col("rec_type") == "Normal", block_content(k=F.col("block") - F.col("addr") + off)).otherwise("0")
    return rows.select("vol_id", "block", content.alias("content"))


def split_max(changes: DataFrame, n: int) -> DataFrame:
    """Extents of at most ``n`` blocks, cut from their own start, with ``off``."""
    return cut_from_start(changes.withColumn("off", F.lit(0).cast("long")), n)


def order_key(major: str = "gid", minor: str = "lsid") -> Column:
    """One order over change sets and the records in them, without a sort. A minor from 2**40 on, or a major from 2**23 on, is an error."""
    fits = (F.col(minor) < (1 << 40)) & (F.col(minor) >= 0) & (F.col(major) < (1 << 23)) & (F.col(major) >= 0)
    key = F.shiftleft(F.col(major).cast("long"), 40) + F.col(minor)
    return F.when(fits, key).otherwise(F.raise_error(F.lit(f"{major} or {minor} is too large to order by")))


def winners(changes: DataFrame) -> DataFrame:
    """Disjoint surviving runs with rec_type, token and ``off``; ``seq`` orders the changes. Runs are found without payload, which is joined after."""
    return with_payload(latest_wins(changes), changes)


def with_payload(runs: DataFrame, changes: DataFrame) -> DataFrame:
    return runs.join(changes.select("vol_id", "seq", "rec_type", "token"), ["vol_id", "seq"])


def compact_log(records: DataFrame, max_blocks: int = 65_535, layout: str = "fragment") -> DataFrame:
    """A log as a change set: later records win. ``seq`` is the record's event number."""
    changes = log_to_changes(records).withColumn("seq", F.col("ev").cast("long"))
    runs = with_payload(latest_wins(changes), changes)
    if layout == "aligned":
        start = F.col("addr") - F.col("off")
        cut = split_aligned(runs.withColumn("start", start), max_blocks)
        return cut.withColumn("off", F.col("addr") - F.col("start")).drop("start")
    return cut_from_start(runs, max_blocks)


def merge_changes(changes: DataFrame, max_blocks: int = 65_535) -> DataFrame:
    """Change sets (gid) merged, the newest record winning."""
    return cut_from_start(winners(changes.withColumn("seq", order_key())), max_blocks)


def check_uuid(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("vol_id").agg(F.count_distinct("uuid").alias("n_uuid")).withColumn("ok", F.col("n_uuid") <= 1)


def cut_at_uuid_change(diffs: DataFrame, order: str = "pos") -> DataFrame:
    """The head of each volume's list that has the uuid of its first entry."""
    w = Window.partitionBy("vol_id").orderBy(order)
    same = (F.col("uuid") == F.first("uuid").over(w)).cast("int")
    return diffs.withColumn("same", same).withColumn("same", F.min("same").over(w)).where("same = 1").drop("same")


def assert_disjoint(changes: DataFrame, by: list[str]) -> DataFrame:
    """Number of records per group that begin before an earlier one ends."""
    w = Window.partitionBy(*by).orderBy("addr").rowsBetween(Window.unboundedPreceding, -1)
    bad = F.col("addr") < F.max(F.col("addr") + F.col("blocks")).over(w)
    return changes.withColumn("bad", F.coalesce(bad, F.lit(False))).groupBy(*by).agg(F.count_if("bad").alias("violations"))


def changes_minus(left: DataFrame, right: DataFrame) -> DataFrame:
    """The parts of ``left`` that no extent of ``right`` covers: (vol_id, seq, addr, blocks, off).

    ``right`` is first reduced to the disjoint ranges that it covers, so an extent meets each
    hole once, however often it was written.
    """
    from .extent import overlap_join

    cut = cut_at_stripes(left.select("vol_id", "seq", "addr", "blocks"))
    over = overlap_join(left, covered(right).withColumn("seq", F.lit(0).cast("long"))).select("vol_id", "l_seq", "addr", "blocks")
    holes = cut_at_stripes(over).select(F.col("vol_id").alias("v"), F.col("l_seq").alias("s"), F.col("stripe").alias("t"), F.col("addr").alias("a"), F.col("blocks").alias("n"))
    # Between holes, in order of address: from the end of one to the start of the next.
    edges = cut.select("vol_id", "seq", "stripe", "addr", F.lit(0).cast("long").alias("blocks"), F.lit(0).alias("kind"))
    edges = edges.unionByName(holes.select(F.col("v").alias("vol_id"), F.col("s").alias("seq"), F.col("t").alias("stripe"), F.col("a").alias("addr"), F.col("n").alias("blocks"), F.lit(1).alias("kind")))
    ends = cut.select("vol_id", "seq", "stripe", (F.col("addr") + F.col("blocks")).alias("addr"), F.lit(0).cast("long").alias("blocks"), F.lit(2).alias("kind"))
    edges = edges.unionByName(ends)
    w = Window.partitionBy("vol_id", "seq", "stripe").orderBy("addr", "kind")
    free = edges.withColumn("from", F.lag(F.col("addr") + F.col("blocks")).over(w)).where("addr > from")
    starts = left.select("vol_id", "seq", F.col("addr").alias("a0"))
    parts = free.join(starts, ["vol_id", "seq"]).select("vol_id", "seq", F.col("from").alias("addr"), (F.col("addr") - F.col("from")).alias("blocks"), (F.col("from") - F.col("a0")).alias("off"))
    return joined_runs(parts).select("vol_id", "seq", "addr", "blocks", "off")


def image_to_changes(image: DataFrame, io_blocks: int) -> DataFrame:
    """A full image as Normal records of ``io_blocks`` blocks; an absent block is '0'."""
    chunk = F.floor(F.col("addr") / io_blocks)
    got = image.groupBy(chunk.alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct("addr", "content"))).alias("m"))
    body = F.expr(f"transform(sequence(chunk * {io_blocks}, chunk * {io_blocks} + {io_blocks - 1}), a -> coalesce(m[a], '0'))")
    return got.select((F.col("chunk") * io_blocks).alias("addr"), F.lit(io_blocks).cast("long").alias("blocks"), F.lit("Normal").alias("rec_type"), F.array_join(body, ",").alias("payload"))


def compaction_gain(before: DataFrame, after: DataFrame) -> DataFrame:
    """Records and blocks per volume before and after a merge."""
    count = lambda df, n: df.groupBy("vol_id").agg(F.count("*").alias(f"{n}_records"), F.sum("blocks").alias(f"{n}_blocks"))
    return count(before, "in").join(count(after, "out"), "vol_id")


def change_checksum_audit(changes: DataFrame, expected: str, payload: str = "payload") -> DataFrame:
    """Normal records: the stored payload's sum against the recorded one."""
    from ..functions.checksum import block_sum

    data = changes.where(F.col("rec_type") == "Normal").withColumn("actual", block_sum(F.col(payload), F.lit(0).cast("long")))
    return data.withColumn("ok", F.col("actual") == F.col(expected))
