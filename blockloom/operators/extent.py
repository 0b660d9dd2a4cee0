"""Extents of blocks and the latest-wins core.

An extent is (vol_id, addr, blocks) with an order ``seq`` that is unique within a volume.
Long extents (discards) are cut at stripes, never into blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scan import scan_sorted

STRIPE = 65_536  # blocks: 32 MiB
CROWD, PART = 32_768, 256  # extents of a stripe beyond which it is swept in parts, and their blocks


def stripes(addr: str = "addr", blocks: str = "blocks", stripe: int = STRIPE) -> Column:
    """The stripes that an extent touches."""
    return F.expr(f"sequence({addr} div {stripe}, ({addr} + {blocks} - 1) div {stripe})")


def cut_at_stripes(df: DataFrame, stripe: int = STRIPE) -> DataFrame:
    """One row per extent and stripe, clipped to it, with ``stripe`` and ``off``, the offset in the extent."""
    df = df.withColumn("stripe", F.explode(stripes(stripe=stripe)))
    start = F.greatest("addr", F.col("stripe") * stripe)
    end = F.least(F.col("addr") + F.col("blocks"), (F.col("stripe") + 1) * stripe)
    return df.withColumns({"off": start - F.col("addr"), "blocks": end - start, "addr": start})


def _sweep(rows: list[tuple]) -> list[list[int]]:
    """Disjoint winners [addr, blocks, seq, off] of extents (addr, blocks, seq, off): at each address that of largest seq."""
    rows = sorted(rows)
    edges = sorted({r[0] for r in rows} | {r[0] + r[1] for r in rows})
    heap: list[tuple] = []
    out: list[list[int]] = []
    i = 0
    for at, until in zip(edges[:-1], edges[1:], strict=True):
        while i < len(rows) and rows[i][0] <= at:
            a, n, s, o = rows[i]
            heapq.heappush(heap, (-s, a + n, a, o))
            i += 1
        while heap and heap[0][1] <= at:
            heapq.heappop(heap)
        if not heap:
            continue
        s, _, a, o = heap[0]
        if out and out[-1][2] == -s and out[-1][0] + out[-1][1] == at and out[-1][3] + out[-1][1] == o + at - a:
            out[-1][1] += until - at
        else:
            out.append([at, until - at, -s, o + at - a])
    return out


_RUN = "vol_id bigint, addr bigint, blocks bigint, seq bigint, off bigint"


def _one_group() -> Callable[[tuple | None], list[tuple]]:
    """Collects the extents of one (vol_id, part), whose number is bounded, and sweeps them at its end."""
    held: list[tuple] = []

    def rule(row: tuple | None) -> list[tuple]:
        if row is not None:
            held.append(row)
            return []
        return [(held[0][0], *run) for run in _sweep([r[2:] for r in held])]

    return rule


def _floored(pieces: DataFrame, whole: int, by: list[str]) -> DataFrame:
    """Pieces of parts of ``whole`` blocks, without those under a newer one that covers their part, with ``n`` pieces a part."""
    seen = pieces.groupBy(*by).agg(F.max(F.when(F.col("blocks") == whole, F.col("seq"))).alias("floor"), F.count("*").alias("n"))
    return pieces.join(seen, by).where("floor is null or seq >= floor").drop("floor")


def latest_wins(df: DataFrame, crowd: int = CROWD, part: int = PART) -> DataFrame:
    """The surviving runs (vol_id, addr, blocks, seq, off) when the extent of largest ``seq`` wins each block.

    ``df`` has vol_id, addr, blocks, seq; ``off`` is a run's offset in its extent. Equal extents
    are reduced to their newest before the shuffle, and what lies under a newer extent that
    covers its whole stripe goes, both by partial sums. An extent alone in its stripe needs no
    sweep, so the long middle of a discard never reaches Python. A stripe of more than
    ``crowd`` extents is cut in parts of ``part`` blocks, where equal pieces are reduced
    again: a part has at most part * (part + 1) / 2 different pieces, however hot it is. So
    each group that is swept is bounded, by ``crowd`` or by that. Runs are joined again after.
    """
    newest = df.groupBy("vol_id", "addr", "blocks").agg(F.max("seq").alias("seq"))
    long = [F.col(c).cast("long").alias(c) for c in ("vol_id", "stripe", "addr", "blocks", "seq", "off")]
    cut = _floored(cut_at_stripes(newest).select(*long), STRIPE, ["vol_id", "stripe"])
    alone = cut.where("n = 1").select("vol_id", "addr", "blocks", "seq", "off")
    few = cut.where(f"n > 1 and n <= {crowd}").select("vol_id", F.col("stripe").alias("part"), "addr", "blocks", "seq", "off")
    hot = cut.where(f"n > {crowd}").select("vol_id", "addr", "blocks", "seq", F.col("off").alias("from"))
    hot = cut_at_stripes(hot, part).groupBy("vol_id", F.col("stripe").alias("part"), "addr", "blocks").agg(F.max(F.struct("seq", (F.col("from") + F.col("off")).alias("off"))).alias("m"))
    hot = _floored(hot.select("vol_id", "part", "addr", "blocks", "m.seq", "m.off"), part, ["vol_id", "part"]).drop("n")
    crowded = few.unionByName(hot.withColumn("part", -1 - F.col("part")))  # names of parts below zero, apart from those of stripes
    return joined_runs(alone.unionByName(scan_sorted(crowded, ["vol_id", "part"], [], _one_group, _RUN)))


def joined_runs(won: DataFrame) -> DataFrame:
    """Runs of one extent that touch at a stripe's edge, as one run."""
    w = Window.partitionBy("vol_id", "seq").orderBy("addr")
    broken = F.coalesce(F.lag(F.col("addr") + F.col("blocks")).over(w) != F.col("addr"), F.lit(True))
    runs = won.withColumn("run", F.sum(broken.cast("int")).over(w))
    return runs.groupBy("vol_id", "seq", "run").agg(F.min("addr").alias("addr"), F.sum("blocks").alias("blocks"), F.min("off").alias("off")).select("vol_id", "addr", "blocks", "seq", "off")


def _dealt(pieces: DataFrame, *by: str) -> DataFrame:
    """Pieces dealt to tasks, by their address where no columns are named. The number of tasks is named, as rows that are few now multiply later."""
    by = by or [c for c in ("vol_id", "addr") if c in pieces.columns]
    return pieces.repartition(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def cut_from_start(runs: DataFrame, n: int) -> DataFrame:
    """Runs cut at multiples of ``n`` blocks from their own extent's start. Long ones are cut at about a stripe first and dealt out, so no row holds a long list and no task all pieces of an extent."""

    def cut(runs: DataFrame, n: int) -> DataFrame:
        pieces = runs.withColumn("k", F.explode(F.expr(f"sequence(off div {n}L, (off + blocks - 1) div {n}L)")))
        lo = F.greatest(F.col("off"), F.col("k") * n)
        hi = F.least(F.col("off") + F.col("blocks"), (F.col("k") + 1) * n)
        return pieces.withColumns({"addr": F.col("addr") + lo - F.col("off"), "blocks": hi - lo, "off": lo}).drop("k")

    whole = n * max(1, STRIPE // n)
    if whole == n:  # no extent has more pieces than stripes
        return cut(runs, n)
    long = F.col("blocks") > whole
    return cut(runs.where(~long).unionByName(_dealt(cut(runs.where(long), whole))), n)


def split_aligned(df: DataFrame, most: int) -> DataFrame:
    """Extents cut to aligned powers of two of at most ``most`` blocks.

    Between an extent's ends lies one place of largest alignment. Before it the pieces are the
    binary digits of the distance, rising; after it those of the rest, falling. Pieces beyond
    a stripe are cut to stripes and dealt out before they are cut to ``most``, so no row holds a
    long list and no task all pieces of an extent.
    """
    most = 1 << (most.bit_length() - 1)
    step = max(most, STRIPE)
    mid = "shiftleft(shiftright(addr + blocks, {0}), {0})".format("(length(bin(addr ^ (addr + blocks))) - 1)")
    digits = "filter(sequence(0, 62), b -> shiftright({n}, b) & 1L = 1L)"
    place = lambda first, n, keep: f"transform({digits.format(n=n)}, b -> struct({first} + ({n} & {keep}) as addr, shiftleft(1L, b) as blocks))"
    rising = place("addr", "(mid - addr)", "(shiftleft(1L, b) - 1)")
    falling = place("mid", "(addr + blocks - mid)", "~(shiftleft(1L, b + 1) - 1)")
    rest = [c for c in df.columns if c not in ("addr", "blocks")]
    got = df.where("blocks > 0").withColumns({"addr": F.col("addr").cast("long"), "blocks": F.col("blocks").cast("long")}).withColumn("mid", F.expr(mid))
    got = got.select(*rest, F.explode(F.expr(f"concat({rising}, {falling})")).alias("p")).select(*rest, "p.addr", "p.blocks")

    def cut(pieces: DataFrame, size: int) -> DataFrame:
        start = F.explode(F.expr(f"sequence(addr, addr + blocks - 1, {size}L)"))
        return pieces.select(*rest, start.alias("addr"), F.least("blocks", F.lit(size).cast("long")).alias("blocks"))

    if step == most:
        return cut(got, most)
    long = F.col("blocks") > step
    return cut(got.where(~long).unionByName(_dealt(cut(got.where(long), step))), most)


def covered_blocks(df: DataFrame, by: list[str], ratio: int = 1) -> DataFrame:
    """Distinct units of ``ratio`` blocks that extents touch, per group; ranges, not blocks, are counted."""
    unit = df.select(*by, F.expr(f"addr div {ratio}").alias("addr"), F.expr(f"(addr + blocks - 1) div {ratio} - addr div {ratio} + 1").alias("blocks"))
    w = Window.partitionBy(*by, "stripe").orderBy("addr").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut_at_stripes(unit)
    seen = F.coalesce(F.max(F.col("addr") + F.col("blocks")).over(w), F.col("addr"))
    new = F.greatest(F.lit(0), F.col("addr") + F.col("blocks") - F.greatest("addr", seen))
    return cut.withColumn("new", new).groupBy(*by).agg(F.sum("new").alias("covered"))


_LEVEL = "greatest(8, 8 * cast(ceil(log2(cast(blocks as double)) / 8) as int))"
_BIN = "(level - 3)"  # a bin's width: an eighth of its level's, so that a hot range of addresses has bins for many tasks
TOGETHER = 256  # extents of a bin that meet the other side as one row, at most


def _leveled(df: DataFrame, levels: list[int], above: bool) -> DataFrame:
    """A row per extent, level and bin it touches, dealt by bin: at its own level, or at each of ``levels`` (above: greater, else from its own on)."""
    rows = df.withColumn("own", F.expr(_LEVEL))
    if levels:
        wanted = F.filter(F.array(*map(F.lit, levels)), lambda v: v > F.col("own") if above else v >= F.col("own"))
        rows = rows.withColumn("level", F.explode(wanted))
    else:
        rows = rows.withColumn("level", F.col("own"))
    bins = F.expr(f"sequence(shiftright(addr, {_BIN}), shiftright(addr + blocks - 1, {_BIN}))")
    return _dealt(rows.withColumn("bin", F.explode(bins)).drop("own"), "vol_id", "level", "bin")


def _together(rows: DataFrame, by: list[str], held: list[str], name: str) -> DataFrame:
    """At most ``TOGETHER`` rows of a group as one, with the array ``name`` of what they hold, in order."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*held)) - 1
    parts = rows.withColumn("part", F.floor(at / TOGETHER)).groupBy(*by, "part")
    return parts.agg(F.sort_array(F.collect_list(F.struct(*held))).alias(name)).drop("part")


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of extents that share a block: (vol_id, l_seq, r_seq, addr, blocks of the overlap).

    Extents have a level by length (powers of 256) and touch at most nine bins of an eighth of
    that width. A pair meets at the level of its longer extent, in the bin where the overlap
    begins, so short extents aren't compared with all of a wide stripe. Both sides are dealt by
    bin, as pairs are many where rows are few. The levels at hand, eight at most, are looked up
    first.

    A bin's left extents meet its equal right ones as one row each, which become pairs after
    the join. Pairs may be far more than there is room for as they come, so they leave in an
    order that columns store in little: the same run of left seqs for each right one in turn,
    hence a merge join, which takes its left side row by row. Pairs are made in a step after
    it, as generated code gathers what comes of one row: there that is a bounded number.
    """
    long = [F.col(c).cast("long").alias(c) for c in ("vol_id", "addr", "blocks", "seq")]
    left, right = left.where("blocks > 0").select(*long), right.where("blocks > 0").select(*long)

    def levels(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select(F.expr(_LEVEL).alias("level")).distinct().collect())  # one number a level

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        by = ["vol_id", "level", "bin"]
        a = a.withColumnsRenamed({"addr": "l_addr", "blocks": "l_blocks", "seq": "l_seq"})
        a, b = _together(a, by, ["l_addr", "l_blocks", "l_seq"], "ls"), _together(b.withColumnRenamed("seq", "r_seq"), [*by, "addr", "blocks"], ["r_seq"], "rs")
        return a.hint("merge").join(b, by)

    ll, rl = levels(left), levels(right)
    met = meet(_leveled(left, rl, False), _leveled(right, [], False))  # the right one is longer, or of the same level
    if ll and rl:
        met = met.unionByName(meet(_leveled(left, [], False), _leveled(right, ll, True)))
    met = met.coalesce(2 * int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = met.select("*", F.inline("rs")).drop("rs").select("*", F.inline("ls")).drop("ls")
    start, end = F.greatest("addr", "l_addr"), F.least(F.col("addr") + F.col("blocks"), F.col("l_addr") + F.col("l_blocks"))
    pairs = pairs.where(start < end).where(F.expr(f"shiftright(greatest(addr, l_addr), {_BIN}) = bin"))
    return pairs.select("vol_id", "l_seq", "r_seq", start.alias("addr"), (end - start).alias("blocks"))


def covered(df: DataFrame) -> DataFrame:
    """The disjoint ranges (vol_id, stripe, addr, blocks) that extents cover, by stripe; touching ones are one."""
    cut = cut_at_stripes(df.select("vol_id", "addr", "blocks").distinct()).select("vol_id", "stripe", "addr", (F.col("addr") + F.col("blocks")).alias("end"))
    w = Window.partitionBy("vol_id", "stripe").orderBy("addr", "end")
    new = F.coalesce(F.col("addr") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    isles = cut.withColumn("isle", F.sum(new.cast("int")).over(w)).groupBy("vol_id", "stripe", "isle").agg(F.min("addr").alias("addr"), F.max("end").alias("end"))
    return isles.select("vol_id", "stripe", "addr", (F.col("end") - F.col("addr")).alias("blocks"))
