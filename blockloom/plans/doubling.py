"""The applicable chain of volumes too large for one task.

From every gid at which a diff ends, and the base, a pointer leads to the best next diff. A
gid's best plain diff is a running maximum over the starts up to it: a maximum for each slice
of ``width`` gids, running over slices, then inside the slice. So a slice has at most ``width`` pointers,
however many diffs there are.

Inside each slice every pointer is followed to where it leaves. Of these leaps only those are kept that
start at a base or where another one lands: few of a slice's gids. The slices that the chain
enters are then found by doubling: the set of entries is joined with pointers that leap 1, 2, 4, ...
slices, until it no longer grows. Last, each entered slice is walked from its entry, by itself;
positions and the snapshots' upper gids follow from sums over the slices entered before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chain import CHAIN, applicable_chain
from .scan import scan_sorted
from .stage import staged

WIDTH = 1 << 16
HUGE = 1_000_000  # diffs of a volume from which on it is worth the joins


def _best() -> Column:
    """Orders diffs as the walk does: farthest end, then latest start, then the cleaner."""
    rest = [F.col(c) for c in ("is_mergeable", "is_comp_diff", "ts", "data_size")]
    return F.max(F.struct("e_b", F.col("b_b").alias("start"), (-F.col("e_e")).alias("ne"), (-F.col("b_e")).alias("nb"), *rest))


def pointers(diffs: DataFrame, base: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vol_id, g, slice, d): the best next diff from each gid that a diff or the base ends at, where there is one."""
    cut = lambda c: F.floor(F.col(c) / width).alias("slice")
    plain = diffs.where("not is_comp_diff").groupBy("vol_id", F.col("b_b").alias("g")).agg(_best().alias("d")).withColumn("slice", cut("g"))
    nodes = diffs.select("vol_id", F.col("e_b").alias("g")).unionByName(base.select("vol_id", F.col("b_b").alias("g"))).distinct().withColumn("slice", cut("g"))
    none = F.lit(None).cast(plain.schema["d"].dataType).alias("d")
    over = plain.groupBy("vol_id", "slice").agg(F.max("d").alias("d")).unionByName(nodes.select("vol_id", "slice", none).distinct())
    before = over.groupBy("vol_id", "slice").agg(F.max("d").alias("d"))
    before = before.select(F.col("vol_id").alias("v"), F.col("slice").alias("s"), F.max("d").over(Window.partitionBy("vol_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    both = plain.select("vol_id", "slice", "g", "d", F.lit(0).alias("kind")).unionByName(nodes.select("vol_id", "slice", "g", none, F.lit(1).alias("kind")))
    inside = both.withColumn("d", F.max("d").over(Window.partitionBy("vol_id", "slice").orderBy("g", "kind").rowsBetween(Window.unboundedPreceding, 0))).where("kind = 1")
    got = inside.join(before, (F.col("vol_id") == F.col("v")) & (F.col("slice") == F.col("s"))).select("vol_id", "slice", "g", F.greatest("d", "before").alias("d"))
    comp = diffs.where("is_comp_diff").groupBy(F.col("vol_id").alias("v"), F.col("b_b").alias("at")).agg(_best().alias("c"))
    got = got.join(comp, (F.col("vol_id") == F.col("v")) & (F.col("g") == F.col("at")), "left")
    ahead = lambda c: F.when(F.col(f"{c}.e_b") > F.col("g"), F.col(c))
    return got.select("vol_id", "slice", "g", F.greatest(ahead("d"), ahead("c")).alias("d")).where("d is not null")


def _exits(width: int) -> Callable[[], Callable[[tuple | None], Iterable[tuple]]]:
    """The rule of one slice: its pointers (vol_id, slice, g, nxt) from the last; those whose path leaves it, with where to."""

    def start() -> Callable[[tuple | None], Iterable[tuple]]:
        end: dict[int, int] = {}

        def rule(row: tuple | None) -> Iterable[tuple]:
            if row is None:
                return ()
            vol, own, g, nxt = row
            out = end[g] = end.get(nxt, nxt)
            return [(vol, g, out)] if out // width != own else ()  # else the chain ends inside

        return rule

    return start


def leaps(points: DataFrame, base: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vol_id, g, out): where the path from g leaves its slice, for gids that a chain can enter a slice by: the base's, and where another leap lands."""
    own = points.select("vol_id", "slice", "g", F.col("d.e_b").alias("nxt"))
    out = staged(scan_sorted(own, ["vol_id", "slice"], [F.col("g").desc()], _exits(width), "vol_id bigint, g bigint, out bigint"), "exits")
    landed = out.select("vol_id", F.col("out").alias("g")).unionByName(base.select("vol_id", F.col("b_b").alias("g"))).distinct()
    return out.join(landed, ["vol_id", "g"], "left_semi")


def entries(points: DataFrame, base: DataFrame, width: int = WIDTH) -> DataFrame:
    """(vol_id, slice, g): where each volume's chain enters a slice, its base the first."""
    leap = staged(leaps(points, base, width), "leaps")
    found = staged(base.select("vol_id", F.col("b_b").alias("g")), "entries")
    n = found.count()
    while True:
        to = leap.select(F.col("vol_id").alias("v"), F.col("g").alias("from"), F.col("out").alias("to"))
        more = found.join(to, (F.col("vol_id") == F.col("v")) & (F.col("g") == F.col("from"))).select("vol_id", F.col("to").alias("g"))
        found = staged(found.unionByName(more).distinct(), "entries")
        if (now := found.count()) == n:
            break
        n = now
        leap = staged(leap.join(to, (F.col("vol_id") == F.col("v")) & (F.col("out") == F.col("from"))).select("vol_id", "g", F.col("to").alias("out")), "leaps")
    return found.withColumn("slice", F.floor(F.col("g") / width))


def _path() -> Callable[[tuple | None], Iterable[tuple]]:
    """The rule of one slice: its entry's row (vol_id, slice, is_entry, g, diff...), then its pointers in order; those on the path from the entry."""
    at, n = None, 0

    def rule(row: tuple | None) -> Iterable[tuple]:
        nonlocal at, n
        if row is None:
            return ()
        if row[2]:
            at = row[3]
        elif row[3] == at:
            at, n = row[6], n + 1
            return [(*row[:2], *row[4:], n)]
        return ()

    return rule


_WALKED = ["b_b", "b_e", "e_b", "e_e", "is_mergeable", "is_comp_diff", "ts", "data_size"]


def chain_by_doubling(diffs: DataFrame, base: DataFrame, width: int = WIDTH) -> DataFrame:
    """As ``applicable_chain``, with all tasks working on one volume."""
    points = staged(pointers(diffs, base, width), "pointers")
    d = [F.col("d.start").alias("b_b"), (-F.col("d.nb")).alias("b_e"), F.col("d.e_b").alias("e_b"), (-F.col("d.ne")).alias("e_e"), "d.is_mergeable", "d.is_comp_diff", "d.ts", "d.data_size"]
    own = points.select("vol_id", "slice", F.lit(False).alias("is_entry"), "g", *d)
    nulls = [F.lit(None).cast(own.schema[c].dataType).alias(c) for c in _WALKED]
    start = entries(points, base, width).select("vol_id", "slice", F.lit(True).alias("is_entry"), "g", *nulls)
    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ["vol_id", "slice", *_WALKED])
    taken = staged(scan_sorted(start.unionByName(own), ["vol_id", "slice"], [F.col("is_entry").desc(), "g"], _path, f"{kinds}, step bigint"), "taken")
    dirty = F.expr("not (b_b = b_e and e_b = e_e)")
    each = taken.groupBy(F.col("vol_id").alias("v"), F.col("slice").alias("s")).agg(F.count("*").alias("n"), F.max_by("e_e", F.when(dirty, F.col("step"))).alias("sets"))
    w = Window.partitionBy("v").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("v", "s", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("ahead"), F.last("sets", ignorenulls=True).over(w).alias("had"))
    first = base.select(F.col("vol_id").alias("w"), F.col("b_e").alias("base_e"))
    got = taken.join(each, (F.col("vol_id") == F.col("v")) & (F.col("slice") == F.col("s"))).join(first, F.col("vol_id") == F.col("w"))
    inside = F.last(F.when(dirty, F.col("e_e")), ignorenulls=True).over(Window.partitionBy("vol_id", "slice").orderBy("step"))
    upper = F.coalesce(inside, "had", "base_e")
    got = got.withColumn("s_e", F.when(dirty, F.col("e_e")).otherwise(F.greatest("e_b", upper)))
    return got.select("vol_id", (F.col("ahead") + F.col("step")).alias("pos"), *_WALKED, F.col("e_b").alias("s_b"), "s_e")


def chain_of_all(diffs: DataFrame, base: DataFrame, huge: int = HUGE, width: int = WIDTH) -> DataFrame:
    """The chains of all volumes: those of more than ``huge`` diffs by doubling, the others by one walk each. Equal at any setting."""
    large = staged(diffs.groupBy("vol_id").agg(F.count("*").alias("n")).where(F.col("n") > huge).select("vol_id"), "huge-volumes")
    if large.isEmpty():
        return applicable_chain(diffs, base)
    part = lambda df, how: df.join(large, "vol_id", how)
    got = chain_by_doubling(part(diffs, "left_semi"), part(base, "left_semi"), width)
    columns = [c.strip().split(" ")[0] for c in CHAIN.split(",")]
    return applicable_chain(part(diffs, "left_anti"), part(base, "left_anti")).select(*columns).unionByName(got.select(*columns))
