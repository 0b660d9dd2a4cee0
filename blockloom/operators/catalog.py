"""Snapshot and diff catalogue. Diffs: vol_id, b_b, b_e, e_b, e_e, is_mergeable, is_comp_diff, ts, data_size; bases: vol_id, b_b, b_e, is_applying, e_b."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.chain import applicable_chain, stop_where
from ..plans.stage import staged

KEY = ["vol_id", "b_b", "b_e", "e_b", "e_e"]


def clean() -> Column:
    return F.expr("b_b = b_e and e_b = e_e")


def with_base(diffs: DataFrame, base: DataFrame) -> DataFrame:
    return diffs.join(base.select("vol_id", F.col("b_b").alias("s_b"), F.col("b_e").alias("s_e")), "vol_id")


def relation(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """A diff's relation to its volume's base snapshot; only the lower gids steer."""
    rel = F.expr("""case when is_comp_diff then case when e_b <= s_b then 'TOO_OLD' when b_b > s_b then 'TOO_NEW' when b_b = s_b then 'APPLICABLE' else 'NOT_APPLICABLE' end
      when e_b <= s_b then 'TOO_OLD' when b_b > s_b then 'TOO_NEW' else 'APPLICABLE' end""")
    return with_base(diffs, base).withColumn("relation", rel)


def apply_snap(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """The snapshot after applying each applicable diff to its base."""
    got = relation(diffs, base).where("relation = 'APPLICABLE'")
    return got.withColumns({"n_b": F.col("e_b"), "n_e": F.when(clean(), F.greatest("e_b", "s_e")).otherwise(F.col("e_e"))})


def can_merge(diffs: DataFrame) -> DataFrame:
    """For each diff and its successor by start: whether they merge, and the merged bounds."""
    w = Window.partitionBy("vol_id").orderBy("b_b", "e_b", "e_e")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("b_b", "e_b", "e_e", "is_mergeable", "is_comp_diff", "ts")}
    got = diffs.withColumns(nxt).where("n_b_b is not null")
    ok = F.expr("n_is_mergeable and not n_is_comp_diff and not is_comp_diff and n_b_b <= e_b and e_b < n_e_b")
    return got.withColumn("mergeable_pair", ok)


def merge_meta(chain: DataFrame) -> DataFrame:
    """One row per volume: the diff that a run of merged diffs gives.

    Its end is folded from the first diff's own end, whatever the base was: a clean diff moves
    the lower gid and keeps a higher upper one, a dirty diff sets both.
    """
    first = F.min_by(F.struct("b_b", "b_e", "is_mergeable"), "pos")
    last = F.max_by(F.struct("e_b", "ts"), "pos")
    w = Window.partitionBy("vol_id").orderBy("pos")
    sets_end = chain.withColumn("sets", (F.row_number().over(w) == 1) | ~clean())
    end = F.max_by("e_e", F.when(F.col("sets"), F.col("pos")))
    got = sets_end.groupBy("vol_id").agg(first.alias("f"), last.alias("l"), end.alias("e"), F.count("*").alias("n"))
    return got.select("vol_id", "f.b_b", "f.b_e", F.col("l.e_b").alias("e_b"), F.greatest("l.e_b", "e").alias("e_e"), "f.is_mergeable", "l.ts", "n")


def contained_diffs(diffs: DataFrame) -> DataFrame:
    """Diffs whose gid range lies within another's, by a running maximum."""
    w = Window.partitionBy("vol_id").orderBy(F.col("b_b"), F.col("e_b").desc(), F.col("e_e").desc(), F.col("b_e"))
    before = F.max("e_b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return diffs.withColumn("m", before).where("m >= e_b").drop("m")


def validate_catalog(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """Violations (vol_id, what) of the rules on snapshots, diffs, applying states and keys."""
    d = diffs.select("vol_id", F.expr("case when b_b > b_e or e_b > e_e then 'snapshot' when b_b >= e_b or b_e > e_e then 'progress' end").alias("what")).where("what is not null")
    dup = diffs.groupBy(*KEY).count().where("count > 1").select("vol_id", F.lit("duplicate").alias("what"))
    s = base.where("is_applying and (e_b is null or b_b >= e_b)").select("vol_id", F.lit("state").alias("what"))
    return d.unionByName(dup).unionByName(s)


def diffs_at_gid(diffs: DataFrame, gids: DataFrame) -> DataFrame:
    """(vol_id, gid) with the number of diffs b_b <= gid < e_b, by running sums over boundaries."""
    edge = F.explode(F.array(F.struct(F.col("b_b").alias("g"), F.lit(1).alias("d")), F.struct(F.col("e_b").alias("g"), F.lit(-1).alias("d"))))
    steps = diffs.select("vol_id", edge.alias("x")).groupBy("vol_id", F.col("x.g").alias("g")).agg(F.sum("x.d").alias("d"), F.lit(0).alias("asked"))
    both = steps.unionByName(gids.select("vol_id", F.col("gid").alias("g"), F.lit(0).cast("long").alias("d"), F.lit(1).alias("asked")))
    w = Window.partitionBy("vol_id").orderBy("g")
    return both.withColumn("n_diffs", F.sum("d").over(w)).where("asked = 1").select("vol_id", F.col("g").alias("gid"), "n_diffs")


def gid_ranges(diffs: DataFrame) -> DataFrame:
    """Elementary gid ranges with the number of diffs over each."""
    edge = F.explode(F.array(F.struct(F.col("b_b").alias("g"), F.lit(1).alias("d")), F.struct(F.col("e_b").alias("g"), F.lit(-1).alias("d"))))
    steps = diffs.select("vol_id", edge.alias("x")).groupBy("vol_id", F.col("x.g").alias("g")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("vol_id").orderBy("g")
    got = steps.select("vol_id", F.col("g").alias("begin_gid"), F.lead("g").over(w).alias("end_gid"), F.sum("d").over(w).alias("n_diffs"))
    return got.where("end_gid is not null")


def diffs_holding(diffs: DataFrame, gids: DataFrame) -> DataFrame:
    """A row per asked (vol_id, gid) and diff with b_b <= gid < e_b: the diff's columns and ``gid``.

    A diff's range is cut to aligned powers of two, about two for each binary digit of its length.
    A gid lies in one such place of each size, so both meet by equality on size and place: a
    volume that holds a third of all diffs is dealt out by place. The sizes at hand, 63 at most,
    are looked up first.
    """
    from .extent import split_aligned

    spans = split_aligned(diffs.withColumns({"addr": F.col("b_b"), "blocks": F.col("e_b") - F.col("b_b")}), 1 << 62)
    spans = spans.withColumn("level", F.expr("cast(length(bin(blocks)) - 1 as int)")).withColumn("node", F.expr("shiftright(addr, level)")).drop("addr", "blocks")
    levels = sorted(r[0] for r in spans.select("level").distinct().collect())  # one number a size
    asked = gids.select(F.col("vol_id").alias("v"), "gid").distinct().withColumn("l", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("n", F.expr("shiftright(gid, l)"))
    return spans.join(asked, (F.col("vol_id") == F.col("v")) & (F.col("level") == F.col("l")) & (F.col("node") == F.col("n"))).select(*diffs.columns, "gid")


def range_diffs(diffs: DataFrame) -> DataFrame:
    """A row per elementary gid range (begin_gid, end_gid) and diff over it."""
    ranges = gid_ranges(diffs).where("n_diffs > 0").select(F.col("vol_id").alias("v"), "begin_gid", "end_gid")
    held = diffs_holding(diffs, ranges.select(F.col("v").alias("vol_id"), F.col("begin_gid").alias("gid")))
    return held.join(ranges, (F.col("vol_id") == F.col("v")) & (F.col("gid") == F.col("begin_gid"))).select(*diffs.columns, "begin_gid", "end_gid")


def max_progress(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("vol_id").agg(F.max_by(F.struct("b_b", "e_b"), F.struct("e_b", "b_b")).alias("d")).select("vol_id", "d.b_b", "d.e_b")


def applicable_until(diffs: DataFrame, base: DataFrame, max_gid: int | None = None, max_ts=None, pred: Column | None = None) -> DataFrame:
    """The chain up to the first diff that passes a limit."""
    broken = F.lit(False)
    if max_gid is not None:
        broken = broken | (F.col("s_b") > max_gid)
    if max_ts is not None:
        broken = broken | (F.col("ts") > F.lit(max_ts))
    if pred is not None:
        broken = broken | ~pred
    return stop_where(applicable_chain(diffs, base), broken)


def _mergeable(chain: DataFrame) -> DataFrame:
    w = Window.partitionBy("vol_id").orderBy("pos")
    broken = (F.col("pos") > 1) & (~F.col("is_mergeable") | F.col("is_comp_diff") | F.coalesce(F.lag("is_comp_diff").over(w), F.lit(False)) | (F.col("b_b") < F.first("b_b").over(w)))
    return stop_where(chain.withColumn("stop", broken), F.col("stop")).drop("stop")


def applicable_mergeable_chain(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """The chain's head whose diffs merge into one."""
    return _mergeable(applicable_chain(diffs, base))


def mergeable_chain(diffs: DataFrame, gid: int, gid_e: int | None = None) -> DataFrame:
    """The mergeable run from the first diff that starts at ``gid`` or later; the first itself need not be mergeable."""
    from_gid = diffs.where(F.col("b_b") >= gid)
    first = F.min_by(F.struct("b_b", "b_e", "e_b", "e_e", "is_mergeable", "is_comp_diff", "ts", "data_size"), F.struct(F.col("b_b"), -F.col("e_b"), F.col("e_e"), F.col("b_e")))
    head = from_gid.groupBy("vol_id").agg(first.alias("f")).select("vol_id", "f.*")
    own = head.select("vol_id", F.lit(0).cast("long").alias("pos"), "b_b", "b_e", "e_b", "e_e", "is_mergeable", "is_comp_diff", "ts", "data_size", F.col("e_b").alias("s_b"), F.col("e_e").alias("s_e"))
    rest = from_gid.where("is_mergeable and not is_comp_diff").join(head.select("vol_id", F.col("b_b").alias("h")), "vol_id").where("b_b >= h").drop("h")
    start = head.where("not is_comp_diff").select("vol_id", F.col("e_b").alias("b_b"), F.col("e_e").alias("b_e"))
    chain = own.unionByName(applicable_chain(rest, start))
    return stop_where(chain, F.col("b_b") >= gid_e) if gid_e is not None else chain


def minimum_chain(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """What an interrupted apply still has to finish; empty where none is applying."""
    end = base.where("is_applying").select("vol_id", F.col("e_b").alias("end_gid"))
    return stop_where(applicable_chain(diffs, base).join(end, "vol_id"), F.col("s_b") > F.col("end_gid")).drop("end_gid")


def latest_state(diffs: DataFrame, base: DataFrame, chain: DataFrame | None = None) -> DataFrame:
    """The snapshot at the end of each volume's chain, or its base; ``chain``: the chains, where they are at hand."""
    last = (applicable_chain(diffs, base) if chain is None else chain).groupBy("vol_id").agg(F.max_by(F.struct("s_b", "s_e", "ts"), "pos").alias("l"))
    got = base.select("vol_id", "b_b", "b_e").join(last, "vol_id", "left")
    return got.select("vol_id", F.coalesce("l.s_b", "b_b").alias("gid_b"), F.coalesce("l.s_e", "b_e").alias("gid_e"), F.col("l.ts").alias("ts"))


def oldest_clean_state(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """The first clean snapshot at or after what is being applied."""
    need = base.select("vol_id", F.coalesce("e_b", "b_b").alias("need"))
    start = base.where("not is_applying and b_b = b_e").select("vol_id", F.lit(0).cast("long").alias("pos"), F.col("b_b").alias("gid"))
    got = applicable_chain(diffs, base).join(need, "vol_id").where("s_b = s_e and s_b >= need").select("vol_id", "pos", F.col("s_b").alias("gid"))
    return start.unionByName(got).groupBy("vol_id").agg(F.min_by("gid", "pos").alias("gid"))


def restorable(diffs: DataFrame, base: DataFrame, every: bool = False, chain: DataFrame | None = None) -> DataFrame:
    """Clean snapshots of the chain: explicit ones (the next diff isn't mergeable, or there is none), or all; ``chain``: the chains, where they are at hand."""
    chain = (applicable_chain(diffs, base) if chain is None else chain).select("vol_id", "pos", F.col("s_b").alias("gid"), F.col("s_e").alias("e"), "is_mergeable")
    start = base.select("vol_id", F.lit(0).cast("long").alias("pos"), F.col("b_b").alias("gid"), F.col("b_e").alias("e"), F.lit(False).alias("is_mergeable"))
    start = start.join(base.where("is_applying").select("vol_id"), "vol_id", "left_anti")
    w = Window.partitionBy("vol_id").orderBy("pos")
    got = chain.unionByName(start).withColumn("explicit", ~F.coalesce(F.lead("is_mergeable").over(w), F.lit(False)))
    got = got.where("gid = e")
    return (got if every else got.where("explicit or pos = 0")).select("vol_id", "pos", "gid", "explicit")


def plan_restore(diffs: DataFrame, base: DataFrame, targets: DataFrame, exact_clean: bool = True, max_nr: int | None = None) -> DataFrame:
    """Per (vol_id, gid): the diffs to apply, where the gid is exactly reachable."""
    chain = staged(applicable_chain(diffs, base).join(targets.select("vol_id", "gid"), "vol_id").where("s_b <= gid"), "chain")
    ok = chain.where(F.col("s_b") == F.col("gid")).where("s_b = s_e" if exact_clean else "true").select("vol_id", F.col("pos").alias("upto"))
    got = chain.join(ok, "vol_id").where("pos <= upto")
    return (got.where(F.col("pos") <= max_nr) if max_nr else got).drop("upto")


def plan_apply(diffs: DataFrame, base: DataFrame, gid: int, max_nr: int) -> DataFrame:
    """Diffs up to a gid, at most ``max_nr``, but never less than an interrupted apply needs."""
    chain = applicable_until(diffs, base, max_gid=gid)
    need = minimum_chain(diffs, base).groupBy("vol_id").agg(F.max("pos").alias("need"))
    got = chain.join(need, "vol_id", "left")
    return got.where(F.col("pos") <= F.greatest(F.lit(max_nr), F.coalesce("need", F.lit(0)))).drop("need")


def truncate_by_size(chain: DataFrame, size: int, nr: int) -> DataFrame:
    """The head within a total size and a number; the first always stays."""
    w = Window.partitionBy("vol_id").orderBy("pos")
    got = chain.withColumns({"upto": F.sum("data_size").over(w), "rank": F.row_number().over(w)})
    return got.where((F.col("rank") == 1) | ((F.col("upto") <= size) & (F.col("rank") <= nr))).drop("upto", "rank")


def garbage(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """Diffs that aren't on the applicable chain."""
    return diffs.join(applicable_chain(diffs, base).select(*KEY), KEY, "left_anti")


def gc_range(diffs: DataFrame, b: int, e: int) -> DataFrame:
    return diffs.where((F.col("b_b") >= b) & (F.col("e_b") <= e) & ~((F.col("b_b") == b) & (F.col("e_b") == e)))


def expire_before(diffs: DataFrame, gid: int) -> DataFrame:
    return diffs.where(F.col("e_b") <= gid)


def set_snapshot(diffs: DataFrame, gid: int, enable: bool) -> DataFrame:
    """The diffs starting at ``gid`` that change: an explicit snapshot isn't merged over."""
    return diffs.where((F.col("b_b") == gid) & (F.col("is_mergeable") == enable)).withColumn("is_mergeable", F.lit(not enable))


def snapshot_found(diffs: DataFrame, gid: int) -> DataFrame:
    """(vol_id, found): whether some diff starts at ``gid``, so that a snapshot there can be set."""
    return diffs.groupBy("vol_id").agg(F.bool_or(F.col("b_b") == gid).alias("found"))


def list_diffs(diffs: DataFrame, gid0: int, gid1: int) -> DataFrame:
    return diffs.where((F.col("b_b") >= gid0) & (F.col("b_b") < gid1))


def diff_totals(diffs: DataFrame) -> DataFrame:
    agg = {"n_diffs": F.count("*"), "total_size": F.sum("data_size").cast("long"), "min_gid": F.min("b_b"), "max_gid": F.max("e_b"), "max_start": F.max("b_b")}
    return diffs.groupBy("vol_id").agg(*[c.alias(n) for n, c in agg.items()])


def can_apply(diffs: DataFrame, states: DataFrame) -> DataFrame:
    """Each diff and whether it applies to its volume's state; where that is applying, only a diff that goes at least as far."""
    begun = states.select("vol_id", F.when(F.col("is_applying"), F.col("e_b")).alias("begun"))
    ok = (F.col("relation") == "APPLICABLE") & (F.col("begun").isNull() | (F.col("begun") <= F.col("e_b")))
    return relation(diffs, states).join(begun, "vol_id").withColumn("can_apply", ok).drop("begun", "relation", "s_b", "s_e")


def can_apply_list(lists: DataFrame, states: DataFrame) -> DataFrame:
    """(vol_id, can_apply) of lists of diffs in order of ``pos``: whether each applies to the snapshot after those before it, and all together go as far as an apply that had begun."""
    at = F.coalesce(F.lag("e_b").over(Window.partitionBy("vol_id").orderBy("pos")), F.col("s"))
    first = states.select("vol_id", F.col("b_b").alias("s"), F.when(F.col("is_applying"), F.col("e_b")).alias("begun"))
    each = lists.join(first, "vol_id").withColumn("at", at)
    ok = F.expr("e_b > at and (if(is_comp_diff, b_b = at, b_b <= at))")
    got = each.groupBy("vol_id").agg(F.bool_and(ok).alias("all"), F.max_by("e_b", "pos").alias("end"), F.max("begun").alias("begun"))
    return got.select("vol_id", (F.col("all") & (F.col("begun").isNull() | (F.col("begun") <= F.col("end")))).alias("can_apply"))


def begin_apply(base: DataFrame, plan: DataFrame) -> DataFrame:
    """States marked as applying up to their plan's last snapshot."""
    last = plan.groupBy("vol_id").agg(F.max_by(F.struct("s_b", "s_e", "ts"), "pos").alias("l"))
    return base.select("vol_id", "b_b", "b_e").join(last, "vol_id").select("vol_id", F.lit(True).alias("is_applying"), "b_b", "b_e", F.col("l.s_b").alias("e_b"), F.col("l.s_e").alias("e_e"))


def end_apply(states: DataFrame) -> DataFrame:
    return states.where("is_applying").select("vol_id", F.lit(False).alias("is_applying"), F.col("e_b").alias("b_b"), F.col("e_e").alias("b_e"))


def verify_merge_range(diffs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per asked (vol_id, gid_b, gid_e): whether diffs begin and end there, and all but the first may merge."""
    got = ranges.join(diffs, "vol_id", "left").where("b_b is null or (b_b >= gid_b and e_b <= gid_e)").groupBy("vol_id", "gid_b", "gid_e")
    ok = got.agg(F.bool_or(F.col("b_b") == F.col("gid_b")).alias("b"), F.bool_or(F.col("e_b") == F.col("gid_e")).alias("e"), F.bool_and(F.expr("b_b = gid_b or is_mergeable")).alias("m"), F.bool_or("is_comp_diff").alias("c"))
    got = ranges.join(ok, ["vol_id", "gid_b", "gid_e"], "left")
    return got.select("vol_id", "gid_b", "gid_e", F.coalesce(F.expr("b and e and m and not c"), F.lit(False)).alias("ok"))


def merge_range(diffs: DataFrame, gid: int, gid_e: int | None = None, max_size: int | None = None) -> DataFrame:
    """The catalogue row that replaces each volume's mergeable run, where it has two or more diffs: up to a gid or within a total size."""
    chain = mergeable_chain(diffs, gid, gid_e)
    return merge_meta(chain if max_size is None else truncate_by_size(chain, max_size, 1 << 30)).where("n >= 2")


def apply_to_gid(diffs: DataFrame, base: DataFrame, gid: int) -> DataFrame:
    """Each volume's base after applying up to a gid, with how many diffs that took and expired."""
    plan = applicable_until(diffs, base, max_gid=gid)
    took = plan.groupBy("vol_id").agg(F.max_by(F.struct("s_b", "s_e"), "pos").alias("l"), F.count("*").alias("n_applied"))
    got = base.select("vol_id", "b_b", "b_e").join(took, "vol_id", "left")
    got = got.select("vol_id", F.coalesce("l.s_b", "b_b").alias("gid_b"), F.coalesce("l.s_e", "b_e").alias("gid_e"), F.coalesce("n_applied", F.lit(0)).alias("n_applied"))
    expired = diffs.join(got.select("vol_id", "gid_b"), "vol_id").where("e_b <= gid_b").groupBy("vol_id").agg(F.count("*").alias("n_expired"))
    return got.join(expired, "vol_id", "left").withColumn("n_expired", F.coalesce("n_expired", F.lit(0)))
