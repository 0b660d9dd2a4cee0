"""The applicable chain of each volume's catalogue.

From a gid g the next diff is the one of largest (e_b, b_b) among those that contain g and
the compared diffs that begin at g. Over diffs in order of b_b this is a greedy walk in one
pass: a step is decided when the first diff beyond g arrives, and what was seen before is
summed up by the best plain diff and the compared ones that begin at g. So a volume's
catalogue is sorted by Spark and streamed; a task holds a few diffs, not the catalogue.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import scan_sorted

CHAIN = "vol_id bigint, pos bigint, b_b bigint, b_e bigint, e_b bigint, e_e bigint, is_mergeable boolean, is_comp_diff boolean, ts timestamp, data_size bigint, s_b bigint, s_e bigint"
_DIFF = ["b_b", "b_e", "e_b", "e_e", "is_mergeable", "is_comp_diff", "ts", "data_size"]


def _rank(d: tuple) -> tuple:
    """Which of two diffs (b_b, b_e, e_b, e_e, ...) goes farther; ties to the cleaner."""
    return (d[2], d[0], -d[3], -d[1])


def _walk() -> Callable[[tuple | None], list[tuple]]:
    """The rule of one volume: rows (vol_id, is_base, diff...), the base's first, then by b_b."""
    vol, g, e, pos = None, None, None, 0
    plain, comp = None, {}  # best plain diff that begins at or before g; compared diffs by start, from g on

    def advance(until: int | None) -> list[tuple]:
        nonlocal g, e, pos, plain
        out = []
        while g is not None and (until is None or g < until):
            best = max((d for d in (plain, comp.pop(g, None)) if d is not None and d[2] > g), key=_rank, default=None)
            if best is None:
                g = None  # nothing leads on: what begins later is out of reach
                break
            clean = best[0] == best[1] and best[2] == best[3]
            g, e, pos = best[2], (max(best[2], e) if clean else best[3]), pos + 1
            out.append((vol, pos, *best, g, e))
            for start in [s for s in comp if s < g]:
                del comp[start]
        return out

    def rule(row: tuple | None) -> list[tuple]:
        nonlocal vol, g, e, plain
        if row is None:
            return advance(None)
        is_base, d = row[1], row[2:]
        if is_base:
            vol, g, e = row[0], d[0], d[1]
            return []
        if g is None:
            return []
        out = advance(d[0]) if d[0] > g else []
        if g is None:
            return out
        if d[5]:
            if d[0] >= g and (d[0] not in comp or _rank(d) > _rank(comp[d[0]])):
                comp[d[0]] = d
        elif plain is None or _rank(d) > _rank(plain):
            plain = d
        return out

    return rule


def applicable_chain(diffs: DataFrame, base: DataFrame) -> DataFrame:
    """A row per diff of each volume's chain from its base snapshot (b_b, b_e): position, diff, and the snapshot after it. One base a volume."""
    rows = diffs.select("vol_id", F.lit(False).alias("is_base"), *_DIFF)
    nulls = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in _DIFF[2:]]
    starts = base.select("vol_id", F.lit(True).alias("is_base"), "b_b", "b_e", *nulls)
    return scan_sorted(starts.unionByName(rows), ["vol_id"], [F.col("is_base").desc(), "b_b"], _walk, CHAIN)


def stop_where(chain: DataFrame, broken: Column) -> DataFrame:
    """The head of each chain before the first diff where ``broken`` holds: a stop, not a filter."""
    w = Window.partitionBy("vol_id").orderBy("pos")
    return chain.withColumn("broken", F.max(F.coalesce(broken, F.lit(False)).cast("int")).over(w)).where("broken = 0").drop("broken")
