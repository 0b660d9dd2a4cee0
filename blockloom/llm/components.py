"""Connected components of an edge table by repeated contraction.

Each round every node points to its least neighbour in a fixed pseudo-random order (or to
itself), edges are renamed by the pointers, and loops and repeats go. Along any path a
constant share of nodes goes each round, so rounds grow with the logarithm of the longest
path; a star is gone after one. All steps are joins and partial aggregates on node ids:
hubs meet skewed joins that Spark splits, never one task's memory. Pointers and edges are
written to the shared folder each round; nothing is collected but a count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _mixed(c: str):
    return F.struct(F.xxhash64(F.lit(7), c).alias("h"), F.col(c).alias("v"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): nodes of one component, and only they, share a root. Nodes without edges to others are absent."""
    live = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    live = staged(live, "edges")
    levels: list[DataFrame] = []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(_mixed("b")).alias("m"))
        own = _mixed("a")
        pointer = staged(least.select(F.col("a").alias("node"), F.least("m", own)["v"].alias("to")), "pointers")
        levels.append(pointer)
        left = live.join(pointer, F.col("a") == F.col("node")).select(F.col("to").alias("a"), "b")
        live = left.join(pointer, F.col("b") == F.col("node")).select("a", F.col("to").alias("b")).where("a <> b")
        live = staged(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not levels:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node that a later round knows goes on from there; the chain ends at the last round's pointer.
    labels = levels[-1].select("node", F.col("to").alias("root"))
    for pointer in reversed(levels[:-1]):
        nxt = labels.select(F.col("node").alias("n"), "root")
        labels = pointer.join(nxt, F.col("to") == F.col("n"), "left").select("node", F.coalesce("root", "to").alias("root"))
    return labels
