"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources in code point order, null last, get weights that repeat; they share the
total of all sizes by weight, no source more than ``max_copies`` times its size, the
excess going to the others by weight (water filling over the sources in order of the
level at which each is full).

Within a source a document's expected copies are proportional to its ``measure``, at most
``max_copies``, and such that the words expected reach the target. The whole part is
allocated for certain. The fraction is an inclusion probability p: with u a hash of the
row in (0, 1), the Pareto rank is u/(1-u) divided by p/(1-p). Documents are taken in rank
order until the source's missing words are reached; the one at the cut gives just the
words still missing, so the sample's size in words is fixed.

No source is ever sorted as a whole: ranks are dealt to ``bins``, the words of bins are
summed before a shuffle, and only the rows of the one bin at the cut are ordered. Plans
have a row per source and measure value, so ``measure`` should have few values. They are
written once and joined by size (Spark broadcasts them only below its threshold).

Null texts have size 0 and take 0. Rows alike in id and text have one rank and share
equally what they take together (whole words each). Of a text of any length only its number of words
counts. An empty table gives an empty result. Only
the columns named here are read; other columns may have any names but the five in
``PREPARED`` and those of the results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged

WEIGHTS, MAX_COPIES, BINS, SEED = (5.0, 2.0, 1.0), 3.0, 4096, 20240
PREPARED = ("mix_id", "mix_hash", "mix_source", "mix_size", "mix_measure")
_TINY = 1e-9


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"(?:^|[\x20\x09-\x0D])" + WORD[:-1])), F.lit(0)).cast("long")


def length_class(size: str) -> Column:
    """A measure of few values: 1 plus the binary order of the size."""
    return F.floor(F.log2(F.col(size) + F.lit(1.0))).cast("double") + 1.0


@dataclass
class Plan:
    classes: DataFrame  # source, measure, whole, p, missing, source_size, target
    cuts: DataFrame  # source, cut, before
    edge: DataFrame  # source, id, text hash, part: rows of the cut's bin


def _with_rank(rows: DataFrame, seed: int, bins: int) -> DataFrame:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_id", "mix_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    odds = (u / (1 - u)) / (F.col("mix_p") / (1 - F.col("mix_p")))
    rank = F.when((F.col("mix_p") > 0) & (F.col("mix_size") > 0), odds / (1 + odds))
    rows = rows.withColumn("mix_rank", rank)
    return rows.withColumn("mix_bin", F.least(F.floor(F.col("mix_rank") * bins), F.lit(bins - 1)).cast("long"))


def prepare(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` with mix_id, mix_hash, mix_source, mix_size and mix_measure."""
    rows = docs.withColumns({"mix_id": F.col(doc_id), "mix_hash": F.xxhash64(text), "mix_source": F.col(source), "mix_size": word_count(text)})
    return rows.withColumn("mix_measure", length_class("mix_size"))


def plan_mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: float = MAX_COPIES, bins: int = BINS, seed: int = SEED) -> Plan:
    """Decide a mix of ``prepare``d rows."""
    rows = rows.select("mix_id", "mix_hash", "mix_source", "mix_size", "mix_measure")
    classes = staged(rows.groupBy("mix_source", "mix_measure").agg(F.sum("mix_size").alias("words")), "mix-classes")

    # One row per source from here on: windows over all of them are small.
    everything = Window.partitionBy()
    by_source = classes.groupBy("mix_source").agg(F.sum("words").alias("source_size"))
    position = F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (position % len(weights) + 1).cast("int"))
    cap = F.lit(max_copies) * F.col("source_size")
    level = Window.orderBy("full_at", F.col("mix_source").asc_nulls_last())
    earlier, later = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    by_source = by_source.withColumn("weight", weight).withColumn("full_at", cap / F.col("weight"))
    by_source = by_source.withColumns({
        "total": F.sum("source_size").over(everything),
        "capped": F.coalesce(F.sum(cap).over(earlier), F.lit(0.0)),
        "open_weight": F.sum("weight").over(later),
    }).withColumn("share", (F.col("total") - F.col("capped")) / F.col("open_weight"))
    reached = F.min(F.when(F.col("share") <= F.col("full_at"), F.struct("full_at", "share"))).over(everything)["share"]
    by_source = by_source.withColumn("target", F.least(cap, F.coalesce(reached * F.col("weight"), cap))).select("mix_source", "source_size", "target")

    # Expected copies by measure within a source.
    own = Window.partitionBy("mix_source").orderBy(F.col("mix_measure").desc())
    before, rest = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(0, Window.unboundedFollowing)
    per = classes.withColumnRenamed("mix_source", "s").join(by_source, F.col("s").eqNullSafe(F.col("mix_source"))).drop("s")
    per = per.withColumns({"full": F.coalesce(F.sum("words").over(before), F.lit(0)) * F.lit(max_copies), "open": F.sum(F.col("words") * F.col("mix_measure")).over(rest)})
    per = per.withColumn("rate", F.when(F.col("open") > 0, (F.col("target") - F.col("full")) / F.col("open")))
    mine = Window.partitionBy("mix_source")
    first_open = F.max(F.when(F.col("rate") * F.col("mix_measure") <= max_copies + _TINY, F.struct("mix_measure", "rate"))).over(mine)["rate"]
    copies = F.coalesce(F.least(F.lit(max_copies), first_open * F.col("mix_measure")), F.lit(0.0))
    per = per.withColumn("copies", copies).withColumn("mix_whole", F.floor(F.col("copies") + _TINY).cast("long"))
    fraction = F.col("copies") - F.col("mix_whole")
    per = per.withColumn("mix_p", F.when(fraction > _TINY, fraction).otherwise(0.0))
    per = per.withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("mix_whole") * F.col("words")).over(mine)))
    per = staged(per.select("mix_source", "mix_measure", "mix_whole", "mix_p", "missing", "source_size", "target"), "mix-plan")

    # The bin at each source's cut.
    ranked = _with_rank(_classed(rows, per), seed, bins).where("mix_rank is not null")
    summed = ranked.groupBy("mix_source", "mix_bin", "missing").agg(F.sum("mix_size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("mix_source").orderBy("mix_bin"))
    summed = summed.withColumns({"upto": upto, "missing": F.least("missing", F.sum("words").over(mine).cast("double"))})
    cuts = summed.where("upto - words < missing and missing <= upto")
    cuts = staged(cuts.select("mix_source", F.col("mix_bin").alias("cut"), (F.col("upto") - F.col("words")).alias("before")), "mix-cuts")

    # Order within that bin alone; rows alike in id and text count as one.
    edge = _cut(ranked, cuts).where("mix_bin = cut")
    edge = edge.groupBy("mix_source", "mix_rank", "mix_id", "mix_hash", "mix_size", "missing", "before").agg(F.count("*").alias("n"))
    upto = F.sum(F.col("mix_size") * F.col("n")).over(Window.partitionBy("mix_source").orderBy("mix_rank", "mix_id", "mix_hash", "mix_size"))
    left = F.col("missing") - F.col("before") - (upto - F.col("mix_size") * F.col("n"))
    part = F.floor(F.greatest(F.lit(0.0), F.least(left / F.col("n"), F.col("mix_size").cast("double"))) + _TINY).cast("long")
    edge = staged(edge.select("mix_source", "mix_id", "mix_hash", part.alias("edge_part")), "mix-edge")
    return Plan(per, cuts, edge)


def _classed(rows: DataFrame, per: DataFrame) -> DataFrame:
    plan = per.select(F.col("mix_source").alias("s"), F.col("mix_measure").alias("m"), "mix_whole", "mix_p", "missing", "source_size", "target")
    return rows.join(plan, F.col("s").eqNullSafe(F.col("mix_source")) & (F.col("m") == F.col("mix_measure")), "left").drop("s", "m")


def _cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    c = cuts.withColumnRenamed("mix_source", "s")
    return rows.join(c, F.col("s").eqNullSafe(F.col("mix_source")), "left").drop("s")


def apply_mix(rows: DataFrame, plan: Plan, bins: int = BINS, seed: int = SEED) -> DataFrame:
    """``prepare``d rows with source_size, target, mix_copies (whole copies) and mix_part (words of one more, partial copy)."""
    rows = _cut(_with_rank(_classed(rows, plan.classes), seed, bins), plan.cuts)
    edge = plan.edge.select(F.col("mix_source").alias("s"), F.col("mix_id").alias("i"), F.col("mix_hash").alias("h"), "edge_part")
    same = F.col("s").eqNullSafe(F.col("mix_source")) & F.col("i").eqNullSafe(F.col("mix_id")) & F.col("h").eqNullSafe(F.col("mix_hash"))
    rows = rows.join(edge, same, "left").drop("s", "i", "h")
    sampled = F.when(F.col("mix_bin") < F.col("cut"), F.col("mix_size")).when(F.col("mix_bin") == F.col("cut"), F.coalesce("edge_part", F.lit(0)))
    sampled = F.coalesce(sampled, F.lit(0)).cast("long")
    whole = F.coalesce("mix_whole", F.lit(0))
    complete = (sampled == F.col("mix_size")) & (F.col("mix_size") > 0)
    return rows.withColumns({"mix_copies": (whole + complete.cast("long")).cast("long"), "mix_part": F.when(complete, 0).otherwise(sampled).cast("long")}).drop(
        "mix_whole", "mix_p", "missing", "mix_rank", "mix_bin", "cut", "before", "edge_part"
    )


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text with the white space between them."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, plan: Plan, text: str = "text", bins: int = BINS, seed: int = SEED) -> DataFrame:
    """The mix itself: each of the ``prepare``d rows as often as taken, the part at a cut shortened."""
    names = [c for c in docs.columns if c not in PREPARED]
    rows = apply_mix(docs, plan, bins, seed).withColumn("mix_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies") + 1)))
    rows = rows.where((F.col("mix_k") <= F.col("mix_copies")) | (F.col("mix_part") > 0))
    short = (F.col("mix_k") > F.col("mix_copies")) & (F.col("mix_part") > 0)
    cut = F.when(short, first_words(F.col(text), F.col("mix_part"))).otherwise(F.col(text))
    rows = rows.withColumn(text, cut)
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(short, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*names)
