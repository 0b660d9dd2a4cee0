"""Operators over block images: a row (vol_id or none, addr, content) per block that isn't zero."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stage import staged
from .catalog import plan_restore
from .changes import block_content, change_stats, winners
from .extent import STRIPE, cut_at_stripes

DISCARD_MODES = ("ignore", "passdown", "zero")


def in_range(changes: DataFrame, size: int) -> DataFrame:
    """The changes; a record beyond a device of ``size`` blocks is an error when rows are read."""
    over = F.col("addr") + F.col("blocks") > size
    what = F.concat(F.lit("a record of volume "), F.col("vol_id").cast("string"), F.lit(" ends beyond the device: block "), (F.col("addr") + F.col("blocks")).cast("string"))
    return changes.withColumn("addr", F.when(over, F.raise_error(what)).otherwise(F.col("addr")))


def clip(changes: DataFrame, size: int) -> DataFrame:
    """Records cut at a device's end; those beyond it go."""
    return changes.where(F.col("addr") < size).withColumn("blocks", F.least(F.col("blocks"), size - F.col("addr")))


def apply_runs(image: DataFrame, runs: DataFrame, discard: str = "ignore") -> DataFrame:
    """Disjoint runs (rec_type, token, off) laid over an image (vol_id, addr, content).

    Only normal runs become blocks. Blocks of a stripe that no run touches pass through. In the
    others the end of the last run before a block is a running maximum in order of address, as
    runs are disjoint; a stripe has at most its blocks and as many runs, so groups are bounded.
    """
    if discard not in DISCARD_MODES:
        raise ValueError(f"discard must be one of {DISCARD_MODES}")
    gone = ("Normal", "Allzero") if discard == "ignore" else ("Normal", "Allzero", "Discard")
    ranges = cut_at_stripes(runs.where(F.col("rec_type").isin(*gone)).select("vol_id", "addr", "blocks"))
    ranges = ranges.select("vol_id", "stripe", "addr", (F.col("addr") + F.col("blocks")).alias("end"))
    touched = ranges.select(F.col("vol_id").alias("v"), F.col("stripe").alias("s")).distinct()
    base = image.select("vol_id", "addr", "content", F.shiftright("addr", STRIPE.bit_length() - 1).alias("stripe"))
    same = (F.col("vol_id") == F.col("v")) & (F.col("stripe") == F.col("s"))
    apart = base.join(touched, same, "left_anti").select("vol_id", "addr", "content")
    under = base.join(touched, same, "left_semi").select("vol_id", "stripe", "addr", F.lit(None).cast("long").alias("end"), "content", F.lit(1).alias("kind"))
    both = under.unionByName(ranges.withColumns({"content": F.lit(None).cast("string"), "kind": F.lit(0)}))
    w = Window.partitionBy("vol_id", "stripe").orderBy("addr", "kind").rowsBetween(Window.unboundedPreceding, 0)
    left = both.withColumn("covered", F.max("end").over(w)).where("kind = 1 and (covered is null or covered <= addr)").select("vol_id", "addr", "content")
    new = cut_at_stripes(runs.where("rec_type = 'Normal'").select("vol_id", "addr", "blocks", "token", F.col("off").alias("from")))
    new = new.withColumn("k", F.explode(F.expr("sequence(from + off, from + off + blocks - 1)")))
    new = new.select("vol_id", (F.col("addr") + F.col("k") - F.col("from") - F.col("off")).alias("addr"), block_content().alias("content"))
    return apart.unionByName(left).unionByName(new)


def apply_changes(image: DataFrame, changes: DataFrame, discard: str = "ignore", size: int | None = None, cut: int | None = None) -> DataFrame:
    """Changes applied in the order of ``seq``. With ``ignore``, discards take no part. Beyond ``size`` is an error; ``cut`` clips instead."""
    if discard == "ignore":
        changes = changes.where("rec_type <> 'Discard'")
    if size is not None:
        changes = in_range(changes, size)
    return apply_runs(image, winners(changes if cut is None else clip(changes, cut)), discard)


def _of_plan(changes: DataFrame, plan: DataFrame) -> DataFrame:
    """The records of the change sets (gid) that each volume's planned diffs hold: those after its first and up to its last gid."""
    span = plan.groupBy(F.col("vol_id").alias("v")).agg(F.min("b_b").alias("from_gid"), F.max("e_b").alias("to_gid"))
    return changes.join(span, (F.col("vol_id") == F.col("v")) & (F.col("gid") > F.col("from_gid")) & (F.col("gid") <= F.col("to_gid"))).drop("v", "from_gid", "to_gid")


def start_images(base: DataFrame, targets: DataFrame, cold: DataFrame | None) -> DataFrame:
    """(vol_id, b_b, b_e, is_cold): the newest restored gid not after the target and newer than the base, else the base."""
    own = base.join(targets.select("vol_id", "gid"), "vol_id").select("vol_id", "b_b", "b_e", "gid")
    if cold is None:
        return own.select("vol_id", "b_b", "b_e", F.lit(False).alias("is_cold"))
    c = cold.select(F.col("vol_id").alias("v"), F.col("gid").alias("cold_gid")).distinct()
    best = own.join(c, (F.col("vol_id") == F.col("v")) & (F.col("cold_gid") <= F.col("gid")) & (F.col("cold_gid") > F.col("b_b")), "left")
    best = best.groupBy("vol_id", "b_b", "b_e").agg(F.max("cold_gid").alias("c"))
    return best.select("vol_id", F.coalesce("c", "b_b").alias("b_b"), F.coalesce("c", "b_e").alias("b_e"), F.col("c").isNotNull().alias("is_cold"))


def image_at(image: DataFrame, diffs: DataFrame, base: DataFrame, changes: DataFrame, targets: DataFrame, cold: DataFrame | None = None, clean: bool = False) -> DataFrame:
    """A virtual full scan of each (vol_id, gid) of ``targets`` (one a volume) that the chain reaches exactly.

    The start is the newest of ``cold`` (vol_id, gid, addr, content: restored images) that serves,
    else ``image``. Discard and Allzero both read as zero. ``clean``: only clean snapshots count.
    """
    start = staged(start_images(base, targets, cold), "starts")  # a row a volume
    plan = staged(plan_restore(diffs, start, targets, exact_clean=clean), "plan")  # a row a diff
    here = start.join(targets.select("vol_id", "gid"), "vol_id").where("b_b = gid" + (" and b_b = b_e" if clean else "")).select("vol_id")
    reached = plan.select("vol_id").distinct().unionByName(here)
    own = start.join(reached, "vol_id", "left_semi").select(F.col("vol_id").alias("v"), F.col("b_b").alias("at"), "is_cold")
    blocks = image.join(own.where("not is_cold"), F.col("vol_id") == F.col("v"), "left_semi").select("vol_id", "addr", "content")
    if cold is not None:
        blocks = blocks.unionByName(cold.join(own.where("is_cold"), (F.col("vol_id") == F.col("v")) & (F.col("gid") == F.col("at")), "left_semi").select("vol_id", "addr", "content"))
    return apply_runs(blocks, staged(winners(_of_plan(changes, plan)), "runs"), "zero")


def restore(image: DataFrame, diffs: DataFrame, base: DataFrame, changes: DataFrame, targets: DataFrame, cold: DataFrame | None = None) -> DataFrame:
    """The images of clean snapshots, to be written as new versions: (vol_id, gid, addr, content)."""
    got = image_at(image, diffs, base, changes, targets, cold, clean=True)
    return got.join(targets.select("vol_id", "gid"), "vol_id").select("vol_id", "gid", "addr", "content")


def redo_counts(changes: DataFrame, mode: str, size: int | None = None) -> DataFrame:
    """Blocks by kind that a redo writes on a device of ``size`` blocks, those that it ignores, and those clipped at the end."""
    end = F.lit(size) if size is not None else F.col("addr") + F.col("blocks")
    inside = F.greatest(F.lit(0), F.least(F.col("addr") + F.col("blocks"), end) - F.col("addr")).cast("long")
    rows = changes.withColumn("out", F.col("blocks") - inside).withColumn("blocks", inside)
    got = change_stats(rows, ["vol_id"]).select("vol_id", "normal_blocks", "allzero_blocks", "discard_blocks")
    gone = rows.groupBy("vol_id").agg(F.sum("out").cast("long").alias("clipped_blocks"))
    ignored = F.col("discard_blocks") if mode == "ignore" else F.lit(0).cast("long")
    return got.withColumn("ignored_blocks", ignored).withColumn("discard_blocks", F.col("discard_blocks") - ignored).join(gone, "vol_id")


def redo_io_counts(changes: DataFrame, mode: str, size: int) -> DataFrame:
    """Records that a redo of a change set reads, and those that it writes: not beyond the device, nor ignored discards."""
    done = F.col("addr") + F.col("blocks") <= size
    done &= F.lit(True) if mode != "ignore" else F.col("rec_type") != "Discard"
    return changes.groupBy("vol_id").agg(F.count("*").alias("n_in"), F.count_if(done).alias("n_out"), F.sum("blocks").cast("long").alias("blocks_in"), F.coalesce(F.sum(F.when(done, F.col("blocks"))), F.lit(0)).cast("long").alias("blocks_out"))


def _beside(a: DataFrame, b: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """Both sides' rows by keys, in a full join: the keys, the left's columns and the right's ``values`` by their new names."""
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(c).alias(n) for c, n in values.items()])
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__{k}") for k in keys])
    return a.join(right, same, "full").withColumns({k: F.coalesce(k, f"__{k}") for k in keys}).drop(*[f"__{k}" for k in keys])


def image_diff(a: DataFrame, b: DataFrame, size: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Addresses below ``size`` whose content differs, by the columns of ``by`` (a volume, say) where given; an absent block is zero."""
    keys = [*(by or []), "addr"]
    both = _beside(a.select(*keys, "content"), b, keys, {"content": "b_content"})
    both = both.where(F.col("addr") < size) if size is not None else both
    return both.where(~F.col("content").eqNullSafe(F.col("b_content"))).select(*keys, "content", "b_content")


def image_diff_counts(a: DataFrame, b: DataFrame, size: int) -> DataFrame:
    """(n_differ, n_checked) of two images up to the end of the shorter, ``size`` blocks."""
    return image_diff(a, b, size).agg(F.count("*").alias("n_differ")).withColumn("n_checked", F.lit(size).cast("long"))


def image_diff_mask(diff: DataFrame) -> DataFrame:
    """``_`` where a byte of the two contents agrees, ``X`` where it doesn't."""
    own = lambda c: F.coalesce(F.col(c), F.lit("0").cast(diff.schema[c].dataType))
    each = lambda c: F.regexp_extract_all(F.hex(own(c).cast("binary")), F.lit("(..)"))
    mask = F.zip_with(each("content"), each("b_content"), lambda x, y: F.when(x.eqNullSafe(y), "_").otherwise("X"))
    return diff.select("addr", F.array_join(mask, "").alias("mask"))


def _chunk(bulk: int, begin: int = 0) -> Column:
    return (F.floor((F.col("addr") - begin) / bulk) * bulk + begin).cast("long")


def _digest(blocks: str) -> Column:
    """sha256 of a column of blocks (addr, content) in order."""
    return F.sha2(F.array_join(F.transform(blocks, lambda x: F.concat_ws("=", x["addr"].cast("string"), x["content"])), ","), 256)


def chunk_digest(image: DataFrame, chunk_blocks: int, begin: int = 0, end: int | None = None, by: list[str] | None = None) -> DataFrame:
    """sha256 of each chunk's blocks in order; chunks without blocks are all zero and absent."""
    by = by or []
    rows = image.where(F.col("addr") >= begin)
    rows = rows.where(F.col("addr") < end) if end is not None else rows
    got = rows.groupBy(*by, _chunk(chunk_blocks, begin).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("addr", "content"))).alias("b"))
    return got.select(*by, "chunk", _digest("b").alias("digest"))


FAN_IN = 4096


def folded_digest(rows: DataFrame, by: list[str], position: str, levels: int = 3, fan_in: int = FAN_IN) -> DataFrame:
    """One digest a group of digests at positions from 0: a tree of ``levels``, each node of at most ``fan_in``, so no row holds more."""
    got = rows.select(*by, F.col(position).alias("p"), "digest")
    for level in range(levels):
        up = F.floor(F.col("p") / fan_in) if level < levels - 1 else F.lit(0)
        got = got.groupBy(*by, up.cast("long").alias("q")).agg(F.array_sort(F.collect_list(F.struct("p", "digest"))).alias("d"))
        got = got.select(*by, F.col("q").alias("p"), F.sha2(F.array_join(F.transform("d", lambda x: x["digest"]), ","), 256).alias("digest"))
    return got.select(*by, "digest")


def image_digest(image: DataFrame, chunk_blocks: int, by: list[str]) -> DataFrame:
    """One digest per image: a tree of sha256 over its chunk digests in order."""
    d = chunk_digest(image, chunk_blocks, by=by)
    return folded_digest(d.withColumn("p", F.floor(F.col("chunk") / chunk_blocks)), by, "p")


def differing_chunks(src: DataFrame, dst: DataFrame, bulk: int, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "chunk"]
    both = _beside(chunk_digest(src, bulk, by=by), chunk_digest(dst, bulk, by=by), keys, {"digest": "b_digest"})
    return both.where(~F.col("digest").eqNullSafe(F.col("b_digest"))).select(*keys)


def _chunks_beside(src: DataFrame, dst: DataFrame, bulk: int, by: list[str] | None) -> DataFrame:
    """Chunks of both images, each dealt once, with their blocks in order and ``same``: whether digests agree. A row holds ``bulk`` blocks a side at most."""
    keys = [*(by or []), "chunk"]

    def held(image: DataFrame) -> DataFrame:
        got = image.groupBy(*(by or []), _chunk(bulk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("addr", "content"))).alias("blocks"))
        return got.withColumn("digest", _digest("blocks"))

    both = _beside(held(src), held(dst), keys, {"blocks": "b_blocks", "digest": "b_digest"})
    none = F.array().cast(both.schema["blocks"].dataType)
    return both.select(*keys, F.coalesce("blocks", none).alias("blocks"), F.coalesce("b_blocks", none).alias("b_blocks"), F.col("digest").eqNullSafe(F.col("b_digest")).alias("same"))


def hash_sync(src: DataFrame, dst: DataFrame, bulk: int, by: list[str] | None = None) -> DataFrame:
    """The blocks of ``src`` and the zeroed blocks of ``dst`` in chunks whose digests differ: (columns of ``by``, addr, content or null)."""
    both = _chunks_beside(src, dst, bulk, by).where("not same")
    at = lambda c: F.transform(c, lambda x: x["addr"])
    none = F.lit(None).cast(both.schema["blocks"].dataType.elementType["content"].dataType)
    gone = F.transform(F.array_except(at("b_blocks"), at("blocks")), lambda x: F.struct(x.alias("addr"), none.alias("content")))
    return both.select(*(by or []), F.explode(F.concat("blocks", gone)).alias("x")).select(*(by or []), "x.addr", "x.content")


def sync_meta(snaps: DataFrame) -> DataFrame:
    """The diff that a sync from one snapshot to another (vol_id, from_b, from_e, to_b, to_e) makes: mergeable unless it starts at a clean, restorable one."""
    return snaps.select(
        "vol_id", F.col("from_b").alias("b_b"), F.col("from_e").alias("b_e"), F.col("to_b").alias("e_b"), F.col("to_e").alias("e_e"),
        (F.col("from_b") != F.col("from_e")).alias("is_mergeable"), F.lit(False).alias("is_comp_diff"),
    )


def hash_replicate(src: DataFrame, dst: DataFrame, bulk: int) -> DataFrame:
    """``hash_sync`` as a compared diff, mergeable."""
    return hash_sync(src, dst, bulk).withColumns({"is_comp_diff": F.lit(True), "is_mergeable": F.lit(True)})


def patch(dst: DataFrame, delta: DataFrame, by: list[str] | None = None) -> DataFrame:
    """An image with (columns of ``by``, addr, content) laid over it; null content clears a block."""
    keys = [*(by or []), "addr"]
    kept = dst.join(delta.select(*keys), keys, "left_anti").select(*keys, "content")
    return kept.unionByName(delta.where("content is not null").select(*keys, "content"))


def resync(src: DataFrame, dst: DataFrame, bulk: int, by: list[str] | None = None) -> DataFrame:
    """``dst`` made equal to ``src`` by the chunks that differ."""
    laid = F.when(F.col("same"), F.col("b_blocks")).otherwise(F.filter("blocks", lambda x: x["content"].isNotNull()))
    return _chunks_beside(src, dst, bulk, by).select(*(by or []), F.explode(laid).alias("x")).select(*(by or []), "x.addr", "x.content")


def copy_start(current: DataFrame, progress: DataFrame) -> DataFrame:
    """Where a full copy goes on: (vol_id, start_block, resumed).

    ``current``: vol_id, archive_uuid, gid_b, gid_e, size; ``progress``: the same but size, and
    progress. A copy resumes only for the same archive and state, and within the size.
    """
    p = progress.select(F.col("vol_id").alias("v"), F.col("archive_uuid").alias("u"), F.col("gid_b").alias("b"), F.col("gid_e").alias("e"), "progress")
    same = (F.col("vol_id") == F.col("v")) & (F.col("archive_uuid") == F.col("u")) & (F.col("gid_b") == F.col("b")) & (F.col("gid_e") == F.col("e")) & (F.col("progress") <= F.col("size"))
    return current.join(p, same, "left").select("vol_id", F.coalesce("progress", F.lit(0).cast("long")).alias("start_block"), F.col("progress").isNotNull().alias("resumed"))


def full_copy(image: DataFrame, starts: DataFrame, bulk: int = 64) -> DataFrame:
    """Chunks (vol_id, chunk, n_blocks) to send from each volume's start on; all-zero chunks have no rows and are skipped."""
    rows = image.join(starts.select("vol_id", "start_block"), "vol_id").where("addr >= start_block")
    return rows.groupBy("vol_id", _chunk(bulk).alias("chunk")).agg(F.count("*").alias("n_blocks"))


def grow_image(sizes: DataFrame, image: DataFrame, new_size: int) -> tuple[DataFrame, DataFrame]:
    """Larger sizes (vol_id, size), and each volume's image with nothing left beyond its old size; a smaller size is an error row."""
    grown = sizes.withColumn("error", F.when(F.col("size") > new_size, "shrink")).withColumn("size", F.greatest("size", F.lit(new_size).cast("long")))
    old = sizes.select("vol_id", F.col("size").alias("old_size"))
    return grown, image.join(old, "vol_id").where("addr < old_size").drop("old_size")


def range_change_events(samples: DataFrame) -> DataFrame:
    """Samples (range_id, ts, digest) that differ from the one before them; the first counts."""
    w = Window.partitionBy("range_id").orderBy("ts")
    return samples.withColumn("before", F.lag("digest").over(w)).where("not (digest <=> before)").select("range_id", "ts", "digest")


def bulk_checksum(image: DataFrame, bulk: int) -> DataFrame:
    """Additive sums of each bulk's blocks in order."""
    from ..functions.checksum import block_sum

    got = image.groupBy(_chunk(bulk).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("addr", "content"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["content"]), "")
    return got.select("chunk", block_sum(F.encode(text, "UTF-8"), F.lit(0).cast("long")).alias("sum"))


def verify_image_recipe(image: DataFrame, recipe: DataFrame) -> DataFrame:
    """Whether the blocks of each recipe line hold that line's content.

    Lines with content are compared block by block. A line of zeros or of a discard (csum Z or null) is right if
    as many of the image's blocks lie before its end as before its start, however long it is.
    """
    zero = F.col("csum").isNull() | (F.col("csum") == "Z")
    own = image.select("vol_id", "addr", "content")
    data = recipe.where(~zero & (F.col("blocks") > 0)).withColumn("k", F.explode(F.expr("sequence(0L, blocks - 1)")))
    data = data.select("vol_id", "ord", (F.col("addr") + F.col("k")).alias("addr"), block_content("csum").alias("want"))
    held = data.join(own, ["vol_id", "addr"], "left").groupBy("vol_id", "ord").agg(F.bool_and(F.col("want").eqNullSafe(F.col("content"))).alias("ok"))
    cut = cut_at_stripes(recipe.where(zero & (F.col("blocks") > 0)).select("vol_id", "ord", "addr", "blocks"))
    ends = F.explode(F.array(F.struct(F.col("addr").alias("pos"), F.lit(-1).alias("sign")), F.struct((F.col("addr") + F.col("blocks")).alias("pos"), F.lit(1).alias("sign")))).alias("x")
    edges = cut.select("vol_id", "stripe", "ord", ends).select("vol_id", "stripe", "ord", "x.pos", "x.sign")
    at = own.select("vol_id", F.shiftright("addr", STRIPE.bit_length() - 1).alias("stripe"), F.lit(None).cast("long").alias("ord"), F.col("addr").alias("pos"), F.lit(0).alias("sign"))
    w = Window.partitionBy("vol_id", "stripe").orderBy("pos", F.col("sign") == 0).rowsBetween(Window.unboundedPreceding, 0)  # an edge comes before the block at it
    counted = edges.unionByName(at).withColumn("before", F.count_if(F.col("sign") == 0).over(w)).where("sign <> 0")
    empty = counted.groupBy("vol_id", "ord").agg((F.sum(F.col("sign") * F.col("before")) == 0).alias("ok"))
    return held.unionByName(empty)


def tree_digest(files: DataFrame, depth: int = 1) -> DataFrame:
    """sha256 of each file (path, content) and of each folder, up to ``depth`` levels above the files: its entries' names and digests, in order of name."""
    level = files.select("path", F.sha2("content", 256).alias("digest"))
    out = level
    for _ in range(depth):
        split = level.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "digest")
        at = F.row_number().over(Window.partitionBy("folder").orderBy("name")) - 1
        own = split.select("folder", at.alias("p"), F.sha2(F.concat_ws("=", "name", "digest"), 256).alias("digest"))
        level = folded_digest(own, ["folder"], "p").withColumnRenamed("folder", "path")
        out = out.unionByName(level)
    return out


def file_digests(spark: SparkSession, path: str, piece: int = 1 << 26) -> DataFrame:
    """(path, digest, modified) of the files under a folder, their paths from there. A file of over ``piece`` bytes is read in ranges by many tasks: its digest is that of its ranges' digests."""
    import hashlib

    from ..sources.ranges import file_system, list_tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, start, end in zip(*(b.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
                fs, at = file_system(name)
                h = hashlib.sha256()
                with fs.open_input_file(at) as f:
                    for k in range(start, end, 1 << 23):
                        h.update(f.read_at(min(1 << 23, end - k), k))
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("start"), pa.array(out, pa.string())], ["path", "start", "digest"])

    found = staged(list_tree(spark, path), "files")
    ranges = found.select("path", "length", F.explode(F.expr(f"sequence(0L, greatest(length - 1, 0L), {piece}L)")).alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + piece, F.col("length")).alias("end"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = staged(ranges.repartition(width, "path", "start").mapInArrow(run, "path string, start bigint, digest string"), "piece-digests")
    whole = found.select("path", "length", "modificationTime", (F.col("length") > piece).alias("cut"))
    one = pieces.join(whole.where("not cut").select("path"), "path").select("path", "digest")
    many = folded_digest(pieces.join(whole.where("cut").select("path"), "path").withColumn("p", F.expr(f"start div {piece}")), ["path"], "p")
    root = re.sub(r"^file:/*", "/", path).rstrip("/") if path.startswith("file:") else path.rstrip("/")
    got = one.unionByName(many).join(whole.select("path", "modificationTime"), "path")
    return got.select(F.regexp_replace("path", "^(file:)?/*" + re.escape(root.lstrip("/")) + "/", "").alias("path"), "digest", F.col("modificationTime").alias("modified"))


def folder_digests(spark: SparkSession, path: str, times: bool = False, piece: int = 1 << 26) -> DataFrame:
    """(path, digest) of every file and folder under a folder, whose own path is empty: a folder's is that of its entries' names and digests, in order of name.

    Folders are folded from the deepest level that the data has upwards. ``times`` takes the files'
    times of change into their folders' digests. Spark lists no empty files, so these, and folders that hold nothing else, take no part.
    """
    stamp = F.concat_ws("@", "digest", F.unix_micros("modified").cast("string")) if times else F.col("digest")
    files = file_digests(spark, path, piece).select("path", "digest", stamp.alias("entry"), F.size(F.split("path", "/")).alias("depth"))
    files = staged(files, "file-digests")
    deepest = files.agg(F.max("depth")).first()[0] or 0
    out, folders = files.select("path", "digest"), None
    for depth in range(deepest, 0, -1):
        level = files.where(F.col("depth") == depth).select("path", "entry")
        level = level if folders is None else level.unionByName(folders)
        split = level.select(F.regexp_extract("path", "^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "entry")
        at = F.row_number().over(Window.partitionBy("folder").orderBy("name")) - 1
        own = split.select("folder", at.alias("p"), F.sha2(F.concat_ws("=", "name", "entry"), 256).alias("digest"))
        done = staged(folded_digest(own, ["folder"], "p").withColumnRenamed("folder", "path"), "folder-digests")
        out, folders = out.unionByName(done), done.select("path", F.col("digest").alias("entry"))
    return out
