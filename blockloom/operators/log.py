"""Operators over write logs (one row per record, or per pack)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .extent import covered_blocks


def log_scan(records: DataFrame, begin: int, end: int) -> DataFrame:
    """Records of an lsid window, end exclusive."""
    return records.where((F.col("lsid") >= begin) & (F.col("lsid") < end))


def log_stats(records: DataFrame, pbs: int = 512) -> DataFrame:
    """Packs, lsid bounds and blocks by kind of each volume; padding counts physical blocks."""
    plain = ~F.col("is_padding") & ~F.col("is_discard")
    total = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0)).cast("long")
    return records.groupBy("vol_id").agg(
        F.count_distinct("pack_lsid").alias("n_packs"), F.min("pack_lsid").alias("begin_lsid"), F.max("next_lsid").alias("end_lsid"),
        total(plain, F.col("blocks")).alias("normal_blocks"), total(F.col("is_discard"), F.col("blocks")).alias("discard_blocks"),
        total(F.col("is_padding"), F.ceil(F.col("blocks") * 512 / pbs)).alias("padding_pb"),
    )


def log_invalid_ranges(packs: DataFrame) -> DataFrame:
    """Ranges of lsids without a valid pack, between one pack's end and the next pack."""
    w = Window.partitionBy("vol_id").orderBy("pack_lsid")
    gaps = packs.withColumn("begin", F.lag("next_lsid").over(w)).where("begin <> pack_lsid")
    return gaps.select("vol_id", F.col("begin").alias("begin_lsid"), F.col("pack_lsid").alias("end_lsid"))


def log_lookup(packs: DataFrame, lsids: DataFrame) -> DataFrame:
    """For each asked (vol_id, lsid) whether a valid pack begins there."""
    found = packs.select("vol_id", F.col("pack_lsid").alias("lsid"), F.lit(True).alias("found")).distinct()
    return lsids.join(found, ["vol_id", "lsid"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def log_valid_prefix(packs: DataFrame, bad=None) -> DataFrame:
    """Packs before a volume's first break (a gap, or a pack where ``bad`` holds)."""
    w = Window.partitionBy("vol_id").orderBy("pack_lsid")
    broken = F.coalesce(F.lag("next_lsid").over(w) != F.col("pack_lsid"), F.lit(False))
    broken = broken | bad if bad is not None else broken
    marked = packs.withColumn("broken", broken.cast("int"))
    upto = F.max("broken").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("broken", upto).where("broken = 0").drop("broken")


def shrink_packs(records: DataFrame, ok: str = "ok") -> DataFrame:
    """Packs cut at their first bad record: (vol_id, pack_lsid, n_records, n_padding, total_io_size, next_lsid).

    Records: vol_id, pack_lsid, rec_idx, blocks, is_padding, is_discard and the flag ``ok``.
    Sizes count what stays; discards take no log space. A pack without a good record at its
    head is left with none, and the next one begins where it did.
    """
    bad = records.groupBy("vol_id", "pack_lsid").agg(F.min(F.when(~F.col(ok), F.col("rec_idx"))).alias("cut"), F.count("*").alias("n"))
    rows = records.join(bad, ["vol_id", "pack_lsid"]).withColumn("stays", F.col("rec_idx") < F.coalesce("cut", "n"))
    space = F.when(F.col("stays") & ~F.col("is_discard"), F.col("blocks")).otherwise(0)
    got = rows.groupBy("vol_id", "pack_lsid").agg(F.count_if("stays").alias("n_records"), F.count_if(F.col("stays") & F.col("is_padding")).alias("n_padding"), F.sum(space).cast("long").alias("total_io_size"))
    return got.withColumn("next_lsid", F.when(F.col("n_records") > 0, F.col("pack_lsid") + 1 + F.col("total_io_size")).otherwise(F.col("pack_lsid")))


def log_rebase(records: DataFrame, delta: int, begin: int, invalid_from: int, dev_blocks: int) -> DataFrame:
    """Lsids moved by ``delta``; packs before ``begin`` and from ``invalid_from`` on left out; beyond the device normal records become padding, discards go."""
    kept = records.where((F.col("pack_lsid") >= begin) & (F.col("pack_lsid") < invalid_from))
    beyond = F.col("addr") + F.col("blocks") > dev_blocks
    kept = kept.where(~(beyond & F.col("is_discard")))
    padding = F.col("is_padding") | beyond
    return kept.withColumns({"is_padding": padding, "token": F.when(~padding, F.col("token")), **{c: F.col(c) + delta for c in ("pack_lsid", "lsid", "next_lsid")}})


def log_continuity(files: DataFrame) -> DataFrame:
    """Logs (vol_id, file_no, uuid, begin_lsid, end_lsid) that don't continue the one before them."""
    w = Window.partitionBy("vol_id").orderBy("file_no")
    f = files.withColumns({"prev_end": F.lag("end_lsid").over(w), "prev_uuid": F.lag("uuid").over(w)})
    f = f.withColumn("reason", F.when(F.col("prev_uuid") != F.col("uuid"), "uuid").when(F.col("prev_end") != F.col("begin_lsid"), "lsid"))
    return f.where("reason is not null").select("vol_id", "file_no", "prev_end", "begin_lsid", "reason")


def log_overwrite_stats(records: DataFrame, bs: int) -> DataFrame:
    """Units of ``bs`` bytes written and changed, and the rate written again; padding skipped, discards counted."""
    ratio = bs // 512
    real = records.where(~F.col("is_padding") & (F.col("blocks") > 0))
    written = real.groupBy("vol_id").agg(F.ceil(F.sum("blocks") / ratio).cast("long").alias("written"))
    got = written.join(covered_blocks(real, ["vol_id"], ratio).withColumnRenamed("covered", "changed"), "vol_id")
    return got.withColumn("rate", (F.col("written") - F.col("changed")) / F.col("written"))


def verify_log_recipe(records: DataFrame, recipe: DataFrame) -> DataFrame:
    """Position by position: whether address, size and checksum agree; missing on a side counts as wrong."""
    w = Window.partitionBy("vol_id").orderBy("lsid", "ev")
    log = records.where(~F.col("is_padding")).select("vol_id", F.row_number().over(w).cast("long").alias("ord"), "addr", "blocks", F.col("token").alias("csum"))
    r = recipe.select("vol_id", "ord", *[F.col(c).alias(f"r_{c}") for c in ("addr", "blocks", "csum")])
    both = log.join(r, ["vol_id", "ord"], "full")
    ok = {f"{c}_ok": F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in ("addr", "blocks", "csum")}
    return both.select("vol_id", "ord", *[x.alias(n) for n, x in ok.items()]).withColumn("ok", F.expr("addr_ok and blocks_ok and csum_ok"))


def verify_log_sums(records: DataFrame, recipe: DataFrame, payload: str = "payload") -> DataFrame:
    """Position by position, with both sums: the recipe's against the payload's with salt 0, the record's against the salted one.

    ``records`` has payload, checksum and salt, ``recipe`` a number csum. Of a record with data the
    sums decide alone; of others address and size do. What is missing on a side is wrong.
    """
    from ..functions.checksum import plain_sum, salted

    w = Window.partitionBy("vol_id").orderBy("lsid", "ev")
    own = records.where(~F.col("is_padding")).select("vol_id", F.row_number().over(w).cast("long").alias("ord"), "addr", "blocks", "checksum", "salt", (~F.col("is_discard")).alias("has_data"), plain_sum(F.col(payload)).alias("zero_sum"))
    r = recipe.select("vol_id", "ord", *[F.col(c).alias(f"r_{c}") for c in ("addr", "blocks", "csum")])
    both = own.withColumn("salted_sum", salted(F.col("zero_sum"), F.col("salt"))).join(r, ["vol_id", "ord"], "full")
    ok = {n: F.coalesce(F.col(a) == F.col(b), F.lit(False)) for n, a, b in (("addr_ok", "addr", "r_addr"), ("blocks_ok", "blocks", "r_blocks"), ("recipe_sum_ok", "r_csum", "zero_sum"), ("record_sum_ok", "checksum", "salted_sum"))}
    ok["ok"] = F.when(F.col("has_data") & F.col("r_addr").isNotNull(), ok["recipe_sum_ok"] & ok["record_sum_ok"]).otherwise(ok["addr_ok"] & ok["blocks_ok"])
    return both.select("vol_id", "ord", "zero_sum", "salted_sum", *[c.alias(n) for n, c in ok.items()])


def log_padding(records: DataFrame) -> DataFrame:
    """Packs that hold padding, with their number of such records."""
    return records.where("is_padding").groupBy("vol_id", "pack_lsid").agg(F.count("*").alias("n_padding"))


def log_checksum_audit(records: DataFrame, expected: str, payload: str = "payload", salt: str | None = None) -> DataFrame:
    """Records with data: the expected and actual payload sums, and ``ok``."""
    from ..functions.checksum import block_sum

    data = records.where(~F.col("is_padding") & ~F.col("is_discard"))
    actual = block_sum(F.col(payload), F.col(salt) if salt else F.lit(0).cast("long"))
    return data.withColumn("actual", actual).withColumn("ok", F.col("actual") == F.col(expected))


def log_block_checksums(records: DataFrame, pbs: int = 512, payload: str = "payload") -> DataFrame:
    """The sum of each physical block of each record's data."""
    from ..functions.checksum import block_sum

    parts = F.expr(f"transform(sequence(0, (octet_length({payload}) - 1) div {pbs}), i -> substring({payload}, i * {pbs} + 1, {pbs}))")
    data = records.where(~F.col("is_padding") & ~F.col("is_discard") & (F.octet_length(payload) > 0))
    rows = data.select("vol_id", "lsid", F.posexplode(parts).alias("k", "part"))
    return rows.select("vol_id", "lsid", F.col("k").cast("long").alias("k"), block_sum(F.col("part"), F.lit(0).cast("long")).alias("sum"))
