"""Sources: listings, text dumps, recipes, images, and binary logs and change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A change set's file name: time, mergeable flag, compared flag, two gids (clean) or four.
NAME = r"(\d{14})-([M-])([C-])-(\d+)-(\d+)(?:-(\d+)-(\d+))?\.wdiff$"
STAMP = "yyyyMMddHHmmss"


def catalog_from_listing(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalogue, rejected) of a listing (path, length, any other columns)."""
    part = lambda k: F.regexp_extract("path", NAME, k)
    gid = lambda k: part(k).cast("long")
    good = F.col("path").rlike(NAME)
    four = part(6) != ""
    rest = [c for c in listing.columns if c not in ("path", "length")]
    rows = listing.where(good).select(
        *rest, gid(4).alias("b_b"), F.when(four, gid(5)).otherwise(gid(4)).alias("b_e"),
        F.when(four, F.expr(f"try_cast(regexp_extract(path, r'{NAME}', 6) as bigint)")).otherwise(gid(5)).alias("e_b"),
        F.when(four, F.expr(f"try_cast(regexp_extract(path, r'{NAME}', 7) as bigint)")).otherwise(gid(5)).alias("e_e"),
        (part(2) == "M").alias("is_mergeable"), (part(3) == "C").alias("is_comp_diff"), F.to_timestamp(part(1), STAMP).alias("ts"), F.col("length").alias("data_size"),
    )
    return rows, listing.where(~good)


def list_folder(spark: SparkSession, path: str) -> DataFrame:
    """The files under a folder as (path, length); contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def with_diff_name(diffs: DataFrame) -> DataFrame:
    flag = lambda c, sign: F.when(F.col(c), sign).otherwise("-")
    gids = F.when(F.expr("b_b = b_e and e_b = e_e"), F.concat_ws("-", "b_b", "e_b")).otherwise(F.concat_ws("-", "b_b", "b_e", "e_b", "e_e"))
    stamp = F.date_format(F.col("ts").cast("timestamp"), STAMP)
    return diffs.withColumn("name", F.concat(stamp, F.lit("-"), flag("is_mergeable", "M"), flag("is_comp_diff", "C"), F.lit("-"), gids, F.lit(".wdiff")))


def _snap(b: str, e: str) -> Column:
    return F.when(F.col(b) == F.col(e), F.concat(F.lit("|"), b, F.lit("|"))).otherwise(F.concat(F.lit("|"), b, F.lit(","), e, F.lit("|")))


def diff_line() -> Column:
    """``|B|-->|E| MC ts size``; a missing flag is ``-``."""
    flags = F.concat(F.when(F.col("is_mergeable"), "M").otherwise("-"), F.when(F.col("is_comp_diff"), "C").otherwise("-"))
    return F.concat(_snap("b_b", "b_e"), F.lit("-->"), _snap("e_b", "e_e"), F.lit(" "), flags, F.lit(" "), F.date_format(F.col("ts").cast("timestamp"), STAMP), F.lit(" "), F.col("data_size").cast("string"))


LINE = r"^\|(\d+)(?:,(\d+))?\|-->\|(\d+)(?:,(\d+))?\| (.)(.) (\d{14}) (\d+)$"


def parse_diff_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    part = lambda k: F.regexp_extract(col, LINE, k)
    or_else = lambda k, o: F.coalesce(F.nullif(part(k), F.lit("")), part(o)).cast("long")
    rest = [c for c in lines.columns if c != col]
    return lines.where(F.col(col).rlike(LINE)).select(
        *rest, part(1).cast("long").alias("b_b"), or_else(2, 1).alias("b_e"), part(3).cast("long").alias("e_b"), or_else(4, 3).alias("e_e"),
        (part(5) == "M").alias("is_mergeable"), (part(6) == "C").alias("is_comp_diff"), F.to_timestamp(part(7), STAMP).alias("ts"), part(8).cast("long").alias("data_size"),
    )


STATE = r"^<\|(\d+)(?:,(\d+))?\|(?:-->\|(\d+)(?:,(\d+))?\|)?>(?:-(\d{14}))?$"


def read_state_dump(states: DataFrame, col: str = "state", loaded: Column | None = None) -> DataFrame:
    """States ``<|b,e|-->|b,e|>-time``; without a time the load time counts."""
    part = lambda k: F.nullif(F.regexp_extract(col, STATE, k), F.lit(""))
    rest = [c for c in states.columns if c != col]
    ts = F.coalesce(F.to_timestamp(part(5), STAMP), loaded if loaded is not None else F.current_timestamp())
    return states.where(F.col(col).rlike(STATE)).select(
        *rest, part(3).isNotNull().alias("is_applying"), part(1).cast("long").alias("b_b"), F.coalesce(part(2), part(1)).cast("long").alias("b_e"),
        part(3).cast("long").alias("e_b"), F.coalesce(part(4), part(3)).cast("long").alias("e_e"), ts.alias("ts"),
    )


def read_recipe(lines: DataFrame, col: str = "value") -> DataFrame:
    """``addr blocks csum`` lines, the sum in hexadecimal."""
    f = F.split(col, " ")
    rest = [c for c in lines.columns if c != col]
    return lines.select(*rest, f[0].cast("long").alias("addr"), f[1].cast("long").alias("blocks"), F.conv(f[2], 16, 10).cast("long").alias("csum"))


def parse_status(lines: DataFrame, col: str = "value") -> DataFrame:
    """``key:value`` fields separated by tabs as a map; the first colon separates."""
    pairs = F.transform(F.split(col, "\t"), lambda f: F.struct(F.substring_index(f, ":", 1), F.regexp_replace(f, "^[^:]*:", "")))
    return lines.withColumn("status", F.map_from_entries(pairs))


def read_image(spark: SparkSession, path: str, block_size: int = 512, range_bytes: int = 1 << 26, odd: str = "error") -> DataFrame:
    """Blocks (path, addr, data) of the full image files under a folder; zero blocks are left out.

    All files are one scan of byte ranges of at most ``range_bytes``. Files whose length isn't a multiple of
    ``block_size`` are named in an error, or with ``odd="skip"`` left out: ``odd_images`` lists them.
    A file compressed by gzip (``.gz``) is unpacked by one task as it is read; its length shows then, and an odd one is an error.
    """
    from . import ranges

    wrong = odd_images(spark, path, block_size)
    if odd == "error" and (bad := wrong.limit(20).collect()):
        raise ValueError(f"not a multiple of {block_size} bytes: " + ", ".join(f"{r.path} ({r.length})" for r in bad))
    files = list_folder(spark, path).where((F.col("length") > 0) & (F.col("path").endswith(ranges.PACKED) | (F.col("length") % block_size == 0))).select("path", "length")
    return ranges.read_blocks(spark, [(r.path, r.length) for r in files.collect()], block_size, range_bytes)  # a name and a length for each image file


def odd_images(spark: SparkSession, path: str, block_size: int = 512) -> DataFrame:
    """(path, length) of the files that no whole number of blocks makes up; compressed ones don't show it here."""
    from . import ranges

    return list_folder(spark, path).where(~F.col("path").endswith(ranges.PACKED) & (F.col("length") % block_size != 0)).select("path", "length")


def write_changes(changes: DataFrame, path: str) -> None:
    """Parquet by change set, sorted by volume and address for min/max pruning; a large change set is dealt by address."""
    changes.repartitionByRange("gid", "vol_id", "addr").sortWithinPartitions("gid", "vol_id", "addr").write.partitionBy("gid").mode("append").parquet(path)


def read_changes(spark: SparkSession, path: str, plan: DataFrame | None = None) -> DataFrame:
    """Written changes, all or those of a plan (vol_id, b_b, e_b); change sets outside every plan aren't read."""
    rows = spark.read.parquet(path)
    if plan is None:
        return rows
    span = plan.groupBy(F.col("vol_id").alias("v")).agg(F.min("b_b").alias("from_gid"), F.max("e_b").alias("to_gid"))
    low, high = span.agg(F.min("from_gid"), F.max("to_gid")).first()
    rows = rows.where((F.col("gid") > low) & (F.col("gid") <= high)) if low is not None else rows.where("false")
    return rows.join(span, (F.col("vol_id") == F.col("v")) & (F.col("gid") > F.col("from_gid")) & (F.col("gid") <= F.col("to_gid"))).drop("v", "from_gid", "to_gid")


def bucket_of(buckets: int = 64) -> Column:
    """The bucket of a block: stripes of volumes are dealt evenly, so the number of folders doesn't grow with volumes."""
    return F.pmod(F.col("vol_id") * 31 + F.shiftright("addr", 16), F.lit(buckets)).cast("int")


def write_image(image: DataFrame, path: str, version: int, buckets: int = 64) -> DataFrame:
    """Write an image version by bucket, sorted by volume and address, and then its manifest (vol_id, bucket, n_blocks, version), which commits it."""
    rows = image.withColumn("bucket", bucket_of(buckets))
    rows.repartitionByRange("bucket", "vol_id", "addr").sortWithinPartitions("bucket", "vol_id", "addr").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/data/version={version}")
    written = image.sparkSession.read.parquet(f"{path}/data/version={version}")
    manifest = written.groupBy("vol_id", "bucket").agg(F.count("*").alias("n_blocks")).withColumn("version", F.lit(version).cast("long"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest/version={version}")
    return image.sparkSession.read.schema("vol_id bigint, bucket int, n_blocks bigint, version bigint").parquet(f"{path}/manifest/version={version}")


def read_image_version(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The blocks of a committed version; without its manifest it is an error."""
    spark.read.parquet(f"{path}/manifest/version={version}")
    return spark.read.parquet(f"{path}/data/version={version}").drop("bucket")
