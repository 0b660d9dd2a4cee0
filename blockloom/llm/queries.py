"""The registered query of each operator, on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, language_id, lm_score, media_ogg, mixing, oracles, packing, periodic_runs, secrets, simhash, token_counts, toxicity, whitening
from .common import id_crc, read, text_or_empty
from .url_filter import Rule, filter_urls, host_rule

#: The rules of the contract, then the method's own patterns.
URL_RULES = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
    Rule("*.spam-*/**", "block"),
    Rule("*.casino*/**", "block"),
    Rule("**/ads/**", "block"),
    Rule("**/track?/**", "block"),
    Rule("**.exe", "block"),
)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), "text", vocabulary("byte_bpe_50k.tiktoken"), keep=("doc_id",))


def op2_media_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode(text_or_empty(), "UTF-8")
    docs = read(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    docs = docs.select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.expr("rpad(raw, int(greatest(64, ceil(octet_length(raw) / 64) * 64)), X'00')").alias("payload"))
    stored = media_ogg.encode_ogg(docs, keep=("doc_id", "n_bytes"))
    back = media_ogg.decode_ogg(stored, keep=("doc_id", "n_bytes", "media"))
    feature = F.concat_ws(
        ";", F.concat(F.lit("pages="), "pages"), F.concat(F.lit("streams="), "streams"), F.concat(F.lit("packets="), F.size("packets")), F.concat(F.lit("broken="), "broken"),
        F.concat(F.lit("seconds="), F.format_string("%.6f", "seconds")), F.concat(F.lit("last="), F.format_string("%.6f", F.element_at("packets", -1)["seconds"])),
    )
    return back.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.prepare(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = mixing.staged(docs.select("doc_id", "mix_id", "mix_hash", "mix_source", "mix_size", "mix_measure"), "mix-rows")
    out = mixing.apply_mix(rows, mixing.plan_mix(rows))
    taken = (F.col("mix_copies") * F.col("mix_size") + F.col("mix_part")).cast("long")
    return out.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", taken.alias("taken"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), keep=("doc_id",))
    n = lambda k: F.size(F.filter("spans", lambda s: s["k"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["k"] < len(secrets.BASE))
    return found.select("doc_id", *[n(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), keep=("doc_id",))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages"), "url", list(URL_RULES), keep=("page_id",))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), "text", vocabulary("byte_bpe_50k.json"), keep=("doc_id",))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable=id_crc() % 4 != 2)
    return toxicity.score(docs.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", (id_crc() % 10 == 0).alias("held_out"), "text")
    return lm_score.score_texts(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.staged(whitening.whiten(read(spark, sf_dir, "embeddings"), "embedding", keep=("vec_id",)), "whitened")
    numbers = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "z")
    error = F.lit(whitening.identity_error(rows).first().identity_error).alias("identity_error")
    return rows.select("vec_id", "n", "deviation", numbers).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "z.whitened", "z.explained", error)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_id.fit(docs, usable=id_crc() % 4 != 2)
    return language_id.identify(docs.select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "text"), model, keep=("doc_id", "held_out"))


def planted() -> Column:
    """The text; of one in ten documents its words from a place on repeat with a period, as the contract of op13 has it."""
    word = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    n, g = F.size(word).cast("long"), F.floor(id_crc() / 10)
    a = g % F.greatest(n, F.lit(1))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    again = F.flatten(F.array_repeat(F.slice(word, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    changed = F.slice(F.concat(F.slice(word, F.lit(1), a.cast("int")), again), F.lit(1), n.cast("int"))
    return F.when((id_crc() % 10 == 0) & (n > 0), F.array_join(changed, " ")).otherwise(F.col("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", planted().alias("text"))
    found = periodic_runs.find_runs(docs, keep=("doc_id",))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], F.concat(r["period"], F.lit("\n")))), "")
    found = found.select("doc_id", "runs", longest.alias("r"), "collapsed")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("r.s")).alias("start"), "r.length", (-F.col("r.p")).alias("period"), F.floor(1000 * F.col("r.length") / -F.col("r.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_media_ogg, op3_embedding_dedup, op4_mixing, op5_secrets, op6_simhash, op7_url_filter, op8_packing, op9_toxicity, op10_lm_score, op11_embedding_whitening, op12_language_id, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": oracles.EMBEDDING_DEDUP, "op5_secrets": oracles.SECRETS, "op7_url_filter": oracles.URL_FILTER}
