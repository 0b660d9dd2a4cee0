"""A corpus pipeline: toxicity, near copies, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and read again
as the next one's documents. All but the last return the columns of documents. Null texts
count as empty in every stage and pass the filters; an empty table passes through. Only
the columns of documents go from stage to stage, so others can't clash with a stage's own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import mixing, packing, secrets, simhash, toxicity
from blockloom.llm.common import read, shared_dir
from blockloom.llm.queries import vocabulary


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier fitted on the labels doesn't call toxic."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where("predicted = 0").select(*COLUMNS)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return simhash.near_copies(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind found."""
    found = secrets.scan(docs, rules=secrets.REDACTED, keep=COLUMNS)
    hit = F.size("spans") > 0
    found = found.withColumn("text", F.when(hit, secrets.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return found.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    rows = mixing.prepare(docs.select(*COLUMNS))
    narrow = mixing.staged(rows.select("mix_id", "mix_hash", "mix_source", "mix_size", "mix_measure"), "mix-rows")
    return mixing.mixed(rows, mixing.plan_mix(narrow))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows."""
    return packing.pack_documents(docs, "text", vocabulary("byte_bpe_50k.json"), keep=("doc_id",))


STAGES = [
    ("toxicity", reject_toxic),
    ("near copies", one_of_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL cannot express the fitted classifier, the fuzzy keys or the tokenizer; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
