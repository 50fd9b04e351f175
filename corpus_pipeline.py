"""A corpus pipeline of five operators: quality rules, near-duplicates, decontamination, personal data, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import bpe, decontaminate, pii, quality_rules, queries, simhash
from quillmark.llm.common import new_path

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.quality_rules(docs).where("kept").select(*DOCUMENT)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the one row with the smallest id; rows
    without an id come last, and rows with equal ids are told apart by a hash of all columns."""
    return simhash.near_duplicates(docs.select(*DOCUMENT), shingle=5, similarity=0.8).where("leads").select(*DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark text: in a long document a whole passage may be a small share."""
    found = decontaminate.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))
    return found.where(F.col("n_hit") == 0).select(*DOCUMENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each span of personal data in its place."""
    clean = pii.redact(pii.find_pii(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with the digest of the text that they decode to."""
    coded = bpe.round_trip(docs, queries.tokenizer_path())
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

#: SQL has no EM, SimHash or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written as Parquet and read again by the next."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
