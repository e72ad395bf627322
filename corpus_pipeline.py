"""The corpus pipeline: language, near duplicates, benchmark passages, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the
columns of documents; the last returns what is stored for training. Rows are told apart by a key of the
whole row, so repeated rows, null ids and null columns pass through every stage in a defined way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, decontaminate, language, near_dedup, private_data
from tallyspark.llm.queries import tokenizer
from tallyspark.llm.textkit import read, row_key, settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; null texts and texts without letters go.

    ``lang`` becomes the predicted language, learned from the rows that have one.
    """
    model = language.train(docs.where(~language.held_out()).select("text", "lang"))
    # The columns travel along, so nothing has to be joined back.
    found = language.predict(docs, model, spans=False, keep=tuple(COLUMNS)).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id, and of equal ids the smallest row key."""
    keyed = docs.select(*COLUMNS, row_key().alias("key"))
    rows = keyed.select(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "key").alias("doc_id"), "text")
    classes = near_dedup.near_duplicates(rows)
    kept = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id.key").alias("key")).distinct()
    # A repeated row is there as often as before: one of them stays. They meet on the map side first.
    one = keyed.groupBy("key").agg(F.min(F.struct("source", "lang", "n_chars", "doc_id", "text")).alias("row"))
    return one.join(kept, "key").select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select("rk").distinct()
    return docs.withColumn("rk", row_key()).join(bad, "rk", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind in brackets."""
    rows = docs.select(F.struct(*COLUMNS).alias("doc_id"), "text")
    found = private_data.find(rows).withColumn("clean", private_data.redact(F.col("doc_id.text"), F.col("spans")))
    out = found.select("doc_id.*", "clean")
    return out.select("doc_id", F.col("clean").alias("text"), "lang", "source", F.when(F.col("clean").isNotNull(), F.length("clean").cast("long")).alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, their count, and digests of the ids and of the decoded text.

    ``ids`` holds them as little-endian unsigned 32-bit integers.
    """
    return bpe.encode(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]
# Viterbi labels, sketches and merges are beyond SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
