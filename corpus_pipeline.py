"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing of documents.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written and read again as the next stage's
docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm import catalog, mixing, packing, quality, secrets, simhash
from tactus.session import durable

#: Pieces of text whose ids a worker keeps while packing: fewer than for packing alone, for the other stages' workers live on.
PACKING_ROOM = 150_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. The model is fitted on the labelled documents among docs.

    Null and empty texts have no words, so they go. Rows are judged each for itself, whatever their id, also repeated ones.
    """
    crf = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = docs.select(F.struct("*").alias("doc"), quality.quality("text", crf).alias("q"))
    return judged.where("q.kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest id; without ids, the first row.

    Null and empty texts are one group. Repeated rows are one group. Rows that share an id but not their text are told apart.
    """
    return simhash.representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars counts the new text.

    Null texts stay null, and rows without a secret stay as they are.
    """
    scanned = docs.select(F.struct("*").alias("doc"), secrets.secret_spans("text").alias("spans"))
    found, text = F.size("spans") > 0, F.col("doc.text")
    clean = F.when(found, secrets.redact(text, F.col("spans"))).otherwise(text)
    if "n_chars" not in docs.columns:
        return scanned.withColumn("text", clean).select(*(F.col("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns))
    cleaned = scanned.select("doc", found.alias("found"), clean.alias("text"))
    counted = F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("doc.n_chars"))
    made = {"text": F.col("text"), "n_chars": counted.alias("n_chars")}
    return cleaned.select(*(made.get(c, F.col("doc").getField(c).alias(c)) for c in docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document's row comes 0 to 3 times, with the words that are taken each time.

    Null and empty texts have no words and are never taken. Null sources are one source. Repeated rows are taken each for itself.
    """
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in the sequences.

    Null and empty texts are one piece of the end token. Repeated rows are packed each for itself. Other columns don't matter.
    """
    return packing.pack_documents(docs, catalog.BYTE_TOKENIZER, room=PACKING_ROOM)


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: No SQL expresses hashing, decoding and tokenizing; tests/llm/test_pipeline.py has brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = durable(docs, f"pipeline-{number}")
    return docs
