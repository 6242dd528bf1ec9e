"""Training-data pipeline over `documents`: quality rules, toxicity, near-duplicates, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from colonnade.llm import packing, quality, secrets, shingles, toxicity
from colonnade.session import new_path, stage

# Scores of a network, hashes and a tokenizer cannot be written in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None
SCORE, ROW, TURN = "__toxicity", "__row", "__turn"
ROWS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH = 1000  # rows of whole texts that go to Python at a time
KEPT_WORDS = 100_000  # words whose ids a worker keeps; it shares its executor with what the stages before have left there


def small_batches(spark: SparkSession) -> None:
    """Sends `BATCH` rows at a time to Python from here on: Spark's 10,000 rows of texts lie in an executor several times, in its buffers and in each
    worker. A stage is written by its caller, so this stays set in the session; `run` sets it back."""
    spark.conf.set(ROWS_A_BATCH, str(BATCH))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that the quality rules reject go, those without text included."""
    small_batches(spark)
    return docs.where(quality.keeps(F.col("text")))


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 6: documents that the network flags for their language go. It is trained on the labelled documents that are still there."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    net, able, trained = toxicity.learn(docs, labels)
    scored = stage(docs.withColumn(SCORE, toxicity.score_of(spark, net)(F.col("text"))), "toxicity")  # one row a document, nothing is shuffled
    limits = toxicity.calibrate(scored.select("doc_id", "lang", F.col(SCORE).alias("score")), able, trained)
    return scored.where(~toxicity.flagged(F.col(SCORE), F.col("lang"), limits)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 7: one document of each group stays, the one with the smallest doc_id; a group is linked by five-word shingles that agree to 0.8 or
    more. Rows are told by all their columns: rows with one id but other texts are documents of their own, rows without an id are
    members like others (and stay only where their group has no id), and rows that are equal throughout are one."""
    rows = docs.withColumn(ROW, F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    groups = shingles.near_duplicates(rows, key=ROW).select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")).distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", ROW))[ROW]
    keep = groups.join(rows.select(ROW, "doc_id").distinct(), ROW).groupBy("group").agg(first.alias(ROW)).select(ROW)
    equal = Window.partitionBy(ROW, "doc_id", F.md5("text")).orderBy(ROW)
    return rows.join(keep, ROW, "left_semi").withColumn(TURN, F.row_number().over(equal)).where(F.col(TURN) == 1).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 9: secrets give way to a mask; every document stays."""
    small_batches(spark)
    return secrets.redact(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: pieces of the documents with their places in sequences of 2048 ids."""
    small_batches(spark)
    return packing.pack(packing.pieces(docs, ids=False, kept=KEPT_WORDS))


STAGES = [("quality", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("packing", pack_documents)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    before = spark.conf.get(ROWS_A_BATCH)
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"pipeline-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(ROWS_A_BATCH, before)
    return docs
