"""The pipeline of corpus_pipeline.py as a query."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from colonnade.llm.registry import query


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules, toxicity, near-duplicates, secrets and packing over all documents."""
    return corpus_pipeline.run(spark, folder)
