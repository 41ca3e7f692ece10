"""Documents to packed training sequences: quality rules, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlog.llm import queries
from strandlog.llm.shared import new_path, table

STAGES = [
    ("quality rules", queries.keep_good),
    ("near-duplicates", queries.keep_one_of_each),
    ("benchmark decontamination", queries.drop_benchmark),
    ("packing", queries.pack_sequences),
]
#: Tokenisation and trained trees are beyond SQL; tests/llm/test_pipeline.py holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
