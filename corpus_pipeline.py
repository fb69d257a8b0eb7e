"""The corpus pipeline: five stages over the documents table, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import stages
from lectern.llm.common import remove, spent, work_dir, written

STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("secret_scan", stages.secret_scan),
    ("mixing", stages.mixing),
    ("encode", stages.encode),
]

#: Fingerprints, votes, rounding and encoding have no SQL; tests/llm/test_whole.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: doc_id, n_tokens, ids_sha256 and decoded_sha256 of what is kept."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        label = f"stage-{name}"
        with spent(label):  # what a stage wrote for itself, and the stage before it, go when it is written
            path = work_dir(spark, label)
            docs = written(stage(spark, docs, sf_dir), label, path)
        if before:
            remove(before)
        before = path
    return docs
