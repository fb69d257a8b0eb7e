"""The operators as stages over a documents table: each takes and, but for the last, returns its columns.

Columns beside those of documents may have any names: they are carried under others and get theirs back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import byte_bpe, mixture, neighbours, secrets, similar
from lectern.llm.common import word_count


#: The columns that stages read or write; all others are only carried.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _carried(stage: Callable) -> Callable:
    """``stage`` over ``docs`` whose other columns have names that no operator uses."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plain = docs.toDF(*[c if c in COLUMNS else f"carried_column_{i}" for i, c in enumerate(docs.columns)])
        out = stage(spark, plain, sf_dir)
        return out.toDF(*docs.columns) if out.columns == plain.columns else out

    return run


@_carried
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of the documents that are there.

    A null text is judged as an empty one; repeated rows are judged alike; without labels every document
    stays, as the score of the unknown is accepted.
    """
    model = neighbours.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return neighbours.score(docs, model).filter("predicted = 1").select(*docs.columns)


@_carried
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 or more, by SimHash: the one with the smallest id. Of repeated rows one stays.

    Null and empty texts are one group; a null id counts as the largest.
    """
    return similar.kept(docs)


@_carried
def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their live-looking credentials replaced; null and empty texts and repeated rows stay as they are.

    n_chars is counted anew (null for a null text). A null source is an owner of its own.
    """
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


@_carried
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it (0, 1 or 2); repeated rows are taken each for itself.

    A document without words is taken as often as its source's whole copies say; a null source is a source.
    """
    mixed = mixture.mix(docs, word_count(F.col("text"))).filter("copies > 0")
    return mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), "copies")).alias("copy_")).select(*docs.columns)


@_carried
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to; a null text is an empty one, a null id stays null."""
    return byte_bpe.digests(docs)
