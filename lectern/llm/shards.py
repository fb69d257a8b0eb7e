"""Sharding: global byte prefix sums from per-partition totals, cut at equal targets into contiguous shards.

Rows are range-partitioned once by their order; each partition's total is summed, the totals (one
row a partition) get running sums, and a window inside each partition adds the rest. No task sees
more than one partition's rows, and only the columns that are passed in are moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import fresh, text_or_empty, written

N_SHARDS = 16


def shard_by_bytes(df: DataFrame, size: Column, order: list[str], n_shards: int = N_SHARDS) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in a shard).

    Rows lie in the order of the columns ``order`` (nulls first); a row belongs to the shard in whose
    equal share of all bytes it starts, so two shards differ by less than two rows. ``size``: bytes of a
    row, null as 0. If all sizes are 0, everything is in shard 0. Rows equal in ``order`` are put in any
    order among themselves, so give enough columns to tell rows apart. An empty table stays empty. If
    ``df`` has columns named shard or slot, they are replaced; helper columns never clash.
    """
    df = df.drop("shard", "slot")
    part, own, before, row, rows_before, total, first = fresh(df, "part", "own", "before", "row", "rows_before", "total", "first")
    ways = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn(own, F.coalesce(size.cast("long"), F.lit(0)))
    dealt = written(dealt.repartitionByRange(ways, *order).withColumn(part, F.spark_partition_id()), "shards")

    parts = dealt.groupBy(part).agg(F.sum(own).alias(total), F.count(F.lit(1)).alias(row))
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(
        part,
        F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before),
        F.coalesce(F.sum(row).over(earlier), F.lit(0)).alias(rows_before),
        F.sum(total).over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(total),
    )
    inside = W.partitionBy(part).orderBy(*order, own).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.join(parts, part).withColumns(
        {
            before: F.col(before) + F.sum(own).over(inside) - F.col(own),
            row: F.col(rows_before) + F.count(F.lit(1)).over(inside) - 1,
        }
    )
    placed = placed.withColumn("shard", F.expr(f"cast(least({n_shards - 1}, coalesce((`{before}` * {n_shards}) div nullif(`{total}`, 0), 0)) as int)"))
    starts = placed.groupBy("shard").agg(F.min(row).alias(first))
    return placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col(row) - F.col(first)).select(*df.columns, "shard", "slot")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: all documents in 16 shards of near equal bytes; equal texts lie together, but for the at most 15 groups that a cut falls into."""
    text = text_or_empty("text")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("text_md5")
    )
    out = shard_by_bytes(rows, F.col("size"), ["text_md5", "doc_id", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
