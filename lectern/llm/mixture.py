"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is the expected number of copies of each of its documents. The whole
part is taken for certain; the fractions are rounded in pairs: the smaller of two possible amounts of
words moves from one document to the other, in the direction that chance gives it, so that one of the
two becomes integral, the source's expected words stay exactly the same and each document's own
expectation too. Groups of some 2,000 documents leave one fractional document each, which meet in
groups of 64 in a reduction tree until one a source is left. Large documents are paired first, so what
is left is small. Chance is a hash of the documents and their ids, so reruns agree.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import content_hash, fresh, word_count, written

#: Fixed by the query's contract: weights of the sources in order, repeated; their share of all sizes; most copies of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
SEED = 20
#: Documents of a first group, fractional documents that meet in a node of the tree.
GROUP, FAN_IN = 2000, 64
#: Fractions this near to 0 or 1 are integral.
NEAR = 1e-12

TREE_SCHEMA = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("source", pa.string()), ("node", pa.int64()), ("size", pa.int64()), ("copies", pa.int32()), ("fraction", pa.float64())])
TREE_DDL = "row long, id long, source string, node long, size long, copies int, fraction double"


def _chance(level: int, *parts: bytes) -> float:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(struct.pack("<q", level) + b"".join(parts), SEED) / 2**64


def pivot(p: float, v: int, q: float, w: int, u: float) -> tuple[float, float]:
    """Fractions of two documents of sizes v and w after one transfer; at least one is 0 or 1, p * v + q * w stays."""
    to_first, to_second = min((1 - p) * v, q * w), min(p * v, (1 - q) * w)
    if u * (to_first + to_second) < to_second:
        p, q = p + to_first / v, q - to_first / w
    else:
        p, q = p - to_second / v, q + to_second / w
    snap = lambda x: 0.0 if x < NEAR else 1.0 if x > 1 - NEAR else x
    p, q = snap(p), snap(q)
    if 0 < p < 1 and 0 < q < 1:  # by rounding; the nearer one becomes integral
        if min(p, 1 - p) < min(q, 1 - q):
            p = round(p)
        else:
            q = round(q)
    return float(p), float(q)


def _round_group(table: pa.Table, level: int, last: bool) -> pa.Table:
    """Rounds the rows of one group; at most one keeps a fraction, and none in the last level."""
    size, fraction = table["size"].to_numpy(), table["fraction"].to_numpy().copy()
    copies = table["copies"].to_numpy().copy()
    keys = [struct.pack("<q", -1 if x is None else x) for x in table["id"].to_pylist()]
    order = np.lexsort((table["row"].to_numpy(), table["id"].to_numpy(zero_copy_only=False).astype(float), -size))
    held = -1
    for i in order.tolist():
        if not 0 < fraction[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        fraction[held], fraction[i] = pivot(fraction[held], int(size[held]), fraction[i], int(size[i]), _chance(level, keys[held], keys[i]))
        held = i if 0 < fraction[i] < 1 else held if 0 < fraction[held] < 1 else -1
    if last and held >= 0:
        fraction[held] = float(_chance(level, keys[held]) < fraction[held])
    whole = fraction >= 1
    copies[whole] += 1
    fraction[whole] = 0
    cols = [table["row"], table["id"], table["source"], pa.array(table["node"].to_numpy() // FAN_IN), table["size"], pa.array(copies, pa.int32()), pa.array(fraction)]
    return pa.table(cols, schema=TREE_SCHEMA)



def _rounder(level: int, last: bool):
    return lambda table: _round_group(table, level, last)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n, source_size, target: weights go round the sources in code point order, null last.

    The targets are the level at which ``share`` of all sizes is poured over the sources by weight,
    none above ``most`` times its own size. Only four sums reach the driver in each round.
    """
    spark = sizes.sparkSession
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    dealt = written(totals.repartitionByRange(ways, F.asc_nulls_last("source")).withColumn("part", F.spark_partition_id()), "sources")
    before = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    table = written(dealt.join(before, "part").select("source", "n", "source_size", weight.cast("double").alias("weight")), "source-weights")
    cap = F.col("source_size") * F.lit(most).cast("double")
    level, capped = 0.0, -1
    while True:
        full = cap < F.lit(level) * F.col("weight")
        n, taken, rest, total = table.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight"))), F.sum("source_size")).first()
        if n == capped or not rest:
            break
        level, capped = (share * total - (taken or 0)) / rest, n
    return written(table.select("source", "n", "source_size", F.least(cap, F.lit(level) * F.col("weight")).alias("target")), "source-targets")


def mix(docs: DataFrame, size, id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if None) with size, source_size, target and copies.

    ``size`` is a column of words, null as 0; a document of size 0 gets the whole copies of its
    source only, and a source of size 0 none. Sources are told apart by code point, null is a source of
    its own. Repeated ids and rows are rounded each for itself; an empty table stays empty. Columns of
    ``docs`` with the names that are added are replaced.
    """
    added = ["size", "source_size", "target", "copies"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    row, own, key, words = fresh(docs, "row", "own_source", "own_id", "own_size")
    # Rows of one id (or none) are told apart by what they hold, so that they are dealt out too.
    made = {row: F.monotonically_increasing_id(), own: F.col(source_col).cast("string"), key: content_hash(docs, id_col), words: F.coalesce(size.cast("long"), F.lit(0))}
    table = written(docs.withColumns(made).select(*keep, row, own, key, words), "mix-documents")
    narrow = table.select(F.col(row).alias("row"), F.col(key).alias("id"), F.col(own).alias("source"), F.col(words).alias("size"))
    targets = source_targets(narrow.select("source", "size"), weights, share, most)

    other = targets.withColumnRenamed("source", "source_")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    node = F.pmod(F.xxhash64("id", F.lit(SEED)), F.ceil(F.col("n") / GROUP))
    fraction = F.when(F.col("size") > 0, F.col("ratio") - F.floor("ratio")).otherwise(0.0)
    rows = narrow.join(other, F.col("source").eqNullSafe(F.col("source_"))).withColumn("ratio", ratio)
    rows = rows.select("row", "id", "source", node.cast("long").alias("node"), "size", F.floor("ratio").cast("int").alias("copies"), fraction.alias("fraction"))

    widest = targets.agg(F.max(F.ceil(F.col("n") / GROUP))).first()[0] or 1
    levels = 1
    while widest > 1:
        widest, levels = -(-widest // FAN_IN), levels + 1
    done = []
    for level in range(levels):
        rounded = rows.groupBy("source", "node").applyInArrow(_rounder(level, level == levels - 1), TREE_DDL)
        rounded = written(rounded, "mix-level")
        done.append(rounded.filter("fraction = 0"))
        rows = rounded.filter("fraction > 0")
    copies = done[0]
    for more in done[1:]:
        copies = copies.unionAll(more)
    # As many rows as documents, so never broadcast, however few they are.
    copies = copies.select(F.col("row").alias("row_"), F.col("copies").alias("copies_")).hint("merge")
    out = table.join(copies, F.col(row) == F.col("row_")).join(targets.select(F.col("source").alias("source_"), F.col("source_size").alias("total_"), F.col("target").alias("target_")), F.col(own).eqNullSafe(F.col("source_")))
    return out.select(*keep, F.col(words).alias("size"), F.col("total_").alias("source_size"), F.col("target_").alias("target"), F.col("copies_").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs, word_count(F.col("text")), keep=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
