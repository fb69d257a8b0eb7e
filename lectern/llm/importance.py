"""Target-distribution importance resampling over hashed word features.

Identical texts are collapsed first, by grouping the full text, with their number of copies; features are
counted and weighted once for each distinct text. The corpus counts of a bucket add up each text's count times
its copies, summed within a task before they leave it. Weights go back to the documents over a 128-bit hash
of the text, and only then comes the noise, which is each document's own. The draw is exact: scores are
range-partitioned, and a row's rank is the number of rows in the partitions before plus its place in its own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, text_or_empty, trimmed, written

#: Fixed by the query's contract: longest run of words, buckets, seed of the noise, least words of a candidate, share drawn in hundredths.
LONGEST, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, 2024, 20, 10
#: Bytes of a text that are cut into words at once.
WINDOW = 1 << 20
#: Bytes of words (0-9, a-z, all beyond ASCII) stay, A-Z become a-z, others are white space.
WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

FEATURE_DDL = "d1 long, d2 long, copies long, n_words long, n_features long, buckets array<int>, counts array<long>"
FEATURE_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("d1", "d2", "copies", "n_words", "n_features")), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
TOTAL_SCHEMA = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
WEIGHT_SCHEMA = pa.schema([(c, pa.int64()) for c in ("d1", "d2", "n_words", "n_features", "weight")])


def word_lists(text: str) -> Iterator[list[bytes]]:
    """The words of a text, a list for every ``WINDOW`` bytes or so; windows end between words."""
    data = text.encode().translate(WORD_BYTES)
    at = 0
    while at < len(data):
        stop = data.find(b" ", at + WINDOW)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


def features(text: str, longest: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, and the buckets with their counts, of all runs of 1 to ``longest`` words."""
    n_words = n_features = 0
    sums: Counter[int] = Counter()
    tail: list[bytes] = []
    for words in word_lists(text):
        n_words += len(words)
        met = Counter(words)
        n_features += len(words)
        for n in range(2, longest + 1):  # runs that end in this window
            own = tail[-(n - 1) :] + words
            runs = [b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)]
            met.update(runs)
            n_features += len(runs)
        for feature, count in met.items():
            sums[zlib.crc32(feature) % buckets] += count
        tail = (tail + words)[-(longest - 1) :] if longest > 1 else []
    keys = np.array(sorted(sums), np.int32)
    return n_words, n_features, keys, np.array([sums[k] for k in keys.tolist()], np.int64)


def _featured(longest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(x, longest, buckets) for x in batch.column(3).to_pylist()]
            cols = [*batch.columns[:3], *(pa.array([g[k] for g in got], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]))]
            yield pa.RecordBatch.from_arrays(cols, schema=FEATURE_SCHEMA)

    return run


def text_features(docs: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """A written table (d1, d2, copies, n_words, n_features, buckets, counts) with a row for each distinct text; null is the empty text."""
    texts = docs.groupBy(text_or_empty(text_col).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.select(*_digest(F.col("text")), "copies", "text")
    return written(small_batches(texts).mapInArrow(lambda it: trimmed(_featured(longest, buckets)(it)), FEATURE_DDL), "text-features")


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(0), text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2")]


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, copies counted: ``buckets`` numbers, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            of, counts = batch.column(1), batch.column(2).flatten().to_numpy()
            copies = np.repeat(batch.column(0).to_numpy(), np.diff(of.offsets.to_numpy()))
            np.add.at(sums, of.flatten().to_numpy(), counts * copies)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], schema=TOTAL_SCHEMA)

    rows = texts.select("copies", "buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, one added to each bucket; floored."""
    n, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weighted(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(4)
            running = np.concatenate([[0], np.cumsum(gain[of.flatten().to_numpy()] * batch.column(5).flatten().to_numpy())])
            ends = of.offsets.to_numpy() - of.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.diff(running[ends]))], schema=WEIGHT_SCHEMA)

    return run


def noise(id_col: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate that follows from the seed and the id (a null id counts as the text "null"); floored."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, drawn: int, order: list[Column]) -> DataFrame:
    """``rows`` (columns without the name part_) with ``rank``: 1 to ``drawn`` by ``order``, null beyond."""
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(ways, *order).withColumn("part_", F.spark_partition_id()), "ranked-rows")
    parts = dealt.groupBy("part_").agg(F.count(F.lit(1)).alias("own_"))
    before = F.coalesce(F.sum("own_").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(F.broadcast(parts.select("part_", before.alias("before_"))), "part_")  # a row for each partition
    rank = F.col("before_") + F.row_number().over(W.partitionBy("part_").orderBy(*order))
    return placed.select(*rows.columns, F.when(rank <= drawn, rank).cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; rank is null for what is not drawn.

    Of the rows of ``min_words`` words or more, ``percent`` in a hundred are drawn (rounded down): the
    highest scores, ties to the smaller id (null last). A text's weight adds up how much likelier each of its
    features is in ``target`` than in ``docs``; the score adds noise that follows from the id and ``seed``, which draws
    without replacement in proportion to the weights. Null and empty texts have no features and weight 0. Repeated rows
    count each, and have one score. An empty target gives gains from the added ones alone; an empty table stays empty.
    Other columns are left out, so no name can clash.
    """
    texts = text_features(docs, text_col, longest, buckets)
    gain = gains(bucket_totals(texts, buckets), bucket_totals(text_features(target, target_col, longest, buckets), buckets))
    parts = small_batches(texts.select("d1", "d2", "n_words", "n_features", "buckets", "counts"))
    weights = parts.mapInArrow(lambda it: trimmed(_weighted(gain)(it)), "d1 long, d2 long, n_words long, n_features long, weight long")
    weights = written(weights, "text-weights")
    own = docs.select(F.col(id_col).alias("doc_id"), *_digest(text_or_empty(text_col)))
    scored = own.join(weights, ["d1", "d2"]).select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    scored = written(scored, "scored-documents")
    able = scored.filter(F.col("n_words") >= min_words)
    out = ranked(able, able.count() * percent // 100, [F.desc("score"), F.asc_nulls_last("doc_id")])
    rest = scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return out.unionByName(rest).drop("n_words")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: every document's features, weight, score and rank, with the benchmark texts as the target."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark"))
