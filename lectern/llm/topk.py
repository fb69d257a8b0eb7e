"""Exact top-k search by distributed histogram selection.

Vectors are packed into blocks, files of the shared folder; only the addresses of pairs of a query
block and a candidate block are dealt out. A pair is one matrix product of integers, exact in floating
point (in wider integers, or integers of any size, where it would not be). Every round
bins all scores of a query inside its current interval, adds the counts up over all blocks, and
narrows the interval to the bin that holds the k-th largest score, until a bin is one score wide. A
last pass keeps the scores above it and, of those equal to it, the smallest ids, and ranks them.

A block hands on counts only from the top down to its own k-th score of the interval, below which
the global k-th cannot lie, and of equal scores the k smallest ids; nothing else is left out, so
the result is exact for any ties.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import publish, read_shared, work_dir, written

SCALE, TOP, QUERY_STEP = 64, 20, 20
#: Vectors in a candidate block and in a query block.
CANDIDATES, QUERIES = 2048, 512
#: Bins of a histogram.
BINS = 256
LONG = (1 << 63) - 1
#: Pairs of blocks that a task gets, and block files that it keeps.
PAIRS, FILES = 512, 64

PAIR_DDL = "row long, bin long, n long"
PAIR_SCHEMA = pa.schema([("row", pa.int64()), ("bin", pa.int64()), ("n", pa.int64())])
HIT_SCHEMA = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _finite(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, Column]:
    """The rows that take part, and their components as doubles."""
    wide = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(fine), wide


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, v): floor(scale * x) of each component, as a double, for all vectors that take part; repeated ids stay.

    From 2**52 on every double is whole, so ``scale`` must be a power of two for exact products.
    """
    rows, wide = _finite(vectors, id_col, vector_col)
    scaled = F.transform(wide, lambda x: F.when(F.abs(x) < float(1 << 52) / scale, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), scaled.alias("v")).withColumn("dim", F.size("v"))


def _blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Rows (row, vec_id, v, dim) packed by dimension into about n / size blocks of the shared folder: (dim, block, uri, rows)."""
    folder = work_dir(rows.sparkSession, "vector-blocks")
    block = F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // size)))).cast("int")
    packed = rows.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("row", "vec_id", "v")).alias("all"))
    packed = packed.select("dim", "block", F.col("all.row").alias("rows"), F.col("all.vec_id").alias("ids"), F.flatten("all.v").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uris = []
            for k in range(batch.num_rows):
                rows, ids, v = (batch.column(i)[k].values.to_numpy() for i in (2, 3, 4))
                uris.append(publish(folder, f"block-{batch.column(0)[k]}-{batch.column(1)[k]}", lambda out, x=(rows, ids, _narrow(v)): np.savez(out, *x)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(uris, pa.string()), batch.column(2)], names=["dim", "block", "uri", "rows"])

    return written(packed.mapInArrow(run, "dim int, block int, uri string, rows array<long>"), "blocks")


def _narrow(v: np.ndarray) -> np.ndarray:
    """The whole numbers ``v`` in the narrowest kind that holds them."""
    for kind in (np.int8, np.int16, np.int32):
        limits = np.iinfo(kind)
        if not len(v) or limits.min <= v.min() <= v.max() <= limits.max:
            return v.astype(kind)
    return v


class _Files(OrderedDict):
    """The block files that were read last."""

    def __missing__(self, uri: str) -> list[np.ndarray]:
        if len(self) >= FILES:
            self.popitem(last=False)
        with np.load(io.BytesIO(read_shared(uri))) as stored:
            self[uri] = arrays = [stored[name] for name in stored.files]
        return arrays


def _product(q: np.ndarray, c: np.ndarray, legal: np.ndarray) -> np.ndarray:
    """The exact inner products, as longs; an error if a legal one is none."""
    most = [max(int(x.max(initial=0)), -int(x.min(initial=0))) for x in (q, c)]
    bound = max(*most, most[0] * most[1] * q.shape[1])
    if bound <= LONG:
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    exact = [np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape) for m in (q, c)]
    scores = np.where(legal, exact[0] @ exact[1].T, 0)
    if scores.size and not -LONG <= scores.min() <= scores.max() <= LONG:
        raise ValueError("a score does not fit a long")
    return scores.astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each pair of blocks: query rows, candidate ids, the matrix of scores, which are of other ids, and the queries' intervals."""
    files = _Files()
    for batch in batches:
        for pair in batch.to_pylist():
            _, ids, v = files[pair["uri"]]
            rows, own, query_v = files[pair["query_uri"]]
            at, low, high = files[pair["bounds_uri"]]
            order = np.argsort(at)
            place = order[np.searchsorted(at, rows, sorter=order)]
            legal = own[:, None] != ids[None, :]
            dim = pair["dim"]
            scores = _product(query_v.reshape(-1, dim), v.reshape(-1, dim), legal) if dim else np.zeros(legal.shape, np.int64)
            yield rows, ids, scores, legal, low[place][:, None], high[place][:, None]


def _histograms(top: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, scores, legal, low, high in _scored(batches):
            inside = legal & (scores >= low) & (scores <= high)
            step = (scores.view(np.uint64) - low.view(np.uint64)) // np.uint64(width)  # the difference of two longs may be none
            place = np.where(inside, step.view(np.int64), BINS) + (np.arange(len(own)) * (BINS + 1))[:, None]
            counts = np.bincount(place.ravel(), minlength=len(own) * (BINS + 1)).reshape(len(own), BINS + 1)[:, :BINS]
            above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
            q, b = np.nonzero((counts > 0) & (above < top))
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(b.astype(np.int64)), pa.array(counts[q, b])], schema=PAIR_SCHEMA)

    return run


def _hits(top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, ids, scores, legal, kth, _ in _scored(batches):
            order = np.argsort(ids)
            ids, scores, legal = ids[order], scores[:, order], legal[:, order]
            equal = (scores == kth) & legal
            keep = ((scores > kth) & legal) | (equal & (np.cumsum(equal, axis=1) <= top))
            q, c = np.nonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(own[q]), pa.array(ids[c]), pa.array(scores[q, c])], schema=HIT_SCHEMA)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``top`` largest inner products with the rows of other ids.

    Both tables are as ``whole`` returns them (vec_id, v, dim). Ties go to the smaller
    vec_id; a query with fewer candidates gets all of them. Only vectors of one dimension meet. All rows
    of a repeated id are candidates of other ids; if a query's id is repeated, its rows are ranked together.
    Ids or vectors that are null, and vectors with null or non-finite components, take no part; an empty
    table gives an empty result. A score that does not fit a long is an error.
    """
    spark = vectors.sparkSession
    n, largest = vectors.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0).cast("double"), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    n_queries = queries.count()
    bound = min(LONG, int(min(largest or 0, 2.0**64) * (1 + 1e-9)) + 1)  # no inner product is larger than the largest squared length
    widths = [-(-(2 * bound + 1) // BINS)]
    while widths[-1] > 1:
        widths.append(-(-widths[-1] // BINS))
    number = F.monotonically_increasing_id()
    blocks = _blocks(vectors.withColumn("row", number), n, CANDIDATES).drop("rows")
    numbered = written(queries.withColumn("row", number), "queries")
    query_blocks = _blocks(numbered, n_queries, QUERIES).select("dim", F.col("block").alias("query_block"), F.col("uri").alias("query_uri"), "rows")
    placed = query_blocks.select("dim", "query_block", F.explode("rows").alias("row"))
    state = placed.withColumns({"low": F.lit(-bound).cast("long"), "high": F.lit(bound).cast("long"), "need": F.lit(top).cast("long")})
    n_blocks = max(1, -(-n // CANDIDATES))
    ways = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks * n_queries // (QUERIES * PAIRS)))

    def paired(state: DataFrame) -> DataFrame:
        """A row for each pair of blocks with the addresses of both and of the queries' intervals; pairs of a candidate block lie together."""
        folder = work_dir(spark, "search-bounds")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                uris = []
                for k in range(batch.num_rows):
                    bounds = [batch.column(i)[k].values.to_numpy() for i in (2, 3, 4)]
                    uris.append(publish(folder, f"bounds-{batch.column(0)[k]}-{batch.column(1)[k]}", lambda out, x=bounds: np.savez(out, *x)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(uris, pa.string())], names=["dim", "query_block", "bounds_uri"])

        bounds = state.groupBy("dim", "query_block").agg(F.collect_list(F.struct("row", "low", "high")).alias("all"))
        bounds = bounds.select("dim", "query_block", "all.row", "all.low", "all.high").mapInArrow(run, "dim int, query_block int, bounds_uri string")
        addresses = written(query_blocks.drop("rows").join(bounds, ["dim", "query_block"]), "query-blocks")
        # Bounded by the blocks: a block has thousands of vectors.
        dealt = addresses.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, ["dim", "block"])
        return dealt.repartition(ways, "dim", "block", F.floor(F.col("query_block") / PAIRS)).sortWithinPartitions("dim", "block", "query_block")

    for width in widths:
        counts = paired(state).mapInArrow(_histograms(top, width), PAIR_DDL).groupBy("row", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("row").orderBy(F.desc("bin"))
        reached = counts.withColumn("sum", F.sum("n").over(down)).withColumn("before", F.col("sum") - F.col("n"))
        # The bin that holds the k-th; a query with fewer candidates keeps the lowest bin that it has.
        held = reached.join(state.select("row", "need"), "row")
        held = held.groupBy("row").agg(
            F.coalesce(F.max(F.when(F.col("sum") >= F.col("need"), F.struct("bin", "before"))), F.min(F.struct("bin", "before"))).alias("at")
        )
        held = held.select("row", F.col("at.bin").alias("bin"), F.col("at.before").alias("before"))
        # In decimals: bins times width may be no long.
        low = F.col("low").cast("decimal(20,0)") + (F.col("bin").cast("decimal(10,0)") * F.lit(width).cast("decimal(20,0)")).cast("decimal(30,0)")
        state = state.join(held, "row").select(
            "dim", "query_block", "row",
            low.cast("long").alias("low"),
            F.least(F.col("high").cast("decimal(38,0)"), (low + F.lit(width - 1).cast("decimal(20,0)")).cast("decimal(38,0)")).cast("long").alias("high"),
            (F.col("need") - F.col("before")).alias("need"),
        )
        state = written(state, "search-state")
    hits = paired(state).mapInArrow(_hits(top), "row long, vec_id long, score long").join(numbered.select("row", F.col("vec_id").alias("query_id")), "row")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the 20 best of every vector whose id is divisible by 20, against all other vectors."""
    vectors = written(whole(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return top_k(vectors, vectors.filter(f"vec_id % {QUERY_STEP} = 0"))


ORACLE = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_STEP} = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
