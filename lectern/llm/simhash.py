"""SimHash near-duplicates by anchor-point covering, and connected components of the links.

Two fingerprints of 64 bits within 4 differing bits must, by the pigeonhole principle, differ in at
most 1 bit of the first 21, or in at most 1 bit of the next 21, or in none of the last 22 (1+1, 1+1
and 0+1 add up to the 5 > 4 that is needed). For each of the first two fields the anchors are the
words of a covering code: the Hamming (15, 11) code times all words of the other 6 bits, with
covering radius 1. The last field's code is the whole space, with radius 0. A fingerprint has one
home anchor in each field, within the radius, and is replicated to every anchor within radius plus
threshold (14 or 22 of them, or 1), so it meets each neighbour at that neighbour's home. ``layout``
lays out other distances alike, and two fields of 32 bits (two Hamming codes each) for very many fingerprints.

Anchors are compared in streams of sorted rows, homes first, so that only homes are held. Only a
forest of the links leaves a task, never all pairs of a group; an anchor with more than ``HOT_HOMES``
homes is cut into tiles that other tasks take. Components follow from alternating large-star and
small-star steps over written tables. ``similar`` builds on this for links by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, text_or_empty, trimmed, written

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Fingerprints beyond which two fields of 32 bits are used: more anchors for each, but ten times fewer comparisons.
MANY = 1 << 26
#: Homes of an anchor beyond which it is cut into tiles.
HOT_HOMES = 1024
#: Pairs of 64 bits compared at once, shingles hashed at once, linked fingerprints held before their forest is handed on.
PAIRS, HASHES, FOREST = 1 << 20, 1 << 16, 1 << 17

PRINT_SCHEMA = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])
ANCHOR_SCHEMA = pa.schema([("bucket", pa.int64()), ("fp", pa.int64()), ("home", pa.bool_())])
EDGE_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def shingle_hashes(text: str, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's word shingles, ``HASHES`` at a time; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    first, last = (starts[: n - shingle + 1], ends[shingle - 1 :]) if n >= shingle else (starts[:1], ends[-1:])
    for at in range(0, len(first), HASHES):
        spans = zip(first[at : at + HASHES].tolist(), last[at : at + HASHES].tolist(), strict=True)
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text's word shingles, unsigned; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, shingle):
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], schema=PRINT_SCHEMA)

    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return narrow.mapInArrow(lambda it: trimmed(run(it)), "doc_id long, fp long")


def layout(distance: int, n: int) -> tuple[tuple[int, int, int, int], ...]:
    """(lowest bit, bits, differing bits allowed, Hamming codes) of each field for n fingerprints.

    Pairs within ``distance`` bits differ by at most the allowed bits in some field, as allowed bits and
    fields add up to more than ``distance``.
    """
    bits = (32, 32) if n > MANY and distance > 1 else (21, 21, 22)
    spare = max(0, distance + 1 - len(bits))
    allowed = [spare // len(bits) + (k < spare % len(bits)) for k in range(len(bits))]
    return tuple((sum(bits[:k]), bits[k], a, (len(bits) == 2) + 1 if a else 0) for k, a in enumerate(allowed))


def _syndrome(word: np.ndarray, codes: int = 1) -> np.ndarray:
    """Of Hamming codes on bits 0 to 14, 15 to 29: the exclusive or of the positions, from 1, of the bits that are set."""
    out = np.zeros_like(word)
    for code in range(codes):
        for bit in range(15):
            out ^= ((word >> (15 * code + bit)) & 1) * ((bit + 1) << (4 * code))
    return out


@cache
def _masks(bits: int = 21, allowed: int = 1, codes: int = 1) -> list[np.ndarray]:
    """For each syndrome: what to exclusive-or a field with to get its anchors within radius plus threshold; the first is the home."""
    near = np.concatenate([np.array([sum(1 << b for b in own) for own in combinations(range(bits), n)], np.int64) for n in range(codes + allowed + 1)])
    of = _syndrome(near, codes)
    # The home corrects each coded part alone, by at most one bit.
    parts = [(near >> (15 * c)) & 0x7FFF for c in range(codes)]
    home = (near >> (15 * codes) == 0) & np.all([np.bitwise_count(p) <= 1 for p in parts], axis=0)
    return [np.concatenate([near[(of == s) & home], near[(of == s) & ~home]]) for s in range(16**codes)]


def _anchors(fields: tuple[tuple[int, int, int, int], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 13):
                fp = batch.column(0).slice(at, 1 << 13).to_numpy().astype(np.int64)
                found = []
                for k, (low, bits, allowed, codes) in enumerate(fields):
                    field = (fp >> low) & ((1 << bits) - 1)
                    if not allowed:
                        found.append((field | (k << 32), fp, np.ones(len(fp), bool)))
                        continue
                    syndrome = _syndrome(field, codes)
                    masks = _masks(bits, allowed, codes)
                    for s in np.unique(syndrome).tolist():
                        own, mask = syndrome == s, masks[s]
                        home = np.zeros((int(own.sum()), len(mask)), bool)
                        home[:, 0] = True
                        found.append(((field[own][:, None] ^ mask | (k << 32)).ravel(), np.repeat(fp[own], len(mask)), home.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], schema=ANCHOR_SCHEMA)

    return run


class Forest:
    """Union-find over fingerprints; hands on a star for each tree."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.parent[max(x, y)] = min(x, y)

    def stars(self) -> pa.RecordBatch | None:
        rows = [(x, self.find(x)) for x in list(self.parent)]
        rows = [r for r in rows if r[0] != r[1]]
        self.parent = {}
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], schema=EDGE_SCHEMA) if rows else None


def near_pairs(prints: np.ndarray, own: np.ndarray, first: np.ndarray, stop: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each row ``own`` and the rows first to stop - 1 that it is compared with: the places of both and the bits, where within ``distance`` bits.

    ``prints`` has a column for each 64 bits; chunks are of a bounded size.
    """
    count = np.maximum(0, stop - first)
    ends = np.cumsum(count)
    pairs = PAIRS // prints.shape[1]
    at = 0
    while at < len(own):
        base = ends[at] - count[at]
        if count[at] > pairs:
            spans = [(at, at + 1, low, min(low + pairs, int(stop[at]))) for low in range(int(first[at]), int(stop[at]), pairs)]
            following = at + 1
        else:
            following = max(at + 1, int(np.searchsorted(ends, base + pairs, side="right")))
            spans = [(at, following, 0, 0)]
        for a, z, low, high in spans:
            if high:
                mine, other = np.full(high - low, own[a]), np.arange(low, high)
            else:
                n = count[a:z]
                local = np.cumsum(n) - n
                mine, other = np.repeat(own[a:z], n), np.repeat(first[a:z] - local, n) + np.arange(int(n.sum()))
            bits = np.zeros(len(mine), np.uint16)
            for w in range(prints.shape[1]):
                bits += np.bitwise_count(prints[mine, w] ^ prints[other, w])
            near = np.flatnonzero((bits <= distance) & (mine != other))
            yield mine[near], other[near], bits[near]
        at = following


def _changes(cols: list[np.ndarray]) -> np.ndarray:
    """A number for each run of rows that are equal in all columns."""
    new = np.zeros(len(cols[0]), bool)
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _of_other_roots(key: np.ndarray, home: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, first, stop): each home with the later homes of its key that have another root, and with the other rows before and after those of its root."""
    own = np.flatnonzero(home)
    side = 2 * key + ~home
    values, rank = np.unique(root, return_inverse=True)
    run = side * len(values) + rank
    low = lambda of, x: np.searchsorted(of, x, side="left")
    high = lambda of, x: np.searchsorted(of, x, side="right")
    others, same = side[own] + 1, run[own] + len(values)
    first = np.concatenate([high(run, run[own]), low(side, others), high(run, same)])
    stop = np.concatenate([high(side, side[own]), low(run, same), high(side, others)])
    return np.tile(own, 3), first, stop


def by_key(batches: Iterator[pa.RecordBatch], n_prints: int, distance: int, how: str = "homes") -> Iterator[tuple]:
    """(places, other places, bits, the columns) of near rows; rows (bucket, tile, home, prints, ...) come sorted by bucket and tile.

    ``how`` tells what is compared within a key. "homes": each home with all rows, homes come first. "roots": each home with
    the rows of other roots (the last column), two homes once; homes come first, and homes and others are sorted by root. "leaders":
    the first row with the others. Only what later rows are compared with is held between batches: the homes or the leader of the last key.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        old = len(held[0]) if held else 0
        if held:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        if not len(cols[0]):
            continue
        key = _changes(cols[:2])
        prints = np.stack([c.view(np.uint64) for c in cols[3 : 3 + n_prints]], axis=1)
        stays = np.diff(key, prepend=-1) > 0 if how == "leaders" else cols[2].astype(bool)
        own = np.flatnonzero(stays)
        stop = np.searchsorted(key, key[own], side="right")
        if how == "homes":
            first = np.searchsorted(key, key[own], side="left")
        elif how == "leaders":
            first = own + 1
        else:
            own, first, stop = _of_other_roots(key, stays, cols[-1])
        first = np.where(own < old, np.maximum(first, old), first)  # rows that were held have met each other
        for mine, other, bits in near_pairs(prints, own, first, stop, distance):
            yield mine, other, bits, cols
        keep = (key == key[-1]) & stays
        held = [c[keep] for c in cols]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for mine, other, _, cols in by_key(batches, 1, distance):
            forest.link(cols[3][mine], cols[3][other])
            if len(forest.parent) >= FOREST and (out := forest.stars()):
                yield out
        if out := forest.stars():
            yield out

    return run


def tiled(rows: DataFrame, hot: DataFrame, by: str, order: list, *more: str) -> DataFrame:
    """Rows (bucket, home, ...) as (bucket, tile, home, ...), dealt by bucket and tile and sorted by these and ``order``.

    ``hot`` (bucket, side) names the anchors that are cut into side x side tiles. A tile is a share of the homes
    times a share of the rows (by the column ``by``): a home goes to all tiles of its share, and so does a row.
    """
    ways = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.join(hot, "bucket", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    share = F.pmod(F.xxhash64(by), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    tiles = F.when(F.col("side") == 1, F.array(F.struct(F.lit(0).alias("tile"), F.col("home").alias("as_home")))).otherwise(
        F.concat(
            F.transform(every, lambda i: F.struct((i * F.col("side") + share).alias("tile"), F.lit(False).alias("as_home"))),
            F.when(F.col("home"), F.transform(every, lambda i: F.struct((share * F.col("side") + i).alias("tile"), F.lit(True).alias("as_home")))).otherwise(F.array()),
        )
    )
    dealt = rows.select("bucket", *more, F.explode(tiles).alias("t")).select("bucket", "t.tile", F.col("t.as_home").alias("home"), *more)
    return dealt.repartition(ways, "bucket", "tile").sortWithinPartitions("bucket", "tile", *order)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``distance`` bits; ``prints`` has distinct values fp."""
    ways = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = layout(distance, prints.count())
    rows = prints.repartition(ways).mapInArrow(lambda it: trimmed(_anchors(fields)(it)), "bucket long, fp long, home boolean")
    hot = rows.filter("home").groupBy("bucket").count().filter(F.col("count") > HOT_HOMES)
    hot = written(hot.select("bucket", F.ceil(F.col("count") / HOT_HOMES).cast("int").alias("side")), "hot-anchors")
    return tiled(rows, hot, "fp", [F.desc("home")], "fp").mapInArrow(lambda it: trimmed(_links(distance)(it)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (columns a, b): root is its component's smallest node.

    Large-star and small-star steps alternate until the edges are stars. Each step's minima are
    summed up before their shuffle and written, so that a join on a hub can be split.
    """
    spark = edges.sparkSession
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")

    def step(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
        met = both.join(least, "u")
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return written(out.filter("a <> b").distinct(), "star-edges")

    def stars(edges: DataFrame) -> bool:
        """Whether every node is the centre of its edges or the end of a single one."""
        ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("end"), F.lit(0).alias("centre")).unionAll(edges.select(F.col("b"), F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("end").alias("end"), F.max("centre").alias("centre")).filter("end + centre > 1").isEmpty()

    if edges.isEmpty():
        return spark.createDataFrame([], "node long, root long")
    while not stars(edges):
        edges = step(step(edges, True), False)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return written(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root"))), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``.

    component_id is the smallest id that is reachable over links of at most ``distance`` differing bits. Rows
    without words have fingerprint 0 and link like any others. Repeated ids and rows are kept; a null
    id gets the smallest id of its component (null if it has none). An empty table stays empty. Other
    columns are left out, so no name can clash.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "first-ids")
    tree = components(links(firsts.select("fp"), distance))
    own = written(tree.join(firsts, tree.node == firsts.fp).select("fp", "root", "first"), "linked")
    least = written(own.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    linked = own.join(least, "root").select("fp", "component_id")
    final = firsts.join(linked.withColumnRenamed("fp", "node"), F.col("fp") == F.col("node"), "left")
    final = written(final.select("fp", F.coalesce("component_id", "first").alias("component_id")), "component-of")
    return prints.join(final, "fp").select("doc_id", "fp", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
