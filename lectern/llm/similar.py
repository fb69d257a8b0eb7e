"""Near-duplicate texts by similarity: wide SimHash fingerprints, anchors in many fields, links checked exactly.

At a Jaccard similarity of 0.8 about 15 % of a SimHash fingerprint's bits differ, which no 64 bits can
tell from chance and no radius of a few bits reaches. So a set of word shingles gets a fingerprint of
``64 * WORDS`` bits, and many fields of ``bits`` sampled bits each. The anchors of a field are, as in ``simhash``, the
words of a covering code: the Hamming (15, 11) code times all words of the other bits, with covering radius 1. A
fingerprint has one home anchor in each field and is replicated to every anchor within radius plus threshold (2), so it meets
each one that differs by at most ``THRESHOLD`` bits in the field at that one's home. ``plan`` takes bits from the number of
sets, so that an anchor has some ``ROOM`` times 16 homes at most, and ``covering`` takes fields from the similarity, so that a pair
just at it is within the threshold in no field with a chance of at most ``MISSED``. (Sets of few shingles differ in up to 19 %
of their bits; of those just at the similarity up to 3 % are missed.)

Homes are compared with all rows of their anchor by whole fingerprints, in the streams of ``simhash``. A first pass over
the homes of ``FIRST`` fields compares each with the first of its anchor alone, which joins groups of copies at a cost
of their size. The second pass, over all fields and anchors, compares homes with rows that are still in other components. Each
pass runs twice. The first time it only names the rows that have a candidate; their shingle sets are
written to shared files. The second time, over these rows alone, it checks every candidate on the sets
themselves, the nearest of a batch first, but for those that links found before join already. So no
candidate is given up unchecked, a pair is checked in one task (that of the smaller one's home in the first field where it is within the threshold), and only
links that join something leave a task, never all pairs of a group.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.llm.common import content_hash, publish, small_batches, text_or_empty, trimmed, work_dir, written
from lectern.llm.simhash import _masks as code_masks
from lectern.llm.simhash import _syndrome, by_key, components, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint; standard deviations of the differing bits that are allowed beyond their mean.
WORDS, SPREAD = 4, 3
#: Chance that a pair just at the similarity is within the threshold in no field; sets that a word of a field has on average.
MISSED, ROOM = 1e-3, 16
#: Bits that the code of a field covers, at least; differing bits of a field at which a pair must meet.
CODE_BITS, THRESHOLD = 15, 1
#: Fields of the first pass; candidates that are looked at before what they joined counts; rows that a task hands on at once.
FIRST, STEP, FLUSH = 6, 1 << 12, 1 << 16
#: Bytes of shingle sets that a task holds, and files that it holds open; bits of an address that tell the place in a file.
HELD_BYTES, HELD_FILES, PLACE_BITS = 64 << 20, 32, 36
#: Rows of an anchor that one task takes at most, and pairs of them in the second pass; beyond either it is cut into tiles.
TILE_ROWS, TILE_PAIRS = 1 << 18, 1 << 22
#: Keys that are broadcast to pick rows by them; more of them are joined by a shuffle.
BROADCAST_ROWS = 250_000

PRINTS = [f"w{i}" for i in range(WORDS)]
CARRIED = ["node", "size", "place", "root"]
ANCHOR_DDL = "bucket long, home boolean, " + ", ".join(f"{c} long" for c in [*PRINTS, *CARRIED])
NODE_SCHEMA = pa.schema([("node", pa.int64())])
PLACE_SCHEMA = pa.schema([("node", pa.int64()), ("part", pa.int64()), ("file", pa.string()), ("place", pa.int64())])
PAIR_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def plan(similarity: float, n: int) -> tuple[int, int, int]:
    """Bits of a field, fields if it had to be equal, and the most bits that fingerprints of the similarity differ in (but for SPREAD deviations)."""
    if not 0 < similarity <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    bits = min(28, max(12, math.ceil(math.log2(max(1, n / ROOM)))))
    met = (1 - differ) ** bits
    fields = 1 if met == 1 else math.ceil(math.log(MISSED) / math.log1p(-met))
    mean = 64 * WORDS * differ
    return bits, fields, math.floor(mean + SPREAD * math.sqrt(mean * (1 - differ)))


def covering(similarity: float, n: int) -> tuple[int, int, int]:
    """Bits of a field that a code covers, fields of which a pair is within the threshold in one at least, and the most differing bits."""
    bits, _, distance = plan(similarity, n)
    bits = max(CODE_BITS, bits)
    differ = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    met = sum(math.comb(bits, k) * differ**k * (1 - differ) ** (bits - k) for k in range(THRESHOLD + 1))
    return bits, 1 if met == 1 else math.ceil(math.log(MISSED) / math.log1p(-met)), distance


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; a text of fewer words has one, one without words none."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, shingle)]))


def wide_print(shingles: np.ndarray) -> np.ndarray:
    """The fingerprint of a set: a bit is 1 if set in over half of its hashes, mixed anew for each word."""
    ones = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(shingles), 4096):
        h = shingles[at : at + 4096, None] + np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        ones += np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(shingles), bitorder="little").view(np.uint64)


def _sets(schema: pa.Schema, n_keys: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(x, shingle) for x in batch.column(n_keys).to_pylist()]
            prints = np.stack([wide_print(x) for x in own]).view(np.int64) if own else np.empty((0, WORDS), np.int64)
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in own]
            cols = [*batch.columns[:n_keys], pa.array(digests, pa.binary()), pa.array([len(x) for x in own], pa.int64()), *map(pa.array, np.ascontiguousarray(prints.T))]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


def _positions(bits: int, fields: int) -> np.ndarray:
    """Which bits each field samples; all bits are used alike often."""
    rng, size = np.random.default_rng(64), 64 * WORDS
    return np.stack([row for _ in range(-(-fields // (size // bits))) for row in rng.permutation(size)[: size // bits * bits].reshape(-1, bits)])[:fields]


def _masks(positions: np.ndarray) -> np.ndarray:
    """The sampled bits of each field, as the words of a fingerprint."""
    out = np.zeros((len(positions), WORDS), np.uint64)
    for k, own in enumerate(positions.tolist()):
        for bit in own:
            out[k, bit // 64] |= np.uint64(1 << bit % 64)
    return out


def _anchors(positions: np.ndarray, homes_alone: bool):
    """Rows (words, then CARRIED) to one row for each anchor of each field within radius plus threshold, or for each home."""
    bits = positions.shape[1]
    place = np.int64(1) << np.arange(bits, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [m[:1] if homes_alone else m for m in code_masks(bits, THRESHOLD)]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                words = np.ascontiguousarray(np.stack([part.column(i).to_numpy() for i in range(WORDS)], axis=1))
                set_bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")
                field = np.concatenate([(set_bits[:, p].astype(np.int64) @ place) | (np.int64(k) << 32) for k, p in enumerate(positions)])
                syndrome = _syndrome(field)
                found = []
                for s in np.unique(syndrome).tolist():
                    own, mask = np.flatnonzero(syndrome == s), masks[s]
                    home = np.zeros((len(own), len(mask)), bool)
                    home[:, 0] = True
                    found.append(((field[own][:, None] ^ mask).ravel(), home.ravel(), np.repeat(own % len(words), len(mask))))
                bucket, home, again = (np.concatenate(x) for x in zip(*found, strict=True))
                again = pa.array(again)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(home), *(c.take(again) for c in part.columns)], names=["bucket", "home", *PRINTS, *CARRIED])

    return run


def _candidates(batches: Iterator[pa.RecordBatch], distance: int, similarity: float, how: str, masks: np.ndarray) -> Iterator[tuple]:
    """(places, other places, the columns) of rows of different roots that may be similar, the nearest of a chunk first.

    In the pass by roots a pair comes once in all tasks: from the first field where it is within the threshold, at the home of
    the smaller node (of a tiled anchor, from the tile where that one is the home).
    """
    for mine, other, bits, cols in by_key(batches, WORDS, distance, how):
        node, size, _, root = cols[3 + WORDS :]
        # The similarity is at most the ratio of the sizes.
        ok = (root[mine] != root[other]) & (np.minimum(size[mine], size[other]) >= np.maximum(size[mine], size[other]) * (similarity * (1 - 1e-9)))
        if how == "roots":
            home = cols[2].astype(bool)
            ok &= np.where(home[other], cols[1][mine] < 0, node[mine] < node[other])
        at = np.flatnonzero(ok)
        if how == "roots" and len(at):
            own = [c.view(np.uint64) for c in cols[3 : 3 + WORDS]]
            chunk = max(1, (1 << 18) // len(masks))
            first = np.ones(len(at), bool)
            for k in range(0, len(at), chunk):
                x, y = mine[at[k : k + chunk]], other[at[k : k + chunk]]
                apart = np.zeros((len(x), len(masks)), np.uint8)
                for w, words in enumerate(own):
                    apart += np.bitwise_count((words[x] ^ words[y])[:, None] & masks[None, :, w])
                first[k : k + chunk] = np.argmin(apart > THRESHOLD, axis=1) == cols[0][x] >> 32
            at = at[first]
        if len(at):
            at = at[np.argsort(bits[at], kind="stable")]
            yield mine[at], other[at], cols


def _met(distance: int, similarity: float, how: str, masks: np.ndarray):
    """The nodes of the rows that have a candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, np.int64)
        for mine, other, cols in _candidates(batches, distance, similarity, how, masks):
            held = np.unique(np.concatenate([held, cols[3 + WORDS][mine], cols[3 + WORDS][other]]))
            if len(held) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(held)], schema=NODE_SCHEMA)
                held = np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held)], schema=NODE_SCHEMA)

    return run


class SharedSets:
    """Shingle sets by their address in shared files; those that were not used for longest go beyond HELD_BYTES."""

    def __init__(self, files: dict[int, str]):
        self.files = files
        self.streams: OrderedDict = OrderedDict()
        self.held: OrderedDict = OrderedDict()
        self.bytes = 0

    def _stream(self, part: int):
        import pyarrow.fs as pafs

        if part in self.streams:
            self.streams.move_to_end(part)
        else:
            fs, path = pafs.FileSystem.from_uri(self.files[part])
            self.streams[part] = fs.open_input_file(path)
            if len(self.streams) > HELD_FILES:
                self.streams.popitem(last=False)[1].close()
        return self.streams[part]

    def at(self, place: int, size: int) -> np.ndarray:
        if place in self.held:
            self.held.move_to_end(place)
        else:
            data = self._stream(place >> PLACE_BITS).read_at(8 * size, 8 * (place & ((1 << PLACE_BITS) - 1)))
            self.held[place] = np.frombuffer(data, np.uint64)
            self.bytes += 8 * size
            while self.bytes > HELD_BYTES and len(self.held) > 2:
                self.bytes -= self.held.popitem(last=False)[1].nbytes
        return self.held[place]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets without repeats, neither empty."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _linked(distance: int, similarity: float, how: str, masks: np.ndarray, files: dict[int, str]):
    """Links (a, b) of the similarity, exactly checked, whose components are those of all that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, parent, out = SharedSets(files), {}, []

        def find(x: int) -> int:
            top = x
            while (up := parent.get(top, top)) != top:
                top = up
            while (up := parent.get(x, x)) != top:
                parent[x], x = top, up
            return top

        def tops(roots: np.ndarray) -> np.ndarray:
            own, back = np.unique(roots, return_inverse=True)
            return np.array([find(x) for x in own.tolist()], np.int64)[back]

        for mine, other, cols in _candidates(batches, distance, similarity, how, masks):
            node, size, place, root = cols[3 + WORDS :]
            for at in range(0, len(mine), STEP):
                x, y = mine[at : at + STEP], other[at : at + STEP]
                still = tops(root[x]) != tops(root[y])
                for i, j in zip(x[still].tolist(), y[still].tolist(), strict=True):
                    p, q = find(int(root[i])), find(int(root[j]))
                    if p != q and jaccard(sets.at(int(place[i]), int(size[i])), sets.at(int(place[j]), int(size[j]))) >= similarity:
                        parent[max(p, q)] = min(p, q)
                        out.append((int(node[i]), int(node[j])))
            if len(out) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PAIR_SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=PAIR_SCHEMA)

    return run


def picked(df: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """``df`` joined with ``keys`` on ``names`` (nulls are equal); few keys, by their count, are broadcast, so that ``df`` stays put."""
    few = keys.count() <= BROADCAST_ROWS
    own = keys.select(*[F.col(c).alias(f"key_{i}_") for i, c in enumerate(names)], *[c for c in keys.columns if c not in names])
    same = [F.col(c).eqNullSafe(F.col(f"key_{i}_")) for i, c in enumerate(names)]
    out = df.join(own.hint("broadcast" if few else "merge"), same, how)
    return out.drop(*[f"key_{i}_" for i in range(len(names))])


def _stored(shingle: int, folder: str):
    """Rows (node, text), sorted by node, to the places of their shingle sets in a file of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        nodes, places, at = [], [], 0

        def write(stream):
            nonlocal at
            for batch in batches:
                for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not nodes or nodes[-1] != node:  # rows of equal keys have equal texts
                        own = shingle_set(text, shingle)
                        stream.write(own.tobytes())
                        nodes.append(node)
                        places.append(part << PLACE_BITS | at)
                        at += len(own)

        file = publish(folder, f"sets-{part}", write)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([part] * len(nodes), pa.int64()), pa.array([file] * len(nodes), pa.string()), pa.array(places, pa.int64())], schema=PLACE_SCHEMA)

    return run


def _hot(rows: DataFrame, how: str) -> DataFrame:
    """(bucket, side) of the anchors that are cut into tiles: those of too many rows, and in the pass by roots those of too many pairs of different roots."""
    homes = F.count_if("home").cast("double").alias("homes")
    many = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("count"), homes)
    many = many.filter((F.col("count") > TILE_ROWS) | (F.col("homes") * F.col("count") > TILE_PAIRS))
    many = written(many, "large-anchors")
    by_rows = F.ceil(F.col("count") / TILE_ROWS)
    if how == "leaders" or many.isEmpty():
        return many.select("bucket", by_rows.cast("int").alias("side")).filter("side > 1")
    alike = rows.join(many.select("bucket"), "bucket", "left_semi").groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("count"), homes)
    alike = alike.groupBy("bucket").agg(F.sum(F.col("homes") * F.col("count")).alias("alike"))
    pairs = F.greatest(F.lit(0.0), F.col("homes") * F.col("count") - F.col("alike"))
    side = F.greatest(by_rows, F.ceil(F.sqrt(pairs / TILE_PAIRS)), F.lit(1))
    return many.join(alike, "bucket").select("bucket", side.cast("int").alias("side")).filter("side > 1")


def _dealt(rows: DataFrame, how: str, ways: int) -> DataFrame:
    """Anchor rows by bucket and tile, sorted for ``by_key``; each tile of a large anchor is another task's.

    For the leaders an anchor's shares have leaders of their own. By roots, tile i * side + j has the homes of share i and the rows
    of share j, homes among them; an anchor that is not cut is tile -1, where a home comes once.
    """
    rows = rows.join(written(_hot(rows, how), "hot-anchors"), "bucket", "left").withColumn("side", F.coalesce("side", F.lit(1)))
    share = F.pmod(F.xxhash64("node"), F.col("side")).cast("int")
    if how == "leaders":
        rows = rows.withColumn("tile", share)
    else:
        every = F.sequence(F.lit(0), F.col("side") - 1)
        own = lambda tile, home: F.struct(tile.alias("tile"), home.alias("as_home"))
        met = F.transform(every, lambda i: own(i * F.col("side") + share, F.lit(False)))
        tiles = F.when(F.col("home"), F.concat(F.transform(every, lambda i: own(share * F.col("side") + i, F.lit(True))), met)).otherwise(met)
        tiles = F.when(F.col("side") == 1, F.array(own(F.lit(-1), F.col("home")))).otherwise(tiles)
        rows = rows.withColumn("t", F.explode(tiles)).withColumns({"tile": F.col("t.tile"), "home": F.col("t.as_home")})
    dealt = rows.select("bucket", "tile", "home", *PRINTS, *CARRIED).repartition(ways, "bucket", "tile")
    return dealt.sortWithinPartitions("bucket", "tile", *(["node"] if how == "leaders" else [F.desc("home"), "root"]))


def groups(docs: DataFrame, keys: list[str], text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The columns ``keys`` of each row of ``docs`` and ``first`` (a struct): the least keys of the row's group.

    Groups are the components of links: pairs of texts whose sets of word shingles have a Jaccard
    similarity of ``similarity`` or more (a miss has the chance that the module states). Words are as in
    ``simhash``. Texts without words (null ones too) are alike, and so are texts of fewer words than a
    shingle if their words are the same. Rows of equal keys must have equal texts; keys may have any names but first, and
    may be null. Repeated rows are kept. An empty table stays empty.
    """
    spark = docs.sparkSession
    own = [f"key{i}" for i in range(len(keys))]
    texts = docs.select(*[F.col(k).alias(c) for k, c in zip(keys, own, strict=True)], text_or_empty(text_col).alias("text"))
    kinds = texts.drop("text").schema
    schema = to_arrow_schema(kinds)
    for name, kind in [("digest", pa.binary()), ("size", pa.int64()), *((w, pa.int64()) for w in PRINTS)]:
        schema = schema.append(pa.field(name, kind))
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), "digest binary, size long", *(f"{w} long" for w in PRINTS)])
    made = written(small_batches(texts).mapInArrow(lambda it: trimmed(_sets(schema, len(keys), shingle)(it)), ddl), "shingle-sets")
    sets = made.groupBy("digest").agg(F.min(F.struct(*own)).alias("first"), *[F.min(c).alias(c) for c in ("size", *PRINTS)])
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")

    some = sets.filter("size > 0").select(*PRINTS, "node", "size")
    bits, fields, distance = covering(similarity, some.count())
    ways = int(spark.conf.get("spark.sql.shuffle.partitions"))
    positions = _positions(bits, fields)
    known, tree = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([], "node long, root long")
    for how, places in (("leaders", positions[:FIRST]), ("roots", positions)):
        masks = _masks(places)

        def anchored(rows: DataFrame, how=how, places=places) -> DataFrame:
            rows = rows.select(*PRINTS, *CARRIED).repartition(ways)
            return _dealt(rows.mapInArrow(lambda it: trimmed(_anchors(places, how == "leaders")(it)), ANCHOR_DDL), how, ways)

        rows = some.join(tree, "node", "left").withColumns({"root": F.coalesce("root", "node"), "place": F.lit(0).cast("long")})
        met = anchored(rows).mapInArrow(lambda it, how=how, masks=masks: trimmed(_met(distance, similarity, how, masks)(it)), "node long")
        met = written(met.distinct(), "met-sets")
        if met.isEmpty():
            continue
        wanted = written(sets.join(met, "node").select("first.*", "node"), "wanted-sets")
        found = picked(texts, wanted, own, "inner").select("node", "text").repartition(ways, "node").sortWithinPartitions("node")
        folder = work_dir(spark, f"sets-{how}-{uuid.uuid4().hex[:8]}")
        stored = small_batches(found).mapInArrow(lambda it, folder=folder: trimmed(_stored(shingle, folder)(it)), "node long, part long, file string, place long")
        stored = written(stored, "stored-sets")
        files = dict(map(tuple, stored.select("part", "file").distinct().collect()))  # one for each shuffle partition, whatever the corpus
        links = anchored(rows.drop("place").join(stored.select("node", "place"), "node"))
        links = links.mapInArrow(lambda it, how=how, masks=masks, files=files: trimmed(_linked(distance, similarity, how, masks, files)(it)), "a long, b long")
        known = written(known.unionAll(links), "known-links")
        tree = components(known)
    rooted = written(sets.select("digest", "node", "first").join(tree, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root")), "rooted-sets")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    # As many as distinct texts, so neither side is broadcast, however few they are.
    final = written(rooted.join(least.hint("merge"), "root").select("digest", F.col("least").alias("first")), "set-groups")
    out = made.select(*own, "digest").join(final.hint("merge"), "digest")
    return out.select(*[F.col(c).alias(k) for k, c in zip(keys, own, strict=True)], F.struct(*[F.col(f"first.{c}").alias(k) for k, c in zip(keys, own, strict=True)]).alias("first"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id (a long) and component_id of each row of ``docs``: the smallest id of its group.

    Repeated ids and rows are kept, each with its own group; a null id gets the smallest id of its group (null if it has none).
    Null and empty texts are one group. An empty table stays empty. Other columns are left out, so no name can clash.
    """
    text = text_or_empty(text_col)
    keys = {"no_id": F.col(id_col).isNull(), "doc_id": F.col(id_col).cast("long"), "hash_1": F.xxhash64(F.lit(0), text), "hash_2": F.xxhash64(F.lit(1), text)}
    own = docs.select(*[c.alias(k) for k, c in keys.items()], text.alias("text"))
    return groups(own, list(keys), "text", shingle, similarity).select("doc_id", F.col("first.doc_id").alias("component_id"))


def row_keys(docs: DataFrame, id_col: str = "doc_id") -> dict[str, Column]:
    """Columns that tell all different rows of ``docs`` apart and order them by id, null last: no_id, id, two hashes of all columns."""
    return {"no_id": F.col(id_col).isNull(), "id": F.col(id_col), "hash_1": content_hash(docs), "hash_2": content_hash(docs, seed=1)}


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group: the one with the least id; of repeated rows one stays.

    Texts are neither written again nor shuffled, unless more rows go than are broadcast or some rows occur twice.
    """
    columns = docs.columns
    made = row_keys(docs, id_col)
    names = {k: f"{k}_of_row_" for k in made}
    while any(c.lower() in {n.lower() for n in names.values()} for c in columns):
        names = {k: n + "_" for k, n in names.items()}
    keys = list(names.values())
    keyed = docs.withColumns({names[k]: c for k, c in made.items()})
    found = written(groups(keyed, keys, text_col, shingle, similarity), "row-groups")
    hashes = [names["hash_1"], names["hash_2"]]
    other = ~(F.col(hashes[0]).eqNullSafe(F.col(f"first.{hashes[0]}")) & F.col(hashes[1]).eqNullSafe(F.col(f"first.{hashes[1]}")))
    gone = written(found.filter(other).select(*hashes).distinct(), "rows-gone")
    again = written(found.filter(~other).groupBy(*hashes).count().filter("count > 1").select(*hashes), "rows-again")
    left = picked(keyed, gone, hashes, "left_anti")
    if again.isEmpty():
        return left.select(*columns)
    twice = picked(left, again, hashes, "left_semi").dropDuplicates(hashes)
    return picked(left, again, hashes, "left_anti").unionAll(twice).select(*columns)
