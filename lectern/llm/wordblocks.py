"""A corpus-wide shuffle of distinct words, with the documents kept as word numbers of their block.

``split`` cuts documents into blocks of bounded size. A block holds each document as a row of word
numbers, in a file of the shared folder that is read where the block is put together, and its distinct
words dealt into parts by hash; both are compressed. ``by_word`` streams the words of a part from all
blocks through one task, which remembers its distinct words and works on each once, and ``by_block``
brings what was found for them back to the block, where the documents are put together again. The
number of parts follows from the bytes of text. A frequent word is one entry a block and never a hot
key, and a long document is only a longer row. Blocks are a written table, so that both shuffles start from it.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, publish, read_shared, release, small_batches, text_or_empty, trimmed, work_dir, written

#: Text and distinct words of a block at most (a longer document is a block of its own).
BLOCK_BYTES, BLOCK_WORDS = 8 << 20, 200_000
#: Text for each part (of which a task holds the distinct words), and parts at most, as a block has a row for each.
PART_BYTES, MOST_PARTS = 256 << 20, 1 << 16
#: Rows of an Arrow batch that are Python objects at once.
ROWS = 256

BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("docs", pa.string())])
BLOCK_DDL = "block long, part int, words binary, docs string"
FOUND_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("found", pa.binary())])
FOUND_DDL = "block long, part int, found binary"


def pack(*arrays: np.ndarray, level: int = 3) -> bytes:
    """Arrays as one compressed value; integers by planes of bytes, which compress far better."""
    import zstandard

    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str},{len(a)};".encode()
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if a.itemsize > 1 else a.tobytes()
        out.append(len(head).to_bytes(1, "little") + head + planes)
    return zstandard.ZstdCompressor(level=level).compress(b"".join(out))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    while at < len(raw):
        n = raw[at]
        kind, count = raw[at + 1 : at + 1 + n].decode().rstrip(";").split(",")
        at, kind, count = at + 1 + n, np.dtype(kind), int(count)
        size = kind.itemsize * count
        planes = np.frombuffer(raw, np.uint8, size, at)
        out.append(planes.view(kind) if kind.itemsize == 1 else np.ascontiguousarray(planes.reshape(kind.itemsize, count).T).view(kind).ravel())
        at += size
    return out


def pack_words(words: list[bytes], *more: np.ndarray) -> bytes:
    return pack(np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8), *more)


def unpack_words(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    lengths, flat, *more = unpack(data)
    raw, ends = flat.tobytes(), np.cumsum(lengths.astype(np.int64))
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], more


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _block(number: int, parts: int, words: _Numbers, rows: list[np.ndarray], ids: list, learns: list[bool], weights: bool, folder: str) -> pa.RecordBatch:
    """One row for the documents' file and one for each part with words. Words are numbered by frequency, which packs best."""
    own = [w if isinstance(w, bytes) else w.encode() for w in words]
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    seq = np.concatenate(rows) if rows else np.empty(0, np.int32)
    often = np.argsort(-np.bincount(seq, minlength=len(own)), kind="stable")
    rank = np.empty(len(own), np.int32)
    rank[often] = np.arange(len(own), dtype=np.int32)
    own = [own[i] for i in often.tolist()]
    seq = rank[seq]
    part = np.fromiter((zlib.crc32(w) % parts for w in own), np.int64, len(own))
    known = np.array([x is not None for x in ids], np.uint8)
    docs = pack(np.array([x or 0 for x in ids], np.int64), known, lengths, part.astype(np.uint16 if parts < 1 << 16 else np.uint32), seq.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32))
    counts = np.bincount(seq[np.repeat(np.array(learns, bool), lengths)], minlength=len(own)) if weights else None
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts), side="right")
    out = [(number, -1, None, publish(folder, f"docs-{number:016x}", lambda stream: stream.write(docs)))]
    begin = 0
    for k, end in enumerate(ends.tolist()):
        if end > begin:
            mine = order[begin:end]
            out.append((number, k, pack_words([own[i] for i in mine.tolist()], *([counts[mine]] if weights else [])), None))
        begin = end
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), BLOCK_SCHEMA, strict=True)], schema=BLOCK_SCHEMA)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        yield from zip(*(part.column(k).to_pylist() for k in range(part.num_columns)), strict=True)


def split(docs: DataFrame, words_of: Callable[[str], Iterable], id_col: str, text_col: str, learn=None) -> tuple[DataFrame, int]:
    """The written blocks of ``docs`` and the number of parts.

    ``learn``: a boolean column; if given, each word carries how often it occurs in rows where it is true.
    """
    counted, folder = learn is not None, work_dir(docs.sparkSession, "word-block-docs")
    total = docs.agg(F.sum(F.octet_length(text_or_empty(text_col)))).first()[0] or 0
    parts = min(MOST_PARTS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_BYTES)))
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), (F.lit(True) if learn is None else learn).alias("learn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        number, size, words, rows, ids, learns = 0, 0, _Numbers(), [], [], []
        for batch in batches:
            for i, text, teaches in _rows(batch):
                own = words_of(text)
                rows.append(np.fromiter(map(words.__getitem__, own), np.int32, len(own)))
                ids.append(i)
                learns.append(teaches)
                size += len(text)
                if size >= BLOCK_BYTES or len(words) >= BLOCK_WORDS:
                    yield _block(first + number, parts, words, rows, ids, learns, counted, folder)
                    number, size, words, rows, ids, learns = number + 1, 0, _Numbers(), [], [], []
        if ids:
            yield _block(first + number, parts, words, rows, ids, learns, counted, folder)

    return written(narrow.mapInArrow(lambda it: trimmed(run(it)), BLOCK_DDL), "word-blocks"), parts


def by_word(blocks: DataFrame, parts: int, work: Callable[[int, Iterator[tuple[int, bytes]]], Iterator[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """``work(part, (block, its packed words) one by one)`` over each part's words from all blocks; it yields rows of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for at in range(0, batch.num_rows, ROWS) for row in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True))
        for part, own in groupby(rows, key=lambda row: row[0]):
            yield from in_batches(((row, sum(len(x) for x in row if isinstance(x, bytes))) for row in work(part, ((b, w) for _, b, w in own))), schema)

    dealt = small_batches(blocks).filter("part >= 0").select("part", "block", "words").repartition(parts, "part").sortWithinPartitions("part", "block")
    return dealt.mapInArrow(lambda it: trimmed(run(it)), ddl)


def by_block(blocks: DataFrame, found: DataFrame, work: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``work(ids, lengths, word numbers, packed findings by part)`` over each block; it returns columns of ``schema``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, known, lengths, part, seq = unpack(read_shared(left["docs"][0].as_py()))
        place = np.empty(len(part), np.int32)  # of a word among the findings, which follow the parts
        place[np.argsort(part, kind="stable")] = np.arange(len(part), dtype=np.int32)
        cols = work(lengths, place[seq], right.sort_by("part")["found"].to_pylist())
        release()
        return pa.table([pa.array(ids, mask=known == 0), *cols], schema=schema)

    rows = blocks.filter("part < 0").select("block", "docs")
    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, ddl)
