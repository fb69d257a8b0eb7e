"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries and document ids.

Layout of a file: the ids of all its documents, one after another (2 bytes each, little-endian, or 4
for vocabularies above 65,536); the Elias-Fano sections of the boundaries and of the document ids; a
fixed footer. A boundary is found by a select over the upper bits, with one 32-bit count for every
512 bits, so no table of 64-bit offsets is kept. Files are written in ascending document order and
each holds one range of documents.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, publish, small_batches, text_or_empty, trimmed, work_dir, written

END_ID = 2
#: Bits of the upper half of an Elias-Fano section that share one stored count.
SELECT_BITS = 512
#: Distinct pieces that a task remembers, and ids of them; the memory starts anew beyond either.
MEMO_LIMIT, MEMO_IDS = 1_000_000, 8 << 20
#: Text that is encoded at once, in bytes.
SLICE = 1 << 20
#: Text in a file, in bytes; smaller inputs get a file for each core, of no less than the second.
FILE_BYTES, LEAST_BYTES = 64 << 20, 8 << 20
#: Documents that are read back at once.
READ_DOCS = 2048
MAGIC = b"LECTERN1"
#: magic, bytes an id, documents, ids, null document ids, smallest document id, lengths of the two sections.
FOOTER = struct.Struct("<8sIQQQqQQ")
#: count of values, universe, bits of the lower half.
SECTION = struct.Struct("<QQI")

ROWS_DDL = "doc_id long, start long, n_tokens long, ids_crc32 long"
ROWS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
FILES_DDL = "part int, uri string, n_docs long, n_ids long"
FILES_SCHEMA = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


class EliasFano:
    """A non-decreasing sequence of n integers below a universe u in about n * (2 + log2(u / n)) bits."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, counts: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.counts = n, low_bits, low, high, counts

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :low_bits]
        size = (top >> low_bits) + n + 1
        one = np.zeros(-(-size // SELECT_BITS) * SELECT_BITS, np.uint8)
        one[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        counts = np.concatenate([[0], np.cumsum(one.reshape(-1, SELECT_BITS).sum(axis=1, dtype=np.int64))[:-1]])
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(one, bitorder="little"), counts.astype("<u4"))

    def select(self, start: int, stop: int) -> np.ndarray:
        """Values start to stop - 1, from the blocks of upper bits that hold them and their own lower bits."""
        if stop <= start:
            return np.empty(0, np.uint64)
        width = SELECT_BITS // 8
        first = int(np.searchsorted(self.counts, start, side="right")) - 1
        last = int(np.searchsorted(self.counts, stop - 1, side="right"))
        ones = np.flatnonzero(np.unpackbits(self.high[first * width : last * width], bitorder="little")) + first * SELECT_BITS
        at = ones[start - int(self.counts[first]) : stop - int(self.counts[first])]
        upper = (at - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return upper
        begin, end = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[begin // 8 : -(-end // 8)], bitorder="little")[begin % 8 :][: end - begin].reshape(-1, self.low_bits)
        full = np.zeros((stop - start, 64), np.uint8)
        full[:, : self.low_bits] = bits
        return upper | np.packbits(full, axis=1, bitorder="little").view("<u8").ravel()

    def to_bytes(self) -> bytes:
        return SECTION.pack(self.n, len(self.high), self.low_bits) + self.low.tobytes() + self.high.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, high, low_bits = SECTION.unpack_from(data)
        sizes = (np.uint8, -(-n * low_bits // 8)), (np.uint8, high), ("<u4", high * 8 // SELECT_BITS)
        at, parts = SECTION.size, []
        for kind, count in sizes:
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low_bits, *parts)


def _powers(factor: int, n: int) -> np.ndarray:
    """The first n powers of ``factor`` modulo 2**64."""
    out = np.full(n, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Encoder:
    """The tokenizers library over texts, each distinct piece of a task's texts encoded once.

    A piece starts before white space that follows something else, and before ASCII punctuation that
    follows an ASCII letter or digit: there a pre-token always starts, whatever stands around it. So a
    text is the concatenation of its pieces' ids. Pieces are told apart by two polynomial hashes of 64
    bits, computed for all bytes at once. Texts with other white space than the space and the line
    feed, with letters beyond Latin Extended-A, or with what might be a special token go to the
    library as they are.
    """

    #: Kinds of bytes: letters of several bytes, ASCII letters and digits, punctuation, white space, anything else.
    WIDE, WORD, MARK, SPACE, ODD = range(5)
    #: Odd multipliers of the two hashes.
    FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
    #: Pieces that are handed to the library in one string.
    JOINED = 256

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        kind = np.full(256, self.ODD, np.uint8)
        kind[33:127] = self.MARK
        kind[[b for b in range(128) if chr(b).isalnum()]] = self.WORD
        kind[[32, 10]] = self.SPACE
        kind[[0xC3, 0xC4, 0xC5, *range(0x80, 0xC0)]] = self.WIDE
        self.kind = kind
        # Ids whose bytes start with a space or a line feed (written as these characters in byte-level vocabularies).
        self.opens = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token[0] in (chr(0x120), chr(0x10A))]] = True
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []
        self._forget()

    def _forget(self) -> None:
        self.hashes, self.checks, self.places = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64)
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0

    def _hash(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        if not self.powers or len(self.powers[0][0]) < len(data):
            n = len(data) * 5 // 4
            self.powers = [(_powers(f, n), _powers(pow(f, -1, 1 << 64), n)) for f in self.FACTORS]
        out = []
        for power, inverse in self.powers:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * power[: len(data)], dtype=np.uint64)])
            out.append((total[end] - total[start]) * inverse[start])
        return out

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and their counts."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _learn(self, hashes: np.ndarray, checks: np.ndarray, pieces: list[str]) -> None:
        """Pieces with one leading space or line feed are joined; an id that opens with it starts the next piece."""
        joined = np.array([x[0] in " \n" and len(x) > 1 and x.count(" ") + x.count("\n") == 1 for x in pieces], bool)
        counts = np.zeros(len(pieces), np.int64)
        own = [x for x, ok in zip(pieces, joined, strict=True) if ok]
        ids, _ = self._library(["".join(own[i : i + self.JOINED]) for i in range(0, len(own), self.JOINED)])
        opens = np.flatnonzero(self.opens[ids])
        counts[joined] = np.diff(np.append(opens, len(ids)))
        rest, counts[~joined] = self._library([x for x, ok in zip(pieces, joined, strict=True) if not ok])
        begin = np.empty(len(pieces), np.int64)
        begin[joined] = self.used + np.cumsum(counts[joined]) - counts[joined]
        begin[~joined] = self.used + len(ids) + np.cumsum(counts[~joined]) - counts[~joined]
        now = self.used + len(ids) + len(rest)
        if now > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(2 * now - self.used, np.uint32)])
        self.flat[self.used : now] = np.concatenate([ids, rest])
        self.used = now
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.checks = np.insert(self.hashes, at, hashes[order]), np.insert(self.checks, at, checks[order])
        self.places = np.insert(self.places, at, (begin << 28 | counts)[order])

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts (UTF-8), one after another, and how many each text has."""
        if len(self.hashes) > MEMO_LIMIT or self.used > MEMO_IDS:
            self._forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(texts), np.uint8)
        kind = self.kind[data]
        odd_bytes = (kind == self.ODD)
        odd_bytes[:-1] |= (data[:-1] == 60) & (data[1:] == 124)
        odd_at = np.flatnonzero(odd_bytes)
        odd = np.zeros(len(texts), bool)
        odd[np.searchsorted(ends, odd_at, side="right")] = True
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] == self.SPACE) & (kind[:-1] != self.SPACE) | (kind[1:] == self.MARK) & (kind[:-1] == self.WORD)
        for k in np.flatnonzero(odd).tolist():
            cut[ends[k] - sizes[k] : ends[k]] = False
        filled = sizes > 0
        cut[(ends - sizes)[filled]] = True
        start = np.flatnonzero(cut[:-1])
        end = np.append(start[1:], len(data))
        found, at = [(np.empty(0, np.uint64),) * 2], 0
        while at < len(start):  # windows of about SLICE bytes, so that the tables of powers stay short
            stop = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, side="right")))
            found.append(self._hash(data[start[at] : end[stop - 1]], start[at:stop] - start[at], end[at:stop] - start[at]))
            at = stop
        hashes, checks = (np.concatenate(x) for x in zip(*found, strict=True))

        order = np.argsort(hashes)
        same = np.ones(len(order), bool)
        same[1:] = hashes[order][1:] != hashes[order][:-1]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(same) - 1
        lead = order[same]  # a piece for each distinct hash
        at = np.searchsorted(self.hashes, hashes[lead])
        known = np.zeros(len(lead), bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == hashes[lead][inside]
        new = lead[~known]
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], checks[new], [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            at = np.searchsorted(self.hashes, hashes[lead])
        if not np.array_equal(self.checks[at][which], checks):
            raise ValueError("two pieces share a hash")
        place = self.places[at][which]
        begin, counts = place >> 28, place & 0xFFFFFFF
        stop = np.cumsum(counts)
        ids = self.flat[np.repeat(begin - stop + counts, counts) + np.arange(int(stop[-1]) if len(stop) else 0)]
        text = np.searchsorted(ends, start, side="right")
        return ids, np.bincount(text, counts, len(texts)).astype(np.int64)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, texts) of about SLICE bytes each, in order."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= SLICE:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _write_file(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Writes one partition as one file."""
    first = next(batches, None)
    if first is None:
        return
    part, encoder = TaskContext.get().partitionId(), Encoder(vocabulary)
    kind, docs, totals = f"<u{encoder.width}", [], []

    def write(out) -> None:
        lengths = [np.zeros(1, np.int64)]
        for ids, texts in _sliced(chain([first], batches)):
            docs.extend(ids)
            got, counts = encoder.encode(texts)
            out.write(np.insert(got.astype(kind), np.cumsum(counts), end_id).tobytes())
            lengths.append(counts + 1)
        bounds = np.cumsum(np.concatenate(lengths))
        totals.append(int(bounds[-1]))
        known = [x for x in docs if x is not None]
        least = known[0] if known else 0
        sections = [EliasFano.of(bounds).to_bytes(), EliasFano.of(np.array([x - least for x in known], np.uint64)).to_bytes()]
        for section in sections:
            out.write(section)
        out.write(FOOTER.pack(MAGIC, encoder.width, len(docs), totals[0], len(docs) - len(known), least, *map(len, sections)))

    uri = publish(folder, f"ids-{part:08d}", write)
    yield pa.RecordBatch.from_pylist([{"part": part, "uri": uri, "n_docs": len(docs), "n_ids": totals[0]}], FILES_SCHEMA)


class TokenFile:
    """Random and sequential access to a token-id file."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n_docs, self.n_ids, self.n_null, self.least, a, b = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token-id file")
        at = size - FOOTER.size - a - b
        self.bounds = EliasFano.from_bytes(self.file.read_at(a, at))
        self.docs = EliasFano.from_bytes(self.file.read_at(b, at + a))

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        known = self.docs.select(max(0, start - self.n_null), max(0, stop - self.n_null))
        return [None] * max(0, min(stop, self.n_null) - start) + [int(x) + self.least for x in known]

    def ids(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """Boundaries of documents start to stop - 1 and their ids."""
        bounds = self.bounds.select(start, stop + 1).astype(np.int64)
        data = self.file.read_at(int(bounds[-1] - bounds[0]) * self.width, int(bounds[0]) * self.width)
        return bounds, np.frombuffer(data, f"<u{self.width}")


def _read_files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
    for batch in batches:
        for row in batch.to_pylist():
            file = TokenFile(row["uri"])
            for at in range(0, file.n_docs, READ_DOCS):
                stop = min(at + READ_DOCS, file.n_docs)
                bounds, ids = file.ids(at, stop)
                wide = memoryview(ids.astype("<u4").tobytes())
                cuts = ((bounds - bounds[0]) * 4).tolist()
                for k, doc in enumerate(file.doc_ids(at, stop)):
                    yield (doc, row["base"] + int(bounds[k]), int(bounds[k + 1] - bounds[k]), zlib.crc32(wide[cuts[k] : cuts[k + 1]])), 32


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token-id files of ``docs`` and returns their manifest (part, uri, n_docs, n_ids), itself written to a table.

    Documents lie in ascending order of id over the files in order of ``part``: nulls first, equal ids
    by a hash of the text, so that rows of one id can be cut into files too. A null or empty text holds the end id alone. An empty table gives no file and an empty
    manifest. ``folder`` must be a place that driver and executors share. Only the two named columns
    are read, so others cannot clash.
    """
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES), min(-(-total // LEAST_BYTES), docs.sparkSession.sparkContext.defaultParallelism))
    dealt = narrow.withColumn("hash", F.xxhash64("text")).repartitionByRange(files, "doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")
    dealt = dealt.drop("hash")
    return written(dealt.mapInArrow(lambda it: trimmed(_write_file(it, folder, vocabulary, end_id)), FILES_DDL), "token-files", f"{folder}/manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    ways = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = manifest.select("uri", base.cast("long").alias("base"))
    return placed.repartition(ways).mapInArrow(lambda it: trimmed(in_batches(_read_files(it), ROWS_SCHEMA)), ROWS_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    """op2: all documents written to token-id files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, work_dir(spark, "token-ids"), public_tokenizers.path("byte_bpe_50k.json")))
