"""Byte-level BPE encoding and decoding by a global shuffle of distinct pre-tokens.

Pre-tokens are exploded with their positions (as word numbers of a block), each distinct one is encoded
once, its ids are joined back and the documents put together by position. Decoding joins the
token-byte table, whose size is the vocabulary's, to the ids.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import trimmed
from lectern.llm.wordblocks import FOUND_DDL, FOUND_SCHEMA, by_block, by_word, pack, split, unpack, unpack_words

IDS_SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
IDS_DDL = "doc_id long, ids binary"
DECODED_SCHEMA, DECODED_DDL = IDS_SCHEMA.append(pa.field("decoded", pa.binary())), f"{IDS_DDL}, decoded binary"
#: Words whose ids are put in place at once.
SEQUENCE = 1 << 18


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


@cache
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: all bytes in order of id, and where each id's begin."""
    by_id = {i: b for b, i in read_ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def gathered(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """flat[begin[i] : begin[i] + lengths[i]] for all i, one after another."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(begin - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]


class _Known(dict):
    """Ids of the words that a part has met, each encoded once, as bytes of a kind of integers."""

    def __init__(self, encoding, kind):
        self.encoding, self.code = encoding, {2: "H", 4: "I"}[np.dtype(kind).itemsize]

    def __missing__(self, word: bytes) -> bytes:
        self[word] = ids = array(self.code, self.encoding.encode_ordinary(word.decode())).tobytes()
        return ids


def _binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """data[offsets[i] : offsets[i + 1]] for all i as binary values."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def decoded(ids: np.ndarray, ranks: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ids by the token-byte table, one after another, and where those of each id begin (and the last end)."""
    flat, at = _token_bytes(ranks)
    widths = np.diff(at).astype(np.uint32)
    begin = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(widths[ids], out=begin[1:])
    out = np.empty(int(begin[-1]), np.uint8)
    for low in range(0, len(ids), SEQUENCE):
        some = ids[low : low + SEQUENCE].astype(np.int64)
        out[begin[low] : begin[min(low + SEQUENCE, len(ids))]] = gathered(flat, at[some], at[some + 1] - at[some])
    return out, begin


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoding: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit) of each row of ``docs``; with ``decoding`` also what the ids decode to.

    Every match of ``pattern`` is encoded by itself and special tokens are ordinary text. A null or
    empty text has no ids. Repeated rows, ties and null ids are kept, an empty table stays empty, and
    other columns are left out, so no name can clash.
    """

    def words_of(text: str) -> list[str]:
        return _pattern(pattern).findall(text)

    def on_words(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        kind = np.uint16 if max(read_ranks(ranks).values()) < 1 << 16 else np.uint32
        known = _Known(_encoding(ranks, pattern), kind)
        for block, packed in rows:
            ids = [known[w] for w in unpack_words(packed)[0]]
            n = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(kind).itemsize
            yield block, part, pack((n if n.max(initial=0) > 255 else n.astype(np.uint8)), np.frombuffer(b"".join(ids), kind))

    def on_block(lengths: np.ndarray, seq: np.ndarray, found: list[bytes]) -> list[pa.Array]:
        parts = [unpack(f) for f in found]
        n = np.concatenate([p[0].astype(np.int32) for p in parts]) if parts else np.empty(0, np.int32)
        flat = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint16)
        begin = np.cumsum(n, dtype=np.int64) - n
        each = n[seq]
        per_doc = np.add.reduceat(np.append(each, 0), np.minimum(np.cumsum(lengths) - lengths, len(seq)), dtype=np.int64) if len(lengths) else lengths
        offsets = np.concatenate([[0], np.cumsum(np.where(lengths > 0, per_doc, 0))]) * 4
        ids = np.empty(int(offsets[-1]) // 4, "<u4")
        at = 0
        for low in range(0, len(seq), SEQUENCE):  # the places of ids are wide, so they are made for some words at a time
            some = gathered(flat, begin[seq[low : low + SEQUENCE]], each[low : low + SEQUENCE].astype(np.int64))
            ids[at : at + len(some)] = some
            at += len(some)
        out = [_binaries(ids, offsets)]
        if decoding:  # in the same worker, so that a task needs no second one
            data, begin = decoded(ids, ranks)
            out.append(_binaries(data, begin[offsets // 4]))
        return out

    blocks, parts = split(docs, words_of, id_col, text_col)
    schema, ddl = (DECODED_SCHEMA, DECODED_DDL) if decoding else (IDS_SCHEMA, IDS_DDL)
    return by_block(blocks, by_word(blocks, parts, on_words, FOUND_SCHEMA, FOUND_DDL), on_block, schema, ddl)


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of rows of ids, by the token-byte table; null ids decode to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decoded(np.frombuffer(x.as_buffer(), "<u4"), ranks)[0].tobytes() if x.is_valid else None for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], schema=DECODED_SCHEMA)

    return encoded.select("doc_id", "ids").mapInArrow(lambda it: trimmed(run(it)), DECODED_DDL)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of ``docs``."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = encode(docs, ranks, public_tokenizers.PATTERN, decoding=True)
    return out.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op9: digests of every document's ids and of what they decode to."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
