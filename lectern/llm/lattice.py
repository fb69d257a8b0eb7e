"""Subword lattice likelihood: the marginal probability of a document over all of its segmentations.

The pieces are those of an existing subword vocabulary; a leading space marks the start of a word, and
every byte is a piece, so every text has a segmentation. Their weights start from the vocabulary's own
scores (as ranks: the weight falls as 1 / (rank + 10)) and are re-estimated on the training documents
by ``ROUNDS`` of expectation-maximisation. A word's probability is the sum over its segmentations of
the product of the weights, by a forward recursion in log space; a document's is the product of its
words' and of its end. As pieces do not cross words, each distinct word is worked on once, in the
shuffle of ``wordblocks``; counts and weights come from all training documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import crc_fold, release, written
from lectern.llm.wordblocks import FOUND_DDL, FOUND_SCHEMA, by_block, by_word, pack, pack_words, split, unpack, unpack_words

FOLDS, HELD_OUT = 10, 0
#: Fixed by the query's contract: the base model's added count.
ADDED = 0.1
#: Rounds of re-estimation; what every piece is counted besides.
ROUNDS, PRIOR = 2, 0.01
#: Steps of a unit in expected counts.
STEPS = 1 << 16
#: Cells of a lattice that are worked off at once.
CELLS = 1 << 17
#: Bytes of a string beyond which its lattice is not held as a whole.
LONG = 4096
NONE = -1e30

SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORE_DDL = "doc_id long, n_tokens long, n_known long, base_score double, score double"
#: Of a part: a row with its distinct words and their counts (block is -1), and a row for each block with which of them it has.
COUNT_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("tokens", pa.int64()), ("kinds", pa.int64())])
COUNT_DDL = "block long, part int, words binary, tokens long, kinds long"


@cache
def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a space for the mark of a word's start, and their starting weights; all bytes come first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rank = {bytes([b]): float(model.get_piece_size()) for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i):
            continue
        piece = model.id_to_piece(i).replace(chr(0x2581), " ").encode()
        if b" " not in piece[1:]:
            rank[piece] = min(rank.get(piece, math.inf), -model.get_score(i))
    return list(rank), 1 / (np.array(list(rank.values())) + 10)


@cache
def _index(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Sorted hashes of the pieces, the piece of each, and the greatest length of a piece."""
    pieces, _ = vocabulary(path)
    hashes = np.array([_hash(np.frombuffer(p, np.uint8)[None])[0, -1] for p in pieces], np.uint64)
    order = np.argsort(hashes)
    if (np.diff(hashes[order]) == 0).any():
        raise ValueError("two pieces share a hash")
    return hashes[order], order, max(map(len, pieces))


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(rows: np.ndarray) -> np.ndarray:
    """Hashes of the prefixes of each row, from length 1: h = h * FACTOR + byte + 1."""
    out = np.empty(rows.shape, np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for j in range(rows.shape[1]):
        h = h * FACTOR + rows[:, j] + np.uint64(1)
        out[:, j] = h
    return out


def _cells(rows: np.ndarray, path: str) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """For each span (i, j) of the positions of equally long words: the words that have a piece there, and which."""
    hashes, which, longest = _index(path)
    length = rows.shape[1]
    out = {}
    for i in range(length):
        at = _hash(rows[:, i : i + longest])
        place = np.minimum(np.searchsorted(hashes, at), len(hashes) - 1)
        hit = hashes[place] == at
        for k in range(at.shape[1]):
            if len(own := np.flatnonzero(hit[:, k])):
                out[i, i + k + 1] = own, which[place[own, k]]
    return out


def _forward(n: int, length: int, cells: dict, weight: np.ndarray, backward: bool = False) -> np.ndarray:
    """Log sums over all segmentations of the words' first (or, backward, last) characters, for each cut."""
    alpha = np.full((n, length + 1), NONE)
    alpha[:, length if backward else 0] = 0
    by_end: dict[int, list[tuple[int, int]]] = {}
    for span in cells:
        by_end.setdefault(span[0] if backward else span[1], []).append(span)
    for end in sorted(by_end, reverse=backward):
        total = alpha[:, end]
        for span in by_end[end]:
            own, piece = cells[span]
            total[own] = np.logaddexp(total[own], alpha[own, span[1] if backward else span[0]] + weight[piece])
    return alpha


def _batches(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers and rows of bytes of equally long strings."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for own in np.split(order, cuts):
        if not len(own):
            continue
        length = int(lengths[own[0]])
        size = max(1, CELLS // length)
        for at in range(0, len(own), size):
            part = own[at : at + size]
            yield part, np.frombuffer(b"".join(words[i] for i in part.tolist()), np.uint8).reshape(len(part), length)


def _spans(data: np.ndarray, begin: int, end: int, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and numbers of the pieces that start in a stretch of a long string; ``data`` has zeros after it."""
    hashes, which, longest = _index(path)
    at = _hash(np.lib.stride_tricks.sliding_window_view(data[begin : end - 1 + longest], longest))
    place = np.minimum(np.searchsorted(hashes, at), len(hashes) - 1)
    start, k = np.nonzero(hashes[place] == at)
    inside = start + begin + k + 1 <= len(data) - longest
    start, k = start[inside], k[inside]
    return start + begin, start + begin + k + 1, which[place[start, k]]


def _add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _long_score(word: bytes, weight: np.ndarray, path: str) -> float:
    """The forward recursion over one long string, with the pieces of LONG starts at a time."""
    data = np.frombuffer(word + b"\0" * _index(path)[2], np.uint8)
    alpha = [NONE] * (len(word) + 1)
    alpha[0] = 0.0
    for begin in range(0, len(word), LONG):
        start, stop, piece = _spans(data, begin, min(begin + LONG, len(word)), path)
        for i, j, w in zip(start.tolist(), stop.tolist(), weight[piece].tolist(), strict=True):
            alpha[j] = _add(alpha[j], alpha[i] + w)
    return alpha[-1]


def _long_counts(word: bytes, weight: np.ndarray, path: str) -> np.ndarray:
    """How often each piece is expected in one long string: forward by stretches of LONG starts, of which only the sums that
    each begins with are held, then backward, where each stretch's own sums are made again."""
    longest, n = _index(path)[2], len(word)
    data = np.frombuffer(word + b"\0" * longest, np.uint8)
    out = np.zeros(len(weight))

    def forward(begin: int, given: list[float]) -> tuple[list[float], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        end = min(begin + LONG, n)
        start, stop, piece = _spans(data, begin, end, path)
        alpha = given + [NONE] * (end - begin)
        for i, j, w in zip((start - begin).tolist(), (stop - begin).tolist(), weight[piece].tolist(), strict=True):
            alpha[j] = _add(alpha[j], alpha[i] + w)
        return alpha, (start - begin, stop - begin, piece)

    given, held = [0.0] + [NONE] * (longest - 1), []
    for begin in range(0, n, LONG):
        held.append(given)
        given = forward(begin, given)[0][-longest:]
    total, later = given[0], [0.0] + [NONE] * (longest - 1)
    for begin in reversed(range(0, n, LONG)):
        alpha, (start, stop, piece) = forward(begin, held.pop())
        beta = [NONE] * (len(alpha) - longest) + later
        for i, j, w in zip(start[::-1].tolist(), stop[::-1].tolist(), weight[piece[::-1]].tolist(), strict=True):
            beta[i] = _add(beta[i], beta[j] + w)
        share = np.exp(np.array(alpha)[start] + weight[piece] + np.array(beta)[stop] - total)
        out += np.bincount(piece, share, len(out))
        later = beta[:longest]
    return out


def word_scores(words: list[bytes], weight: np.ndarray, path: str) -> np.ndarray:
    """Natural log of each word's marginal probability; words are strings with their leading space."""
    out = np.empty(len(words))
    own = [b" " + w for w in words]
    short = [i for i, w in enumerate(own) if len(w) <= LONG]
    for part, rows in _batches([own[i] for i in short]):
        out[np.array(short)[part]] = _forward(len(part), rows.shape[1], _cells(rows, path), weight)[:, -1]
    for i, w in enumerate(own):
        if len(w) > LONG:
            out[i] = _long_score(w, weight, path)
    return out


def expected_counts(words: list[bytes], counts: np.ndarray, weight: np.ndarray, path: str) -> np.ndarray:
    """How often each piece is expected in the words, by the posterior of their segmentations.

    Words of more than LONG bytes are worked off one at a time, by stretches.
    """
    out = np.zeros(len(weight))
    spans = []
    for w, c in zip(words, counts.tolist(), strict=True):
        if len(w) < LONG:  # the leading space counts
            spans.append((b" " + w, c))
        else:
            out += c * _long_counts(b" " + w, weight, path)
    times = np.array([c for _, c in spans], float)
    for own, rows in _batches([w for w, _ in spans]):
        cells = _cells(rows, path)
        alpha, beta = (_forward(len(own), rows.shape[1], cells, weight, backward) for backward in (False, True))
        for (i, j), (has, piece) in cells.items():
            share = np.exp(alpha[has, i] + weight[piece] + beta[has, j] - alpha[has, -1])
            out += np.bincount(piece, share * times[own[has]], len(out))
    return out


def _count(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    number: dict[bytes, int] = {}
    total = np.zeros(1 << 12, np.int64)
    for block, packed in rows:
        words, (counts,) = unpack_words(packed)
        own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        if len(number) > len(total):
            total = np.concatenate([total, np.zeros(2 * len(number) - len(total), np.int64)])
        total[own] += counts  # a block has a word once
        yield block, part, pack(own.astype(np.uint32)), 0, 0
    words = sorted(number)  # in the same order whatever the blocks were
    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    yield -1, part, pack_words(words, total[at], at), int(total.sum()), int((total > 0).sum())


def _weights(counted: DataFrame, ends: int, path: str) -> np.ndarray:
    """Natural logs of the pieces' weights, and last of the end's, re-estimated on the training words."""
    start = vocabulary(path)[1]
    n = len(start)
    words = counted.filter("block < 0").select("words")

    def normal(pieces: np.ndarray, end: float) -> np.ndarray:
        w = np.append(pieces, end) + PRIOR
        return np.log(w / w.sum())

    total = counted.agg(F.sum("tokens")).first()[0] or 0
    weight = normal(start / start.sum() * max(1, 3 * total), ends)
    for _ in range(ROUNDS if total else 0):
        given = weight[:n].copy()

        def expect(batches: Iterator[pa.RecordBatch], given: np.ndarray = given) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n, np.int64)
            for batch in batches:
                for packed in batch.column(0).to_pylist():
                    own, (counts, *_) = unpack_words(packed)
                    taught = np.flatnonzero(counts)
                    # Whole steps, so that the sums do not depend on their order.
                    out += np.rint(expected_counts([own[i] for i in taught.tolist()], counts[taught], given, path) * STEPS).astype(np.int64)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["piece", "expected"])
            release()

        rows = words.mapInArrow(expect, "piece long, expected long").groupBy("piece").agg(F.sum("expected").alias("expected")).toArrow()
        expected = np.zeros(n)
        expected[rows["piece"].to_numpy()] = rows["expected"].to_numpy() / STEPS
        weight = normal(expected, ends)
    return weight


def score(docs: DataFrame, vocabulary_path: str, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (both log10) of each row of ``docs``.

    ``train`` is a boolean column: the rows to learn from. Words are lower-cased (A to Z) runs without
    ASCII white space; every document has one end besides. A null or empty text is an end alone. With no
    training rows nothing is known: base_score is 0 (one smoothed kind of token) and score follows the
    vocabulary's own weights. Repeated rows, ties and null ids are kept, an empty table stays empty,
    and other columns are left out, so no name can clash.
    """
    blocks, parts = split(docs, lambda text: text.encode().lower().split(), id_col, text_col, learn=F.coalesce(train, F.lit(False)))
    ends = docs.filter(train).count()
    counted = written(by_word(blocks, parts, _count, COUNT_SCHEMA, COUNT_DDL), "word-counts")
    tokens, kinds = counted.agg(F.sum("tokens"), F.sum("kinds")).first()
    n, v = (tokens or 0) + ends, (kinds or 0) + (ends > 0)
    weight = _weights(counted, ends, vocabulary_path)
    pieces, end = weight[:-1], float(weight[-1])
    lower = math.log10(n + ADDED * (v + 1))

    def judge(part: int, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
        words, (sums, at) = unpack_words(next(rows)[1])  # the row of the part's words comes first
        counts, logs = np.empty(len(words), np.int64), np.empty(len(words))
        counts[at], logs[at] = sums, word_scores(words, pieces, vocabulary_path)
        del words
        for block, packed in rows:
            own = unpack(packed)[0].astype(np.int64)
            yield block, part, pack(counts[own], logs[own], level=1)

    found = by_word(counted, parts, judge, FOUND_SCHEMA, FOUND_DDL)

    def on_block(lengths: np.ndarray, seq: np.ndarray, found: list[bytes]) -> list[pa.Array]:
        parts = [unpack(f) for f in found]
        counts = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        logs = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
        begin = np.minimum(np.cumsum(lengths) - lengths, len(seq))
        summed = lambda x: np.where(lengths > 0, np.add.reduceat(np.append(x[seq], 0), begin), 0) if len(lengths) else np.empty(0)
        base = summed(np.log10(counts + ADDED) - lower) + math.log10(ends + ADDED) - lower
        model = (summed(logs) + end) / math.log(10)
        return [pa.array(lengths + 1), pa.array(summed((counts > 0).astype(np.int64)).astype(np.int64) + (ends > 0)), pa.array(base.astype(float)), pa.array(model.astype(float))]

    return by_block(blocks, found, on_block, SCORE_SCHEMA, SCORE_DDL).withColumn("train_tokens", F.lit(n).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: base and lattice score of every document."""
    import public_tokenizers

    fold = crc_fold(F.col("doc_id"), FOLDS)
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), fold != HELD_OUT)
    return out.select("doc_id", (fold == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
