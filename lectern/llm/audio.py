"""Audio features: polyphase resampling, overlapped log-mel filterbanks, hysteresis energy segmentation.

A clip is a RIFF/WAVE file of unsigned 8-bit mono samples. Its features are Arrow fixed-shape
tensors (an Arrow IPC stream per clip, one record per patch of frames) with their time spans.
Clips are written to a table in one pass over the rows, features are computed in a pass over
what is read back, and stored in a table of their own, without a shuffle; a clip is worked off in blocks of frames, so memory depends
on one batch and not on the longest clip's spectrum.
"""

from __future__ import annotations

import functools
import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import in_batches, small_batches, text_or_empty, trimmed, written

#: A payload is padded with bytes of 255 to a positive multiple of this.
UNIT = 576
RATE_IN, UP, DOWN = 24_000, 2, 3
RATE = RATE_IN * UP // DOWN
FRAME, HOP, NFFT, MELS = 400, 160, 512, 40
#: Frames in a patch: a tensor has the shape (PATCH, MELS).
PATCH = 16
#: Taps of each phase of the resampling filter.
PHASE_TAPS = 12
#: Frames whose spectra are held at once.
BLOCK = 2048
#: Steps of a unit in the filter's taps and in log-mel values: sums of samples are exact, and hashes of features do not depend on the order of sums.
TAP_GRID, MEL_GRID = 1 << 20, 1 << 8
#: Energy thresholds between a clip's quiet (10 %) and loud (90 %) levels: a segment starts at ENTER and lasts above LEAVE.
ENTER, LEAVE = 0.6, 0.35

CLIP_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
MEDIA_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("n_frames", pa.int64()), ("tensors", pa.binary()),
        ("segments", pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))),
    ]
)
MEDIA_DDL = "doc_id long, n_bytes long, media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, n_frames long, tensors binary, segments array<struct<start_s: double, end_s: double>>"
TENSOR_SCHEMA = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("mel", pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS)))])


def padded(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def to_wave(payload: bytes) -> bytes:
    """The payload as a mono WAVE file, one unsigned 8-bit sample a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


@functools.cache
def _filter() -> np.ndarray:
    """The low-pass filter as (UP, PHASE_TAPS): a Hann-windowed sinc, cut at the lower of the two Nyquist rates."""
    n = UP * PHASE_TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = min(1 / UP, 1 / DOWN)
    h = cut * np.sinc(cut * t) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return np.ascontiguousarray(np.rint(h.reshape(PHASE_TAPS, UP).T * TAP_GRID) / TAP_GRID)


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP/DOWN times its rate. Output n takes phase n*DOWN mod UP and the inputs up to n*DOWN div UP."""
    n_out = -(-len(x) * UP // DOWN)
    out = np.empty(n_out)
    window = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(PHASE_TAPS - 1), x, np.zeros(1)]), PHASE_TAPS)
    for first in range(UP):
        at = np.arange(first, n_out, UP) * DOWN
        if len(at):
            taps = _filter()[at[0] % UP][::-1]
            out[first::UP] = window[at[0] // UP :: DOWN][: len(at)] @ taps
    return out


@functools.cache
def _mel_bank() -> np.ndarray:
    """(bins, MELS) triangular filters, evenly spaced on the mel scale from 0 to half the rate."""
    edge = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), MELS + 2) / 2595) - 1)
    f = np.arange(NFFT // 2 + 1)[:, None] * RATE / NFFT
    rise, fall = (f - edge[:-2]) / (edge[1:-1] - edge[:-2]), (edge[2:] - f) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall))


@functools.cache
def _window() -> np.ndarray:
    return np.hanning(FRAME + 1)[:-1]


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows on their grid and energies in dB of the overlapped frames; the last frame is filled with zeros."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate([y, np.zeros((n - 1) * HOP + FRAME - len(y))])
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    mel, level = np.empty((n, MELS), np.float32), np.empty(n)
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        spectrum = np.fft.rfft(part * _window(), NFFT)
        mel[at : at + BLOCK] = np.rint(np.log(1e-6 + (spectrum.real**2 + spectrum.imag**2) @ _mel_bank()) * MEL_GRID) / MEL_GRID
        level[at : at + BLOCK] = 10 * np.log10(1e-8 + np.square(part).mean(axis=1))
    return mel, level


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans (end exclusive): entered at the upper threshold, left below the lower one. An even clip is one span."""
    quiet, loud = np.percentile(level, [10, 90])
    if loud - quiet < 1e-6:
        return [(0, len(level))]
    state = np.where(level >= quiet + ENTER * (loud - quiet), 1, np.where(level < quiet + LEAVE * (loud - quiet), 0, -1))
    last = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.concatenate([[0], np.where(last >= 0, state[last], 0), [0]])
    edge = np.diff(on)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def tensor_stream(mel: np.ndarray) -> bytes:
    """Patches of PATCH frames as an Arrow IPC stream of fixed-shape tensors; the last patch is filled with zeros."""
    n = -(-len(mel) // PATCH)
    full = np.zeros((n * PATCH, MELS), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * (PATCH * HOP / RATE)
    end = (np.minimum((np.arange(n) + 1) * PATCH, len(mel)) * HOP + FRAME - HOP) / RATE
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, TENSOR_SCHEMA) as w:
        w.write_batch(pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), tensors], schema=TENSOR_SCHEMA))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    """The patches of a clip, with columns start_s, end_s and mel (a tensor of PATCH x MELS)."""
    return pa.ipc.open_stream(stream).read_all()


def clip_features(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """What a stored clip holds: its payload, its log-mel rows, its active frame spans."""
    payload = from_wave(media)
    samples = (np.frombuffer(payload, np.uint8).astype(np.float64) - 128) / 128
    mel, level = log_mel(resample(samples))
    return payload, mel, segments(level)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
    for batch in batches:
        for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_buffer().to_pybytes()
            media = to_wave(padded(data))
            yield (doc_id, len(data), media), len(media)


def store_clips(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table (doc_id, n_bytes, media) of one clip for each row of ``docs``, written to ``path`` or the shared folder and read back.

    A null or empty text is a clip of UNIT samples of 255; repeated rows and null ids are clips like any other; no rows give no clips.
    """
    narrow = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("data"))
    clips = narrow.mapInArrow(lambda it: trimmed(in_batches(_clips(it), CLIP_SCHEMA)), "doc_id long, n_bytes long, media binary")
    return written(clips, "clips", path, "zstd")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
    for batch in batches:
        for doc_id, n_bytes, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            media = media.as_buffer().to_pybytes()
            payload, mel, spans = clip_features(media)
            seconds = [{"start_s": a * HOP / RATE, "end_s": (b * HOP + FRAME - HOP) / RATE} for a, b in spans]
            stream = tensor_stream(mel)
            yield (doc_id, n_bytes, media, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(mel), stream, seconds), len(media) + len(stream)


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One clip and its features for each row of ``docs``; all but n_bytes comes from the stored clips, read back.

    A null or empty text is a clip of 576 samples of 255. A null id stays null. Repeated rows give
    repeated results; equal texts give equal clips and features. Other columns are left out, so no
    name can clash.
    """
    return small_batches(store_clips(docs, None, id_col, text_col)).mapInArrow(lambda it: trimmed(in_batches(_rows(it), MEDIA_SCHEMA)), MEDIA_DDL)


def store_features(features: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``audio_features``, their clips as lengths and digests, written to ``path`` or the shared folder and read back.

    The tensors are stored as they are, an Arrow stream a clip (``read_tensors``), beside the spans of its segments.
    """
    clip = [F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")]
    return written(features.select(*[c for c in features.columns if c != "media"], *clip), "clip-features", path, "zstd")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: digests of the stored clips and of their stored features, over all documents."""
    out = store_features(audio_features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.concat_ws(";", F.format_string("frames=%d", "n_frames"), F.format_string("segments=%d", F.size("segments")),
                    F.format_string("active=%.3f", F.aggregate("segments", F.lit(0.0), lambda s, x: s + x.end_s - x.start_s)),
                    F.concat(F.lit("mel="), F.sha2("tensors", 256))).alias("feature"),
    )
