"""Audio features of byte payloads kept as 8-bit PCM.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the
unsigned samples of a mono WAV file.  The samples read back from that file are
resampled by a polyphase filter, framed with overlap (zeros fill the last
frame), turned into log-mel
bands, and segmented by an energy threshold with hysteresis.  The bands are
stored as fixed-shape Arrow tensors of BLOCK frames, each with its time span.

Nulls: a null text counts as empty, and so has one block of 64 zero bytes.
A null doc_id is kept, repeated rows each give a row, other columns are
ignored.  Features depend on the text alone.
"""

from __future__ import annotations

import functools
import hashlib
import io
import math
import wave
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

RATE_IN, RATE = 16_000, 8_000
FRAME, HOP, FFT, BANDS = 200, 80, 256, 24
#: Frames of one stored tensor.
BLOCK = 32
#: Filter taps of each phase; samples resampled, and frames transformed, at once.
TAPS, SAMPLES, FRAMES = 24, 1 << 18, 4096
#: Hysteresis: a segment starts over mean + HIGH deviations and ends under mean + LOW.
HIGH, LOW = 0.5, -0.25
FLOOR = 1e-6


class Features(NamedTuple):
    mel: np.ndarray  # frames x BANDS, float32
    spans: list[tuple[int, int]]  # milliseconds, of the segments


def store(text: str | None) -> tuple[int, bytes]:
    """Number of UTF-8 bytes, and the WAV file of the padded payload."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = raw + bytes(-len(raw) % 64 or 64 * (not raw))
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(payload)
    return len(raw), out.getvalue()


def read(media: bytes) -> bytes:
    """The samples that a stored WAV file holds."""
    with wave.open(io.BytesIO(media)) as w:
        return w.readframes(w.getnframes())


@functools.cache
def phases(rate_in: int, rate: int) -> tuple[int, int, np.ndarray]:
    """Up and down factors and the low-pass filter, one row of taps for each phase."""
    g = math.gcd(rate_in, rate)
    up, down = rate // g, rate_in // g
    n = TAPS * up
    at = np.arange(n) - (n - 1) / 2
    h = np.sinc(at / max(up, down)) * np.hamming(n)
    return up, down, np.ascontiguousarray((h / h.sum() * up).reshape(TAPS, up).T)


def resample(x: np.ndarray, rate_in: int = RATE_IN, rate: int = RATE) -> np.ndarray:
    """Polyphase resampling, in blocks; only outputs that are kept are computed.

    Output n lies at n * down / up samples: its phase is n * down mod up, and
    its newest sample is floor(n * down / up).
    """
    up, down, h = phases(rate_in, rate)
    total = -(-len(x) * up // down)
    out = np.empty(total, dtype=np.float32)
    padded = np.concatenate([np.zeros(TAPS - 1, dtype=x.dtype), x, np.zeros(down, dtype=x.dtype)])
    windows = sliding_window_view(padded, TAPS)
    for first in range(min(up, total)):
        taps = h[first * down % up][::-1]
        at, n = first * down // up, -(-(total - first) // up)
        for b in range(0, n, SAMPLES):
            e = min(n, b + SAMPLES)
            part = windows[at + b * down : at + (e - 1) * down + 1 : down]
            out[first + b * up : first + (e - 1) * up + 1 : up] = np.einsum("nt,t->n", part, taps)
    return out


@functools.cache
def mel_filters() -> np.ndarray:
    """Triangular filters, (FFT / 2 + 1) x BANDS, even on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(RATE / 2), BANDS + 2) / 2595) - 1)
    bins = np.arange(FFT // 2 + 1) * RATE / FFT
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    rise, fall = (bins[:, None] - low) / (mid - low), (high - bins[:, None]) / (high - mid)
    return np.maximum(0, np.minimum(rise, fall))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans of frames that start over a high threshold and last until a low one."""
    mean, spread = float(energy.mean()), float(energy.std())
    mark = np.where(energy > mean + HIGH * spread, 1, np.where(energy < mean + LOW * spread, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: bytes) -> Features:
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y = resample(x)
    # Zeros fill the last frame, so that every sample is in one.
    y = np.concatenate([y, np.zeros(FRAME - len(y) if len(y) < FRAME else -(len(y) - FRAME) % HOP, dtype=y.dtype)])
    frames = sliding_window_view(y, FRAME)[::HOP]
    mel, energy = np.empty((len(frames), BANDS), dtype=np.float32), np.empty(len(frames))
    hann, filters = np.hanning(FRAME), mel_filters()
    for b in range(0, len(frames), FRAMES):
        part = frames[b : b + FRAMES] * hann
        power = np.abs(np.fft.rfft(part, FFT)) ** 2
        mel[b : b + FRAMES] = np.log(np.maximum(power @ filters, FLOOR))
        energy[b : b + FRAMES] = np.log(np.maximum(np.einsum("nf,nf->n", part, part), FLOOR))
    ms = lambda f: f * HOP * 1000 // RATE
    return Features(mel, [(ms(a), ms(b - 1) + FRAME * 1000 // RATE) for a, b in segments(energy)])


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors, BLOCK x BANDS, with their time spans; the last is filled with zeros."""
    n = -(-len(mel) // BLOCK)
    filled = np.zeros((n * BLOCK, BANDS), dtype=np.float32)
    filled[: len(mel)] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), [BLOCK, BANDS])
    values = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), BLOCK * BANDS))
    start = np.arange(n) * BLOCK
    end = np.minimum(start + BLOCK, len(mel))
    ms = HOP * 1000 // RATE
    batch = pa.record_batch([values, pa.array(start * ms), pa.array((end - 1) * ms + FRAME * 1000 // RATE)], names=["log_mel", "start_ms", "end_ms"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def untensor(stream: bytes) -> np.ndarray:
    """The tensors of a stored stream, blocks x BLOCK x BANDS."""
    return pa.ipc.open_stream(stream).read_all().column("log_mel").combine_chunks().to_numpy_ndarray()


def extract(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media binary, tensors binary, spans) of each row: the stored WAV, the Arrow stream, the segments."""

    def run(ids, texts):
        media = [store(t)[1] for t in texts]
        found = [features(read(m)) for m in media]
        return [ids, media, [tensors(f.mel) for f in found], [[{"start_ms": a, "end_ms": b} for a, b in f.spans] for f in found]]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, media binary, tensors binary, spans array<struct<start_ms: long, end_ms: long>>")


def describe(f: Features, stream: bytes) -> str:
    """frames:segments:span digest:mean of each band, to two decimals, from the stored tensors."""
    bands = untensor(stream).reshape(-1, BANDS)[: len(f.mel)].mean(axis=0, dtype=np.float64)
    spans = zlib.crc32(",".join(f"{a}-{b}" for a, b in f.spans).encode())
    return f"{len(f.mel)}:{len(f.spans)}:{spans:08x}:" + ",".join(f"{v + 0.0:.2f}" for v in bands)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What extract() makes, hashed where it is made: sizes and digests of payload and medium, and the feature."""

    def run(ids, texts):
        rows = []
        for t in texts:
            n, media = store(t)
            payload = read(media)
            f = features(payload)
            rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), describe(f, tensors(f.mel))))
        return [ids, *zip(*rows, strict=True)]

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
