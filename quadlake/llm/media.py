"""Audio features of 8-bit sample payloads.

A payload is stored losslessly as a WAV file of unsigned 8-bit samples. Features are made
from the stored bytes: polyphase resampling from 16 to 10 kHz (five phases of a windowed sinc), log-mel energies of frames
that overlap by half, and spans of activity by two energy thresholds (a span begins above
the upper one and lasts until energy falls below the lower one). Log-mel frames are stored
as an Arrow fixed-shape tensor of blocks (frames x bands, the last block zero-padded) in an
Arrow IPC stream, beside the time spans in milliseconds.

Long payloads are worked through in blocks of frames, so memory does not grow with them.

Defined results: null text is empty; the empty text has a payload of 64 zero bytes; equal
texts have equal values; repeated rows and null ids are answered each.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadlake.llm.common import slices, text_of, texts

RATE, UP, DOWN, TAPS = 16000, 5, 8, 32
FRAME, HOP, BANDS, BLOCK = 256, 128, 24, 32
UNIT, FRAMES_AT_A_TIME = 64, 4096


def payload_of(data: bytes, unit: int = UNIT) -> bytes:
    """The bytes, zero-padded to a positive multiple of ``unit``."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    odd = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + odd, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * odd


def from_wav(data: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a WAV file of unsigned 8-bit samples."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not unsigned 8-bit mono")
        elif name == b"data":
            return data[at + 8 : at + 8 + size], rate
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


@cache
def _phases(up: int, down: int, taps: int) -> np.ndarray:
    """Windowed-sinc low-pass, one row of taps for each of the ``up`` phases."""
    n = np.arange(taps * up) - (taps * up - 1) / 2
    h = np.sinc(n / max(up, down)) * np.hamming(taps * up)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32).copy()


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase resampling by ``up / down``: output i uses the phase (i * down) % up."""
    h, n = _phases(up, down, taps), -(-len(x) * up // down)
    if not n:
        return np.zeros(0, np.float32)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps, np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for p in range(up):  # outputs of one phase share their taps
        first = next((i for i in range(up) if i * down % up == p), None)
        if first is not None:
            at = np.arange(first, n, up) * down // up
            rows = views[at[0] : at[-1] + 1 : at[1] - at[0]] if len(at) > 1 else views[at]
            out[first::up] = rows @ h[p][::-1]
    return out


@cache
def _filters(frame: int, bands: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, fall), 0, None).astype(np.float32)


def log_mel(x: np.ndarray, rate: int, frame: int = FRAME, hop: int = HOP, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames and the log energy of each; at least one frame, the last zero-padded."""
    n = 1 + max(0, -(-(len(x) - frame) // hop))
    padded = np.concatenate([x, np.zeros((n - 1) * hop + frame - len(x), np.float32)])
    views = np.lib.stride_tricks.sliding_window_view(padded, frame)[::hop]
    window, filters = np.hanning(frame).astype(np.float32), _filters(frame, bands, rate)
    mel, energy = np.empty((n, bands), np.float32), np.empty(n, np.float32)
    for at in range(0, n, FRAMES_AT_A_TIME):
        part = views[at : at + FRAMES_AT_A_TIME] * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mel[at : at + FRAMES_AT_A_TIME] = np.log(power @ filters + 1e-6)
        energy[at : at + FRAMES_AT_A_TIME] = np.log(np.einsum("ij,ij->i", part, part) + 1e-6)
    return mel, energy


def segments(energy: np.ndarray, high: float = 0.3, low: float = 0.1) -> list[tuple[int, int]]:
    """Spans of frames by hysteresis: from a frame above the upper threshold, backwards and
    forwards as long as energy stays above the lower one. The thresholds are shares of the
    way from the least to the greatest energy."""
    lo, hi = float(energy.min()), float(energy.max())
    keep = np.concatenate([[False], energy >= lo + low * (hi - lo), [False]]) if hi > lo else np.zeros(len(energy) + 2, bool)
    edges = np.flatnonzero(keep[1:] != keep[:-1]).reshape(-1, 2)
    strong = np.concatenate([[0], np.cumsum(energy >= lo + high * (hi - lo))])
    return [(int(a), int(b)) for a, b in edges if strong[b] > strong[a]]


def features(wav: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and spans in milliseconds of a stored file."""
    samples, rate = from_wav(wav)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x), rate * UP // DOWN
    mel, energy = log_mel(y, rate)
    return mel, [(a * HOP * 1000 // rate, ((b - 1) * HOP + FRAME) * 1000 // rate) for a, b in segments(energy)]


def tensor(mel: np.ndarray, block: int = BLOCK) -> pa.ExtensionArray:
    """The frames as blocks of one shape, the last one zero-padded."""
    n = -(-len(mel) // block)
    full = np.zeros((n * block, mel.shape[1]), np.float32)
    full[: len(mel)] = mel
    return pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, block, mel.shape[1]))


def tensor_ipc(mel: np.ndarray, block: int = BLOCK) -> bytes:
    """The blocks as an Arrow IPC stream with one fixed-shape tensor column."""
    values = tensor(mel, block)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("log_mel", values.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([values], ["log_mel"]))
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> np.ndarray:
    return np.concatenate([b.column(0).to_numpy_ndarray() for b in pa.ipc.open_stream(data)])


SPANS = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))


def audio_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (WAV), n_frames, log_mel (Arrow IPC stream), spans of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                raw = texts(part.column("text"))
                media = [to_wav(payload_of(x)) for x in raw]
                found = [features(m) for m in media]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array([len(m) for m, _ in found], pa.int64()),
                    pa.array([tensor_ipc(m) for m, _ in found], pa.binary()), pa.array([[{"start_ms": a, "end_ms": b} for a, b in s] for _, s in found], SPANS),
                ], ["doc_id", "n_bytes", "media", "n_frames", "log_mel", "spans"])

    kind = "doc_id long, n_bytes long, media binary, n_frames long, log_mel binary, spans array<struct<start_ms: long, end_ms: long>>"
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, kind)


def digests(media: DataFrame) -> DataFrame:
    """Of each row of ``audio_columns``: sizes and digests of the stored media, read back, and a
    summary of its features (frames, mean energy by band, spans, digest of the tensors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                rows = []
                for doc, n, wav, frames, ipc, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "n_frames", "log_mel", "spans")), strict=True):
                    payload, _ = from_wav(wav)
                    mel = from_ipc(ipc).reshape(-1, BANDS)[:frames]
                    means = ",".join(f"{x:.3f}" for x in mel.mean(axis=0, dtype=np.float64))
                    active = sum(s["end_ms"] - s["start_ms"] for s in spans)
                    rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(wav), hashlib.sha256(wav).hexdigest(), f"frames={frames};spans={len(spans)};active_ms={active};mel={means};tensor={zlib.crc32(ipc):08x}"))
                cols = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
