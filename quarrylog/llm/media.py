"""Operator 9: audio columns. Bytes become 8-bit PCM in a WAV container, and the stored bytes give features.

A document's UTF-8 bytes, padded with zeros to a positive multiple of ``UNIT``, are the
samples of a mono 8-bit WAV at 24 kHz. Features come from the container's bytes, read back:
polyphase resampling to 16 kHz (up 2, down 3), log-mel filterbanks over overlapping windows
of 25 ms every 10 ms, and hysteresis segmentation of the frames' energy into time spans.
Log-mels are cut into tensors of one fixed shape with their time spans: ``audio_features`` has
those of a document as one Arrow stream with Arrow's fixed-shape tensor type, to be stored
like any binary column, and ``audio_digest`` stores it, reads it back and describes what it reads.

All sums run over one document at a time in blocks of fixed size, so that equal texts have
equal values whatever lies beside them, and a very long text needs no more memory.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import materialize, slices

UNIT, RATE, UP, DOWN, TAPS = 64, 24000, 2, 3, 16
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
#: Decibels below the loudest frame at which a span begins, and at which it ends.
BEGIN_DB, END_DB = 3.0, 6.0
#: Frames in a tensor; frames computed at once.
PATCH, BLOCK = 64, 4096


def _prototype() -> np.ndarray:
    """Low-pass filter for UP / DOWN, as UP phases of TAPS taps."""
    n = np.arange(TAPS * UP) - (TAPS * UP - 1) / 2
    cut = 1 / max(UP, DOWN)
    h = np.sinc(n * cut) * cut * np.hamming(len(n)) * UP
    phases = h.reshape(TAPS, UP).T[:, ::-1]
    return (phases / phases.sum(axis=1, keepdims=True)).astype(np.float32)


def _mel_bank() -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    rate = RATE * UP // DOWN
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * rate / FFT
    rise = (f[:, None] - points[:-2]) / (points[1:-1] - points[:-2])
    fall = (points[2:] - f[:, None]) / (points[2:] - points[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_PHASES, _BANK, _WINDOW = _prototype(), _mel_bank(), np.hanning(FRAME).astype(np.float32)


def store(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT or (0 if text else UNIT))


def resample(samples: np.ndarray, first: int, stop: int) -> np.ndarray:
    """Resampled values first to stop, of 8-bit samples; beyond the ends there is silence."""
    first -= first % UP
    a, z = first // UP * DOWN - TAPS // 2, -(-stop // UP) * DOWN + TAPS
    x = np.full(z - a, 128, dtype=np.uint8)
    lo, hi = max(0, a), min(len(samples), z)
    if hi > lo:
        x[lo - a : hi - a] = samples[lo:hi]
    x = (x.astype(np.float32) - 128) / 128
    n = -(-(stop - first) // UP)
    out = np.empty((n, UP), dtype=np.float32)
    for p in range(UP):
        shift = p * DOWN // UP
        windows = np.lib.stride_tricks.sliding_window_view(x[shift:], TAPS)[::DOWN][:n]
        out[:, p] = windows @ _PHASES[(p * DOWN) % UP]
    return out.ravel()


def log_mels(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mels (frames, MELS) and energies in decibels of all frames."""
    length = -(-len(samples) * UP // DOWN)
    frames = 1 + max(0, -(-(length - FRAME) // HOP))
    mels, energy = np.empty((frames, MELS), dtype=np.float32), np.empty(frames, dtype=np.float32)
    for f in range(0, frames, BLOCK):
        n = min(BLOCK, frames - f)
        y = resample(samples, f * HOP, (f + n - 1) * HOP + FRAME)[: (n - 1) * HOP + FRAME]
        x = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP] * _WINDOW
        power = np.square(np.abs(np.fft.rfft(x, FFT, axis=1))).astype(np.float32)
        mels[f : f + n] = np.log10(np.maximum(power @ _BANK, 1e-8))
        energy[f : f + n] = 10 * np.log10(np.square(x).mean(axis=1) + 1e-10)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Spans [first, stop) of frames: one begins within BEGIN_DB of the loudest frame, and lasts while within END_DB."""
    top = energy.max()
    mark = np.where(energy >= top - BEGIN_DB, 1, np.where(energy < top - END_DB, 0, -1))
    at = np.where(mark >= 0, np.arange(len(mark)), 0)
    np.maximum.accumulate(at, out=at)
    on = np.concatenate([[0], (mark[at] == 1).astype(np.int8), [0]])
    step = np.diff(on)
    return list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True))


def milliseconds(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def tensor_kind():
    import pyarrow as pa

    return pa.fixed_shape_tensor(pa.float16(), (PATCH, MELS), dim_names=("frame", "mel"))


def pack_tensors(mels: np.ndarray, spans: list[tuple[int, int]]) -> bytes:
    """An Arrow stream with a row for each tensor: its log-mels (silence beyond the end), number of frames, time span, and the spans of sound inside it."""
    import pyarrow as pa

    n = -(-len(mels) // PATCH)
    padded_ = np.full((n * PATCH, MELS), -8, dtype=np.float16)
    padded_[: len(mels)] = mels
    first = np.arange(n) * PATCH
    stop = np.minimum(first + PATCH, len(mels))
    inside: list[list[dict]] = [[] for _ in range(n)]
    for a, b in spans:
        for k in range(a // PATCH, -(-b // PATCH)):
            inside[k].append({"start_ms": milliseconds(max(a, k * PATCH)), "end_ms": milliseconds(min(b, (k + 1) * PATCH))})
    tensor = pa.ExtensionArray.from_storage(tensor_kind(), pa.FixedSizeListArray.from_arrays(pa.array(padded_.ravel()), PATCH * MELS))
    span = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))
    batch = pa.RecordBatch.from_arrays([tensor, pa.array(stop - first), pa.array(milliseconds(first)), pa.array(milliseconds(stop)), pa.array(inside, span)], names=["tensor", "frames", "start_ms", "end_ms", "sound"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_tensors(stored) -> tuple[np.ndarray, object]:
    """(tensors, PATCH, MELS) and the whole Arrow table of a stream of ``pack_tensors``."""
    import pyarrow as pa

    table = pa.ipc.open_stream(stored).read_all()
    return table["tensor"].combine_chunks().to_numpy_ndarray(), table


def describe(tensors: np.ndarray, table) -> str:
    """Feature digest of stored tensors: their number, frames, time, spans of sound, mean of each eighth of the mel bands, and a checksum of all log-mels and spans."""
    frames = int(np.asarray(table["frames"]).sum())
    sound: list[list[int]] = []
    for tensor in table["sound"].to_pylist():
        for x in tensor:
            if sound and sound[-1][1] == x["start_ms"]:
                sound[-1][1] = x["end_ms"]  # goes on from the tensor before
            else:
                sound.append([x["start_ms"], x["end_ms"]])
    own = tensors.reshape(-1, MELS)[:frames]
    bands = own.mean(axis=0, dtype=np.float64).reshape(8, -1).mean(axis=1)
    check = zlib.crc32(repr(sound).encode(), zlib.crc32(np.ascontiguousarray(own, dtype="<f2").tobytes()))
    active = sum(b - a for a, b in sound)
    return f"tensors={len(tensors)};frames={frames};ms={table['end_ms'][-1].as_py()};spans={len(sound)};active={active};first={sound[0][0]}-{sound[0][1]};mel=" + ",".join(f"{x:.2f}" for x in bands) + f";crc={check:08x}"


_MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"


def audio_features(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, and its tensors as an Arrow stream (see ``pack_tensors``).

    Null text is empty: its payload is UNIT zeros, one tensor. A repeated row is a document of
    its own; an empty table gives no rows. Other columns are not read.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                rows = []
                for doc, text in zip(part["doc_id"].to_pylist(), part["text"].cast(pa.large_binary()).to_pylist(), strict=True):
                    text = text or b""
                    media = store(padded(text))
                    back = load(media)
                    mels, energy = log_mels(np.frombuffer(back, dtype=np.uint8))
                    rows.append((doc, len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), pack_tensors(mels, segments(energy))))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_MEDIA}, tensors binary")


def audio_digest(docs: DataFrame) -> DataFrame:
    """``audio_features`` stored and read back, with a description (``feature``) of the read tensors and spans in their place."""
    stored = materialize(audio_features(docs), "audio-tensors")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            feature = [describe(*unpack_tensors(x.as_buffer())) for x in batch["tensors"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(feature, pa.string())], names=[*batch.schema.names[:-1], "feature"])

    return stored.mapInArrow(run, f"{_MEDIA}, feature string")


def audio_tensors(docs: DataFrame) -> DataFrame:
    """A row for each tensor of a document: doc_id, patch, frames, start_ms, end_ms, sound, and PATCH x MELS log-mels (row by row). Nulls, empty and repeated rows as in ``audio_features``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for doc, stored in zip(batch["doc_id"], batch["tensors"], strict=True):
                tensors, table = unpack_tensors(stored.as_buffer())
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(tensors) + 1) * PATCH * MELS, pa.int32()), pa.array(tensors.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()] * len(tensors), pa.int64()), pa.array(np.arange(len(tensors))), *[table[c].combine_chunks() for c in ("frames", "start_ms", "end_ms", "sound")], flat], names=["doc_id", "patch", "frames", "start_ms", "end_ms", "sound", "tensor"])

    schema = "doc_id long, patch long, frames long, start_ms long, end_ms long, sound array<struct<start_ms:long,end_ms:long>>, tensor array<float>"
    return audio_features(docs).select("doc_id", "tensors").mapInArrow(run, schema)


def as_tensors(column):
    """An Arrow list column of tensors, with Arrow's fixed-shape tensor type."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), (PATCH, MELS), dim_names=("frame", "mel"))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(column.flatten(), PATCH * MELS))
