"""Audio features of stored media: polyphase resampling, log-mel filterbanks, hysteresis segments."""

from __future__ import annotations

import functools
import hashlib
import io
import math
import struct
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strideframe.llm.common import byte_texts

SCHEMA = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
    "media_bytes bigint, media_sha256 string, feature string, n_frames bigint, segments array<struct<start_s:double,end_s:double>>, n_tensors bigint, tensors_sha256 string, media binary, tensors binary"
)
BLOCK = 1 << 18  # samples held as floats at a time


def to_wav(payload: bytes, rate: int) -> bytes:
    """Unsigned 8-bit mono PCM, losslessly."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes()), r.getframerate()


@functools.cache
def resampling_phases(rate_in: int, rate_out: int, half_width: int = 8) -> tuple[int, int, np.ndarray]:
    """Up and down factor and, per phase, the taps of a Hann-windowed sinc low-pass."""
    g = math.gcd(rate_in, rate_out)
    up, down = rate_out // g, rate_in // g
    wide = max(up, down)
    t = np.arange(-half_width * wide, half_width * wide + 1)
    h = np.sinc(t / wide) * np.hanning(len(t)) * (up / wide)
    per = -(-len(h) // up)
    taps = np.zeros((up, per), np.float32)
    for p in range(up):
        part = h[p::up]
        taps[p, : len(part)] = part
    return up, down, taps


def resample(x: np.ndarray, rate_in: int, rate_out: int) -> np.ndarray:
    """y[m] = sum_k taps[m down mod up][k] x[floor(m down / up) - k + centre]; zero outside."""
    up, down, taps = resampling_phases(rate_in, rate_out)
    n, per = len(x), taps.shape[1]
    m = -(-n * up // down)
    centre = (per - 1) // 2
    padded = np.concatenate([np.zeros(per, np.float32), x, np.zeros(per + down, np.float32)])
    y = np.zeros(m, np.float32)
    for first in range(min(up, m)):
        phase, start = first * down % up, first * down // up
        count = len(range(first, m, up))
        acc = np.zeros(count, np.float32)
        for k in range(per):
            at = start - k + centre + per
            acc += taps[phase, k] * padded[at : at + (count - 1) * down + 1 : down]
        y[first::up] = acc
    return y


@functools.cache
def mel_bank(rate: int, frame: int, mels: int) -> np.ndarray:
    """Triangles on the mel scale, bins x mels."""
    hz = np.linspace(0, rate / 2, frame // 2 + 1)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    f = hz[:, None]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(y: np.ndarray, rate: int, frame: int, hop: int, mels: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and frame energies of frames that overlap by ``frame - hop``; the last is zero-padded."""
    n = max(1, 1 + -(-(len(y) - frame) // hop)) if len(y) > frame else 1
    need = (n - 1) * hop + frame
    if len(y) < need:
        y = np.concatenate([y, np.zeros(need - len(y), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(y, frame)[:: hop][:n]
    spectrum = np.fft.rfft(frames * np.hanning(frame).astype(np.float32), axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(power @ mel_bank(rate, frame, mels) + np.float32(1e-6)), power.sum(axis=1)


def hysteresis_segments(energy: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Runs of frames above ``low`` times the mean energy that reach ``high`` times it somewhere: [first, last + 1)."""
    level = float(energy.mean())
    inside = np.concatenate([[False], energy > low * level, [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return [(int(a), int(b)) for a, b in zip(change[::2], change[1::2], strict=True) if energy[a:b].max() >= high * level]


def features(payload: bytes, rate_in: int, rate_out: int, frame: int, hop: int, mels: int):
    """Log-mel rows and energies of the whole payload, block by block with the overlap that frames need."""
    up, down, taps = resampling_phases(rate_in, rate_out)
    samples = np.frombuffer(payload, np.uint8)
    if len(samples) <= BLOCK:
        return log_mel(resample((samples.astype(np.float32) - 128) / 128, rate_in, rate_out), rate_out, frame, hop, mels)
    step = BLOCK // (hop * down) * hop * down  # whole hops of output
    margin = -(-(taps.shape[1] + down) // down) * down
    rows, energies = [], []
    for at in range(0, len(samples), step):
        left = min(at, margin)
        part = samples[at - left : at + step + margin + -(-(frame - hop) * down // up)]
        y = resample((part.astype(np.float32) - 128) / 128, rate_in, rate_out)[left * up // down :]
        last = at + step >= len(samples)
        mel, energy = log_mel(y if last else y[: step * up // down + frame - hop], rate_out, frame, hop, mels)
        rows.append(mel)
        energies.append(energy)
    return np.concatenate(rows), np.concatenate(energies)


def tensor_batches(mel: np.ndarray, hop_s: float, frame_s: float, height: int) -> tuple[int, bytes]:
    """Their number, and an Arrow stream: fixed-shape tensors of ``height`` frames (the last zero-padded) with their time spans."""
    import pyarrow as pa

    n, mels = mel.shape
    blocks = -(-n // height)
    data = np.zeros((blocks * height, mels), np.float32)
    data[:n] = mel
    kind = pa.fixed_shape_tensor(pa.float32(), (height, mels), dim_names=("frame", "mel"))
    storage = pa.FixedSizeListArray.from_arrays(pa.array(data.ravel()), height * mels)
    first = np.arange(blocks) * height
    batch = pa.record_batch(
        {
            "start_s": pa.array(first * hop_s),
            "end_s": pa.array((np.minimum(first + height, n) - 1) * hop_s + frame_s),
            "mel": pa.ExtensionArray.from_storage(kind, storage),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return blocks, sink.getvalue().to_pybytes()


def audio_features(
    docs: DataFrame,
    *,
    rate: int = 16_000,
    feature_rate: int = 8_000,
    frame: int = 256,
    hop: int = 128,
    mels: int = 16,
    low: float = 0.6,
    high: float = 1.5,
    tensor_frames: int = 32,
    with_media: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Stores each text's bytes as audio, reads them back and computes features.

    The UTF-8 bytes are padded with zero bytes to a positive multiple of 64
    and stored as unsigned 8-bit mono WAV samples.  The samples read back are
    resampled to ``feature_rate`` by a polyphase filter, cut into overlapped
    frames for log-mel rows, and segmented where the energy stays over ``low``
    times its mean and reaches ``high`` times it.  ``tensors`` is an Arrow
    stream of fixed-shape tensors with time spans, ``media`` the WAV file;
    ``with_media=False`` leaves both null, so that only their sizes and
    digests, the features and the segments' time spans leave the tasks.

    Null texts are empty ones (64 zero bytes); equal texts give equal values;
    texts of any length are worked through in blocks; other columns are not
    read; an empty table gives an empty result.  No shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def one(raw: bytes):
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        media = to_wav(payload, rate)
        back, rate_back = from_wav(media)
        mel, energy = features(back, rate_back, feature_rate, frame, hop, mels)
        spans = [(a * hop / feature_rate, ((b - 1) * hop + frame) / feature_rate) for a, b in hysteresis_segments(energy, low, high)]
        mean, spread = mel.mean(axis=0), mel.std(axis=0)
        said = f"frames={len(mel)};segments={len(spans)};active={sum(b - a for a, b in spans):.3f}s;mel=" + ",".join(f"{v:.2f}" for v in mean) + ";sd=" + ",".join(f"{v:.2f}" for v in spread)
        n_tensors, tensors = tensor_batches(mel, hop / feature_rate, frame / feature_rate, tensor_frames)
        return (
            len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(),
            said, len(mel), [{"start_s": a, "end_s": b} for a, b in spans], n_tensors, hashlib.sha256(tensors).hexdigest(),
            media if with_media else None, tensors if with_media else None,
        )

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [one(raw) for raw in byte_texts(part.column(1))]
                columns = [part.column(0), *(list(zip(*out, strict=True)) or [[]] * 13)]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
