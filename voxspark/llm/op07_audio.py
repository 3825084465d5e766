"""Media columns: audio features of 8-bit PCM.

``to_wav`` stores bytes losslessly as the samples of a mono 8-bit WAV file and
``wav_payload`` reads them back; ``audio_features`` decodes WAV, resamples with
a polyphase filter bank, takes overlapped log-mel frames and marks sounding
spans with a two-threshold (hysteresis) energy gate.  Features are stored as
Arrow fixed-shape tensors of ``SPAN_FRAMES`` x ``N_MELS`` with the time span of
each, beside the sounding spans; ``describe`` reads them back.

Every signal is handled in blocks of one fixed shape, so equal bytes give equal
features wherever they stand and memory does not grow with a signal's length
(beyond the bytes of the row itself).

Nulls and edge cases: a null text is the empty text, and an empty text becomes
one unit of padding; texts of any length are taken whole; repeated rows stay
rows of their own, with equal values; an empty table gives an empty result;
columns named ``feature``, ``tensors`` or ``spans`` are replaced and all others
are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.functions.storage import stored
from voxspark.functions.workers import ship

UNIT = 576  # the payload is padded to a multiple of this
RATE_IN, UP, DOWN = 16_000, 3, 8  # resampled to 6 kHz
TAPS = 12  # per phase
FRAME, HOP, N_FFT, N_MELS = 240, 120, 256, 16
SPAN_FRAMES = 64
BLOCK_OUT = 6_000  # resampled samples per block: a multiple of UP and of HOP
OPEN_DB, CLOSE_DB = -15.0, -24.0  # relative to full scale
HEADER = 44


def _le(n: Column, width: int) -> Column:
    """An unsigned integer as little-endian bytes."""
    digits = F.lpad(F.hex(n), 2 * width, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(width))]))


def to_wav(payload: Column, rate: int = RATE_IN) -> Column:
    """A WAV file (PCM, mono, 8 bits) whose samples are the payload's bytes."""
    n = F.octet_length(payload)
    fixed = b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0" + rate.to_bytes(4, "little") * 2 + b"\1\0\x08\0" + b"data"
    return F.concat(F.lit(b"RIFF"), _le(n + 36, 4), F.lit(fixed), _le(n, 4), payload)


def padded(text: Column, unit: int = UNIT) -> Column:
    """UTF-8 bytes, filled with 255 to a positive multiple of ``unit``."""
    body = F.coalesce(text, F.lit("")).cast("binary")
    size = F.greatest(F.lit(1), F.ceil(F.octet_length(body) / F.lit(float(unit)))) * unit
    return F.call_function("rpad", body, size.cast("int"), F.lit(b"\xff"))


def wav_payload(media: Column) -> Column:
    """The sample bytes of a file made by :func:`to_wav`."""
    return F.substring(media, HEADER + 1, 2**31 - 1 - HEADER)


def _filters() -> np.ndarray:
    """Phases of a windowed-sinc low-pass: row p holds the taps for output phase p."""
    length = TAPS * UP
    t = np.arange(length) - (length - 1) / 2
    cut = 1.0 / max(UP, DOWN)
    h = np.sinc(t * cut) * cut * np.hamming(length) * UP
    return np.stack([h[p::UP][::-1] for p in range(UP)]).astype(np.float32)


def _mel_bank(rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, as (bins, mels)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), N_MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    freq = np.arange(N_FFT // 2 + 1) * rate / N_FFT
    rise = (freq[:, None] - edges[None, :-2]) / np.diff(edges)[None, :-1]
    fall = (edges[None, 2:] - freq[:, None]) / np.diff(edges)[None, 1:]
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


_BANK: dict[str, np.ndarray] = {}


def _bank() -> dict[str, np.ndarray]:
    if not _BANK:
        _BANK.update(phases=_filters(), mels=_mel_bank(RATE_IN * UP // DOWN), window=np.hanning(FRAME).astype(np.float32))
    return _BANK


def resample_blocks(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Polyphase resampling by UP/DOWN, in blocks of BLOCK_OUT (the last is cut)."""
    phases = _bank()["phases"]
    total = -(-len(samples) * UP // DOWN)
    per = BLOCK_OUT // UP * DOWN  # inputs per block
    for first in range(0, max(total, 1), BLOCK_OUT):
        start = first // UP * DOWN
        chunk = np.full(per + TAPS, 0, dtype=np.float32)
        have = samples[max(0, start - TAPS + 1) : start + per]
        at = TAPS - 1 if start == 0 else 0
        chunk[at : at + len(have)] = (have.astype(np.float32) - 128) / 128
        out = np.empty((BLOCK_OUT // UP, UP), dtype=np.float32)
        for j in range(UP):
            offset, phase = divmod(j * DOWN, UP)
            view = np.lib.stride_tricks.sliding_window_view(chunk, TAPS)[offset : offset + per : DOWN]
            out[: len(view), j] = view @ phases[phase]
        yield out.reshape(-1)[: max(0, min(BLOCK_OUT, total - first))]


def log_mels(samples: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(log-mel frames, energy in dB) block by block; frames overlap by half."""
    bank = _bank()
    rest = np.zeros(0, dtype=np.float32)
    blocks = resample_blocks(samples)
    block = next(blocks)
    while True:
        following = next(blocks, None)
        signal = np.concatenate([rest, block])
        if following is None:
            short = -(len(signal) - FRAME) % HOP if len(signal) > FRAME else FRAME - len(signal)
            signal = np.concatenate([signal, np.zeros(short, dtype=np.float32)])
        frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP] * bank["window"]
        power = np.abs(np.fft.rfft(frames, N_FFT)) ** 2 / N_FFT
        mels = np.log10(np.maximum(np.einsum("fb,bm->fm", power.astype(np.float32), bank["mels"], optimize=False), 1e-6))
        yield mels.astype(np.float32), 10 * np.log10(np.maximum((frames * frames).mean(axis=1), 1e-9))
        if following is None:
            return
        rest, block = signal[len(frames) * HOP :], following


def hysteresis(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans that rise above OPEN_DB, each held until below CLOSE_DB."""
    above, below = energy >= OPEN_DB, energy < CLOSE_DB
    event = np.where(above, 1, np.where(below, -1, 0))
    at = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    state = (at >= 0) & (event[np.maximum(at, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], state.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Frames as (spans, SPAN_FRAMES, N_MELS), zero-filled, and sounding spans in ms."""
    parts = list(log_mels(np.frombuffer(payload, dtype=np.uint8)))
    mels, energy = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    n = -(-len(mels) // SPAN_FRAMES)
    grid = np.zeros((n * SPAN_FRAMES, N_MELS), dtype=np.float32)
    grid[: len(mels)] = np.round(mels, 2)
    ms = 1000 * HOP * DOWN / (RATE_IN * UP)
    return grid.reshape(n, SPAN_FRAMES, N_MELS), [(int(a * ms), int(b * ms)) for a, b in hysteresis(energy)]


TENSOR = pa.fixed_shape_tensor(pa.float32(), (SPAN_FRAMES, N_MELS), dim_names=["frame", "mel"])


def tensor_bytes(grid: np.ndarray) -> bytes:
    """An Arrow IPC stream of one batch: fixed-shape tensors and their time spans."""
    ms = 1000 * HOP * DOWN / (RATE_IN * UP)
    starts = np.arange(len(grid)) * SPAN_FRAMES * ms
    column = pa.ExtensionArray.from_storage(TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(grid.reshape(-1)), SPAN_FRAMES * N_MELS))
    batch = pa.record_batch({"tensor": column, "start_ms": pa.array(starts.astype(np.int64)), "end_ms": pa.array((starts + SPAN_FRAMES * ms).astype(np.int64))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored_bytes: memoryview) -> tuple[np.ndarray, np.ndarray]:
    """(tensors, their start and end in ms) of the bytes of :func:`tensor_bytes`."""
    with pa.ipc.open_stream(pa.py_buffer(stored_bytes)) as reader:
        batch = reader.read_next_batch()
    return batch.column("tensor").to_numpy_ndarray(), np.stack([batch.column(c).to_numpy() for c in ("start_ms", "end_ms")], axis=1)


def _like(df: DataFrame, *gone: str) -> tuple[list[str], str]:
    """Names and schema of the columns that stay."""
    kept = [f for f in df.schema.fields if f.name not in gone]
    return [f.name for f in kept], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)


def audio_features(media: DataFrame, column: str = "media") -> DataFrame:
    """Replace the media by ``tensors`` (Arrow IPC bytes of fixed-shape tensors with time spans) and the sounding ``spans``."""
    ship(media.sparkSession)
    names, schema = _like(media, column, "tensors", "spans")
    kind = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                tensors, sounding = [], []
                for value in part.column(column):
                    grid, spans = features(memoryview(value.as_buffer())[HEADER:])
                    tensors.append(tensor_bytes(grid))
                    sounding.append([{"start_ms": a, "end_ms": b} for a, b in spans])
                yield pa.RecordBatch.from_arrays([part.column(n) for n in names] + [pa.array(tensors, pa.binary()), pa.array(sounding, kind)], names=[*names, "tensors", "spans"])

    return media.mapInArrow(run, f"{schema}, tensors binary, spans array<struct<start_ms:bigint,end_ms:bigint>>")


def describe(features: DataFrame) -> DataFrame:
    """Replace stored ``tensors`` and ``spans`` by ``feature``: their numbers, the loudest band and a digest."""
    names, schema = _like(features, "tensors", "spans", "feature")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for value, spans in zip(batch.column("tensors"), batch.column("spans").to_pylist(), strict=True):
                grid, times = read_tensors(value.as_buffer())
                sounding = [(x["start_ms"], x["end_ms"]) for x in spans]
                digest = hashlib.sha256(grid.tobytes() + times.tobytes() + repr(sounding).encode()).hexdigest()
                loudest = int(grid.mean(axis=(0, 1), dtype=np.float64).argmax())
                found.append(f"spans={len(grid)};segments={len(sounding)};sounding_ms={sum(b - a for a, b in sounding)};loudest={loudest};sha256={digest}")
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(found, pa.string())], names=[*names, "feature"])

    return features.mapInArrow(run, f"{schema}, feature string")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text stored as 8-bit audio, read back, and described by its features, which are stored and read back as well."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    media = stored(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), to_wav(padded(F.col("text"))).alias("media")), "media", compression="zstd")
    payload = wav_payload(F.col("media"))
    digests = media.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "media",
    )
    return describe(stored(audio_features(digests), "tensors", compression="zstd"))
