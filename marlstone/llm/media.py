"""Media columns: WAV samples, short-time Fourier transforms and fingerprints of spectral-peak pairs."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import byte_column, pieces

#: Samples a second of the stored form; samples that a payload is padded to a multiple of.
RATE, UNIT = 8000, 64
#: Samples in a frame and between frames; frames that are transformed at once.
FRAME, HOP, BLOCK = 256, 128, 2048
#: A peak exceeds the bins within REACH of its own and those of the frames on both sides, and this many
#: times the mean power of its frame; at most so many peaks of a frame count, the strongest.
REACH, LOUD, PER_FRAME = 3, 6.0, 2
#: Each peak is paired with so many that follow within so many frames.
FAN, SPAN = 3, 32
#: Bytes of samples that a batch holds.
BATCH = 2 << 20
_BINS = FRAME // 2 + 1
_WINDOW = np.hanning(FRAME + 1)[:-1]


def payload_of(raw: bytes) -> bytes:
    """raw and bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def wav_bytes(payload: bytes, rate: int = RATE) -> bytes:
    """A WAV file of one channel of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    """The samples of a WAV file of one channel of 8 bits."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not one channel of 8-bit samples")
        return w.readframes(w.getnframes())


def _power(samples: np.ndarray, first: int, last: int) -> np.ndarray:
    """Power spectra of the frames first to last - 1, each without its mean."""
    part = samples[first * HOP : (last - 1) * HOP + FRAME]
    frames = sliding_window_view(part, FRAME)[::HOP].astype(np.float64)
    z = np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * _WINDOW, axis=1)
    return z.real**2 + z.imag**2


def n_frames(n_samples: int) -> int:
    return max(1, -(-(n_samples - FRAME) // HOP) + 1)


def spectral_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the peaks of the short-time Fourier transform, in that order.

    Samples of bytes; the last frame is filled up with the last sample. Powers are compared as whole numbers
    scaled by a frame's own mean, so silence has no peaks. BLOCK frames are transformed at a time,
    with one more on both sides, so the peaks are those of the whole."""
    total = n_frames(len(samples))
    room = (total - 1) * HOP + FRAME
    samples = np.concatenate((samples, np.full(room - len(samples), samples[-1]))) if room > len(samples) else samples
    frames, bins = [], []
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        lo, hi = max(0, a - 1), min(total, b + 1)
        p = np.rint(_power(samples, lo, hi))
        wide = np.pad(p, ((1 - (a - lo), 1 - (hi - b)), (REACH, REACH)), constant_values=-1.0)
        own = wide[1:-1, REACH:-REACH]
        peak = own > LOUD * np.maximum(own.mean(axis=1, keepdims=True), 1.0)
        for d in range(1, REACH + 1):
            peak &= (own > wide[1:-1, REACH - d : REACH - d + _BINS]) & (own >= wide[1:-1, REACH + d : REACH + d + _BINS])
        peak &= (own > wide[:-2, REACH:-REACH]) & (own >= wide[2:, REACH:-REACH])
        t, k = np.nonzero(peak)
        strongest = np.lexsort((k, -own[t, k], t))
        rank = np.arange(len(t)) - np.searchsorted(t, t)  # t is sorted either way
        keep = np.sort(strongest[rank < PER_FRAME])
        frames.append(t[keep] + a)
        bins.append(k[keep])
    return np.concatenate(frames).astype(np.int64), np.concatenate(bins).astype(np.int64)


def peak_pairs(frames: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time and code of each pair of a peak and one of the FAN that follow in later frames within SPAN:
    the code holds both bins and the frames between, so it is the same wherever the sound stands."""
    after, out = np.searchsorted(frames, frames, side="right"), []
    for j in range(FAN):
        to = after + j
        from_ = np.flatnonzero(to < len(frames))
        to = to[from_]
        near = frames[to] - frames[from_] <= SPAN
        from_, to = from_[near], to[near]
        out.append(np.stack((frames[from_], (bins[from_] * _BINS + bins[to]) * SPAN + frames[to] - frames[from_] - 1, to)))
    t, code, _ = both = np.concatenate(out, axis=1)
    order = np.lexsort((both[2], code, t))
    return t[order].astype(np.int32), code[order].astype(np.int32)


def media_column(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes as the samples of a WAV file."""

    def store(batches):
        for batch in batches:
            data, at = byte_column(batch.column("text"))
            for i, j in pieces(at, BATCH):
                files = [wav_bytes(payload_of(data[a:b].tobytes())) for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(at[i : j + 1])), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(store, "doc_id long, n_bytes long, media binary")


def fingerprint_media(media: DataFrame, column: str = "media") -> DataFrame:
    """The rows of media, in place of the column: media_bytes, media_sha256, payload_bytes,
    payload_sha256, tail_crc32, frames, peaks, and the fingerprint as two arrays, times (frames) and codes."""
    others = [f for f in media.schema.fields if f.name != column]
    made = "media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, frames long, peaks long, times array<int>, codes array<int>"
    names = [f.name for f in others] + [f.split()[0] for f in made.split(", ")]

    def read(batches):
        for batch in batches:
            data, at = byte_column(batch.column(column))
            for i, j in pieces(at, BATCH):
                out = []
                for a, b in zip(at[i:j].tolist(), at[i + 1 : j + 1].tolist(), strict=True):
                    file = data[a:b].tobytes()
                    payload = read_wav(file)
                    t, k = spectral_peaks(np.frombuffer(payload, dtype=np.uint8))
                    times, codes = peak_pairs(t, k)
                    out.append((len(file), hashlib.sha256(file).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), n_frames(len(payload)), len(t), times, codes))
                cols = list(zip(*out, strict=True))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]).astype(np.int32)), pa.array(np.concatenate(c))) for c in cols[7:]]
                kept = [batch.column(f.name).slice(i, j - i) for f in others]
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c) for c in cols[:7]], *lists], names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [made])
    return media.mapInArrow(read, schema)


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Each text as sound: what media_column stores and fingerprint_media reads back, a row for each row.

    Rows are worked on where they lie, in batches of bounded bytes; a text's frames in blocks, so that
    memory grows with its bytes and peaks alone. A null or empty text is 64 samples of 0: silence,
    without peaks. Equal texts give equal rows, repeated rows a row each; a null doc_id stays null.
    An empty table gives no rows. Other columns are ignored, whatever their names."""
    return fingerprint_media(media_column(docs, text, doc_id))
