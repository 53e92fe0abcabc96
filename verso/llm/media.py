"""Media columns: texts as WAV samples, with spectral-peak pair fingerprints.

A payload is a text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64. It is stored as
a mono 8-bit WAV file (one byte is one sample, so nothing is lost), read back by the ``wave`` module and
checked by digests of what was read. A short-time Fourier transform of the samples gives, in each of
several frequency bands, the peaks that are not below their neighbours in time; every peak is paired with
the next few, and a pair is one 64-bit number: time, first and second frequency, time between. A gap of silence
between two peaks can be any number of frames; from ``LONGEST`` on it is written as that, which no shorter gap is.

Everything happens in one pass over the rows, without a shuffle; a very long payload is transformed in
blocks of frames, so that memory does not depend on the transform. A null text is the empty text, whose payload is
64 zero bytes. Every row is treated by itself, so ids may repeat or be null, and equal texts have equal media and
fingerprints; ids are numbers (or text that casts to bigint). Of equally loud bins in a band the lowest is the peak;
of equally loud neighbouring frames the first.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns

BLOCK = 64
RATE, FRAME, HOP, FRAMES_AT_ONCE = 8000, 128, 64, 1 << 14
#: Frequency bins [from, to) in which peaks are sought, and the number of later peaks that a peak is paired with.
BANDS, FAN, LONGEST = ((1, 12), (12, 32), (32, 65)), 2, 0xFFFF
_WINDOW = np.hanning(FRAME).astype(np.float32)


def store(payload: bytes) -> bytes:
    """The payload as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def load(media: bytes) -> bytes:
    """The payload of a WAV file made by :func:`store`."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and frequencies (bins) of the spectral peaks, in order of time and frequency.

    A frame is FRAME samples from each multiple of HOP; the last frame is filled up with silence. A band's
    loudest bin in a frame is a peak if it is louder than in the frame before and not less loud than in
    the frame after.
    """
    signal = np.frombuffer(samples, np.uint8).astype(np.float32)
    signal -= 128.0
    frames = len(signal) // HOP
    signal = np.concatenate([signal, np.zeros(FRAME, np.float32)])
    tops, bins = np.empty((len(BANDS), frames), np.float32), np.empty((len(BANDS), frames), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    for k in range(0, frames, FRAMES_AT_ONCE):
        block = view[k : min(k + FRAMES_AT_ONCE, frames)] * _WINDOW
        spectrum = np.fft.rfft(block, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        for b, (low, high) in enumerate(BANDS):
            at = power[:, low:high].argmax(axis=1)
            bins[b, k : k + len(block)] = at + low
            tops[b, k : k + len(block)] = power[np.arange(len(block)), at + low]
    before = np.concatenate([np.full((len(BANDS), 1), -1, np.float32), tops[:, :-1]], axis=1)
    after = np.concatenate([tops[:, 1:], np.full((len(BANDS), 1), -1, np.float32)], axis=1)
    times, bands = np.nonzero(((tops > before) & (tops >= after)).T)
    return times, bins[bands, times]


def fingerprints(samples: bytes) -> np.ndarray:
    """Pairs of peaks as numbers: 32 bits of time, 8 and 8 of frequency, 16 of time between."""
    times, bins = peaks(samples)
    found = []
    for ahead in range(1, FAN + 1):
        t1, t2 = times[:-ahead], times[ahead:]
        gap = np.minimum(t2 - t1, LONGEST)
        found.append((t1 << 32) | (bins[:-ahead] << 24) | (bins[ahead:] << 16) | gap)
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8")
    return len(data), data + bytes(-len(data) % BLOCK if data else BLOCK)


MEDIA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, fingerprints array<bigint>"


def media_columns(docs: DataFrame, key: str = "doc_id", text: str = "text", with_media: bool = False) -> DataFrame:
    """Sizes, digests and fingerprints of every row's text; ``with_media`` adds the WAV file itself."""

    def work(batches):
        for ids, texts in batches:
            out: list[list] = [[] for _ in range(8 + with_media)]
            for identifier, text in zip(ids, texts, strict=True):
                n, payload = _payload(text)
                media = store(payload)
                back = load(media)
                row = [identifier, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), fingerprints(back)]
                for column, value in zip(out, [*row, media] if with_media else row, strict=True):
                    column.append(value)
            yield out

    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_columns(source, MEDIA + ", media binary" * with_media, work)


def op3_media_columns(spark, sf_dir: str) -> DataFrame:
    """The contract's columns and the time-coded ``fingerprints``; ``feature`` is their number and a hash of them."""
    found = media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    feature = F.concat(F.size("fingerprints").cast("string"), F.lit(":"), F.lower(F.hex(F.xxhash64("fingerprints"))))
    return found.withColumn("feature", feature)
