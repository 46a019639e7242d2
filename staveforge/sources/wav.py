"""WAV files as PCM frames and their spectra."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "path string, frame_index int, start_sec double, end_sec double, rms double, peak double, zero_crossing_rate double, spectral_centroid_hz double, spectral_rolloff_hz double, spectral_flux double, low_band double, f0_hz double, pitch_confidence double"


def mono(content: bytes) -> tuple[np.ndarray, int]:
    """Samples in -1..1, the mean of all channels, and the rate; 8, 16, 24 and 32 bit PCM."""
    with wave.open(io.BytesIO(content)) as w:
        n, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / float(1 << (8 * width - 1))
    return x.reshape(-1, n).mean(axis=1) if len(x) else np.zeros(0), rate


def framed(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Frames with a zero-padded tail; the last is the first to reach the end, and an empty signal is one zero frame."""
    n = 1 if len(x) <= size else -(-(len(x) - size) // hop) + 1
    padded = np.concatenate([x, np.zeros(max(0, (n - 1) * hop + size - len(x)))])
    return np.lib.stride_tricks.sliding_window_view(padded, size)[::hop][:n]


def features(x: np.ndarray, rate: int, size: int = 2048, hop: int = 512, low: tuple[float, float] = (35.0, 400.0)) -> dict[str, np.ndarray]:
    """Per frame: levels, crossings, Hann-window spectrum shape, flux, low-band power, and the strongest bin of the low band as pitch."""
    f = framed(x, size, hop)
    mag = np.abs(np.fft.rfft(f * np.hanning(size), axis=1))
    hz = np.fft.rfftfreq(size, 1 / rate)
    total = mag.sum(axis=1)
    quiet = total <= 1e-12
    safe = np.where(quiet, 1.0, total)
    cum = np.cumsum(mag, axis=1)
    roll = hz[np.minimum((cum < 0.85 * total[:, None]).sum(axis=1), len(hz) - 1)]
    band = (hz >= low[0]) & (hz <= low[1])
    inside = mag[:, band]
    best = inside.argmax(axis=1) if band.any() else np.zeros(len(f), int)
    peak = inside[np.arange(len(f)), best] if band.any() else np.zeros(len(f))
    silent = quiet | (peak <= 0)
    start = np.arange(len(f)) * hop / rate
    return {
        "frame_index": np.arange(len(f)), "start_sec": start, "end_sec": np.minimum(start + size / rate, max(len(x) / rate, 1e-9)), "rms": np.sqrt((f**2).mean(axis=1)),
        "peak": np.abs(f).max(axis=1), "zero_crossing_rate": np.diff(np.signbit(f), axis=1).mean(axis=1), "spectral_centroid_hz": np.where(quiet, np.nan, (mag @ hz) / safe),
        "spectral_rolloff_hz": np.where(quiet, np.nan, roll), "spectral_flux": np.concatenate([[0.0], np.maximum(0, np.diff(mag, axis=0)).sum(axis=1)]),
        "low_band": (inside**2).mean(axis=1) if band.any() else np.zeros(len(f)), "f0_hz": np.where(silent, np.nan, hz[band][best] if band.any() else 0.0),
        "pitch_confidence": np.where(silent, 0.0, np.minimum(1.0, 8 * peak / np.where(inside.sum(axis=1) > 0, inside.sum(axis=1), 1.0))),
    }


def read_frames(spark: SparkSession, folder: str, size: int = 2048, hop: int = 512) -> DataFrame:
    """FEATURES of every .wav file below folder; a file is one recording and one task's unit."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(".wav"))
    names = [c.split()[0] for c in FEATURES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b.path, b.content):
                x, rate = mono(bytes(content))
                yield pd.DataFrame(features(x, rate, size, hop)).assign(path=path)[names]

    nan = [c for c in names if c.endswith("_hz")]
    out = files.select("path", "content").mapInPandas(run, FEATURES)
    return out.withColumns({c: F.when(F.isnan(c), None).otherwise(F.col(c)) for c in nan})
