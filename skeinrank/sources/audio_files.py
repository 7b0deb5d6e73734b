"""Audio files to samples of one rate: binary files, channel means, resampling by Fourier transform, 16-bit clipping."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

RATE = 16_000
SAMPLES = "path string, rate int, n_samples long, pcm binary"


def decoded(content: bytes) -> tuple[np.ndarray, int]:
    """(frames, channels) in [-1, 1) and the rate of a wave file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        width, channels, rate, raw = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    if width == 1:
        x = np.frombuffer(raw, np.uint8).astype(float) - 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(float)
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(float)
    return x.reshape(-1, channels) / 2.0 ** (8 * width - 1), rate


def resampled(x: np.ndarray, n: int) -> np.ndarray:
    """x with n samples over the same time: its spectrum cut or padded."""
    if not len(x) or not n:
        return np.zeros(n)
    spectrum, least = np.fft.rfft(x), min(n, len(x))
    out = np.zeros(n // 2 + 1, complex)
    out[: least // 2 + 1] = spectrum[: least // 2 + 1]
    if least % 2 == 0 and n != len(x):
        # The highest frequency of an even number of samples stands for both its signs.
        out[least // 2] *= 2.0 if n < len(x) else 0.5
    return np.fft.irfft(out, n) * (n / len(x))


def normalised(content: bytes, rate: int = RATE) -> np.ndarray:
    """One channel of 16-bit samples at `rate`."""
    x, own = decoded(content)
    x = x.mean(axis=1)
    if own != rate:
        x = resampled(x, int(len(x) * rate / own))
    return (np.clip(x, -1.0, 1.0) * 32_767).astype("<i2")


def audio_files(spark: SparkSession, path: str, rate: int = RATE) -> DataFrame:
    """(path, rate, n_samples, pcm) of the wave files under path; files that are none have null samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"], strict=True):  # a file at a time
                try:
                    x = normalised(content.as_py(), rate)
                except (wave.Error, EOFError, ValueError):
                    x = None
                n = None if x is None else len(x)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rate], pa.int32()), pa.array([n], pa.int64()), pa.array([None if x is None else x.tobytes()], pa.binary())], names=["path", "rate", "n_samples", "pcm"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SAMPLES)
