"""Images and sound as descriptor rows. Decoding that the JVM can't do runs over Arrow batches, with pluggable parts."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Takes an image (rows x columns, 8 bit) and gives descriptors (n x width).
Extractor = Callable[[np.ndarray], np.ndarray]


def fit_size(width: int, height: int, most_width: int, most_height: int) -> tuple[int, int]:
    """The size within bounds, in proportion; images are never enlarged."""
    scale = min(most_width / width, most_height / height, 1.0)
    return max(1, round(width * scale)), max(1, round(height * scale))


def _overlap(n: int, m: int) -> np.ndarray:
    """Shares (m x n) that m equal cells take of n pixels."""
    edges = np.linspace(0, n, m + 1)
    low = np.maximum(edges[:-1, None], np.arange(n)[None])
    high = np.minimum(edges[1:, None], np.arange(1, n + 1)[None])
    return np.maximum(high - low, 0) * m / n


def resize(image: np.ndarray, most_width: int, most_height: int) -> np.ndarray:
    """Area-averaged, within bounds."""
    height, width = image.shape
    w, h = fit_size(width, height, most_width, most_height)
    return image if (w, h) == (width, height) else np.rint(_overlap(height, h) @ image @ _overlap(width, w).T).astype(np.uint8)


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Rows as Spark's image source has them (blue, green, red) as 8-bit gray."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return pixels[:, :, 0]
    return np.rint(pixels[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, image): decoded in the JVM; unreadable files give an error when they are used."""
    return spark.read.format("image").load(folder).select(F.col("image.origin").alias("path"), "image")


def gradient_descriptors(image: np.ndarray, cell: int = 16, bins: int = 8, most: int = 500) -> np.ndarray:
    """Local gradient histograms (4 x 4 cells, 8 directions, 128 wide) at the places with most contrast.

    What stands in where no SIFT library is installed; any other ``Extractor`` can be given instead.
    """
    x = image.astype(np.float32)
    dy, dx = np.gradient(x) if min(x.shape) > 1 else (np.zeros_like(x), np.zeros_like(x))
    size, turn = np.hypot(dx, dy), ((np.arctan2(dy, dx) / (2 * np.pi) + 1) % 1 * bins).astype(int) % bins
    found = []
    for top in range(0, x.shape[0] - cell + 1, cell // 2):
        for left in range(0, x.shape[1] - cell + 1, cell // 2):
            s, t = size[top : top + cell, left : left + cell], turn[top : top + cell, left : left + cell]
            if s.sum() <= 0:
                continue
            sub = cell // 4
            v = np.concatenate([np.bincount(t[a : a + sub, b : b + sub].ravel(), s[a : a + sub, b : b + sub].ravel(), bins) for a in range(0, cell, sub) for b in range(0, cell, sub)])
            found.append((s.sum(), v / np.linalg.norm(v)))
    found.sort(key=lambda p: -p[0])
    return np.array([v for _, v in found[:most]], dtype=np.float32).reshape(-1, 16 * bins)


def image_descriptors(images: DataFrame, extract: Extractor = gradient_descriptors, most_width: int = 1080, most_height: int = 1440) -> DataFrame:
    """(path, at, descriptor) of (path, image), the image made gray and brought within bounds first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.height <= 0 or r.width <= 0:
                    raise ValueError(f"unreadable image: {r.path}")
                d = extract(resize(gray(r.data, r.height, r.width, r.nChannels), most_width, most_height))
                yield pd.DataFrame({"path": r.path, "at": np.arange(len(d)), "descriptor": list(d)})

    flat = images.select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, "path string, at int, descriptor array<float>")


def load_wave(data: bytes, rate: int = 22_050, longest: float | None = None) -> np.ndarray:
    """Samples of a WAV file as one channel of floats at the rate; an empty file is an error."""
    with wave.open(io.BytesIO(data)) as f:
        own, channels, width, n = f.getframerate(), f.getnchannels(), f.getsampwidth(), f.getnframes()
        raw = f.readframes(n if longest is None else min(n, int(longest * own)))
    if not raw:
        raise ValueError("no sound")
    if width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8) / 2**23
    else:
        x = (np.frombuffer(raw, dtype=np.uint8).astype(float) - 128) / 128 if width == 1 else np.frombuffer(raw, dtype={2: "<i2", 4: "<i4"}[width]) / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(axis=1)
    if own != rate:
        x = np.interp(np.arange(round(len(x) * rate / own)) * own / rate, np.arange(len(x)), x)
    return x.astype(np.float32)


def mel_filters(rate: int, n_fft: int, bands: int = 128) -> np.ndarray:
    """Triangles (bands x n_fft / 2 + 1), evenly spaced in mel (linear to 1 kHz, logarithmic above), of equal area."""
    step, corner = 200 / 3, 1000.0
    to_mel = lambda f: np.where(f < corner, f / step, corner / step + np.log(np.maximum(f, 1e-9) / corner) / (np.log(6.4) / 27))
    to_hz = lambda m: np.where(m < corner / step, m * step, corner * np.exp((m - corner / step) * np.log(6.4) / 27))
    edges = to_hz(np.linspace(to_mel(np.array(0.0)), to_mel(np.array(rate / 2)), bands + 2))
    f = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mfcc(samples: np.ndarray, rate: int = 22_050, count: int = 20, n_fft: int = 2_048, hop: int = 512) -> np.ndarray:
    """Mel cepstra (frames x count); the window is no longer than the sound, unbounded values become 0."""
    n_fft = min(n_fft, len(samples))
    padded = np.pad(samples, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(padded, n_fft)[::hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(n_fft + 1)[:-1], axis=1)) ** 2
    mel = power @ mel_filters(rate, n_fft).T
    level = 10 * np.log10(np.maximum(mel, 1e-10))
    level = np.maximum(level, level.max() - 80)
    k, bands = np.arange(count)[:, None], level.shape[1]
    basis = np.cos(np.pi * k * (2 * np.arange(bands)[None] + 1) / (2 * bands)) * np.sqrt(2 / bands)
    basis[0] /= np.sqrt(2)
    return np.nan_to_num(level @ basis.T, nan=0.0, posinf=0.0, neginf=0.0).astype(np.float32)


def sound_descriptors(files: DataFrame, rate: int = 22_050, count: int = 20, longest: float | None = None) -> DataFrame:
    """(path, at, descriptor) of (path, content): one row per frame of each WAV file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                d = mfcc(load_wave(r.content, rate, longest), rate, count)
                yield pd.DataFrame({"path": r.path, "at": np.arange(len(d)), "descriptor": list(d)})

    return files.select("path", "content").mapInPandas(run, "path string, at int, descriptor array<float>")
