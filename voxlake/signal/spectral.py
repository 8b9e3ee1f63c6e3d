"""Spectra of one waveform: short-time transform, mel bands, cepstra, per-channel energy normalisation, pitch."""

from __future__ import annotations

import numpy as np

EPS = 1e-10


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Magnitudes, frames x (size // 2 + 1), of centred Hann windows."""
    x = np.pad(np.asarray(x, float), size // 2)
    n = max(0, (len(x) - size) // hop + 1)
    at = np.arange(size)[None, :] + hop * np.arange(n)[:, None]
    return np.abs(np.fft.rfft(x[at] * np.hanning(size + 1)[:-1], axis=1)) if n else np.zeros((0, size // 2 + 1))


def mel_filters(rate: int, size: int, bands: int, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangles of unit area on the mel scale, bands x (size // 2 + 1)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(low), to_mel(high or rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - f[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel(x: np.ndarray, rate: int, size: int, hop: int, bands: int, power: float = 2.0, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Mel energies, frames x bands."""
    return stft(x, size, hop) ** power @ mel_filters(rate, size, bands, low, high).T


def mfcc(x: np.ndarray, rate: int, size: int, hop: int, bands: int = 20, count: int = 13) -> np.ndarray:
    """Cepstra, frames x count: the orthonormal cosine transform of log mel energies."""
    db = 10 * np.log10(mel(x, rate, size, hop, bands) + EPS)
    k = np.arange(count)[:, None]
    basis = np.cos(np.pi * k * (2 * np.arange(bands)[None, :] + 1) / (2 * bands)) * np.where(k == 0, np.sqrt(1 / bands), np.sqrt(2 / bands))
    return db @ basis.T


def pcen(energy: np.ndarray, rate: int, hop: int, time_constant: float = 0.06, gain: float = 0.98, bias: float = 2.0, power: float = 0.5) -> np.ndarray:
    """Per-channel energy normalisation of frames x bands: each band against its own running level."""
    t = time_constant * rate / hop
    weight = (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t)
    level, smooth = np.empty_like(energy), energy[:1].mean(axis=0) if len(energy) else None
    for k, row in enumerate(energy):
        smooth = weight * row + (1 - weight) * smooth
        level[k] = smooth
    return (energy / (1e-6 + level) ** gain + bias) ** power - bias**power


def pitch(x: np.ndarray, rate: int, size: int, hop: int, low: float, high: float, threshold: float = 0.2) -> np.ndarray:
    """Hz of each frame's period, the first lag whose cumulative normalised difference falls under threshold; NaN where none does."""
    x = np.asarray(x, float)
    n = max(0, (len(x) - size) // hop + 1)
    longest, shortest = min(size // 2, int(rate / low)), max(1, int(rate / high))
    out = np.full(n, np.nan)
    for k in range(n):
        f = x[k * hop : k * hop + size]
        span = size - longest
        d = np.array([((f[:span] - f[lag : lag + span]) ** 2).sum() for lag in range(longest + 1)])
        norm = d[1:] * np.arange(1, longest + 1) / np.maximum(np.cumsum(d[1:]), EPS)
        under = np.flatnonzero(norm[shortest - 1 :] < threshold) + shortest - 1
        if len(under) and d[1:].max() > EPS:
            lag = under[0]
            while lag + 1 < longest and norm[lag + 1] < norm[lag]:  # down to the dip's bottom
                lag += 1
            out[k] = rate / (lag + 1)
    return out


def flatness(magnitude: np.ndarray) -> np.ndarray:
    """Geometric over arithmetic mean of each frame."""
    m = magnitude + EPS
    return np.exp(np.log(m).mean(axis=1)) / m.mean(axis=1)


def shape(magnitude: np.ndarray, hz: np.ndarray) -> dict[str, np.ndarray]:
    """Of each frame: richness (bins above its upper quartile), flatness, spread about its centre in Hz, crest (peak over mean)."""
    total = magnitude.sum(axis=1) + EPS
    centre = magnitude @ hz / total
    return {
        "rich": (magnitude > np.percentile(magnitude, 75, axis=1)[:, None]).sum(axis=1).astype(float),
        "flat": flatness(magnitude),
        "spread": np.sqrt((magnitude * (hz[None, :] - centre[:, None]) ** 2).sum(axis=1) / total),
        "crest": magnitude.max(axis=1) / (magnitude.mean(axis=1) + EPS),
    }


def peak_count(x: np.ndarray, size: int, floor_db: float = -40.0) -> int:
    """Local maxima of all frames' spectra that are within floor_db of the loudest bin."""
    m = stft(x, size, max(1, size // 4))
    if not m.size or not m.max():
        return 0
    db = 20 * np.log10(np.maximum(m, m.max() * 1e-5) / m.max())
    inner = db[:, 1:-1]
    return int(((inner > db[:, :-2]) & (inner > db[:, 2:]) & (inner >= floor_db)).sum())


def richest_window(x: np.ndarray, rate: int, length: float, hop: float, size: int, skip: float = 0.0) -> tuple[float, float]:
    """Start and end in seconds of the window with most spectral peaks, the first of equals; the beginning if there is none."""
    n, step = int(length * rate), max(1, int(hop * rate))
    starts = range(int(skip * rate), len(x) - n + 1, step)
    best = max(starts, key=lambda s: (peak_count(x[s : s + n], size), -s), default=0)
    return best / rate, (best + n) / rate
