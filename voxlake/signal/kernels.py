"""NumPy kernels over one waveform each, and the column functions that apply them. Parallelism comes from files."""

from __future__ import annotations

import numpy as np

from voxlake.functions.python import by_value

EPS = 1e-12


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    x = np.asarray(x, float)
    n = max(0, (len(x) - size) // hop + 1)
    return x[np.arange(size)[None, :] + hop * np.arange(n)[:, None]] if n else np.zeros((0, size))


def levels(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """dB of each frame's root mean square against full scale."""
    return 20 * np.log10(np.sqrt((frames(x, size, hop) ** 2).mean(axis=1)) + EPS)


def band_share(x: np.ndarray, rate: int, low: float, high: float) -> np.ndarray:
    """Share of each frame's power between two frequencies."""
    power = np.abs(np.fft.rfft(x * np.hanning(x.shape[1]), axis=1)) ** 2
    f = np.fft.rfftfreq(x.shape[1], 1 / rate)
    return power[:, (f >= low) & (f <= high)].sum(axis=1) / (power.sum(axis=1) + EPS)


def dial_seconds(x: np.ndarray, rate: int, low: float = 415, high: float = 445, share: float = 0.6) -> float:
    """How long the dial tone lasts at the start."""
    size = rate // 10
    tone = band_share(frames(x, size, size), rate, low, high) >= share
    return float((np.flatnonzero(~tone)[0] if (~tone).any() else len(tone)) * size / rate) if len(tone) else 0.0


def ncc(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation at every offset, by FFT."""
    x, h = np.asarray(x, float), np.asarray(template, float)
    if len(h) > len(x) or not len(h):
        return np.zeros(0)
    n = 1 << int(np.ceil(np.log2(len(x) + len(h))))
    dots = np.fft.irfft(np.fft.rfft(x, n) * np.conj(np.fft.rfft(h, n)), n)[: len(x) - len(h) + 1]
    energy = np.cumsum(np.concatenate([[0], x**2]))
    norm = np.sqrt(np.maximum(energy[len(h) :] - energy[: -len(h)], 0)) * np.sqrt((h**2).sum())
    return dots / (norm + EPS)


#: Samples of a file that are correlated at a time.
BLOCK = 1 << 16


def zncc(x: np.ndarray, template: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """As ncc, of deviations from the mean of the template and of each stretch; 0 where a stretch hardly deviates.

    By overlap-save: a block of samples and the template's length of those after it are transformed at a time, and means and deviations run over them, so work and memory besides the file's own
    scores are those of a block, and sums don't lose digits over a long file.
    """
    x, h = np.asarray(x, float), np.asarray(template, float)
    m = len(h)
    if m < 2 or m > len(x):
        return np.zeros(0)
    h = h - h.mean()
    size = max(block, 2 * m)
    n = 1 << int(np.ceil(np.log2(size + m)))
    mirrored, norm = np.conj(np.fft.rfft(h, n)), np.sqrt(m) * np.sqrt((h**2).sum())
    out = np.empty(len(x) - m + 1)
    for at in range(0, len(out), size):
        part = x[at : at + size + m - 1]
        part = part - part.mean()  # what all samples have in common changes nothing
        count = len(part) - m + 1
        dots = np.fft.irfft(np.fft.rfft(part, n) * mirrored, n)[:count]
        sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (part, part * part))
        mean = (sums[m:] - sums[:-m]) / m
        spread = np.sqrt(np.maximum((squares[m:] - squares[:-m]) / m - mean**2, 0))
        out[at : at + count] = np.where(spread < 1e-3, 0.0, dots / (spread * norm + EPS))
    return out


def peaks(score: np.ndarray, least: float, apart: int) -> list[int]:
    """Offsets above ``least``, the best of those closer than ``apart``."""
    out: list[int] = []
    for k in np.argsort(-score, kind="stable"):
        if score[k] < least:
            break
        if all(abs(int(k) - p) >= apart for p in out):
            out.append(int(k))
    return sorted(out)


def adaptive_least(score: np.ndarray, base: float) -> float:
    """base, or what stands out of this score: six median deviations over the median, and 0.02 over the 99.5th percentile."""
    middle = np.median(score)
    return max(base, middle + 6 * (np.median(np.abs(score - middle)) + 1e-8), np.quantile(score, 0.995) + 0.02)


def detect(x, template: np.ndarray, rate: int, least: float = 0.8, *, zero_mean: bool = False, adaptive: bool = False, apart: float | None = None, merge: float = 0.0) -> list[float]:
    """Seconds at which the signature begins: peaks of the correlation at least ``apart`` seconds from a higher one (default: its length), then those within ``merge`` seconds of the last one left out."""
    s = (zncc if zero_mean else ncc)(np.asarray([] if x is None else x, float), template)
    if not len(s):
        return []
    found = peaks(s, adaptive_least(s, least) if adaptive else least, max(1, len(template) if apart is None else int(apart * rate)))
    out: list[float] = []
    for p in found:
        if not out or p / rate - out[-1] >= merge:
            out.append(p / rate)
    return out


def voice_frames(x: np.ndarray, rate: int, on: float = 9.0, off: float = 5.0, least: int = 3) -> np.ndarray:
    """Active frames of 20 ms: hysteresis against the noise floor (the 10th percentile), short runs dropped."""
    db = levels(x, rate // 50, rate // 50)
    if not len(db):
        return np.zeros(0, bool)
    floor, active, state = np.percentile(db, 10), np.zeros(len(db), bool), False
    for k, v in enumerate(db):
        state = v >= floor + on or (state and v >= floor + off)
        active[k] = state
    edge = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(int), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a < least:
            active[a:b] = False
    return active


def flatness(x: np.ndarray, size: int) -> np.ndarray:
    """Geometric over arithmetic mean of each frame's power spectrum."""
    p = np.abs(np.fft.rfft(frames(x, size, size), axis=1)) ** 2 + EPS
    return np.exp(np.log(p).mean(axis=1)) / p.mean(axis=1)


def snr(x: np.ndarray, rate: int) -> float:
    """dB between active and inactive frames."""
    db, active = levels(x, rate // 50, rate // 50), voice_frames(x, rate)
    return float(db[active].mean() - db[~active].mean()) if active.any() and (~active).any() else 0.0


def saturation(x: np.ndarray, top: float = 0.99) -> float:
    return float((np.abs(np.asarray(x, float)) >= top).mean()) if len(x) else 0.0


def two_means(v: np.ndarray, rounds: int = 20) -> np.ndarray:
    """1 where a value is nearer to the upper of two centres, which start at the 20th and 80th percentile."""
    v = np.asarray(v, float)
    if not len(v):
        return np.zeros(0, int)
    a, b = np.percentile(v, [20, 80])
    for _ in range(rounds):
        up = np.abs(v - b) < np.abs(v - a)
        if not up.any() or up.all():
            break
        a, b = v[~up].mean(), v[up].mean()
    return (np.abs(v - b) < np.abs(v - a)).astype(int)


flatness_of = by_value(lambda x: None if x is None else flatness(np.asarray(x), 32).tolist(), "array<double>")
