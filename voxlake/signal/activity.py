"""Samples by segments and turns, speakers by a mixture over cepstra, and the frame features of the activity variants."""

from __future__ import annotations

import numpy as np

from .frames import EPS, rms_of
from .spectral import mel, mfcc, pcen, pitch, stft

Segments = list[tuple[float, float]]


#: Bands of telephone speech, Hz.
BANDS = (80.0, 250.0, 500.0, 1000.0, 2000.0, 3000.0, 4000.0)


def band_levels(x: np.ndarray, rate: int, size: int, hop: int, edges: tuple[float, ...] = BANDS) -> np.ndarray:
    """Log energies of centred frames between the edges that the rate has, frames x bands."""
    power, hz = stft(x, size, hop) ** 2, np.fft.rfftfreq(size, 1 / rate)
    bands = [power[:, (hz >= a) & (hz < b)].sum(axis=1) for a, b in zip(edges[:-1], edges[1:], strict=True) if ((hz >= a) & (hz < b)).any()]
    return np.log(np.stack(bands, axis=1) + EPS) if bands else np.zeros((len(power), 0))


def modelled(levels: np.ndarray, *, rate: float = 0.05, over: float = 0.5, hangover: int = 5) -> np.ndarray:
    """Where speech is likelier than noise: each band has a normal model of either, which the frames taken for it move; speech goes on for some frames.

    Models start at the band's low and high deciles, and never come closer than 1; the mean log-likelihood ratio of the bands has to pass ``over``.
    """
    n, bands = levels.shape
    out = np.zeros(n, bool)
    if not n or not bands:
        return out
    low, high = np.percentile(levels, [10, 90], axis=0)
    mean = np.stack([low, np.maximum(high, low + 1)])
    var = np.full((2, bands), max(1.0, float(levels.var(axis=0).mean()) / 4))
    left = 0
    for t, v in enumerate(levels):
        like = -0.5 * (np.log(var) + (v - mean) ** 2 / var)
        is_speech = int((like[1] - like[0]).mean() > over)
        mean[is_speech] += rate * (v - mean[is_speech])
        var[is_speech] = np.maximum(0.25, var[is_speech] + rate * ((v - mean[is_speech]) ** 2 - var[is_speech]))
        mean[1] = np.maximum(mean[1], mean[0] + 1)
        left = hangover if is_speech else max(0, left - 1)
        out[t] = is_speech or left > 0
    return out


def variants(x: np.ndarray, rate: int, size: int, hop: int, *, low: float = 70, high: float = 400, bands: int = 20) -> dict[str, np.ndarray]:
    """Columns of a frame table: rms, pcen (mean normalised energy of mel bands), f0 (Hz; NaN: no pitch), bands (1 where the band models hear speech)."""
    rms = rms_of(size, hop)(x)["rms"]
    n = len(rms)
    fit = lambda v, fill: np.concatenate([v[:n], np.full(max(0, n - len(v)), fill)])
    return {
        "rms": rms,
        "pcen": fit(pcen(mel(x, rate, size, hop, bands, power=1.0), rate, hop).mean(axis=1), 0.0),
        "f0": fit(pitch(np.pad(x, size // 2), rate, size, hop, low, high), np.nan),
        "bands": fit(modelled(band_levels(x, rate, size, hop)).astype(float), 0.0),
    }


def split(x: np.ndarray, rate: int, segments: Segments) -> tuple[np.ndarray, np.ndarray]:
    """The samples in the segments and those outside, each in order."""
    at = np.zeros(len(x) + 1, int)
    for a, b in segments:
        a, b = max(0, min(len(x), round(a * rate))), max(0, min(len(x), round(b * rate)))
        if b > a:
            at[a] += 1
            at[b] -= 1
    inside = np.cumsum(at)[:-1] > 0
    return np.asarray(x)[inside], np.asarray(x)[~inside]


def stereo(x: np.ndarray, rate: int, turns: list[tuple[float, float, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Two channels as long as x: the samples of the first speaker's turns (in the order of labels) and of the second's; silence elsewhere. One speaker is on both."""
    labels = sorted({s for _, _, s in turns})
    tracks = {s: np.zeros(len(x)) for s in labels}
    for a, b, s in turns:
        i, j = max(0, min(len(x), round(a * rate))), max(0, min(len(x), round(b * rate)))
        tracks[s][i:j] = np.asarray(x, float)[i:j]
    silent = np.zeros(len(x))
    left = tracks[labels[0]] if labels else silent
    return left, tracks[labels[1]] if len(labels) > 1 else left


def joined_calls(parts: list[np.ndarray], rate: int, silence: float = 0.0) -> np.ndarray:
    """Waveforms one after another, with silence between."""
    gap = np.zeros(int(silence * rate))
    return np.concatenate([y for k, p in enumerate(parts) for y in ([gap] if k else []) + [np.asarray(p, float)]]) if parts else np.zeros(0)


def mixture(x: np.ndarray, k: int = 2, rounds: int = 50) -> np.ndarray:
    """Each row's component of a Gaussian mixture with diagonal covariances, on standardised columns; it starts from slices along the direction of most variance, so it is the same on every run."""
    if len(x) < k:
        return np.zeros(len(x), int)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-9)
    axis = np.linalg.eigh(z.T @ z)[1][:, -1]
    resp = np.zeros((len(z), k))
    resp[np.argsort(z @ axis, kind="stable"), np.arange(len(z)) * k // len(z)] = 1
    for _ in range(rounds):
        n = resp.sum(axis=0) + 1e-9
        mean = resp.T @ z / n[:, None]
        var = resp.T @ z**2 / n[:, None] - mean**2 + 1e-3
        log = np.log(n / n.sum()) - 0.5 * (np.log(2 * np.pi * var).sum(axis=1) + ((z[:, None, :] - mean) ** 2 / var).sum(axis=2))
        new = np.exp(log - log.max(axis=1, keepdims=True))
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - resp).max() < 1e-6:
            break
        resp = new
    return resp.argmax(axis=1)


def cepstral(x: np.ndarray, rate: int, size: int, hop: int, k: int = 2) -> dict[str, np.ndarray]:
    """Columns of a frame table: component (of a mixture over cepstra) and loudness (against the loudest frame)."""
    f = mfcc(x, rate, size, hop)
    level = np.concatenate([[0.0], np.cumsum(np.abs(np.pad(x, size // 2)))])
    at = hop * np.arange(len(f))
    loudness = (level[at + size] - level[at]) / size
    return {"component": mixture(f, k), "loudness": loudness / (loudness.max(initial=0) + EPS)}
