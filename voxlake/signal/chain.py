"""The preparation of a call's waveform: fade, telephone band, level, compressor and limiter; what is measured of the result; and the metrics of a batch."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.storage import written

from . import frames
from . import kernels as K

#: Silence, in dB.
NONE = 1e-12


def fade_in(x: np.ndarray, rate: int, ms: float = 30) -> np.ndarray:
    n = min(len(x), int(rate * ms / 1000))
    ramp = np.linspace(0, 1, n) if n > 1 else np.ones(n)
    return np.concatenate([x[:n] * ramp, x[n:]])


def telephone_band(x: np.ndarray, rate: int, low: float = 150, high: float = 3400) -> np.ndarray:
    """Without its mean and what is outside the band, without delay: the squared gains of a second-order high pass and a fourth-order low pass."""
    if not len(x):
        return x
    low, high = (min(max(least, f), 0.475 * rate) for least, f in ((20.0, low), (200.0, high)))
    f = np.fft.rfftfreq(2 * len(x), 1 / rate)
    gain = 1 / (1 + (low / np.maximum(f, 1e-9)) ** 4) / (1 + (f / high) ** 8)
    return np.fft.irfft(np.fft.rfft(x - x.mean(), 2 * len(x)) * gain, 2 * len(x))[: len(x)]


# Fixed values of the loudness standard: the weighting's two filters (Hz, dB, quality), gates and blocks.
SHELF, LOW_CUT = (1681.974450955533, 3.999843853973347, 0.7071752369554196), (38.13547087602444, 0.5003270373238773)
OFFSET, ABSOLUTE_GATE, RELATIVE_GATE, GATED_S, STEP_S = -0.691, -70.0, -10.0, 0.4, 0.1
#: Seconds after which the weighting's response to a sample is spent, and samples that are weighted at a time.
RESPONSE_S, WEIGHTED = 1.0, 1 << 16


@functools.lru_cache(8)
def weighting(rate: int) -> np.ndarray:
    """What the weighting makes of a single sample: a high shelf (where the rate has such frequencies), then a low cut."""
    stages = []
    if SHELF[0] < 0.45 * rate:
        k, gain = np.tan(np.pi * SHELF[0] / rate), 10 ** (SHELF[1] / 20)
        bend = gain**0.4996667741545416
        a0 = 1 + k / SHELF[2] + k * k
        stages.append(([(gain + bend * k / SHELF[2] + k * k) / a0, 2 * (k * k - gain) / a0, (gain - bend * k / SHELF[2] + k * k) / a0], [2 * (k * k - 1) / a0, (1 - k / SHELF[2] + k * k) / a0]))
    k = np.tan(np.pi * LOW_CUT[0] / rate)
    a0 = 1 + k / LOW_CUT[1] + k * k
    stages.append(([1.0, -2.0, 1.0], [2 * (k * k - 1) / a0, (1 - k / LOW_CUT[1] + k * k) / a0]))
    y = np.zeros(max(8, int(RESPONSE_S * rate)))
    y[0] = 1.0
    for b, a in stages:
        x, y = y, np.zeros(len(y))
        for t in range(len(x)):
            y[t] = sum(b[j] * x[t - j] for j in range(3) if t >= j) - sum(a[j - 1] * y[t - j] for j in (1, 2) if t >= j)
    return y


def weighted(x: np.ndarray, rate: int) -> np.ndarray:
    """The weighted waveform, block by block: what a block's samples still do after its end is added to the next."""
    h = weighting(rate)
    n = 1 << int(np.ceil(np.log2(WEIGHTED + len(h))))
    response, out = np.fft.rfft(h, n), np.zeros(len(x) + n)
    for at in range(0, len(x), WEIGHTED):
        out[at : at + n] += np.fft.irfft(np.fft.rfft(x[at : at + WEIGHTED], n) * response, n)
    return out[: len(x)]


def loudness(x: np.ndarray, rate: int) -> float | None:
    """Perceived loudness (LUFS): the mean power of weighted blocks of 400 ms, each 100 ms, over the absolute gate and not 10 dB under the mean of those; None if no block is. A shorter file is one block."""
    if not len(x):
        return None
    size, step = min(len(x), max(1, int(GATED_S * rate))), max(1, int(STEP_S * rate))
    sums = np.concatenate([[0.0], np.cumsum(weighted(x, rate) ** 2)])
    at = np.arange(0, len(x) - size + 1, step)
    power = np.maximum(sums[at + size] - sums[at], 0) / size
    level = lambda p: OFFSET + 10 * np.log10(p + NONE**2)
    heard = power[level(power) > ABSOLUTE_GATE]
    if not len(heard):
        return None
    return float(level(heard[level(heard) > level(heard.mean()) + RELATIVE_GATE].mean()))


def to_level(x: np.ndarray, rate: int, target: float = -23.0, ceiling: float = -1.0) -> np.ndarray:
    """Scaled to a loudness, or less if the peak would pass the ceiling (dB); silence stays."""
    now = loudness(x, rate)
    if now is None:
        return x
    y = x * 10 ** ((target - now) / 20)
    return y * min(1.0, 10 ** (ceiling / 20) / np.abs(y).max())


def compressed(x: np.ndarray, rate: int, threshold: float, ratio: float, attack_ms: float, release_ms: float) -> np.ndarray:
    """Levels over threshold (dB) rise by 1 / ratio of what they did. The level follows the peaks of blocks of a millisecond, with time constants for rising and falling."""
    size = max(1, rate // 1000)
    n = -(-len(x) // size)
    peaks = np.abs(np.pad(x, (0, n * size - len(x)))).reshape(n, size).max(axis=1) if n else np.zeros(0)
    rise, fall = (np.exp(-1000 * size / rate / max(ms, 1e-3)) for ms in (attack_ms, release_ms))
    level, followed = 0.0, np.empty(n)
    for k, p in enumerate(peaks.tolist()):
        keep = rise if p > level else fall
        level = keep * level + (1 - keep) * p
        followed[k] = level
    over = np.maximum(0, 20 * np.log10(np.maximum(followed, NONE)) - threshold)
    return x * np.repeat(10 ** (-over * (1 - 1 / ratio) / 20), size)[: len(x)]


def prepared(x: np.ndarray, rate: int, *, low: float = 150, high: float = 3400, target: float = -23.0, ceiling: float = -1.0) -> np.ndarray:
    """Fade, band, level, compressor (2.5 : 1 over -26 dB), limiter at -1.5 dB, clipped to [-1, 1]."""
    y = to_level(telephone_band(fade_in(np.asarray(x, float), rate), rate, low, high), rate, target, ceiling)
    y = compressed(y, rate, -26.0, 2.5, 7.0, 220.0)
    return np.clip(compressed(y, rate, -1.5, 1e6, 0.0, 60.0), -1, 1)


def measured(y: np.ndarray, rate: int) -> dict[str, float]:
    """Peak, level and crest in dB, share of clipped samples, noise floor and distance of speech from it."""
    if not len(y):
        return dict.fromkeys(("peak_db", "rms_db", "crest_db", "clipped", "floor_db", "snr_db"), 0.0)
    db = lambda v: float(20 * np.log10(v + NONE))
    peak, rms = db(np.abs(y).max()), db(np.sqrt(np.mean(y * y)))
    size = max(2, int(0.025 * rate))
    levels = K.levels(y, size, max(1, int(0.010 * rate)))
    floor, top = np.percentile(levels, [10, 90]) if len(levels) else (0.0, 0.0)
    return {"peak_db": peak, "rms_db": rms, "crest_db": peak - rms, "clipped": float((np.abs(y) > 0.99).mean()), "floor_db": float(floor), "snr_db": float(top - floor)}


#: A file's own measures; the others are those of its frames.
OWN = ("dial_s", "hangup_s", "signatures", "duration_s", "peak_db", "rms_db", "crest_db", "clipped", "floor_db", "snr_db", "silence", "saturation")
COLUMNS = (*OWN, "speech", "segments", "overlap_s", "overlaps")


def file_metrics(x: np.ndarray, rate: int, template: np.ndarray | None = None) -> tuple[dict[str, float | None], np.ndarray]:
    """What is measured of one file in the batch's order (dial tone cut off, signature, preparation, levels), and its prepared waveform."""
    x = np.asarray(x, float)
    if x.ndim != 1 or not len(x) or not np.isfinite(x).all():
        raise ValueError("no waveform")
    dial = K.dial_seconds(x, rate)
    rest = x[int(dial * rate) :]
    hits = [] if template is None else K.detect(rest, template, rate, 0.5, zero_mean=True, apart=2.0)
    y = prepared(rest, rate)
    levels = K.levels(y, max(2, rate // 40), max(1, rate // 100))
    found = {
        "dial_s": dial,
        "hangup_s": hits[-1] + dial if hits else None,
        "signatures": float(len(hits)),
        "duration_s": len(x) / rate,
        "silence": float((levels < -50).mean()) if len(levels) else None,
        "saturation": K.saturation(x),
        **measured(y, rate),
    }
    return found, y


def batch_metrics(files: DataFrame, key: str, wave: str, rate: int, template: np.ndarray | None = None) -> DataFrame:
    """key and COLUMNS of every file: its own measures, then speech and overlaps as queries over the frames of the prepared waveforms, which are written once. A file that fails has nulls."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, x in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    found, y = file_metrics(np.array(x.values if x.is_valid else [], float), rate, template)
                except (ValueError, IndexError, FloatingPointError, ZeroDivisionError):
                    found, y = dict.fromkeys(OWN), None
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()], name.type), *(pa.array([found[c]], pa.float64()) for c in OWN), pa.array([y], pa.list_(pa.float64()))], names=[key, *OWN, "y"])

    rows = files.select(key, F.col(wave).cast("array<double>").alias(wave))
    done = written(rows.mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} double' for c in OWN)}, y array<double>"))
    hop = max(1, rate // 100)
    levels = frames.table(done, key, "y", frames.rms_of(max(2, rate // 40), hop), ["rms"])
    spans = frames.segments(frames.active(levels, key, least=4, smooth=20, local=75, over_db=4, drop_db=2, local_share=0.6), F.col("active") == 1, key, hop / rate)
    long = frames.tidy(frames.padded(spans, key, 0.12), key, gap=0.15, least=0.2)
    ends = done.select(key, (F.size("y") / F.lit(rate)).alias("__end"))
    speech = written(frames.padded(long.join(ends, key), key, 0.1, F.col("__end")))
    size, step = min(512, 1 << max(3, rate.bit_length() - 4)), max(1, rate // 50)
    shapes = frames.spoken(frames.table(done, key, "y", frames.shape_of(rate, size, step), [*frames.WEIGHTS]), speech, key, step / rate)
    second = step / rate
    both = frames.overlaps(shapes, key, second=second, smooth=max(1, round(0.512 / second)), least=max(1, round(0.125 / second)), gap=0.06, pad=0.08, quartiles=2.25, by="duration")
    of = lambda spans, length, count: spans.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias(length), F.count("*").cast("double").alias(count))
    x = done.join(of(speech, "speech_s", "segments"), key, "left").join(of(both, "overlap_s", "overlaps"), key, "left")
    ours = lambda c: F.when(F.col("y").isNotNull(), F.coalesce(c, F.lit(0.0)))
    return x.select(key, *OWN, ours(F.col("speech_s") * rate / F.size("y")).alias("speech"), *(ours(F.col(c)).alias(c) for c in COLUMNS[-3:]))
