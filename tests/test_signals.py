"""Waveform kernels on synthetic tones, noise and silence."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.signal import activity as V
from voxlake.signal import chain, kernels, spectral
from voxlake.signal import frames as FR

RATE = 8000
rng = np.random.default_rng(12)


def tone(hz, seconds, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(seconds * RATE)) / RATE)


def noise(seconds, level=0.001):
    return level * rng.normal(size=int(seconds * RATE))


SPEECH = np.concatenate([noise(1), tone(200, 1) + tone(900, 1, 0.2) + noise(1), noise(1.5), tone(150, 0.8) + noise(0.8), noise(1)])


def near(got, want, within):
    assert len(got) == len(want) and all(abs(a - b) <= within for x, y in zip(got, want, strict=True) for a, b in zip(x, y, strict=True)), got


def files(spark, *waves):
    return spark.createDataFrame([(k, None if x is None else [float(v) for v in x]) for k, x in enumerate(waves)], "id int, x array<double>")


def speech(df, pad=0.0, **how):
    """Segments by file, in frames of 25 ms each 5 ms."""
    levels = FR.table(df, "id", "x", FR.rms_of(RATE // 40, RATE // 200), ["rms"])
    spans = FR.segments(FR.active(levels, "id", **{"least": 3, "smooth": 40, "local": 100, **how}), F.col("active") == 1, "id", 1 / 200)
    out = {}
    for r in FR.padded(spans, "id", pad).orderBy("id", "start").collect():
        out.setdefault(r.id, []).append((r.start, r.end))
    return out


def test_speech_segments_are_where_the_tones_are(spark):
    df = files(spark, SPEECH, [], None, [np.nan, 1.0], SPEECH[::-1])
    found = speech(df)
    assert set(found) == {0, 4}
    near(found[0], [(1, 2), (3.5, 4.3)], 0.1)
    near(found[4], [(1, 1.8), (3.3, 4.3)], 0.1)
    near(speech(df, 0.11)[0], [(0.89, 2.11), (3.39, 4.41)], 0.1)


def slow_mean(v, size):
    left = size // 2
    return [sum(v[min(max(k, 0), len(v) - 1)] for k in range(i - left, i - left + size)) / size for i in range(len(v))]


def test_frames_equal_a_walk_through_each_file(spark):
    """The windows against the same rules, frame by frame."""
    waves = [rng.normal(size=700) * np.repeat(rng.choice([0.01, 0.3, 1.0], 14), 50) for _ in range(6)]
    kernel, least, smooth, local = FR.rms_of(40, 10), 3, 6, 9
    got = {}
    for r in FR.active(FR.table(files(spark, *waves), "id", "x", kernel, ["rms"]), "id", least=least, smooth=smooth, local=local).collect():
        got.setdefault(r.id, {})[r.frame] = r.active
    for k, x in enumerate(waves):
        db = 20 * np.log10(kernel(x)["rms"] + FR.EPS)
        db = np.maximum(db - db.max(), -80)
        floor, low = np.percentile(db, [10, 35])
        state, up = False, []
        for v, here in zip(db, slow_mean(db, local), strict=True):
            on = 0.3 * max(low + 3, floor + 1) + 0.7 * max(here + 3, floor + 1)
            state = v >= on if not state else v >= on - 1.5
            up.append(bool(state))
        runs, at = [], 0
        for value, group in itertools.groupby(up):
            n = len(list(group))
            runs += [float(value and n >= least)] * n
            at += n
        assert [got[k][i] for i in range(len(db))] == [int(m >= 0.5) for m in slow_mean(runs, smooth)]


def test_segments_joined_padded_and_tidied(spark):
    spans = spark.createDataFrame([(1, 3.0, 4.0), (1, 0.0, 1.0), (1, 1.1, 2.0), (2, 0.0, 0.1), (2, 0.2, 1.0), (2, 5.0, 5.05)], "id int, start double, end double")
    rows = lambda df: sorted((r.id, round(r.start, 6), round(r.end, 6)) for r in df.collect())
    assert rows(FR.joined(spans, "id", 0.15)) == [(1, 0, 2), (1, 3, 4), (2, 0, 1), (2, 5, 5.05)]
    assert rows(FR.padded(FR.tidy(spans.where("id = 2"), "id", gap=0.15, least=0.2), "id", 0.1, F.lit(1.05))) == [(2, 0, 1.05)]


def voices():
    def voice(hz):
        return sum(tone(hz * k, 6, 0.3 / k) for k in range(1, 12))

    one, two = voice(140), voice(253)
    two[: RATE * 3] = two[RATE * 18 // 5 :] = 0
    return one + two + 0.4 * np.where(two != 0, rng.normal(size=len(two)), 0) + noise(6)


def test_overlap_is_where_two_voices_are(spark):
    how = {"second": 0.01, "smooth": 25, "least": 16, "gap": 0.12, "pad": 0.08}
    df = files(spark, voices(), np.zeros(10), None)
    shapes = FR.table(df, "id", "x", FR.shape_of(RATE, 256, 80), [*FR.WEIGHTS])
    rows = FR.overlaps(shapes.withColumn("spoken", F.lit(True)), "id", **how).orderBy("rank").collect()
    assert rows and {r.id for r in rows} == {0} and abs(rows[0].start - 3) < 0.3 and abs(rows[0].end - 3.6) < 0.3
    assert [r.p95 for r in rows] == sorted((r.p95 for r in rows), reverse=True) and all(r.mean <= r.p95 <= r.max and abs(r.duration - (r.end - r.start)) < 1e-9 for r in rows)
    early = spark.createDataFrame([(0, 0.0, 1.0)], "id int, start double, end double")
    assert all(r.start < 1.2 for r in FR.overlaps(FR.spoken(shapes, early, "id", 0.01), "id", **how).collect())
    inside = FR.spoken(shapes, spark.createDataFrame([(0, 0.5, 1.005)], "id int, start double, end double"), "id", 0.01).where("spoken")
    assert sorted(r.frame for r in inside.collect()) == list(range(50, 101))


def test_zero_mean_correlation_equals_the_definition():
    x, h = rng.normal(size=300) + 3, rng.normal(size=20)
    want = [np.corrcoef(x[k : k + 20], h)[0, 1] for k in range(281)]
    assert np.allclose(kernels.zncc(x, h), want, atol=1e-9) and kernels.zncc(h, x).size == 0
    assert kernels.zncc(np.ones(50), h).tolist() == [0] * 31


def test_signatures_with_adaptive_threshold_and_merging():
    h = tone(700, 0.1) * np.hanning(800)
    x = noise(4, 0.05) + 0.5
    for at in (1.0, 1.3, 3.0):
        x[int(at * RATE) : int(at * RATE) + 800] += h
    assert kernels.detect(x, h, RATE, 0.8, zero_mean=True) == pytest.approx([1.0, 1.3, 3.0], abs=2e-3)
    assert kernels.detect(x, h, RATE, 0.8, zero_mean=True, apart=0.5) == pytest.approx([kernels.detect(x, h, RATE, 0.8, zero_mean=True, apart=0.5)[0], 3.0], abs=2e-3)
    assert kernels.detect(x, h, RATE, 0.8, zero_mean=True, merge=0.5) == pytest.approx([1.0, 3.0], abs=2e-3)
    flat = np.full(1000, 0.1)
    assert kernels.adaptive_least(flat, 0.5) == 0.5 and kernels.adaptive_least(np.r_[flat, [0.9] * 50], 0.5) == pytest.approx(0.92)


def test_preparation_chain():
    hum, voice = tone(50, 2, 0.3), tone(1000, 2, 0.1)
    y = chain.telephone_band(hum + voice + 0.4, RATE)
    power = np.abs(np.fft.rfft(y)) ** 2
    hz = np.fft.rfftfreq(len(y), 1 / RATE)
    assert power[np.abs(hz - 50) < 5].sum() < 0.01 * power[np.abs(hz - 1000) < 5].sum() and abs(y.mean()) < 1e-3
    assert chain.fade_in(np.ones(RATE), RATE)[[0, 120, 300]].tolist() == pytest.approx([0, 0.5, 1], abs=0.01)
    assert chain.loudness(chain.to_level(voice, RATE), RATE) == pytest.approx(-23, abs=0.01)
    assert np.abs(chain.to_level(np.r_[voice * 0.05, 1.0], RATE, -3)).max() <= 10 ** (-1 / 20) + 1e-9
    assert chain.to_level(np.zeros(50), RATE).tolist() == [0] * 50 and chain.to_level(np.zeros(0), RATE).size == 0
    loud = chain.compressed(tone(1000, 2, 0.8), RATE, -26, 2.5, 7, 220)
    level = 20 * np.log10(np.abs(loud[RATE:]).max())
    assert level == pytest.approx(-26 + (20 * np.log10(0.8) + 26) / 2.5, abs=0.5)
    assert np.array_equal(chain.compressed(tone(1000, 1, 0.01), RATE, -26, 2.5, 7, 220), tone(1000, 1, 0.01))
    out = chain.prepared(SPEECH * 1.9, RATE)
    assert len(out) == len(SPEECH) and np.abs(out).max() <= 1 and chain.measured(out, RATE)["clipped"] == 0


@pytest.mark.parametrize("rate", [8000, 16000, 48000])
def test_loudness_of_known_tones(rate):
    """A full-scale tone of 997 Hz is at -3.01; each halving of its amplitude is 6.02 less; silence and what is 10 dB under the rest don't count."""
    t = np.arange(20 * rate) / rate
    x = np.sin(2 * np.pi * 997 * t)
    assert chain.loudness(x, rate) == pytest.approx(-3.01, abs=0.1)
    assert chain.loudness(x / 8, rate) == pytest.approx(-3.01 - 18.06, abs=0.1)
    assert chain.loudness(np.r_[x[: 10 * rate], np.zeros(10 * rate)], rate) == pytest.approx(-3.01, abs=0.1)
    assert chain.loudness(np.r_[x[: 10 * rate], x[: 10 * rate] / 10], rate) == pytest.approx(-3.01, abs=0.1)
    assert chain.loudness(np.zeros(rate), rate) is None and chain.loudness(x[:100], rate) is not None
    if rate == 48000:
        low = np.sin(2 * np.pi * 25 * t)
        assert chain.loudness(low, rate) < -12 and chain.loudness(np.sin(2 * np.pi * 6000 * t), rate) > -0.2
    whole, chain_block = chain.weighted(x, rate), chain.WEIGHTED
    try:
        chain.WEIGHTED = 5000
        assert np.allclose(chain.weighted(x, rate), whole, atol=1e-9)
    finally:
        chain.WEIGHTED = chain_block


def test_correlation_by_blocks_equals_the_definition():
    x, h = rng.normal(size=3000) * np.linspace(0.1, 5, 3000) + 40, rng.normal(size=33)
    want = [np.corrcoef(x[k : k + 33], h)[0, 1] for k in range(len(x) - 32)]
    for block in (1, 66, 100, 2968, 10_000):
        assert np.allclose(kernels.zncc(x, h, block), want, atol=1e-8)


def test_batch_metrics_and_failures(spark):
    x = np.concatenate([tone(430, 0.5), SPEECH])
    rows = {r.id: r for r in chain.batch_metrics(files(spark, x, [], [np.nan, 1.0], None, np.concatenate([noise(2), voices(), noise(2)])), "id", "x", RATE, tone(900, 0.1)).collect()}
    m = rows[0]
    assert set(chain.COLUMNS) == set(m.asDict()) - {"id"} and m.dial_s == pytest.approx(0.5, abs=0.11) and m.duration_s == pytest.approx(len(x) / RATE)
    assert 0.2 < m.speech < 0.6 and m.segments == 2 and m.snr_db > 20
    assert all(rows[k][c] is None for k in (1, 2, 3) for c in chain.COLUMNS)
    assert 0.4 < rows[4].speech < 0.8 and rows[4].duration_s == pytest.approx(10) and rows[4].overlap_s >= 0


def test_variants_and_pitch(spark):
    x = np.concatenate([noise(0.5), tone(200, 0.5) + noise(0.5), noise(0.5)])
    f0 = spectral.pitch(tone(200, 0.3), RATE, 400, 80, 70, 400)
    assert np.nanmedian(f0) == pytest.approx(200, rel=0.02) and np.isnan(spectral.pitch(np.zeros(800), RATE, 400, 80, 70, 400)).all()
    v = V.variants(x, RATE, 400, 80)
    t = np.arange(len(v["rms"])) * 80 / RATE
    tones, quiet = (t > 0.6) & (t < 0.9), t < 0.4
    assert v["rms"][tones].min() > 10 * v["rms"][quiet].max()
    assert (~np.isnan(v["f0"]))[tones].mean() > 0.9 and v["bands"][tones].mean() > 0.9 and v["bands"][quiet].mean() < 0.2
    p = spectral.pcen(np.full((50, 3), 4.0), RATE, 80)
    assert np.allclose(p, p[0])


@pytest.mark.parametrize("level", [0.02, 0.05, 0.2])
def test_band_models_hear_tones_in_noise(level):
    """Tones well under the noise's whole energy, in a noise that grows slowly, and nothing in noise alone."""
    n = np.random.default_rng(5).normal(size=4 * RATE) * level * np.linspace(1, 1.5, 4 * RATE)
    x = n + np.concatenate([np.zeros(RATE), level * 2 * (tone(300, 1, 1) + tone(700, 1, 1) + tone(1500, 1, 1) + tone(2500, 1, 1)), np.zeros(2 * RATE)])
    mask = V.modelled(V.band_levels(x, RATE, 400, 80))
    t = np.arange(len(mask)) / 100
    assert mask[(t > 1.1) & (t < 1.9)].mean() > 0.9 and mask[(t < 0.9) | (t > 2.2)].mean() < 0.25
    assert len(V.modelled(np.zeros((0, 6)))) == 0 and not V.modelled(np.zeros((50, 6))).any()


def test_mel_and_richest_window():
    m = spectral.mel(tone(1000, 1), RATE, 512, 128, 20)
    centres = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + 4000 / 700), 22)[1:-1] / 2595) - 1)
    assert abs(centres[m.mean(axis=0).argmax()] - 1000) < 150
    assert spectral.mfcc(tone(1000, 1), RATE, 512, 128).shape == (63, 13)
    x = np.concatenate([tone(300, 2), sum(tone(170 * k, 2, 0.2) for k in range(1, 20)), tone(300, 2)])
    a, b = spectral.richest_window(x, RATE, 1.0, 0.5, 512)
    assert 1.9 <= a and b <= 4.1 and spectral.richest_window(np.zeros(10), RATE, 1, 1, 512) == (0, 1)


def test_split_stereo_and_join():
    x = np.arange(1.0, 17)
    on, off = V.split(x, 8, [(0.25, 0.75), (0.5, 1.0), (5, 9)])
    assert on.tolist() == list(range(3, 9)) and off.tolist() == [1, 2, *range(9, 17)]
    left, right = V.stereo(x, 8, [(0, 0.5, "b"), (0.5, 1, "a"), (1.5, 2, "b")])
    assert left.tolist() == [0] * 4 + [5, 6, 7, 8] + [0] * 8 and right.tolist() == [1, 2, 3, 4] + [0] * 8 + [13, 14, 15, 16]
    assert V.joined_calls([x[:2], x[2:3]], 8, 0.25).tolist() == [1, 2, 0, 0, 3] and V.stereo(x, 8, [])[0].tolist() == [0] * 16


def test_speakers_and_rules(spark):
    x = np.concatenate([tone(200, 1) + tone(400, 1, 0.3), tone(1200, 1) + tone(2500, 1, 0.3), tone(200, 1) + tone(400, 1, 0.3)]) + noise(3)
    found = FR.table(files(spark, x), "id", "x", lambda x: V.cepstral(x, RATE, 512, 128), ["component", "loudness"])
    long = [r for r in FR.turns(found, "component", "id", 128 / RATE).orderBy("turn").collect() if r.end - r.start > 0.3]
    assert len(long) == 3 and long[0].component == long[2].component != long[1].component and abs(long[0].end - 1) < 0.1 and abs(long[2].start - 2) < 0.1
    labels, loudness = [0, 0, 1, 1, 0, 1, 0, 0], [1, 1, 0.1, 1, 1, 1, 9.0, 1]
    rows = spark.createDataFrame([(1, k, a, float(b)) for k, (a, b) in enumerate(zip(labels, loudness, strict=True))], "id int, frame int, label int, loudness double")
    odd = (F.col("loudness") < 0.3) | (F.col("label") != F.col("__after")) & (F.col("loudness") > 5)
    assert [r.s for r in FR.steady_labels(rows, "label", odd, keys=["id"], order=["frame"], name="s").orderBy("frame").collect()] == [0, 0, 0, 1, 0, 1, 0, 0]
    alone = (F.col("label") != F.col("__after")) & (F.col("frame") == 5)
    assert [r.s for r in FR.steady_labels(rows, "label", alone, keys=["id"], order=["frame"], name="s").orderBy("frame").collect()] == [0, 0, 1, 1, 0, 0, 0, 0]
    assert V.mixture(np.array([[0.0], [0.1], [9.0], [9.1]])).tolist() in ([0, 0, 1, 1], [1, 1, 0, 0])
