"""Whole queries without SQL against slow computations of their rows, on the given tables or a few made ones."""

import difflib
import json
import random

import numpy as np
import pytest

from voxlake.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.queries()


def rows_of(spark, name, folder=SF):
    return QUERIES[name](spark, folder).collect()


@pytest.fixture(scope="module")
def waves(spark):
    return {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.p_partkey: (r.p_name.lower(), f"{r.p_type} part".lower()) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}


def test_F13(spark, texts):
    got = {r.p_partkey: r.ratio for r in rows_of(spark, "F13_similarity")}
    assert got == {k: pytest.approx(difflib.SequenceMatcher(None, a, b).ratio(), abs=1e-7) for k, (a, b) in texts.items()}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def slow_fuzzy(a, b):
    short, long = sorted((a, b), key=len)
    part = max(indel(short, long[max(0, s) : s + len(short)]) for s in range(1 - len(short), len(long)))
    x, y = set(a.split()), set(b.split())
    both, p, q = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if both and (not p or not q):
        words = 1.0
    else:
        one, two = (" ".join(filter(None, (both, z))) for z in (p, q))
        words = max([indel(one, two)] + ([indel(both, one), indel(both, two)] if both else []))
    return max(words, 0.85 * part)


def test_F14(spark, texts):
    got = {r.p_partkey: r.score for r in rows_of(spark, "F14_fuzzy")}
    some = random.Random(1).sample(sorted(texts), 60)
    assert {k: got[k] for k in some} == {k: pytest.approx(slow_fuzzy(*texts[k]), abs=1e-7) for k in some}


def test_F05(spark, tmp_path):
    rows = [(1, "Las CASAS, la casa; corriendo y corría 12", "es"), (2, None, "es"), (3, "", "es"), (4, "nación naciones", "es")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: sorted((r.stems or "").split()) for r in rows_of(spark, "F05_keywords", str(tmp_path))}
    assert {"cas", "corr"} <= set(got[1]) and "la" not in got[1] and got[2] == got[3] == [] and len(got[4]) == 1


def test_N07(spark):
    def walk(node):
        if isinstance(node, dict):
            if isinstance(node.get("text"), str):
                assert node["highlight_error"] == ("worthless" in node["text"])
                yield node["text"]
            else:
                assert "highlight_error" not in node
        for x in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
            yield from walk(x)

    got = {r.call_id: list(walk(json.loads(r.json))) for r in rows_of(spark, "N07_mark_any_depth")}
    want: dict = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append(r.text)
    assert {k: [t for t in v if t in set(want[k])] for k, v in got.items()} == want


def test_V02(spark, waves):
    """The correlation by its definition, the threshold, then peaks one by one."""
    h = np.sin(np.arange(8) * 0.8)
    for r in rows_of(spark, "V02_signatures"):
        x = waves[r.vec_id]
        score = np.array([0.0 if x[k : k + 8].std() < 1e-3 else np.corrcoef(x[k : k + 8], h)[0, 1] for k in range(len(x) - 7)])
        middle = np.median(score)
        least = max(0.7, middle + 6 * (np.median(np.abs(score - middle)) + 1e-8), np.quantile(score, 0.995) + 0.02)
        peaks = []
        for k in np.argsort(-score, kind="stable"):
            if score[k] >= least and all(abs(k - p) >= 8 for p in peaks):
                peaks.append(int(k))
        kept = []
        for p in sorted(peaks):
            if not kept or p / 640 - kept[-1] >= 0.02:
                kept.append(p / 640)
        assert (r.hits, r.last_s) == (len(kept), pytest.approx(kept[-1], abs=1e-6) if kept else None)


def test_V07(spark, waves):
    got = {r.vec_id: r for r in rows_of(spark, "V07_activity_variants")}
    assert set(got) == set(waves)
    for k, x in waves.items():
        padded = np.pad(x, 16)
        db = np.array([20 * np.log10(np.sqrt(np.mean(padded[8 * t : 8 * t + 32] ** 2)) + 1e-10) for t in range((len(padded) - 32) // 8 + 1)])
        assert got[k].energy == (db >= np.percentile(db, 60) + 2).sum()
        assert 0 <= got[k].most <= len(db) and 1 <= got[k].pcen <= 0.2 * len(db) + 1 and max(got[k].pitch, got[k].bands) <= len(db)


def test_V10_V12(spark, waves):
    """Turns cover a file's nine frames without gaps, speakers take turns, and the tracks hold what the turns and segments say."""
    turns: dict = {}
    for r in sorted(rows_of(spark, "V12_diarised"), key=lambda r: (r.vec_id, r.turn)):
        turns.setdefault(r.vec_id, []).append(r)
    assert set(turns) == set(waves)
    for own in turns.values():
        assert own[0].start_s == 0 and own[0].speaker == 0 and own[-1].end_s == pytest.approx(9 * 8 / 640, abs=1e-6)
        assert all(a.end_s == b.start_s and a.speaker != b.speaker for a, b in zip(own, own[1:], strict=False))
    speech: dict = {}
    for r in rows_of(spark, "V04_voice_activity"):
        if r.start_s is not None:
            speech.setdefault(r.vec_id, []).append((r.start_s, r.end_s))
    for r in rows_of(spark, "V10_tracks"):
        x, inside = waves[r.vec_id], np.zeros(64, bool)
        for a, b in speech.get(r.vec_id, []):
            inside[round(a * 640) : round(b * 640)] = True
        assert (r.active, r.other, r.joined) == (inside.sum(), 64 - inside.sum(), 64 + 6)
        tracks = [np.zeros(64, bool), np.zeros(64, bool)]
        for t in turns[r.vec_id]:
            tracks[t.speaker][round(t.start_s * 640) : round(t.end_s * 640)] = True
        second = tracks[1] if len({t.speaker for t in turns[r.vec_id]}) > 1 else tracks[0]
        assert (r.left, r.right) == ((x[tracks[0]] != 0).sum(), (x[second] != 0).sum())


def test_V03_V08b(spark, waves):
    got = {r.vec_id: r for r in rows_of(spark, "V03_prepared")}
    for r in got.values():
        assert r.peak_db <= 0 and r.crest_db == pytest.approx(r.peak_db - r.rms_db, abs=1e-5) and r.clipped == 0 and r.snr_db >= 0
    for r in rows_of(spark, "V08b_mel_and_richest"):
        x = waves[r.vec_id]
        best = []
        for start in range(0, 64 - 32 + 1, 8):
            padded = np.pad(x[start : start + 32], 8)
            m = np.abs(np.array([np.fft.rfft(padded[4 * t : 4 * t + 16] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16))) for t in range(9)]))
            db = 20 * np.log10(np.maximum(m, m.max() * 1e-5) / m.max())
            best.append((-sum(db[t, k] >= -40 and db[t, k] > db[t, k - 1] and db[t, k] > db[t, k + 1] for t in range(9) for k in range(1, 8)), start))
        assert (r.start_s, r.end_s) == (pytest.approx(min(best)[1] / 640, abs=1e-6), pytest.approx((min(best)[1] + 32) / 640, abs=1e-6))


@pytest.mark.parametrize("name", ["M01_text_classifier", "M04_weighted_classifier", "M08_forest", "M09_embedding_classifier"])
def test_classifiers(spark, name):
    rows = rows_of(spark, name)
    labels = {r.label for r in rows}
    share = sum(r.held_out for r in rows) / len(rows)
    right = lambda own: sum(r.label == r.predicted for r in own) / len(own)
    most = max(sum(r.label == y for r in rows) for y in labels) / len(rows)
    assert {r.predicted for r in rows} <= labels and 0.05 < share < 0.45
    assert right([r for r in rows if not r.held_out]) >= most - 0.1


def test_M12(spark):
    rows = rows_of(spark, "M12_search")
    assert [r.best for r in rows].count(True) == 1 and len({(r.reg, r.elastic) for r in rows}) == 6
    assert next(r.macro_f1 for r in rows if r.best) == max(r.macro_f1 for r in rows) and all(0 <= r.macro_f1 <= 1 for r in rows)
