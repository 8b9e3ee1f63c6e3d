"""Classifiers on texts that can be told apart, judged on the rows held out."""

import math
import random
import re
from collections import Counter

import pytest

from voxlake.ml import topics

WORDS = {"price": "cost euro month pay offer cheap tariff".split(), "farewell": "bye thanks day nice goodbye later call".split(), "legal": "terms law consent data record accept notice".split()}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    out = []
    for i in range(300):
        label = rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[label]) if rng.random() < 0.7 else rng.choice(["the", "a", "of", "and"]) for _ in range(15)), label))
    return spark.createDataFrame(out, "id long, text string, label string").persist()


@pytest.mark.parametrize("how", [{}, {"kind": "logistic", "balanced": True}, {"kind": "forest", "embedding": 8}, {"kind": "logistic", "embedding": 8, "more": True}])
def test_held_out_rows_are_told_apart(rows, how):
    how, data = dict(how), rows
    if how.pop("more", None):
        far = topics.label_distances("text", list(WORDS))
        data, how["more"] = rows.withColumns(far), tuple(far)
    said = topics.predict(topics.fit(data.where(~topics.held_out("id")), **how), data.where(topics.held_out("id"))).collect()
    assert 30 < len(said) < 100 and sum(r.predicted == r.label for r in said) >= 0.9 * len(said)
    assert all(0.3 < r.confidence <= 1 and abs(sum(r.probabilities) - 1) < 1e-6 for r in said)


def test_macro_f1(spark):
    said = [("a", "a")] * 5 + [("a", "b")] * 3 + [("b", "b")] * 2 + [("c", "a")]
    f1 = [2 * 5 / (8 + 6), 2 * 2 / (2 + 5), 0.0]
    assert topics.macro_f1(spark.createDataFrame(said, "label string, predicted string")).first().macro_f1 == pytest.approx(sum(f1) / 3)


def test_search_judges_every_setting_on_held_out_rows(rows):
    found = topics.search(rows, key="id", reg=(0.01, 100.0), elastic=(0.0,))
    assert [x[:2] for x in found] == [(0.01, 0.0), (100.0, 0.0)] and found[0][2] > 0.9 > found[1][2] or found[0][2] >= found[1][2] > 0


def test_label_distances(spark):
    r = spark.createDataFrame([("Price",), ("abc",), (None,)], "text string").select(*(c.alias(k) for k, c in topics.label_distances("text", ["price", "xyz"]).items())).collect()
    assert (r[0]["__d0"], r[1]["__d1"], r[2]["__d0"]) == (0.0, 1.0, 1.0)


def test_conversations_are_decoded_for_all_calls(spark, sf):
    from voxlake.plans import catalog, learning
    from voxlake.plans.registry import Source

    windows = learning.timed_windows(Source(spark, sf)).collect()
    got = catalog.queries()["M03_conversation_classifier"](spark, sf).collect()
    assert sorted((r.call_id, r.place) for r in got) == sorted((r.call_id, r.place) for r in windows) and {r.label for r in got} <= {"agent", "client"}
    assert all(("[bin=early]" in r.text) == (r.bin == "early") and 0 <= r.place_bin <= 6 for r in windows)
    places: dict = {}
    for r in windows:
        places.setdefault(r.call_id, []).append((r.place, r.place_bin))
    assert all([b for _, b in sorted(p)] == sorted(b for _, b in p) for p in places.values())


def test_nearest_phrases(spark):
    turns = spark.createDataFrame([(1, "cheap offer month"), (2, "bye thanks")], "id long, text string")
    phrases = spark.createDataFrame([("price", k, t) for k, t in enumerate(("cheap offer", "offer each month", "cheap month"))] + [("farewell", 10 + k, t) for k, t in enumerate(("thanks bye", "bye now", "thanks all"))], "topic string, phrase_id long, text string")
    got = {r.id: r for r in topics.nearest_phrases(turns, phrases, key="id").collect()}
    assert (got[1].topic, got[2].topic) == ("price", "farewell") and got[2].confidence > 0


def slow_nearest(rows, phrases, k=3):
    """All rows against all phrases."""
    def grams(t):
        w = [x for x in re.split(r"[^\w]+", (t or "").lower()) if x]
        return Counter(w + [" ".join(p) for p in zip(w, w[1:], strict=False)])

    bags = {("r", i): grams(t) for i, t in rows} | {("p", i): grams(t) for _, i, t in phrases}
    df = Counter(t for b in bags.values() for t in b)
    def unit(b):
        x = {t: n * math.log((len(bags) + 1) / (df[t] + 1)) for t, n in b.items() if df[t] > 1}
        length = math.sqrt(sum(v * v for v in x.values()))
        return {t: v / length for t, v in x.items()} if length else {}

    v = {i: unit(b) for i, b in bags.items()}
    out = {}
    for i, _ in rows:
        far = sorted((round(math.sqrt(max(0.0, 2 - 2 * sum(w * v["p", j].get(t, 0.0) for t, w in v["r", i].items()))), 9), j, topic) for topic, j, _ in phrases)[:k]
        out[i] = (far[0][2], pytest.approx(1 / (sum(d for d, _, _ in far) / len(far) + 1e-5)))
    return out


def test_nearest_phrases_equal_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(60)]
    text = lambda: " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 12)))
    rows = [(k, rng.choice([text(), None, "nowhere"]) if k % 9 == 0 else text()) for k in range(150)] + [(500 + k, "w0 w1") for k in range(80)]
    for count in (1, 2, 50):
        phrases = [(f"t{k % 4}", 7 * k, text()) for k in range(count)]
        got = topics.nearest_phrases(spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(phrases, "topic string, phrase_id long, text string"), key="id").collect()
        assert {r.id: (r.topic, r.confidence) for r in got} == slow_nearest(rows, phrases)


def test_nearest_phrases_in_packs_that_share_frequent_terms(spark, monkeypatch):
    """Packs meet packs, a few postings at a time, and give k phrases for each text however many share its terms."""
    import numpy as np

    for name, value in (("PACK", 40), ("SCRIPTS", 16), ("MET", 50)):
        monkeypatch.setattr(topics, name, value)
    rng = random.Random(8)
    text = lambda: " ".join(["the", *rng.choices([f"w{k}" for k in range(30)], k=rng.randint(0, 9))])
    rows, phrases = [(k, text()) for k in range(120)] + [(900, None)], [(f"t{k % 4}", 5 * k, text()) for k in range(50)] + [("none", 999, None)]
    df, script = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame(phrases, "topic string, phrase_id long, text string")
    assert {r.id: (r.topic, r.confidence) for r in topics.nearest_phrases(df, script, key="id").collect()} == slow_nearest(rows, phrases)
    index = topics.inverted(np.arange(3000), np.zeros(3000, np.int64), np.linspace(1, 0.5, 3000))
    near, far = topics.nearest_in(2, np.array([1]), np.array([0]), np.array([1.0]), index, 3000, 3)
    assert near.tolist() == [[0, 1, 2], [0, 1, 2]] and far[0].tolist() == [1.414213562] * 3 and far[1, 0] == 0 < far[1, 1] < far[1, 2]


def test_smoothed_mixture_changes_single_minutes_only(spark, sf):
    from voxlake.plans import catalog

    rows = catalog.queries()["M11_mixture"](spark, sf).orderBy("file_id", "minute").collect()
    assert {r.component for r in rows} <= {0, 1}
    before: dict = {}
    for r in rows:
        assert r.smooth in (r.component, before.get(r.file_id, r.component))
        before[r.file_id] = r.component


def test_word_vectors_are_bounded_however_many_words_there_are(spark, monkeypatch):
    from pyspark.ml.feature import Word2VecModel

    from voxlake.ml import topics

    monkeypatch.setattr(topics, "VECTORS", 16)
    rows = spark.range(200).selectExpr("concat('w', id, ' w', id, ' v', id % 50) as text", "if(id % 2 = 0, 'a', 'b') as label")
    model = topics.fit(rows, kind="logistic", embedding=4)
    vectors = next(m for m in model.stages if isinstance(m, Word2VecModel))
    assert vectors.getVectors().count() <= 16 and topics.predict(model, rows).count() == 200


def test_word_vectors_are_learned_by_tasks_of_bounded_size(spark, rows, monkeypatch):
    from pyspark.ml.feature import Word2VecModel

    monkeypatch.setattr(topics, "LEARNED", 50)
    known = rows.where(~topics.held_out("id"))
    model = topics.fit(known, kind="logistic", embedding=8)
    vectors = next(m for m in model.stages if isinstance(m, Word2VecModel))
    assert vectors.getNumPartitions() == math.ceil(known.count() / 50) > 1
    words = {w for r in known.collect() for w in r.text.split()}
    assert vectors.getVectors().count() == len({r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr(f"pmod(xxhash64(w), {topics.VECTORS}) as h").collect()})
    assert all(math.isfinite(x) for r in vectors.getVectors().collect() for x in r.vector)
    said = topics.predict(model, rows.where(topics.held_out("id"))).collect()
    assert sum(r.predicted == r.label for r in said) >= 0.9 * len(said)


def test_M08_has_every_window_once_and_deals_the_turns_of_a_single_file(spark, sf, tmp_path, monkeypatch):
    from voxlake.plans import catalog, learning

    form = "conv_id long, turn long, role string, text string"
    turns = [(c, t, ("user", "assistant", None)[t % 3], " ".join(f"w{(c * 7 + t * k) % 50}" for k in range(c + t))) for c in range(40) for t in range(4)]
    spark.createDataFrame([*turns, (99, 0, "user", None)], form).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    kept = []
    monkeypatch.setattr(learning, "judged", lambda rows, key, *, f=learning.judged, **how: f(kept.append(rows) or rows, key, **how))
    got = catalog.queries()["M08_forest"](spark, str(tmp_path)).collect()
    want = [f"{c}/{t}/{at}" for c, t, _, text in turns if (n := len(text.split())) for at in range(0, max(n - 15, 0) + 1, 7)]
    assert sorted(r.id for r in got) == sorted(want)
    texts = {f"{c}/{t}": text.split() for c, t, _, text in turns}
    assert all(r.text.split() == texts[r.id.rpartition("/")[0]][int(r.id.rpartition("/")[2]) :][:15] for r in kept[0].collect())
    assert kept[0].inputFiles()[0].rpartition("/")[0].rpartition("/")[2].startswith("voxlake-")
