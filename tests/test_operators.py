"""Golden cases, worked out by hand, and properties."""

import difflib
import functools
import json
import math
import random
import re
import time
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxlake.functions import fuzzy, matching, snowball
from voxlake.functions import numeric as Nu
from voxlake.functions import text as T
from voxlake.operators import calibrate, merge, ordered, sequential
from voxlake.plans import scalars
from voxlake.scoring import calls as X
from voxlake.signal import kernels
from voxlake.sources import transcripts


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_asof_matches_equal_starts_and_leaves_gaps(spark):
    words = spark.createDataFrame([(1, 0.0), (1, 1.5), (1, 2.0), (1, 6.0), (2, 1.0)], "k int, t double")
    spans = spark.createDataFrame([(1, 0.0, "a"), (1, 2.0, "b")], "k int, s double, name string")
    got = ordered.asof_join(words, spans, keys=["k"], left_time="t", right_time="s", take=["name"]).collect()
    assert sorted((r.k, r.t, r.name) for r in got if r.name) == [(1, 0.0, "a"), (1, 1.5, "a"), (1, 2.0, "b"), (1, 6.0, "b")]
    assert [r.name for r in got if r.k == 2] == [None]


def test_overlap_is_strict_and_keeps_each_pair_once(spark):
    a = spark.createDataFrame([(1, 2.0, 4.0)], "k int, a0 double, a1 double")
    b = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, 3.0), (1, 4.0, 6.0)], "k int, b0 double, b1 double")
    got = ordered.overlap_join(a, b, keys=["k"], left_span=("a0", "a1"), right_span=("b0", "b1"), width=0.5).collect()
    assert [(r.b0, r.b1) for r in got] == [(1.0, 3.0)]


def test_runs_number_what_is_inside(spark):
    df = spark.createDataFrame([(1, i, float(c)) for i, c in enumerate([0, 0.2, 0.3, 0, 0.1])], "k int, i int, c double")
    got = ordered.run_ids(df, F.col("c") > 0, keys=["k"], order=["i"]).orderBy("i").collect()
    assert [r.run_id for r in got] == [0, 1, 1, 0, 2]


def test_collapse_means_each_run(spark):
    df = spark.createDataFrame([(1, 0, "A", 0.4), (1, 1, "A", 0.6), (1, 2, "B", 0.9), (1, 3, "A", 0.2)], "k int, i int, v string, c double")
    got = ordered.collapse_runs(df, keys=["k"], order=["i"], value="v", mean="c").orderBy("run").collect()
    assert [(r.v, round(r.mean, 6)) for r in got] == [("A", 0.5), ("B", 0.9), ("A", 0.2)]


def test_sessions_tolerate_small_drops(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 5.0, 4.8, 4.0, 9.0])], "k int, i int, t double")
    got = ordered.sessions_by_reset(df, "t", keys=["k"], order=["i"], drop=0.5).orderBy("i").collect()
    assert [r.session_id for r in got] == [0, 0, 0, 1, 1]


def test_fill_reaches_so_far(spark):
    df = spark.createDataFrame([(1, 0, 90.0, 2.26), (1, 1, None, None), (1, 2, None, None), (1, 3, None, None)], "k int, i int, v double, d double")
    got = ordered.bounded_fill(df, "v", "d", keys=["k"], order=["i"], name="f").orderBy("i").collect()
    assert [r.f for r in got] == [90.0, 90.0, 90.0, 0.0]


def test_merge_by_gap(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 1.1, 2.0), (1, 3.0, 4.0)], "k int, s double, e double")
    got = sorted((r.s, r.e) for r in ordered.merge_by_gap(df, "s", "e", keys=["k"], gap=0.12).collect())
    assert got == [(0.0, 2.0), (3.0, 4.0)]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 15)), min_size=1, max_size=12))
def test_merged_spans_cover_what_they_merge(spark, spans):
    df = spark.createDataFrame([(1, float(a), float(a + n)) for a, n in spans], "k int, s double, e double")
    got = sorted((r.s, r.e) for r in ordered.merge_by_gap(df, "s", "e", keys=["k"], gap=0.0).collect())
    inside = lambda x, rs: any(a <= x < b for a, b in rs)
    assert all(inside(x, got) == inside(x, [(a, a + n) for a, n in spans]) for x in range(80))
    assert all(b[0] > a[1] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n,size,tail,want", [(20, 14, False, [0, 6]), (26, 18, True, [0, 6, 8]), (5, 14, False, [0]), (0, 14, True, [])])
def test_word_windows(spark, n, size, tail, want):
    df = spark.createDataFrame([([str(k) for k in range(n)],)], "w array<string>")
    assert sorted(r.window_start for r in ordered.word_windows(df, "w", size=size, step=6, tail=tail).collect()) == want


def test_scalars(spark):
    assert one(spark, Nu.minute_tag(F.lit(119.6))) == "01:60"
    assert [one(spark, Nu.time_bin(F.lit(x).cast("double"))) for x in (0.15, 0.65, 0.66, None)] == ["early", "mid", "late", "unknown"]
    assert [one(spark, Nu.minutes_seconds(F.lit(float(x)))) for x in (75, 9, 125)] == pytest.approx([1.15, 0.09, 2.05])
    assert [one(spark, Nu.ratio(F.lit(x))) for x in ("74%", "74", "0.74", "")] == [0.74, 0.74, 0.74, None]
    assert [one(spark, Nu.speed_class(F.lit(x))) for x in (119.9, 120.0, 250.0)] == ["low", "mid", "high"]
    assert [one(spark, Nu.machines(F.lit(x))) for x in (599, 600, 1799, 1800)] == [1, 2, 3, 4]
    amount, currency = T.money(F.lit("$ 1.234,50"))
    assert (one(spark, amount), one(spark, currency)) == (1234.5, "$")
    amount, currency = T.money(F.lit("2,5 millones"))
    assert (one(spark, amount), one(spark, currency)) == (2500000.0, None)
    assert one(spark, T.normalize(F.lit("¡Él, 2 Años!"))) == "el  anos"


def call(**more):
    base = dict(mac_count=1, mac_likelihood=0.9, price_likelihood=0.5, reinforced=False, participation=0.6, wpm=140.0, turns=10, questions=0, confidence=0.8, silence=0.5, overlap=0.0)
    return base | more


def test_scores_by_hand(spark):
    df = spark.createDataFrame([call()])
    r = df.select(X.mac_flow().alias("f"), X.sale_score().alias("d1"), X.engagement_score().alias("d4"), X.audio_score().alias("d5")).first()
    assert tuple(r.f) == ("VENTA_CONFIRMADA", False, False)
    assert (r.d1, r.d4, r.d5) == pytest.approx((8.7, 8.0, 7.5))
    flags = {f"f{k}": False for k in range(14)} | {f"f{k}": True for k in (1, 5, 8)}
    assert spark.createDataFrame([flags]).select(X.compliance_score().alias("x")).first().x == pytest.approx(5.5)
    d = spark.createDataFrame([dict(d1=8.7, d2=5.5, d3=0.0, d4=8.0, d5=7.5)])
    assert d.select(X.final_score().alias("x")).first().x == pytest.approx(6.305)


def test_script_order_counts_pairs(spark):
    rows = [(1, "SALUDO", 0, 1.0), (1, "MAC", 6, 3.0), (1, "PRECIO", 8, 2.0)]
    r = X.script_score(spark.createDataFrame(rows, "call_id int, label string, ordinal int, start_s double")).first()
    assert r.tau == pytest.approx(2 / 3)


def test_upserts(spark):
    t = spark.createDataFrame([(1, 10, 1), (2, 20, 1)], "id int, v int, processed int")
    c = spark.createDataFrame([(2, 21), (3, 30)], "id int, v int")
    assert sorted(map(tuple, merge.upsert_with_reset(t, c, key="id", watched="v", flag="processed").collect())) == [(1, 10, 1), (2, 21, 0), (3, 30, 0)]
    assert sorted((r.id, r.v) for r in merge.upsert(t.drop("processed"), c, keys=["id"]).collect()) == [(1, 10), (2, 21), (3, 30)]


def slow_thresholds(rows, share):
    """The rule, with every candidate counted over all rows."""
    count = lambda p, m: sum(e == 1 or a < p or b < m for e, a, b in rows)
    want, empties = math.ceil(len(rows) * share), sum(e == 1 for e, _, _ in rows)
    values = sorted({min(a, b) for e, a, b in rows if e != 1})
    if empties >= want or not values:
        return 0.0, math.nextafter(0, 1), None, want
    up = lambda v: math.nextafter(v, 1)
    pairs = [pair for v in values for pair in ((v, v), (up(v), v), (v, up(v)), (up(v), up(v)))]
    exact = [x for x in pairs if count(*x) == want]
    if apart := [x for x in exact if x[0] != x[1]]:
        return *apart[0], None, want
    if exact:
        v = exact[-1][0]
        return (v, up(v), v, want) if v < 1 else (math.nextafter(v, 0), v, v, want)
    p, m = min(pairs, key=lambda x: abs(count(*x) - want))
    return p, (m if p != m else up(m) if m < 1 else math.nextafter(m, 0)), None, want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 0, 0, 1]), st.integers(0, 10), st.integers(0, 10)), min_size=1, max_size=30), st.sampled_from([0.0, 0.1, 0.4, 0.9]))
def test_thresholds_follow_the_rule(spark, rows, share):
    rows = [(e, a / 10, b / 10) for e, a, b in rows]
    df = spark.createDataFrame(rows, "e int, p double, m double")
    r = calibrate.thresholds(df, empty="e", price="p", mac="m", share=share).first()
    assert (r.price_th, r.mac_th, r.general_th, r.wanted) == slow_thresholds(rows, share)
    assert r.selected == sum(e == 1 or a < r.price_th or b < r.mac_th for e, a, b in rows)


def test_thresholds_without_likelihoods(spark):
    df = spark.createDataFrame([(0, None, None), (None, float("nan"), None), (0, 0.5, None)], "e int, p double, m double")
    r = calibrate.thresholds(df, empty="e", price="p", mac="m", share=0.3).first()
    assert (r.price_th, r.mac_th, r.general_th, r.selected) == (math.nextafter(0.5, 1), 0.5, None, 1)
    assert tuple(calibrate.thresholds(df.where("p is null"), empty="e", price="p", mac="m", share=0.5).first())[:4] == (0.0, math.nextafter(0, 1), None, 0)
    assert calibrate.thresholds(df.limit(0), empty="e", price="p", mac="m", share=0.5).first().wanted == 0


def test_merged_goes_on_after_a_restart(spark, tmp_path):
    from voxlake.streaming import events as E

    one = spark.createDataFrame([(1, 5, "a"), (2, 5, "b"), (1, 7, "c")], "k long, t long, v string")
    one.coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: sorted(map(tuple, E.merged(spark.readStream.schema(one.schema).parquet(str(tmp_path / "in")), ["k"], [F.desc("t"), F.desc("v")], path=str(tmp_path / "table")).collect()))
    assert run() == [(1, 7, "c"), (2, 5, "b")]
    spark.createDataFrame([(2, 4, "late"), (3, 1, "d"), (1, 9, "e")], one.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == [(1, 9, "e"), (2, 5, "b"), (3, 1, "d")]
    assert run() == [(1, 9, "e"), (2, 5, "b"), (3, 1, "d")]
    (tmp_path / "none").mkdir()
    assert E.merged(spark.readStream.schema(one.schema).parquet(str(tmp_path / "none")), ["k"], [F.desc("t")]).count() == 0



def test_sequential_operators(spark):
    plan = spark.createDataFrame([("a", 7), ("b", 5), ("c", 4), ("d", 3), ("e", 1)], "k string, n int")
    got = {r.k: r.bin for r in sequential.least_loaded(plan, key="k", size="n", bins=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 0, "e": 1}


def slow_pass(sizes, least, most):
    """Units of one pass, item after item."""
    units, totals, i = [], [], 0
    while i < len(sizes):
        options = []
        if sizes[i] < least:
            if totals and totals[-1] + sizes[i] <= most:
                options.append((totals[-1] + sizes[i], 0))
            if i + 1 < len(sizes) and sizes[i] + sizes[i + 1] <= most:
                options.append((sizes[i] + sizes[i + 1], 1))
        if options and min(options)[1] == 0:
            totals[-1] += sizes[i]
            units.append(len(totals) - 1)
        elif options:
            totals.append(sizes[i] + sizes[i + 1])
            units += [len(totals) - 1] * 2
            i += 1
        else:
            totals.append(sizes[i])
            units.append(len(totals) - 1)
        i += 1
    return units, totals


def test_compacted_equals_two_passes_item_by_item(spark):
    rng = np.random.default_rng(8)
    calls = {k: [int(x) for x in rng.choice([0, 1, 3, 5, 9, 12, 30, 45], rng.integers(0, 25))] for k in range(40)}
    df = spark.createDataFrame([(k, i, n, "x") for k, sizes in calls.items() for i, n in enumerate(sizes)], "call int, at int, n int, unit0 string")
    got: dict = {}
    for r in sequential.compacted(df, "n", keys="call", order="at", least=10, most=40).orderBy("call", "at").collect():
        got.setdefault(r.call, []).append((r.at, r.unit))
    for k, sizes in calls.items():
        kept = [(i, n) for i, n in enumerate(sizes) if 0 < n <= 40]
        one, totals = slow_pass([n for _, n in kept], 10, 40)
        two, _ = slow_pass(totals, 10, 40)
        assert got.get(k, []) == [(i, two[u]) for (i, _), u in zip(kept, one, strict=True)]
    assert sequential.compacted(df.limit(0), "n", keys="call", order="at", least=10, most=40).collect() == []


def slow_merge_short(rows, least, gap):
    """Group numbers of (start, end, speaker, words), one row after another."""
    n = len(rows)
    target = list(range(n))
    for i, (start, end, speaker, words) in enumerate(rows):
        if words < least:
            if i and rows[i - 1][2] == speaker and start - rows[i - 1][1] <= gap:
                target[i] = target[i - 1]
            elif i + 1 < n and rows[i + 1][2] == speaker and rows[i + 1][0] - end <= gap:
                target[i] = i + 1
    for i in range(n - 1, -1, -1):
        while target[target[i]] != target[i]:
            target[i] = target[target[i]]
    number = {t: k for k, t in enumerate(dict.fromkeys(target))}
    return [number[t] for t in target]


def test_short_rows_join_their_neighbours(spark):
    rng = np.random.default_rng(4)
    calls = {0: [(0.0, 1.0, 0, 50), (1.2, 2.0, 0, 3), (5.0, 6.0, 1, 2), (6.5, 9.0, 1, 40)]}
    for k in range(1, 40):
        t, rows = 0.0, []
        for _ in range(int(rng.integers(1, 15))):
            start = t + float(rng.choice([0.1, 0.5, 2.0]))
            t = start + float(rng.choice([0.5, 1.0]))
            rows.append((start, t, int(rng.integers(0, 2)), int(rng.integers(1, 10))))
        calls[k] = rows
    df = spark.createDataFrame([(k, *r) for k, rows in calls.items() for r in rows], "k int, s double, e double, who int, n int")
    got: dict = {}
    for r in sequential.merged_short(df, keys="k", start="s", end="e", speaker="who", words="n", least=5, gap=1.0).orderBy("k", "s").collect():
        got.setdefault(r.k, []).append(r.unit)
    assert got == {k: slow_merge_short(rows, 5, 1.0) for k, rows in calls.items()}


@settings(max_examples=20, deadline=None)
@given(st.integers(2, 5), st.integers(1, 6), st.integers(0, 1000))
def test_viterbi_is_the_best_path(labels, length, seed):
    rng = np.random.default_rng(seed)
    e, move, start = rng.normal(size=(length, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    worth = lambda p: start[p[0]] + e[0, p[0]] + sum(move[p[t - 1], p[t]] + e[t, p[t]] for t in range(1, length))
    assert sequential.best_within(e, move, start) == list(max(product(range(labels), repeat=length), key=worth))
    best = max(worth(p) for p in product(range(labels), repeat=length))
    assert sequential.times((start + e[0])[None, :], sequential.through(e[1:], move))[0].max() == pytest.approx(best) if length > 1 else True


@pytest.mark.parametrize("chunk", [1, 3, 7, 1000])
def test_viterbi_by_chunks_equals_the_whole(spark, chunk):
    rng = np.random.default_rng(9)
    move, start = rng.normal(size=(3, 3)), rng.normal(size=3)
    calls = {k: rng.normal(size=(n, 3)) for k, n in enumerate([1, 2, 3, 4, 20, 33])}
    rows = [(k, 100 - t, [float(x) for x in v]) for k, e in calls.items() for t, v in enumerate(e[::-1])]
    df = spark.createDataFrame(rows, "k int, t long, e array<double>").repartition(4)
    got: dict = {}
    for r in sequential.viterbi(df, keys="k", order="t", column="e", labels=["a", "b", "c"], transition=move, start=start, chunk=chunk).orderBy("k", "t").collect():
        got.setdefault(r.k, []).append("abc".index(r.label))
    assert got == {k: sequential.best_within(e, move, start) for k, e in calls.items()}


def test_groups_that_can_not_be_decoded_are_kept_apart(spark):
    good = [(1, 0, [0.0, -1.0]), (1, 1, [-1.0, 0.0])]
    bad = [(2, 0, None), (2, 1, [0.0, 0.0]), (3, 0, [0.0]), (4, 0, [float("nan"), 0.0]), (4, 1, [0.0, None]), (5, None, [0.0, 0.0])]
    df = spark.createDataFrame(good + bad, "k int, t int, e array<double>")
    rows, apart = sequential.decodable(df, keys="k", order="t", column="e", labels=2)
    assert {r.k for r in rows.collect()} == {1}
    assert {r.k: (r.rows, r.bad, r.reason) for r in apart.collect()} == {2: (2, 1, "no emissions"), 3: (1, 1, "labels missing"), 4: (2, 2, "an emission is no number"), 5: (1, 1, "no place")}
    done = sequential.viterbi(rows, keys="k", order="t", column="e", labels=["a", "b"], transition=np.zeros((2, 2)), start=np.zeros(2))
    assert {r.t: r.label for r in done.collect()} == {0: "a", 1: "b"}


def slow_json_block(text):
    if text is None:
        return None
    parses = lambda t: _parses(t)
    fence = re.search(r"```json\s*(\{.*?\})\s*```", text, re.S)
    if fence and parses(fence[1]):
        return fence[1]
    start, depth = text.find("{"), 0
    for k in range(start, len(text)) if start >= 0 else ():
        depth += (text[k] == "{") - (text[k] == "}")
        if text[k] == "}" and depth == 0 and parses(text[start : k + 1]):
            return text[start : k + 1]
    return text if parses(text) else None


def _parses(text):
    try:
        json.loads(text)
    except ValueError:
        return False
    return True


def test_json_blocks_equal_a_walk(spark):
    rng = random.Random(11)
    part = ['{"a": 1}', '{"b": {"c": [1, 2]}}', "{", "}", "text ", '{"s": "}{"}', "```json", "```", "\n", "[1]", '"q"', "{}", "é"]
    texts = ["".join(rng.choice(part) for _ in range(rng.randint(0, 7))) for _ in range(400)] + [None, "", "[1, 2]", "7", "no", "```json\n{\"x\": 1}\n``` {", "{" * 3000 + "}" * 3000 + '{"z": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.x for r in df.select("i", T.json_block("t").alias("x")).collect()}
    assert got == {i: slow_json_block(t) for i, t in enumerate(texts)}


def test_two_means_by_built_ins(spark):
    rng = np.random.default_rng(12)
    rows = [[float(x) for x in rng.choice([rng.normal(0, 1, n), rng.normal(5, 0.1, n), np.full(n, 2.0)])] for n in (1, 2, 3, 10, 64) for _ in range(6)] + [[], None, [1.0, 1.2, 9.0, 9.1]]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, v array<double>")
    got = {r.i: r.x for r in df.select("i", Nu.two_means("v").alias("x")).collect()}
    assert got == {i: None if v is None else kernels.two_means(np.array(v)).tolist() for i, v in enumerate(rows)}


@settings(max_examples=200, deadline=None)
@given(st.text("ab c", max_size=40), st.text("ab c", max_size=40))
def test_matching_blocks_equal_the_common_form(a, b):
    assert matching.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())


def test_long_texts_match_in_seconds():
    rng = random.Random(13)
    a, b = (" ".join(rng.choice(["the", "house", "of", "river", "thing"]) for _ in range(300)) for _ in range(2))
    assert matching.ratio(a, b) == pytest.approx(difflib.SequenceMatcher(None, a, b).ratio())
    long = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(100_000)) for _ in range(2)]
    began = time.process_time()
    assert 0 < matching.ratio(*long) < 1 and matching.ratio(long[0], long[0]) == 1
    assert time.process_time() - began < 30


def test_python_functions():
    assert scalars.mark_errors({"a": [{"text": "worthless"}, {"text": "x"}]}) == {"a": [{"text": "worthless", "highlight_error": True}, {"text": "x", "highlight_error": False}]}


def test_signals():
    rate = 8000
    t = np.arange(rate) / rate
    tone, noise = np.sin(2 * np.pi * 430 * t), np.random.default_rng(0).normal(0, 0.05, rate)
    assert kernels.dial_seconds(np.concatenate([tone, noise]), rate) == pytest.approx(1.0, abs=0.1)
    template = np.sin(2 * np.pi * np.linspace(300, 900, 400) * np.arange(400) / rate)
    x = np.concatenate([noise[:3000], template, noise[:2000], template, noise[:500]])
    assert kernels.detect(x.tolist(), template, rate) == [3000 / rate, 5400 / rate]
    voice = np.concatenate([noise[:4000] * 0.01, tone[:4000], noise[:4000] * 0.01])
    on = kernels.voice_frames(voice, rate)
    assert 20 <= on.sum() <= 28 and on[30] and not on[5]
    assert kernels.levels(np.ones(32), 16, 16).tolist() == pytest.approx([0, 0], abs=1e-6)
    assert kernels.two_means(np.array([1, 1.2, 9, 9.1])).tolist() == [0, 0, 1, 1]
    assert kernels.saturation(np.array([0.1, 1.0])) == 0.5 and kernels.snr(voice, rate) > 20
    assert (kernels.flatness(noise, 256) > kernels.flatness(tone, 256)).all()


def test_transcripts_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    nested = transcripts.nested(turns)
    (tmp_path / "a.json").write_text(nested.first().json)
    got = transcripts.sentences(transcripts.read(spark, str(tmp_path)))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "user", "hi"), (1, 1, "assistant", "yes")]
    broken = spark.createDataFrame([("{nope",), (None,)], "json string")
    assert transcripts.sentences(transcripts.parse(broken)).count() == 0
    assert json.loads(nested.first().json)["metadata"]["channels"] == 1


def test_shared_folder_follows_the_setting(spark):
    from voxlake.storage import shared_folder

    a, b = shared_folder(spark), shared_folder(spark)
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))

    class Java:
        sc = lambda self: self
        getCheckpointDir = lambda self: self
        isDefined = lambda self: False

    class Unset:
        conf = {}

        def __init__(self, master):
            self.sparkContext = type("C", (), {"_jsc": Java(), "master": master})()

    assert shared_folder(Unset("local[8]")).rpartition("/")[0] == shared_folder(Unset("local[2]")).rpartition("/")[0]
    with pytest.raises(ValueError, match="share"):  # a cluster's executors would write to their own disks
        shared_folder(Unset("spark://host:7077"))


def test_majority_smoothing(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate("AABAACBCB")] + [(2, 0, "Z"), (2, 1, None)], "f int, t int, v string")
    got = {(r.f, r.t): r.smooth for r in sequential.smoothed(rows, "v", keys="f", order=["t"], reach=1).collect()}
    assert [got[1, k] for k in range(9)] == slow_majority("AABAACBCB", 1)
    assert got[2, 0] == got[2, 1] == "Z"


def slow_majority(values, reach):
    windows = [values[max(0, i - reach) : i + reach + 1] for i in range(len(values))]
    return [max(dict.fromkeys(w), key=w.count) for w in windows]


def test_cut_places(spark):
    def slow(text):
        marks = [k + 1 for k, c in enumerate(text[:-1]) if c in ".,;:?!"]
        spaces = [k for k, c in enumerate(text) if c == " "]
        return min(marks or spaces or [len(text)], key=lambda k: (abs(k - len(text) / 2), k))

    texts = ["one two. three four five", "", "a", "....", "no marks at all", "x. y", "end mark.", "é, ñandú; über", "abcdef", " ", "a b"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    k = F.coalesce(scalars.nearest_cut("text", "[.,;:?!]", False), scalars.nearest_cut("text", " ", True), F.length("text"))
    assert {r.text: r.k for r in rows.withColumn("k", k).collect()} == {t: slow(t) for t in texts}


def test_spanish_stems():
    pairs = "checar chec checoslovaquia checoslovaqui chefs chefs chelo chel chemise chemis chequeo cheque cheques chequ chetumaleños chetumaleñ chía chi chiapaneca chiapanec chicago chicag chicas chic chicharrones chicharron chichimecas chichimec torá tor tórax torax torcer torc toreados tor toreándolo tor toreara tor torearlo tor toreó tore toreros torer tormentas torment tornados torn tornen torn torneos torne tornillos tornill torniquete torniquet toronto toront torpedearon torped torpeza torpez torrenciales torrencial torrente torrent torreón torreon torrescano torrescan".split()
    assert [snowball.stem(w) for w in pairs[::2]] == pairs[1::2]
    assert [snowball.stem(w) for w in ("biología", "rápidamente", "posibilidad", "distribución", "frecuencias", "sigue", "pague", "averigüen")] == ["biolog", "rapid", "posibil", "distribu", "frecuenci", "sig", "pag", "averigü"]


@given(st.text("ab c", max_size=9), st.text("ab c", max_size=9))
def test_fuzzy_ratios(a, b):
    @functools.cache
    def lcs(i, j):
        return 0 if i == len(a) or j == len(b) else 1 + lcs(i + 1, j + 1) if a[i] == b[j] else max(lcs(i + 1, j), lcs(i, j + 1))

    assert fuzzy.common(a, b) == lcs(0, 0)
    s, t = sorted((a, b), key=len)
    slow = max((fuzzy.ratio(s, t[max(0, k) : k + len(s)]) for k in range(1 - len(s), len(t))), default=0.0) if s else float(not t)
    assert fuzzy.partial_ratio(a, b) == slow
    assert fuzzy.token_set_ratio("b a", "a b c") == 1.0 and fuzzy.partial_ratio("abc", "xxabcxx") == 1.0 and 0 <= fuzzy.score(a, b) <= 1


def test_small_sides_are_looked_at(spark):
    from voxlake.operators import small

    assert small.bounded(spark.range(5), 5, "rows").count() == 5 and len(small.fetched(spark.range(5), 5, "rows")) == 5
    for f in (small.bounded, small.fetched):
        with pytest.raises(ValueError, match="more than 4 rows"):
            f(spark.range(5), 4, "rows")


@pytest.mark.parametrize("chunk", [3, 1024])
def test_viterbi_rounds_and_breaks_ties_as_a_fold_over_all_rows(spark, chunk):
    rng = np.random.default_rng(5)
    calls = {k: rng.integers(1, 10, 40) / 10 for k in range(200)}
    df = spark.createDataFrame([(k, t, [float(x), float(1 - x)]) for k, p in calls.items() for t, x in enumerate(p)], "k long, t long, e array<double>")
    move = start = np.log(np.full((2, 2), 0.5))
    got: dict[int, list[int]] = {}
    for r in sequential.viterbi(df, keys="k", order="t", column="e", labels=["a", "b"], transition=move, start=start[0], chunk=chunk, probabilities=True).orderBy("k", "t").collect():
        got.setdefault(r.k, []).append("ab".index(r.label))
    assert got == {k: sequential.best_within(np.array([[math.log(x), math.log(1 - x)] for x in p.tolist()]), move, start[0]) for k, p in calls.items()}
