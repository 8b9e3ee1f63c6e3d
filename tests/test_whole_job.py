"""Queries do the whole job: each test fails where rows, terms or candidates are left out."""

import functools
import random

import numpy as np

from voxlake.operators import likelihood


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def test_J18_J19_all_windows_and_whole_phrases(spark):
    random.seed(3)
    word = lambda n=9: "".join(random.choice("abcd") for _ in range(random.randint(1, n)))
    phrases = [(i, i % 3, " ".join(word() for _ in range(random.randint(1, 30)))) for i in range(9)]
    docs = [(d, [word() for _ in range(n)]) for d, n in enumerate((0, 1, 4, 6, 7, 17, 18, 19, 31, 200))]
    docs += [(20, phrases[4][2].split()), (21, [word(150) for _ in range(25)]), (22, None), (23, ["zzz"])]
    df = spark.createDataFrame(docs, "doc_id long, w array<string>")
    script = spark.createDataFrame(phrases, "item_id long, cluster long, phrase string")
    for how in ({"size": 6, "step": 1, "tail": False, "top": 1}, {"size": 18, "step": 6, "tail": True, "top": 3}):
        got = sorted(tuple(r) for r in likelihood.best_pairs(df, script, **how).where("item_id is not null").collect())
        want = []
        for d, w in docs:
            starts = likelihood.windows(w or [], how["size"], how["step"], how["tail"])
            for c in range(3):
                pairs = []
                for i, _, p in (x for x in phrases if x[1] == c):
                    for k in starts:
                        span = " ".join(w[k : k + how["size"]])
                        m = max(len(span), len(p))
                        pairs.append((-((2_000_000 * (m - distance(span, p)) + m) // (2 * m)), i, k))
                want += [(d, c, i, k, -x / 1e6) for x, i, k in sorted(pairs)[: how["top"]]]
        assert got == sorted(want)
        assert {r.doc_id for r in likelihood.best_pairs(df, script, **how).where("item_id is null and score = 0").collect()} == {0, 22}


def test_J18_J19_any_number_of_phrases_and_few_pairs_compared(spark, monkeypatch):
    """The script in blocks gives the rows of the script as a whole; of the pairs that there are only some are compared."""
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(2, 9)))
    phrases = [(i, i % 3, " ".join(word() for _ in range(random.randint(4, 9)))) for i in range(60)]
    docs = [(d, [word() for _ in range(60)]) for d in range(20)] + [(50 + i, [word() for _ in range(20)] + p.split() + [word()]) for i, _, p in phrases[:20]]
    df, script = spark.createDataFrame(docs, "doc_id long, w array<string>"), spark.createDataFrame(phrases, "item_id long, cluster long, phrase string")
    how = {"size": 6, "step": 1, "tail": False, "top": 2}
    whole = sorted(map(tuple, likelihood.best_pairs(df, script, **how).collect()))
    monkeypatch.setattr(likelihood, "PHRASES", 7)
    monkeypatch.setattr(likelihood, "SCRIPT", 5)
    assert sorted(map(tuple, likelihood.best_pairs(df, script, **how).collect())) == whole
    evidence = sorted(map(tuple, likelihood.evidence(df, script).collect()))
    monkeypatch.undo()
    assert sorted(map(tuple, likelihood.evidence(df, script).collect())) == evidence
    pairs = sum(len(likelihood.windows(w, 6, 1, False)) for _, w in docs) * len(phrases)
    compared = likelihood.best_of([w for _, w in docs], [(i, 0, p) for i, _, p in phrases], 1, size=6, step=1, tail=False, top=1).verified
    assert compared < 0.3 * pairs


def test_least_distances_are_under_all_distances():
    random.seed(6)
    texts = [["".join(random.choice("ab") for _ in range(random.randint(1, 40))) for _ in range(random.randint(1, 90))] for _ in range(6)]
    data, doc, start, lo, hi = likelihood.laid_out(texts, 3, 1, False)
    phrases = [(k, 0, " ".join("".join(random.choice("ab") for _ in range(random.randint(1, 70))) for _ in range(2))) for k in range(9)] + [(9, 0, "")]
    least = likelihood.least_distances(data, doc, lo, hi, likelihood.Script(phrases))
    for w in range(0, len(lo), 7):
        span = data[lo[w] : hi[w]].tobytes().decode()
        for k, (_, _, p) in enumerate(phrases):
            far = distance(p, span)
            assert least[w, k] <= far and least[w, k] <= len(p)
            if start[w] % likelihood.LANE == 0:  # a lane's first window has no stretch that begins before it
                assert least[w, k] == min(distance(p, span[j:]) for j in range(len(span) + 1))


def test_J18_J19_long_texts_and_texts_without_a_shared_word(spark, tmp_path):
    from voxlake.plans import catalog

    long = " ".join(["filler words here"] * 100 + ["alpha beta gamma delta epsilon zeta"])
    spark.createDataFrame([(1, long, len(long)), (2, "alphq betb gammc", 16), (3, None, None), (4, long, None)], "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, "Alpha beta gamma, delta epsilon zeta."), (6, "one two three four five six seven eight")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: (r.score, r.item_id) for r in catalog.queries()["J18_best_phrase"](spark, str(tmp_path)).collect()}
    assert got[1] == got[4] == (1.0, 5) and got[2][0] > 0 and got[2][1] == 5 and got[3] == (0.0, None)
    rows = catalog.queries()["J19_cluster_evidence"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.cluster) for r in rows} == {(d, c) for d in (1, 2, 4) for c in (5, 6)}
    assert max(r.k for r in rows) > 0


def test_J19b_blended_evidence(spark):
    """Every window against every phrase, score by score."""
    from collections import Counter
    from math import sqrt

    random.seed(5)
    word = lambda: "".join(random.choice("abcd") for _ in range(random.randint(1, 7)))
    phrases = [(i, i % 3, " ".join(word() for _ in range(random.randint(1, 12)))) for i in range(7)]
    docs = [(d, [word() for _ in range(n)]) for d, n in enumerate((0, 1, 5, 18, 19, 40))] + [(9, None), (10, phrases[4][2].split())]

    def vector(t):
        number = {c: k for k, c in enumerate(" abcdefghijklmnopqrstuvwxyz")}
        n = Counter((((number[t[k]] * 729 + number[t[k + 1]] * 27 + number[t[k + 2]]) * 2654435761) & 0xFFFFFFFF) >> 22 for k in range(len(t) - 2))
        size = sqrt(sum(x * x for x in n.values())) or 1.0
        return {k: x / size for k, x in n.items()}

    dot = lambda a, b: sum(x * b.get(k, 0.0) for k, x in a.items())
    want = []
    for d, w in docs:
        spans = [(k, " ".join((w or [])[k : k + 18])) for k in likelihood.windows(w or [], 18, 6, True)]
        for c in range(3):
            mine = [(i, p) for i, x, p in phrases if x == c]
            vectors = [vector(p) for _, p in mine]
            mean: Counter = Counter()
            for v in vectors:
                mean.update(v)
            size = sqrt(sum(x * x for x in mean.values())) or 1.0
            found = []
            for k, span in spans:
                edit = [round(1 - distance(span, p) / max(len(span), len(p)), 6) for _, p in mine]
                near = [dot(vector(span), v) for v in vectors]
                alike = max(max(near), dot(vector(span), mean) / size)
                ref = mine[near.index(max(near))][0] if round(alike, 6) >= max(edit) else mine[edit.index(max(edit))][0]
                found.append((-(0.55 * max(edit) + 0.45 * alike), k, ref, max(edit), alike))
            want += [(d, c, -x, e, a) for x, k, ref, e, a in sorted(found)[:3]]
    df = spark.createDataFrame(docs, "doc_id long, w array<string>")
    got = sorted((r.doc_id, r.cluster, -r.score, r.fuzzy, r.semantic) for r in likelihood.evidence(df, spark.createDataFrame(phrases, "item_id long, cluster long, phrase string")).collect())
    want = sorted((d, c, -x, e, a) for d, c, x, e, a in want)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and all(abs(a - b) < 3e-6 for a, b in zip(g[2:], w[2:], strict=True)), (g, w)


def test_J19b_compares_only_what_can_be_among_the_first():
    """Windows far from every phrase in meaning and letters are not compared letter by letter; one that a phrase resembles is found among them."""
    random.seed(9)
    noise = lambda letters, n: ["".join(random.choice(letters) for _ in range(5)) for _ in range(n)]
    phrases = [(i, i % 2, " ".join(noise("abcdefgh", 18))) for i in range(20)]
    text = noise("stuvwxyz", 18 * 40)
    for k, (_, _, phrase) in enumerate(phrases[:6]):
        text[18 * (5 + k) : 18 * (6 + k)] = phrase.split()
    counted: list = []
    found = likelihood.evidence_of([text, [], text[:30]], phrases, 2, size=18, step=6, tail=True, top=3, counted=counted)
    assert {(d, c, i, k) for d, c, i, k, *_ in found if d == 0} == {(0, i % 2, i, 18 * (5 + i)) for i in range(6)}
    assert all(x[4:] == (1.0, 1.0, 1.0) for x in found if x[0] == 0) and sum(x[0] == 2 for x in found) == 6
    ((compared, pairs),) = counted
    assert compared < pairs / 4


def test_distances_of_any_number_of_blocks():
    random.seed(2)
    number = likelihood.letter_numbers()
    for blocks in (1, 2, 3):
        texts = ["".join(random.choice("abc ") for _ in range(random.randint(64 * blocks - 63, 64 * blocks))) for _ in range(20)] + ["a" * 64 * blocks]
        ends = np.cumsum([len(t) for t in texts])
        begins = ends - [len(t) for t in texts]
        masks = likelihood.masks_of(np.frombuffer("".join(texts).encode(), np.uint8), begins, ends, blocks)
        for phrase in ("", "a", "abc cba" * 25):
            got = likelihood.distances(masks, ends - begins, number[np.frombuffer(phrase.encode(), np.uint8)])
            assert got.tolist() == [distance(t, phrase) for t in texts]


def test_windows():
    assert likelihood.windows(["a"] * 20, 18, 6, True) == [0, 2] and likelihood.windows([], 6, 1, False) == []
    assert likelihood.windows(["a"] * 3, 6, 1, False) == [0] and likelihood.windows(["a"] * 8, 6, 1, False) == [0, 1, 2]


def test_M02_all_calls_and_all_terms(spark, sf):
    import math
    from collections import Counter

    from voxlake.plans import catalog, scoring
    from voxlake.plans.registry import Source

    rows = Source(spark, sf).view("call_topics").collect()
    end: dict = {}
    for r in rows:
        end[r.call_id] = max(end.get(r.call_id, 0), r.end_s)
    seen = [(r, "early" if r.start_s <= 20 else "late", sum(r.start_s / end[r.call_id] >= e for e in scoring.REL_BINS)) for r in rows]
    tb, rb, ys = Counter((r.label, b) for r, b, _ in seen), Counter((r.label, p) for r, _, p in seen), Counter(r.label for r in rows)
    want = Counter()
    for r, b, p in seen:
        w = {y: math.exp(math.log(0.4 if y == r.label else 0.6 / 13) + 0.5 * math.log((tb[y, b] + 1) / (n + 2)) + 0.5 * math.log((rb[y, p] + 1) / (n + 7)) + 0.1 * math.log(n / len(rows))) for y, n in ys.items()}
        want.update((r.call_id, r.line, r.part_id, r.supp_id, y, x / sum(w.values())) for y, x in w.items())
    got = catalog.queries()["M02_time_fusion"](spark, sf).collect()
    assert len(got) == len(rows) * len(ys) and len({r.call_id for r in got}) == len(end)
    pairs = list(zip(sorted(want.elements()), sorted((r.call_id, r.line, r.part_id, r.supp_id, r.cand, r.p) for r in got), strict=True))
    assert all(a[:5] == b[:5] and abs(a[5] - b[5]) < 2e-6 for a, b in pairs), next((a, b) for a, b in pairs if a[:5] != b[:5] or abs(a[5] - b[5]) >= 2e-6)


def test_J21_best_member_and_M05_grid(spark, sf, tmp_path):
    from voxlake.plans import catalog

    rows = [(1, 0, [1.0, 0.0]), (2, 0, [-1.0, 0.1]), (3, 1, [0.6, 0.8]), (4, 1, [0.7, 0.7]), (5, 2, [0.99, 0.05])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: (r.cluster, r.score) for r in catalog.queries()["J21_nearest_cluster"](spark, str(tmp_path)).collect()}
    assert got[5][0] == 2 and got[1][0] == 2 and got[3][0] == 1
    # the mean of cluster 0 is far from its member (1, 0)
    spark.createDataFrame([*rows, (6, 2, [0.0, -1.0]), (7, 0, [0.98, -0.05])], "vec_id long, label int, embedding array<float>").write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    assert {r.vec_id: r.cluster for r in catalog.queries()["J21_nearest_cluster"](spark, str(tmp_path)).collect()}[7] == 0
    grid = catalog.queries()["M05_weight_search"](spark, sf).collect()
    assert len(grid) == 64 and sum(r.best for r in grid) == 1 and max(grid, key=lambda r: r.macro_f1).macro_f1 == next(r.macro_f1 for r in grid if r.best)
    assert next(r.macro_f1 for r in grid if (r.alpha, r.beta, r.gamma) == (0.0, 0.0, 0.0)) == 1.0


def test_W19_spans_without_an_end_and_equal_spans(spark, tmp_path):
    import duckdb

    from voxlake.plans import catalog

    form = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    spans = [(1, 1, 5.0), (1, 3, None), (1, 3, 7.0), (2, 1, 6.0), (2, None, 6.0), (2, 4, 8.0), (3, 1, 5.0), (3, 4, 9.0), (3, 4, 9.0)]
    spark.createDataFrame([(call, 0, 1, line, q, 1.0, 0.0) for call, line, q in spans], form).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(map(tuple, catalog.queries()["W19_merge_by_gap"](spark, str(tmp_path)).collect()))
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.oracle_sql()["W19_merge_by_gap"]).fetchall())
    assert got == [(1, 10.0, 15.0, 1), (1, 30.0, 37.0, 2), (2, 10.0, 16.0, 1), (2, 40.0, 48.0, 2), (3, 10.0, 15.0, 1), (3, 40.0, 49.0, 2)]


def test_X18_a_mean_halfway_is_summed_in_the_order_of_the_table(spark, tmp_path):
    from voxlake.plans import catalog

    at = lambda line, q: (line * 10.0 + (line * 10.0 + q)) / 240
    mean = lambda values: functools.reduce(lambda t, x: t + x, values, 0.0) / len(values)  # noqa: E731  (sum() would correct its rounding)
    marker = lambda values: round(8 * mean(values))
    a, b, c = (3, 29), (2, 26), (2, 30)
    assert marker([at(*x) for x in (a, b, c)]) != marker([at(*x) for x in (c, a, b)])
    form = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double"
    row = lambda call, x: (call, 0, 1, x[0], float(x[1]), 1.0, 0.0)
    (tmp_path / "lineitem.parquet").mkdir()
    # the second file is larger, so a scan begins with it
    for name, rows in (("a", [row(1, a), row(1, b)]), ("b", [row(1, c), *(row(k, (1 + k % 7, 1 + k % 50)) for k in range(2, 3000))])):
        spark.createDataFrame(rows, form).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / "lineitem.parquet" / f"{name}.parquet")
    got = {r.call_id: r.markers for r in catalog.queries()["X18_chart_markers"](spark, str(tmp_path)).collect()}
    assert got[1] == ",".join(map(str, sorted([marker([at(*x) for x in (a, b, c)]), 2, 5, 4, 6, 7])))


def test_X16_a_mean_at_its_threshold_is_summed_in_the_order_of_events(spark, tmp_path):
    import random
    from datetime import datetime

    from voxlake.plans import catalog

    def bad(values):
        level = rest = vol = 0.0
        for x in values:
            level, rest, vol = level + x, rest + x % 7, vol - x
        n = len(values)
        return (level / n / 10 < 5) + (rest / n / 50 > 0.06) + (vol / n < -45) > 1

    random.seed(3)
    threes = [(x, y, 13500 - x - y) for x, y in ((random.randint(3600, 5400), random.randint(3600, 5400)) for _ in range(2000))]
    low = [[v / 100 for v in t] for t in threes if sum(v % 700 for v in t) == 200]  # 45 on average, and rests after 7 below 3
    own = next(v for v in (sum(random.sample(low, 7), []) for _ in range(20_000)) if bad(v) != bad(v[::-1]))
    rows = [(len(own) - k, datetime(2024, 1, 1), 1, "view", x, "") for k, x in enumerate(own)]  # the file's order is not that of the events
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.queries()["X16_audio_quality"](spark, str(tmp_path)).collect()
    assert got[0].quality == ("bad" if bad(own[::-1]) else "good")


def test_J18_phrases_that_lengths_rule_out_are_not_passed_over(monkeypatch):
    met = []
    whole = likelihood.least_distances

    def counted(data, doc, lo, hi, script):
        met.append(len(script.items))
        return whole(data, doc, lo, hi, script)

    monkeypatch.setattr(likelihood, "least_distances", counted)
    text = "one two three four five six".split()
    phrases = [(k, 0, "one two three four five six") for k in range(likelihood.SCRIPT)] + [(1000 + k, 0, "long " * 60 + "end") for k in range(200)]
    best = likelihood.best_of([text], phrases, 1, size=6, step=1, tail=False, top=1)
    assert best.score[0, 0, 0] == 1_000_000 and best.item[0, 0, 0] == 0
    assert sum(met) == likelihood.SCRIPT
