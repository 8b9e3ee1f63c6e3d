"""Scores and reasons of a call (X), calibration, and the parts of the models that are relational (M)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import calibrate
from voxlake.plans.aggregates import EVALUATE, R, class_report
from voxlake.plans.registry import Source, query
from voxlake.scoring import calls as X
from voxlake.storage import written
from voxlake.views import REQUIRED_TOPICS, SCRIPT_ORDER, ctes

CALLS, TOP, WIN, UTT = ctes("calls"), ctes("call_topics"), ctes("windows"), ctes("utterances")
FLOW = "CASE WHEN mac_count = 0 THEN 'NO_MAC' WHEN mac_likelihood >= 0.88 AND NOT reinforced THEN 'VENTA_CONFIRMADA' WHEN reinforced THEN 'VENTA_REFUERZO' ELSE 'NO_CONFIRMADA' END"
D1 = f"least(2 * CAST(mac_count > 0 AS INT) + 3 * mac_likelihood + CASE {FLOW} WHEN 'VENTA_CONFIRMADA' THEN 3 WHEN 'VENTA_REFUERZO' THEN 2 WHEN 'NO_CONFIRMADA' THEN 0.5 ELSE 0 END + 2 * least(price_likelihood, 1), 10)"
D4 = "least(CASE WHEN participation BETWEEN 0.55 AND 0.7 THEN 4 WHEN participation > 0.85 THEN greatest(0, 4 - 20 * (participation - 0.85)) ELSE 4 * participation / 0.55 END + CASE WHEN wpm BETWEEN 120 AND 160 THEN 3 WHEN wpm > 160 THEN greatest(0, 3 - (wpm - 160) / 40) ELSE 3 * wpm / 120 END + least(turns / 20.0, 1) * 2 + least(questions / 5.0, 1), 10)"
D5 = "least(5 * confidence + 3 * (1 - silence) + 2 * (1 - overlap), 10)"
FLAGS = f"SELECT call_id, {', '.join(f'bool_or(label = {chr(39)}{t}{chr(39)}) AS f{k}' for k, t in enumerate(SCRIPT_ORDER))} FROM call_topics GROUP BY 1"
REQUIRED = [SCRIPT_ORDER.index(t) for t in REQUIRED_TOPICS]
COUNT = " + ".join(f"CAST(f{k} AS INT)" for k in REQUIRED)
D2 = f"least(9 * ({COUNT}) / 6.0 + CAST(f{SCRIPT_ORDER.index('CONFIRMACION MONITOREO')} AS INT), 10)"
FIRSTS = "SELECT call_id, ordinal, min(start_s) AS t FROM call_topics GROUP BY 1, 2"
TAU = f"SELECT a.call_id, sum(CASE WHEN (a.t, a.ordinal) < (b.t, b.ordinal) THEN 1.0 ELSE 0 END) / count(*) AS tau FROM ({FIRSTS}) a JOIN ({FIRSTS}) b ON a.call_id = b.call_id AND a.ordinal < b.ordinal GROUP BY 1"
ALL = f"""WITH {CALLS}, {TOP}, fl AS ({FLAGS}), ta AS ({TAU}), d AS (SELECT c.*, coalesce({D1.replace('mac_', 'c.mac_').replace('price_', 'c.price_').replace('reinforced', 'c.reinforced')}, 0) AS d1, CASE WHEN f0 IS NULL THEN 0 ELSE {D2} END AS d2, coalesce(6 * ({COUNT}) / 6.0, 0) + 4 * coalesce(tau, 0) AS d3, {D4} AS d4, {D5} AS d5 FROM calls c LEFT JOIN fl USING (call_id) LEFT JOIN ta USING (call_id))"""


@query("X01_mac_flow", f"WITH {CALLS} SELECT call_id, {FLOW} AS outcome, mac_count > 0 AND NOT (mac_likelihood >= 0.88 AND NOT reinforced) AND (reinforced OR mac_likelihood >= 0.8) AS triggered, mac_count > 0 AND reinforced AS effective FROM calls")
def mac_flow(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", X.mac_flow().alias("f")).select("call_id", "f.outcome", "f.triggered", "f.effective")


@query("X02_sale_score", f"WITH {CALLS} SELECT call_id, round({D1}, 4) AS d1 FROM calls")
def sale_score(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", F.round(X.sale_score(), 4).alias("d1"))


@query("X03_compliance_score", f"WITH {TOP}, fl AS ({FLAGS}) SELECT call_id, round({D2}, 4) AS d2 FROM fl")
def compliance_score(s: Source) -> DataFrame:
    return X.topic_flags(s.view("call_topics")).select("call_id", F.round(X.compliance_score(), 4).alias("d2"))


@query("X04_script_score", f"WITH {TOP}, fl AS ({FLAGS}), ta AS ({TAU}) SELECT call_id, round(6 * ({COUNT}) / 6.0 + 4 * coalesce(tau, 0), 4) AS d3 FROM fl LEFT JOIN ta USING (call_id)")
def script_score(s: Source) -> DataFrame:
    return X.script_score(s.view("call_topics")).select("call_id", F.round("d3", 4).alias("d3"))


@query("X05_engagement_score", f"WITH {CALLS} SELECT call_id, round({D4}, 4) AS d4 FROM calls")
def engagement_score(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", F.round(X.engagement_score(), 4).alias("d4"))


@query("X06_audio_score", f"WITH {CALLS} SELECT call_id, round({D5}, 4) AS d5 FROM calls")
def audio_score(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", F.round(X.audio_score(), 4).alias("d5"))


@query("X07_final_score", f"{ALL} SELECT call_id, round(least(greatest(0.4 * d1 + 0.3 * d2 + 0.15 * d3 + 0.1 * d4 + 0.05 * d5, 0), 10), 6) AS score, round((0.4 * d1 + 0.15 * d3 + 0.05 * d5) / 0.6, 6) AS without_two FROM d")
def final_score(s: Source) -> DataFrame:
    x = X.dimensions(s.view("calls"), s.view("call_topics"))
    some = {"d1": F.col("d1"), "d2": F.lit(None).cast("double"), "d3": F.col("d3"), "d4": F.lit(None).cast("double"), "d5": F.col("d5")}
    return x.select("call_id", F.round(X.final_score(), 6).alias("score"), F.round(X.available_score(some), 6).alias("without_two"))


@query("X08_topic_flags", f"WITH {TOP}, fl AS ({FLAGS}) SELECT call_id, {', '.join(f'f{k}' for k in range(14))}, round(({COUNT}) / 6.0, 8) AS completeness FROM fl")
def topic_flags(s: Source) -> DataFrame:
    x = X.topic_flags(s.view("call_topics"))
    return x.select("call_id", *(f"f{k}" for k in range(14)), R(X.required_count() / 6.0).alias("completeness"))


@query("X09_audio_stats", f"WITH {WIN} SELECT file_id, round(avg(CASE WHEN vol < -50 THEN 1.0 ELSE 0 END), 8) AS silence, round(avg(vol), 8) AS mean, round(stddev_pop(vol), 6) AS std FROM windows WHERE isfinite(vol) GROUP BY 1")
def audio_stats(s: Source) -> DataFrame:
    w = s.view("windows").where(F.abs("vol") < float("inf"))
    return w.groupBy("file_id").agg(R(F.avg((F.col("vol") < -50).cast("double"))).alias("silence"), R(F.avg("vol")).alias("mean"), R(F.stddev_pop("vol"), 6).alias("std"))


@query("X10_at_topic_times", f"WITH {TOP}, {WIN}, t AS (SELECT call_id, min(start_s) FILTER (WHERE label = 'MAC') AS mac, min(start_s) FILTER (WHERE label = 'PRECIO') AS price FROM call_topics GROUP BY 1), v AS (SELECT event_id % 200 AS k, min(level) AS level FROM windows GROUP BY 1) SELECT call_id, CASE WHEN m.level < 25 THEN 'low' WHEN m.level < 60 THEN 'mid' WHEN m.level >= 60 THEN 'high' END AS at_mac, CASE WHEN p.level < 25 THEN 'low' WHEN p.level < 60 THEN 'mid' WHEN p.level >= 60 THEN 'high' END AS at_price FROM t LEFT JOIN v m ON m.k = CAST(mac AS BIGINT) LEFT JOIN v p ON p.k = CAST(price AS BIGINT)")
def at_topic_times(s: Source) -> DataFrame:
    t = s.view("call_topics").groupBy("call_id").agg(*(F.min(F.when(F.col("label") == label, F.col("start_s"))).cast("long").alias(n) for label, n in (("MAC", "mac"), ("PRECIO", "price"))))
    v = s.view("windows").groupBy((F.col("event_id") % 200).alias("k")).agg((F.min("level") / 100).alias("level"))
    side = lambda n: v.select(F.col("k").alias(n), F.when(F.col("level") < 0.25, "low").when(F.col("level") < 0.6, "mid").otherwise("high").alias(f"at_{n}"))
    return t.join(side("mac"), "mac", "left").join(side("price"), "price", "left").select("call_id", "at_mac", "at_price")


@query("X11_reasons", f"""WITH {CALLS}, m AS (SELECT avg(score) AS s, avg(tmo_s) AS t, avg(forbidden_rate) AS f FROM calls) SELECT call_id, CASE WHEN is_empty = 1 THEN 'LLAMADA VACÍA' WHEN strikes > 3 THEN 'NO AUDITABLE' ELSE concat_ws(', ', CASE WHEN mac_likelihood < 0.8 * 0.95 THEN 'MAC INCORRECTO' END, CASE WHEN price_likelihood < 0.7 * 0.8 THEN 'PRECIO INCORRECTO' END, CASE WHEN mac_count > 2 THEN 'MAC FORZADO' END) END AS reject_reason,
CASE WHEN is_empty = 1 OR strikes > 3 THEN '' ELSE concat_ws(', ', CASE WHEN coalesce(hangup_s, tmo_s) < tmo_s - 15 AND coalesce(hangup_s, tmo_s) > 20 THEN 'HANGUP ANTICIPADO' END, CASE WHEN overlap_s > 5 THEN 'OVERLAPPING' END, CASE WHEN mac_likelihood < 0.8 THEN 'MAC INEXACTO' END, CASE WHEN price_likelihood < 0.7 THEN 'PRECIO INEXACTO' END,
CASE WHEN forbidden_rate > 1.1 * f THEN 'PALABRAS PROHIBIDAS' END, CASE WHEN tmo_s < 0.8 * t THEN 'TMO BAJO' END, CASE WHEN score < 0.8 * s THEN 'PUNTAJE BAJO' END, CASE WHEN participation > 0.9 THEN 'BPC' END) END AS warning_reason FROM calls, m""")
def reasons(s: Source) -> DataFrame:
    return X.reasons(s.view("calls"), mac_cut=0.8, price_cut=0.7).select("call_id", "reject_reason", "warning_reason")


@query("X12_any_condition", f"WITH {CALLS} SELECT call_id FROM calls WHERE mac_likelihood < 0.5 OR price_likelihood < 0.5 OR participation > 0.9")
def any_condition(s: Source) -> DataFrame:
    return s.view("calls").where("mac_likelihood < 0.5 or price_likelihood < 0.5 or participation > 0.9").select("call_id")


def candidate_sql(up: str, c: float = 1.1113071e-16) -> str:
    """The oracle's next double from a value towards 1."""
    return f"CASE WHEN {up} = 0 THEN 4.9e-324 WHEN {up} < 1 THEN {up} + {up} * {c} WHEN {up} > 1 THEN {up} - {up} * {c} ELSE {up} END"


CANDIDATES = f"""WITH {CALLS}, r AS (SELECT is_empty = 1 AS e, price_likelihood AS p, mac_likelihood AS m FROM calls), s AS (SELECT CAST(ceil(count(*) * 0.2) AS BIGINT) AS wanted, count(*) FILTER (e) AS empties FROM r),
g AS (SELECT least(p, m) AS v, count(*) AS n, count(*) FILTER (p <= m) AS np, count(*) FILTER (m <= p) AS nm FROM r WHERE NOT e GROUP BY 1), u AS (SELECT *, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, {candidate_sql('v')} AS up FROM g),
c AS (SELECT v, 0 AS k, v AS p, v AS m, below AS t FROM u UNION ALL SELECT v, 1, up, v, below + CASE WHEN v < 1 THEN np ELSE 0 END FROM u UNION ALL SELECT v, 2, v, up, below + CASE WHEN v < 1 THEN nm ELSE 0 END FROM u UNION ALL SELECT v, 3, up, up, below + CASE WHEN v < 1 THEN n ELSE 0 END FROM u),
d AS (SELECT c.*, empties + t = wanted AS exact, abs(empties + t - wanted) AS off FROM c, s),
b AS (SELECT (SELECT {{p: p, m: m}} FROM d WHERE exact AND p <> m ORDER BY v, k LIMIT 1) AS apart, (SELECT p FROM d WHERE exact AND p = m ORDER BY v DESC, k DESC LIMIT 1) AS equal, (SELECT {{p: p, m: m}} FROM d ORDER BY off, v, k LIMIT 1) AS near),
t AS (SELECT wanted, CASE WHEN empties >= wanted OR near IS NULL THEN {{p: 0.0::DOUBLE, m: 4.9e-324}} WHEN apart IS NOT NULL THEN apart WHEN equal < 1 THEN {{p: equal, m: {candidate_sql('equal')}}} WHEN equal IS NOT NULL THEN {{p: equal - equal * 1.1113071e-16, m: equal}}
  WHEN near.p <> near.m THEN near ELSE {{p: near.p, m: CASE WHEN near.m < 1 THEN {candidate_sql('near.m')} ELSE near.m - near.m * 1.1113071e-16 END}} END AS t, CASE WHEN empties < wanted AND apart IS NULL THEN equal END AS general_th FROM b, s)
SELECT t.t.p AS price_th, t.t.m AS mac_th, general_th, (SELECT count(*) FROM r WHERE e OR r.p < t.t.p OR r.m < t.t.m) AS selected, wanted FROM t"""


@query("X13_calibrated_thresholds", CANDIDATES)
def calibrated(s: Source) -> DataFrame:
    return calibrate.thresholds(s.view("calls"), empty="is_empty", price="price_likelihood", mac="mac_likelihood", share=0.2)


@query("X13b_counts_below", f"WITH {CALLS}, m AS (SELECT CASE WHEN is_empty = 1 THEN -1 ELSE round(least(price_likelihood, mac_likelihood), 6) END AS v FROM calls) SELECT v, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY v) AS BIGINT) AS upto FROM m GROUP BY v")
def counts_below(s: Source) -> DataFrame:
    """How many calls a threshold at each value selects; values are few beside calls."""
    v = F.when(F.col("is_empty") == 1, -1.0).otherwise(F.round(F.least("price_likelihood", "mac_likelihood"), 6))
    return calibrate.counts_below(s.view("calls").select(v.alias("v")), "v").select("v", "n", "upto")


@query("X14_conscious_sale", f"WITH {CALLS} SELECT call_id, round(0.3 * CASE WHEN questions > 0 THEN 0.5 * least(participation / 0.15, 1) + 0.5 * least(turns / 40.0, 1) ELSE least(participation / 0.15, 1) END + 0.3 * least(questions / 5.0, 1) + 0.2 * mac_likelihood + 0.2 * price_likelihood, 6) AS score FROM calls")
def conscious_sale(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", R(X.conscious_sale(), 6).alias("score"))


@query("X15_batch_deltas", f"WITH {CALLS} SELECT call_id, round((score - avg(score) OVER ()) / nullif(avg(score) OVER (), 0), 6) AS delta FROM calls")
def batch_deltas(s: Source) -> DataFrame:
    c = s.view("calls").select("call_id", "score")
    return c.crossJoin(F.broadcast(c.agg(F.avg("score").alias("m")))).select("call_id", R(F.try_divide(F.col("score") - F.col("m"), F.col("m")), 6).alias("delta"))


@query("X16_audio_quality", f"WITH {WIN}, q AS (SELECT file_id, avg(level) / 10 AS snr, avg(level % 7) / 50 AS flatness, avg(vol) AS mel FROM windows WHERE level > 5 GROUP BY 1) SELECT file_id, CASE WHEN CAST(snr < 5 AS INT) + CAST(flatness > 0.06 AS INT) + CAST(mel < -45 AS INT) > 1 THEN 'bad' ELSE 'good' END AS quality FROM q")
def audio_quality(s: Source) -> DataFrame:
    """Sums run in the order of events, so that a mean that stands at its threshold falls the same way in every run: as in the SQL on one thread."""
    w = Window.partitionBy("file_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum(v).over(w).alias(n) for n, v in (("level", F.col("level")), ("rest", F.col("level") % 7), ("vol", F.col("vol")))]
    q = s.view("windows").where("level > 5").select("file_id", "event_id", *sums).groupBy("file_id").agg(F.count("*").alias("n"), F.max_by(F.struct("level", "rest", "vol"), "event_id").alias("t"))
    mean = lambda c: F.col(f"t.{c}") / F.col("n")
    bad = (mean("level") / 10 < 5).cast("int") + (mean("rest") / 50 > 0.06).cast("int") + (mean("vol") < -45).cast("int")
    return q.select("file_id", F.when(bad > 1, "bad").otherwise("good").alias("quality"))


@query("X17_legacy_score", f"WITH {CALLS}, x AS (SELECT call_id, sqrt(mac_likelihood * price_likelihood) * least(tmo_s / 300, 1) * power(1 - overlap, 0.25) AS v FROM calls) SELECT call_id, round(10 * least(v / (SELECT quantile_cont(v, 0.99) FROM x), 1), 6) AS score FROM x")
def legacy_score(s: Source) -> DataFrame:
    v = F.sqrt(F.col("mac_likelihood") * F.col("price_likelihood")) * F.least(F.col("tmo_s") / 300, F.lit(1.0)) * F.pow(1 - F.col("overlap"), F.lit(0.25))
    x = s.view("calls").select("call_id", v.alias("v"))
    return x.crossJoin(F.broadcast(calibrate.percentile(x, "v", 0.99))).select("call_id", R(10 * F.least(F.col("v") / F.col("p"), F.lit(1.0)), 6).alias("score"))


MARKERS = (("SALUDO", 0.1), ("PRODUCTO", 0.3), ("MAC", 0.6), ("PRECIO", 0.5), ("TERMINOS LEGALES", 0.7), ("DESPEDIDA", 0.9))


@query("X18_chart_markers", f"WITH {TOP}, p AS (SELECT call_id, {', '.join(f'coalesce(avg(CASE WHEN label = {chr(39)}{t}{chr(39)} THEN (start_s + end_s) / 240 END), {d}) AS m{k}' for k, (t, d) in enumerate(MARKERS))} FROM call_topics GROUP BY 1) SELECT call_id, array_to_string(list_sort([{', '.join(f'CAST(round_even(8 * m{k}, 0) AS INT)' for k in range(6))}]), ',') AS markers FROM p")
def chart_markers(s: Source) -> DataFrame:
    """Each mean is summed in the order of the table's rows, so that one halfway between two markers falls the same way in every run: as in the SQL on one thread. A call's rows are one array."""
    line = F.col("l_linenumber") * F.lit(10.0)
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"), (F.col("l_partkey") % 14).cast("int").alias("k"), ((line + (line + F.col("l_quantity"))) / 240).alias("v"))
    calls = s.table("lineitem").select(F.col("l_orderkey").alias("call_id"), place.alias("x")).groupBy("call_id").agg(F.sort_array(F.collect_list("x")).alias("rows"))

    def at(topic: str, default: float) -> Column:
        own = F.filter("rows", lambda r: (r.k == SCRIPT_ORDER.index(topic)) & r.v.isNotNull())
        mean = F.try_divide(F.aggregate(own, F.lit(0.0), lambda t, r: t + r.v), F.size(own))
        return F.bround(8 * F.coalesce(mean, F.lit(default)), 0).cast("int")

    return calls.select("call_id", F.array_join(F.array_sort(F.array(*(at(t, d) for t, d in MARKERS))), ",").alias("markers"))


@query("X19_strikes", f"WITH {CALLS} SELECT call_id, CAST(silence > 0.5 AS INT) + CAST(confidence <= 0.9 AS INT) + CAST(mac_likelihood <= 0.9 AS INT) + CAST(price_likelihood <= 0.9 AS INT) AS strikes FROM calls")
def strikes(s: Source) -> DataFrame:
    flags = [F.col("silence") > 0.5, *(F.col(c) <= 0.9 for c in ("confidence", "mac_likelihood", "price_likelihood"))]
    return s.view("calls").select("call_id", sum((f.cast("int") for f in flags[1:]), flags[0].cast("int")).alias("strikes"))


@query("X20_one_sided", f"WITH {UTT}, g AS (SELECT call_id, sum(num_words) FILTER (WHERE speaker = 0) AS a, sum(num_words) FILTER (WHERE speaker = 1) AS b FROM utterances GROUP BY 1) SELECT call_id, least(coalesce(a, 0), coalesce(b, 0)) = 0 AND greatest(coalesce(a, 0), coalesce(b, 0)) > 0 AS one_sided FROM g")
def one_sided(s: Source) -> DataFrame:
    said = lambda k: F.sum(F.when(F.col("speaker") == k, F.col("num_words")).otherwise(0))
    return s.view("utterances").groupBy("call_id").agg(((F.least(said(0), said(1)) == 0) & (F.greatest(said(0), said(1)) > 0)).alias("one_sided"))


@query("X21_reset_due", "SELECT event_type, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 10 HOUR AS due FROM events GROUP BY 1")
def reset_due(s: Source) -> DataFrame:
    e = s.table("events")
    return e.groupBy("event_type").agg(F.max("ts").alias("t")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).select("event_type", (F.col("t") < F.col("now") - F.expr("interval 10 hours")).alias("due"))


@query("X22_activity", f"WITH {TOP}, x AS (SELECT call_id, end_s / max(end_s) OVER (PARTITION BY call_id) AS t, words FROM call_topics) SELECT CAST(least(floor(t * 10), 9) AS INT) AS bin, round(avg(words), 6) AS words FROM x GROUP BY 1")
def activity(s: Source) -> DataFrame:
    t = F.col("end_s") / F.max("end_s").over(Window.partitionBy("call_id"))
    return s.view("call_topics").withColumn("bin", F.least(F.floor(t * 10), F.lit(9)).cast("int")).groupBy("bin").agg(R(F.avg("words"), 6).alias("words"))


@query("X23_call_export", f"WITH {CALLS} SELECT call_id, CAST(round_even(mac_likelihood * 100, 0) AS INT) AS mac_pct, max(turns) OVER () - turns AS missing, round((mac_likelihood + price_likelihood) * 50, 6) AS both_pct FROM calls")
def call_export(s: Source) -> DataFrame:
    c = s.view("calls")
    x = c.crossJoin(F.broadcast(c.agg(F.max("turns").alias("top"))))
    return x.select("call_id", F.bround(F.col("mac_likelihood") * 100, 0).cast("int").alias("mac_pct"), (F.col("top") - F.col("turns")).alias("missing"), R((F.col("mac_likelihood") + F.col("price_likelihood")) * 50, 6).alias("both_pct"))


@query("X24_icons", f"WITH {WIN} SELECT file_id, round(max(100 - level), 6) AS quiet, max(abs(vol)) > 95 AS loud, coalesce(max(level) FILTER (WHERE state = 'error'), 0) > 0 AS hangup FROM windows GROUP BY 1")
def icons(s: Source) -> DataFrame:
    return s.view("windows").groupBy("file_id").agg(R(F.max(100 - F.col("level")), 6).alias("quiet"), (F.max(F.abs("vol")) > 95).alias("loud"), (F.coalesce(F.max(F.when(F.col("state") == "error", F.col("level"))), F.lit(0.0)) > 0).alias("hangup"))


@query("X25_agent_export", f"WITH {CALLS}, a AS (SELECT agent_id, count(*) AS n FROM calls WHERE status = 'F' GROUP BY 1) SELECT agent_id, CAST(round_even(avg(score) * 10, 0) AS INT) AS score, any_value(coalesce(n, 0)) AS affected FROM calls LEFT JOIN a USING (agent_id) GROUP BY 1")
def agent_export(s: Source) -> DataFrame:
    return s.view("calls").groupBy("agent_id").agg(F.bround(F.avg("score") * 10, 0).cast("int").alias("score"), F.count_if(F.col("status") == "F").alias("affected"))


#: Weights of the time bin, the place in the call and the label's frequency (a start of the reference's search), and the edges of places.
ALPHA, BETA, GAMMA = 0.5, 0.5, 0.1
REL_BINS = (0.10, 0.20, 0.35, 0.50, 0.65, 0.80)
FUSED = f"""WITH {TOP}, y0 AS (SELECT *, CASE WHEN start_s <= 20 THEN 'early' ELSE 'late' END AS bin, start_s / max(end_s) OVER (PARTITION BY call_id) AS place FROM call_topics),
x AS (SELECT *, {' + '.join(f'CAST(place >= {e} AS INT)' for e in REL_BINS)} AS rel FROM y0), t AS (SELECT * FROM (VALUES {', '.join(f"('{t}', {k})" for k, t in enumerate(SCRIPT_ORDER))}) v(topic, k)),
c AS (SELECT label AS cand, k, count(*) AS n_of, sum(count(*)) OVER () AS n_all FROM x JOIN t ON topic = label GROUP BY label, k), nb AS (SELECT label AS cand, bin, count(*) AS n_bin FROM x GROUP BY 1, 2), nr AS (SELECT label AS cand, rel, count(*) AS n_rel FROM x GROUP BY 1, 2),
s AS (SELECT ordinal, bin, rel, any_value(label) AS label, count(*) AS n FROM x GROUP BY 1, 2, 3),
e AS (SELECT s.ordinal, s.bin, s.rel, s.label, s.n, cand, ln(CASE WHEN k = ordinal THEN 0.4::DOUBLE ELSE 0.6::DOUBLE / 13 END) AS lp, ln((coalesce(n_bin, 0) + 1.0::DOUBLE) / (n_of + 2)) AS tp, ln((coalesce(n_rel, 0) + 1.0::DOUBLE) / (n_of + {len(REL_BINS) + 1})) AS rp, ln(n_of::DOUBLE / n_all) AS yp FROM s CROSS JOIN c LEFT JOIN nb USING (cand, bin) LEFT JOIN nr USING (cand, rel))"""


@query("M02_time_fusion", f"{FUSED}, w AS (SELECT *, exp(lp + {ALPHA} * tp + {BETA} * rp + {GAMMA} * yp) AS w FROM e), p AS (SELECT ordinal, bin, rel, cand, round(w / sum(w) OVER (PARTITION BY ordinal, bin, rel), 6) AS p FROM w) SELECT call_id, line, part_id, supp_id, price, cand, p FROM x JOIN p USING (ordinal, bin, rel)")
def time_fusion(s: Source) -> DataFrame:
    """Text, time bin, place in the call and label frequency, log-linear, normalised over the labels, for all calls."""
    keys = ["call_id", "line", "part_id", "supp_id", "price"]
    w = F.exp(F.col("lp") + ALPHA * F.col("tp") + BETA * F.col("rp") + GAMMA * F.col("yp"))
    shares = evidence(s).withColumn("w", w).withColumn("p", R(F.col("w") / F.sum("w").over(Window.partitionBy("ordinal", "bin", "rel")), 6)).select("ordinal", "bin", "rel", "cand", "p")
    return placed(s).join(F.broadcast(shares), ["ordinal", "bin", "rel"]).select(*keys, "cand", "p")


def placed(s: Source) -> DataFrame:
    """Topics of calls with their time bin and the bin of their place in the call."""
    place = F.col("start_s") / F.max("end_s").over(Window.partitionBy("call_id"))
    rel = sum(((F.col("place") >= e).cast("int") for e in REL_BINS), F.lit(0))
    return s.view("call_topics").withColumn("bin", F.when(F.col("start_s") <= 20, "early").otherwise("late")).withColumn("place", place).withColumn("rel", rel)


def evidence(s: Source) -> DataFrame:
    """For each ordinal, bin and place that occur, n of them, and each label's log-probabilities: lp of the text, tp of the bin, rp of the place, yp of the label; Laplace's smoothing."""
    n = placed(s).groupBy("label", "ordinal", "bin", "rel").agg(F.count("*").alias("n"))
    share = lambda by, of, kinds: F.ln((by + 1.0) / (of + kinds))
    labels = n.groupBy(F.col("label").alias("cand")).agg(F.sum("n").alias("of"))
    labels = labels.crossJoin(F.broadcast(labels.agg(F.sum("of").alias("all")))).select("cand", "of", F.ln(F.col("of") / F.col("all")).alias("yp"))
    count = lambda c: n.groupBy(F.col("label").alias("cand"), c).agg(F.sum("n").alias(f"n_{c}"))
    topics = s.spark.createDataFrame([(t, k) for k, t in enumerate(SCRIPT_ORDER)], "cand string, k int")
    x = n.groupBy("ordinal", "bin", "rel").agg(F.first("label").alias("label"), F.sum("n").alias("n")).crossJoin(F.broadcast(labels.join(topics, "cand")))
    x = x.join(count("bin"), ["cand", "bin"], "left").join(count("rel"), ["cand", "rel"], "left").fillna(0, ["n_bin", "n_rel"])
    text = F.ln(F.when(F.col("k") == F.col("ordinal"), 0.4).otherwise(0.6 / 13))
    return x.select("ordinal", "label", "bin", "rel", "n", "cand", "yp", text.alias("lp"), share(F.col("n_bin"), F.col("of"), 2).alias("tp"), share(F.col("n_rel"), F.col("of"), len(REL_BINS) + 1).alias("rp"))


GRID = (0.0, 0.5, 1.0, 4.0)


@query("M05_weight_search", f"""{FUSED}, g AS (SELECT a.w AS alpha, b.w AS beta, c.w AS gamma FROM (VALUES {', '.join(f'({w}::DOUBLE)' for w in GRID)}) a(w), (VALUES {', '.join(f'({w}::DOUBLE)' for w in GRID)}) b(w), (VALUES {', '.join(f'({w}::DOUBLE)' for w in GRID)}) c(w)),
b AS (SELECT alpha, beta, gamma, label, ordinal, bin, rel, n, arg_max(cand, (round(lp + alpha * tp + beta * rp + gamma * yp, 9), cand)) AS said FROM e, g GROUP BY ALL),
u AS (SELECT alpha, beta, gamma, label AS y, n, CASE WHEN said = label THEN n ELSE 0 END AS hit FROM b UNION ALL SELECT alpha, beta, gamma, said, n, 0 FROM b), f AS (SELECT alpha, beta, gamma, round(avg(f1), 6) AS macro_f1 FROM (SELECT alpha, beta, gamma, y, 2.0 * sum(hit) / sum(n) AS f1 FROM u GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT alpha, beta, gamma, macro_f1, row_number() OVER (ORDER BY macro_f1 DESC, alpha, beta, gamma) = 1 AS best FROM f""")
def weight_search(s: Source) -> DataFrame:
    """Macro F1 at every point of a grid of (alpha, beta, gamma), and which is best (of equals the least weights); rows of the same evidence are one with a count."""
    x = evidence(s)
    for w in WEIGHTS:
        x = x.withColumn(w, F.explode(F.array(*map(F.lit, GRID))))
    f1 = macro_f1(x)
    top = f1.agg(F.min_by(F.struct(*WEIGHTS), F.struct(-F.col("macro_f1"), *WEIGHTS)).alias("top"))
    return f1.crossJoin(F.broadcast(top)).select(*WEIGHTS, "macro_f1", (F.struct(*WEIGHTS) == F.col("top")).alias("best"))


WEIGHTS = ("alpha", "beta", "gamma")


def macro_f1(x: DataFrame) -> DataFrame:
    """Evidence with weights beside it: the weights and the macro F1 that they give."""
    total = F.round(F.col("lp") + F.col("alpha") * F.col("tp") + F.col("beta") * F.col("rp") + F.col("gamma") * F.col("yp"), 9)
    b = x.groupBy(*WEIGHTS, "label", "ordinal", "bin", "rel", "n").agg(F.max_by("cand", F.struct(total, "cand")).alias("said"))
    hit = F.when(F.col("said") == F.col("label"), F.col("n")).otherwise(0)
    both = b.select(*WEIGHTS, F.explode(F.array(F.struct(F.col("label").alias("y"), "n", hit.alias("hit")), F.struct(F.col("said").alias("y"), "n", F.lit(0).cast("long").alias("hit")))).alias("t"))
    return both.groupBy(*WEIGHTS, "t.y").agg((2 * F.sum("t.hit") / F.sum("t.n")).alias("f1")).groupBy(*WEIGHTS).agg(R(F.avg("f1"), 6).alias("macro_f1"))


#: Where the simplex search starts.
STARTS = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 0.0, 1.0), (2.0, 0.0, 0.0), (0.0, 2.0, 0.5))


@query("M05b_simplex_search")
def simplex_search(s: Source) -> DataFrame:
    """The weights that a simplex search reaches from each start, their macro F1, and which are best; the evidence is written once, and each step's points are scored in one job. Runs these jobs."""
    from voxlake.ml import simplex

    x = written(evidence(s))

    def score(points: np.ndarray) -> np.ndarray:
        distinct = sorted({tuple(map(float, p)) for p in points})
        asked = F.explode(F.array(*(F.struct(*(F.lit(v).alias(w) for v, w in zip(p, WEIGHTS, strict=True))) for p in distinct)))
        found = {tuple(r[w] for w in WEIGHTS): r.macro_f1 for r in macro_f1(x.withColumn("__w", asked).select("*", "__w.*").drop("__w")).collect()}
        return np.array([found.get(tuple(map(float, p)), 0.0) for p in points])

    rows = simplex.maximised(score, STARTS)
    best = max(rows, key=lambda r: (r.value, -r.start)).start
    return s.spark.createDataFrame([(r.start, *r.point, r.value, r.steps, r.start == best) for r in rows], "start int, alpha double, beta double, gamma double, macro_f1 double, steps int, best boolean")


@query("M06_feedback", "SELECT doc_id, 'topic_' || lang AS label FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND lang IN ('en', 'es')")
def feedback(s: Source) -> DataFrame:
    known = s.spark.createDataFrame([("en", "topic_en"), ("es", "topic_es")], "lang string, label string")
    return s.table("labels").where("quality = 1").join(s.table("documents").select("doc_id", "lang"), "doc_id").join(F.broadcast(known), "lang").select("doc_id", "label")


__all__ = ["EVALUATE", "class_report"]
