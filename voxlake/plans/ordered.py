"""Windows, runs, sessions and other order-dependent operators (W)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import calibrate
from voxlake.operators import ordered as O
from voxlake.operators import sequential
from voxlake.plans.aggregates import R
from voxlake.plans.registry import Source, query
from voxlake.views import ctes

WIN, UTT, TOP = ctes("windows"), ctes("utterances"), ctes("call_topics")
EVENT = ["ts", "event_id"]
LINE = ["line", "part_id", "supp_id", "price"]
ON = "OVER (PARTITION BY file_id ORDER BY ts, event_id)"
ONC = "OVER (PARTITION BY call_id ORDER BY line, part_id, supp_id, price)"


def by_file():
    return Window.partitionBy("file_id").orderBy(*EVENT)


def by_call():
    return Window.partitionBy("call_id").orderBy(*LINE)


@query("W01_turn_index", f"WITH {TOP} SELECT call_id, line, part_id, supp_id, price, row_number() {ONC} - 1 AS turn_idx FROM call_topics")
def turn_index(s: Source) -> DataFrame:
    return s.view("call_topics").select("call_id", *LINE, (F.row_number().over(by_call()) - 1).cast("long").alias("turn_idx"))


@query("W02_relative_time", f"WITH {WIN} SELECT event_id, round(least(greatest(second_of_day * 1.0 / nullif(max(second_of_day) OVER (PARTITION BY file_id, day), 0), 0), 1), 8) AS rel FROM windows")
def relative_time(s: Source) -> DataFrame:
    top = F.nullif(F.max("second_of_day").over(Window.partitionBy("file_id", "day")), F.lit(0))
    return s.view("windows").select("event_id", R(F.least(F.greatest(F.col("second_of_day") * F.lit(1.0) / top, F.lit(0.0)), F.lit(1.0))).alias("rel"))


@query("W03_group_count", f"WITH {TOP} SELECT call_id, line, part_id, supp_id, price, count(*) OVER (PARTITION BY call_id) AS n FROM call_topics")
def group_count(s: Source) -> DataFrame:
    return s.view("call_topics").select("call_id", *LINE, F.count("*").over(Window.partitionBy("call_id")).alias("n"))


@query("W04_best_row", f"WITH {TOP} SELECT call_id, label, confidence FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY round(confidence, 6) DESC, line, part_id, supp_id, price) AS rn FROM call_topics) WHERE rn = 1")
def best_row(s: Source) -> DataFrame:
    return O.first_rows(s.view("call_topics"), 1, keys=["call_id"], order=[F.desc(F.round("confidence", 6)), *LINE]).select("call_id", "label", "confidence")


RUNS = f"""WITH {WIN}, a AS (SELECT *, CASE WHEN level > 50 AND coalesce(lag(level) {ON}, 0) <= 50 THEN 1 ELSE 0 END AS new FROM windows), r AS (SELECT *, CASE WHEN level > 50 THEN sum(new) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run_id FROM a)"""


@query("W05_run_ids", f"{RUNS} SELECT event_id, CAST(run_id AS BIGINT) AS run_id FROM r")
def run_ids(s: Source) -> DataFrame:
    return O.run_ids(s.view("windows"), F.col("level") > 50, keys=["file_id"], order=EVENT).select("event_id", F.col("run_id").cast("long").alias("run_id"))


@query("W06_best_run", f"""{RUNS}, t AS (SELECT file_id, run_id, round(sum(level), 6) AS total FROM r WHERE run_id > 0 GROUP BY 1, 2), b AS (SELECT file_id, arg_max(run_id, (total, -run_id)) AS best FROM t GROUP BY 1)
SELECT event_id, CASE WHEN best IS NOT NULL AND run_id = best THEN 'MAC_DEF' ELSE state END AS label FROM r LEFT JOIN b USING (file_id)""")
def best_run(s: Source) -> DataFrame:
    """The run with the largest sum is named; other rows keep their label."""
    x = O.run_ids(s.view("windows"), F.col("level") > 50, keys=["file_id"], order=EVENT)
    x = x.withColumn("total", F.when(F.col("run_id") > 0, F.round(F.sum("level").over(Window.partitionBy("file_id", "run_id")), 6)))
    x = x.withColumn("best", F.max(F.when(F.col("run_id") > 0, F.struct("total", -F.col("run_id")))).over(Window.partitionBy("file_id")))
    hit = (F.col("run_id") > 0) & (F.col("best").getField("col2") == -F.col("run_id"))
    return x.select("event_id", F.when(hit, "MAC_DEF").otherwise(F.col("state")).alias("label"))


@query("W07_collapse_runs", f"""WITH {WIN}, a AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) {ON} AND row_number() {ON} > 1 THEN 1 ELSE 0 END AS new FROM windows), r AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a)
SELECT file_id, CAST(run AS BIGINT) AS run, state, round(avg(level), 8) AS mean, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def collapse(s: Source) -> DataFrame:
    x = O.collapse_runs(s.view("windows"), keys=["file_id"], order=EVENT, value="state", mean="level")
    return x.select("file_id", F.col("run").cast("long").alias("run"), "state", R(F.col("mean")).alias("mean"), "n")


@query("W08_sessions_by_reset", f"""WITH {WIN}, a AS (SELECT *, CASE WHEN lag(second_of_day) {ON} - second_of_day > 3600 THEN 1 ELSE 0 END AS new FROM windows) SELECT event_id, CAST(sum(new) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM a""")
def sessions_by_reset(s: Source) -> DataFrame:
    x = O.sessions_by_reset(s.view("windows"), "second_of_day", keys=["file_id"], order=EVENT, drop=3600, name="session")
    return x.select("event_id", F.col("session").cast("long").alias("session"))


@query("W09_split_at_zero", f"WITH {TOP}, a AS (SELECT *, CASE WHEN part_id % 5 = 0 THEN 1 ELSE 0 END AS z FROM call_topics) SELECT call_id, line, part_id, supp_id, price, CAST(sum(z) OVER (PARTITION BY call_id ORDER BY line, part_id, supp_id, price ROWS UNBOUNDED PRECEDING) AS BIGINT) AS part FROM a")
def split_at_zero(s: Source) -> DataFrame:
    return s.view("call_topics").select("call_id", *LINE, F.sum((F.col("part_id") % 5 == 0).cast("long")).over(by_call().rowsBetween(Window.unboundedPreceding, 0)).alias("part"))


@query("W10_word_windows", f"""WITH {UTT} SELECT call_id, turn, CAST(k AS INT) AS start, array_to_string(words[k + 1:k + 14], ' ') AS text FROM (SELECT *, unnest(range(0, greatest(num_words - 14, 0) + 1, 6)) AS k FROM utterances WHERE num_words > 0)""")
def word_windows(s: Source) -> DataFrame:
    return O.word_windows(s.view("utterances"), "words", size=14, step=6, tail=False).select("call_id", "turn", F.col("window_start").alias("start"), F.array_join("window_words", " ").alias("text"))


@query("W10b_word_windows_tail", f"""WITH {UTT}, k AS (SELECT *, unnest(list_distinct(list_append(range(0, greatest(num_words - 18, 0) + 1, 6), greatest(num_words - 18, 0)))) AS k FROM utterances WHERE num_words > 0) SELECT call_id, turn, CAST(k AS INT) AS start, CAST(len(words[k + 1:k + 18]) AS INT) AS n FROM k""")
def word_windows_tail(s: Source) -> DataFrame:
    return O.word_windows(s.view("utterances"), "words", size=18, step=6, tail=True).select("call_id", "turn", F.col("window_start").alias("start"), F.size("window_words").alias("n"))


@query("W11_window_level", f"WITH {WIN} SELECT file_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, round(10 * log10(avg(level * level) + 1e-12), 6) + 0.0 AS db FROM windows GROUP BY 1, 2")
def window_level(s: Source) -> DataFrame:
    """Power level over fixed windows of time."""
    g = s.view("windows").groupBy("file_id", F.window("ts", "1 hour").alias("w")).agg(F.avg(F.col("level") * F.col("level")).alias("p"))
    return g.select("file_id", F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), R(10 * F.log10(F.col("p") + 1e-12), 6).alias("db"))


@query("W12_window_rate", f"""WITH {UTT}, m AS (SELECT call_id, CAST(floor((start_s + end_s) / 2 / 10) AS BIGINT) AS t, num_words, end_s - start_s AS d FROM utterances WHERE num_words > 0) SELECT call_id, t, round(sum(num_words) / sum(d) * 60, 6) AS wpm, CAST(sum(num_words) AS BIGINT) AS words FROM m GROUP BY 1, 2""")
def window_rate(s: Source) -> DataFrame:
    """Words a minute of the sentences whose middle lies in the window; windows align, so a range join is a division."""
    u = s.view("utterances").where("num_words > 0").withColumn("t", F.floor((F.col("start_s") + F.col("end_s")) / 2 / 10))
    return u.groupBy("call_id", "t").agg(R(F.sum("num_words") / F.sum(F.col("end_s") - F.col("start_s")) * 60, 6).alias("wpm"), F.sum("num_words").alias("words"))


@query("W13_bounded_fill", f"""WITH {WIN}, n AS (SELECT *, row_number() {ON} AS i, CASE WHEN state = 'click' THEN level END AS v FROM windows), h AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS src FROM n)
SELECT h.event_id, round(CASE WHEN h.i - h.src < greatest(ceil(q.level / 20), 1) THEN q.v ELSE 0 END, 8) AS filled FROM h LEFT JOIN n q ON q.file_id = h.file_id AND q.i = h.src""")
def bounded_fill(s: Source) -> DataFrame:
    w = s.view("windows").withColumn("v", F.when(F.col("state") == "click", F.col("level"))).withColumn("reach", F.col("level") / 20)
    return O.bounded_fill(w, "v", "reach", keys=["file_id"], order=EVENT, name="filled").select("event_id", R(F.col("filled")).alias("filled"))


@query("W14_relative_change", f"WITH {WIN} SELECT event_id, round((level - lag(level) {ON}) / (level + 1), 8) AS change, row_number() OVER (PARTITION BY file_id ORDER BY ts DESC, event_id DESC) <= 8 AS in_tail FROM windows")
def relative_change(s: Source) -> DataFrame:
    late = Window.partitionBy("file_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return s.view("windows").select("event_id", R((F.col("level") - F.lag("level").over(by_file())) / (F.col("level") + 1)).alias("change"), (F.row_number().over(late) <= 8).alias("in_tail"))


@query("W15_longest_silence", f"""WITH {TOP}, g AS (SELECT call_id, start_s, lag(end_s) {ONC} AS before, line, part_id, supp_id FROM call_topics), b AS (SELECT call_id, arg_max((before, start_s), (start_s - before, -line, -part_id)) AS g FROM g WHERE start_s > before GROUP BY 1)
SELECT c.call_id, coalesce(g[2] - g[1], 0) AS silence, g[1] AS from_s, g[2] AS to_s, coalesce(g[2] - g[1], 0) > 60 AS exceeded FROM (SELECT DISTINCT call_id FROM call_topics) c LEFT JOIN (SELECT call_id, [g[1], g[2]] AS g FROM b) b USING (call_id)""")
def longest_silence(s: Source) -> DataFrame:
    """The largest gap to the end of the row before, and its bounds."""
    x = s.view("call_topics").withColumn("before", F.lag("end_s").over(by_call()))
    gap = F.when(F.col("start_s") > F.col("before"), F.struct((F.col("start_s") - F.col("before")).alias("d"), -F.col("line"), -F.col("part_id"), F.col("before").alias("a"), F.col("start_s").alias("b")))
    g = x.groupBy("call_id").agg(F.max(gap).alias("g"))
    return g.select("call_id", F.coalesce("g.d", F.lit(0.0)).alias("silence"), F.col("g.a").alias("from_s"), F.col("g.b").alias("to_s"), (F.coalesce("g.d", F.lit(0.0)) > 60).alias("exceeded"))


_K = [float(np.exp(-0.5 * k * k)) for k in (-3, -2, -1, 0, 1, 2, 3)]
_TAPS = " + ".join(f"{x / sum(_K)!r} * " + ("level" if k == 0 else f"coalesce({'lag' if k < 0 else 'lead'}(level, {abs(k)}) {ON}, {'first' if k < 0 else 'last'}_value(level) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))") for k, x in zip(range(-3, 4), _K, strict=True))


@query("W16_gaussian", f"WITH {WIN} SELECT event_id, round({_TAPS}, 6) AS smooth FROM windows")
def gaussian(s: Source) -> DataFrame:
    return O.gaussian(s.view("windows"), "level", sigma=1.0, radius=3, keys=["file_id"], order=EVENT, name="smooth").select("event_id", R(F.col("smooth"), 6).alias("smooth"))


@query("W17_interpolate", """WITH g AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, avg(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT user_id, unnest(range(min(d), max(d) + 1)) AS d FROM g GROUP BY 1), j AS (SELECT x.user_id, x.d, v FROM x LEFT JOIN g USING (user_id, d)),
k AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN d END) OVER (PARTITION BY user_id ORDER BY d) AS a, min(CASE WHEN v IS NOT NULL THEN d END) OVER (PARTITION BY user_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM j)
SELECT k.user_id, k.d, round(coalesce(k.v, ga.v + (gb.v - ga.v) * (k.d - k.a) / nullif(k.b - k.a, 0)), 6) AS v FROM k LEFT JOIN g ga ON ga.user_id = k.user_id AND ga.d = k.a LEFT JOIN g gb ON gb.user_id = k.user_id AND gb.d = k.b""")
def interpolated(s: Source) -> DataFrame:
    g = s.table("events").groupBy("user_id", F.floor(F.unix_timestamp("ts") / 86400).alias("d")).agg(F.avg("value").alias("v"))
    x = g.groupBy("user_id").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).select("user_id", F.explode(F.sequence("lo", "hi")).alias("d"))
    return O.interpolate(x.join(g, ["user_id", "d"], "left"), "d", "v", keys=["user_id"], name="w").select("user_id", "d", R(F.col("w"), 6).alias("v"))


@query("W18_majority_smoothing", f"WITH {WIN}, w AS (SELECT event_id, list(state) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS w FROM windows), u AS (SELECT event_id, unnest(w) AS v, unnest(range(0, len(w))) AS k FROM w), c AS (SELECT event_id, v, count(*) AS n, min(k) AS k FROM u GROUP BY 1, 2) SELECT event_id, arg_max(v, (n, -k)) AS smooth FROM c GROUP BY 1")
def majority(s: Source) -> DataFrame:
    return sequential.smoothed(s.view("windows").select("file_id", "ts", "event_id", "state"), "state", keys="file_id", order=EVENT, reach=2).select("event_id", "smooth")


@query("W19_merge_by_gap", f"""WITH {TOP}, a AS (SELECT call_id, start_s, end_s, CASE WHEN start_s - max(end_s) OVER (PARTITION BY call_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 2 THEN 1 ELSE 0 END AS new FROM call_topics), b AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT call_id, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n FROM b GROUP BY call_id, g HAVING max(end_s) - min(start_s) >= 5""")
def merged(s: Source) -> DataFrame:
    """Spans merged over gaps of at most 2 s; what stays under 5 s is dropped."""
    return O.merge_by_gap(s.view("call_topics").select("call_id", "start_s", "end_s"), "start_s", "end_s", keys=["call_id"], gap=2.0).where("end_s - start_s >= 5")


HYST = f"WITH {WIN}, h AS (SELECT *, coalesce(last_value(CASE WHEN level >= 60 THEN 1 WHEN level < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS active FROM windows)"


@query("W20_hysteresis", f"{HYST} SELECT event_id, active FROM h")
def hysteresis(s: Source) -> DataFrame:
    return O.hysteresis(s.view("windows"), "level", on=60, off=20, keys=["file_id"], order=EVENT).select("event_id", "active")


@query("W21_minimum_runs", f"""{HYST}, a AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) {ON}, 0) = 0 THEN 1 ELSE 0 END AS new FROM h), r AS (SELECT *, CASE WHEN active = 1 THEN sum(new) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM a),
m AS (SELECT *, CASE WHEN run > 0 AND count(*) OVER (PARTITION BY file_id, run) >= 3 THEN 1 ELSE 0 END AS kept FROM r) SELECT event_id, kept, CASE WHEN avg(kept) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 0.5 THEN 1 ELSE 0 END AS smooth FROM m""")
def minimum_runs(s: Source) -> DataFrame:
    """Runs of under three rows go; then a majority of each row and its neighbours."""
    h = O.hysteresis(s.view("windows"), "level", on=60, off=20, keys=["file_id"], order=EVENT)
    k = O.enforce_min_run(h, "active", 3, keys=["file_id"], order=EVENT, name="kept")
    return k.select("event_id", "kept", F.when(F.avg("kept").over(by_file().rowsBetween(-1, 1)) >= 0.5, 1).otherwise(0).alias("smooth"))


@query("W22_least_loaded", f"""WITH RECURSIVE {ctes('calls')}, p AS (SELECT campaign_id, count(*) AS files, row_number() OVER (ORDER BY count(*) DESC, campaign_id) AS rn FROM calls GROUP BY 1),
g AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS INT) AS campaign_id, CAST(NULL AS BIGINT) AS files, CAST([0, 0, 0, 0] AS BIGINT[]) AS loads, CAST(NULL AS INT) AS bin UNION ALL
SELECT p.rn, p.campaign_id, p.files, list_transform([1, 2, 3, 4], lambda i: loads[i] + CASE WHEN i = list_position(loads, list_min(loads)) THEN p.files ELSE 0 END), CAST(list_position(loads, list_min(loads)) - 1 AS INT) FROM g JOIN p ON p.rn = g.rn + 1)
SELECT campaign_id, files, bin FROM g WHERE rn > 0""")
def least_loaded(s: Source) -> DataFrame:
    plan = s.view("calls").groupBy("campaign_id").agg(F.count("*").alias("files"))
    return sequential.least_loaded(plan, key="campaign_id", size="files", bins=4)


def pass_sql(name: str, source: str) -> str:
    """One pass over items (call_id, i from 1, size): each item's unit, from 0. A unit that is open has its sum in open."""
    back = "CASE WHEN f.open + x.size <= 200 THEN f.open + x.size END"
    ahead = "CASE WHEN x.size + x.following <= 200 THEN x.size + x.following END"
    joins = f"coalesce(x.size < 40 AND ({back}) IS NOT NULL AND (({ahead}) IS NULL OR ({back}) <= ({ahead})), false)"
    takes = f"coalesce(x.size < 40 AND NOT {joins} AND ({ahead}) IS NOT NULL, false)"
    return f"""{name}x AS (SELECT *, lead(size) OVER (PARTITION BY call_id ORDER BY i) AS following FROM {source}),
{name} AS (SELECT call_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS open, CAST(-1 AS BIGINT) AS unit, false AS taken FROM (SELECT DISTINCT call_id FROM {source}) UNION ALL
SELECT x.call_id, x.i, CASE WHEN f.taken THEN f.open WHEN {joins} THEN {back} WHEN {takes} THEN {ahead} ELSE x.size END, f.unit + CASE WHEN f.taken OR {joins} THEN 0 ELSE 1 END, NOT f.taken AND {takes} FROM {name} f JOIN {name}x x ON x.call_id = f.call_id AND x.i = f.i + 1)"""


@query("W23_compact_units", f"""WITH RECURSIVE {UTT}, u AS (SELECT call_id, turn, num_words, row_number() OVER (PARTITION BY call_id ORDER BY turn) AS i, CAST(num_words AS BIGINT) AS size FROM utterances WHERE num_words BETWEEN 1 AND 200),
{pass_sql('one', 'u')}, g AS (SELECT call_id, unit + 1 AS i, CAST(sum(size) AS BIGINT) AS size FROM one JOIN u USING (call_id, i) GROUP BY 1, 2), {pass_sql('two', 'g')}
SELECT call_id, turn, num_words, CAST(two.unit AS INTEGER) AS unit FROM u JOIN one USING (call_id, i) JOIN two ON two.call_id = u.call_id AND two.i = one.unit + 1""")
def compact_units(s: Source) -> DataFrame:
    """Two passes that join short rows to the neighbour that gives the smaller sum, under a hard cap."""
    return sequential.compacted(s.view("utterances").select("call_id", "turn", "num_words"), "num_words", keys="call_id", order="turn", least=40, most=200)


@query("W24_merge_short", f"""WITH {UTT}, u AS (SELECT call_id, turn, start_s, end_s, coalesce(speaker, -1) AS speaker, num_words FROM utterances),
c AS (SELECT *, coalesce(lag(speaker) OVER w = speaker AND start_s - lag(end_s) OVER w <= 1, false) AS near FROM u WINDOW w AS (PARTITION BY call_id ORDER BY start_s, end_s, turn)),
j AS (SELECT *, num_words < 20 AND near AS back, num_words < 20 AND NOT near AND coalesce(lead(near) OVER (PARTITION BY call_id ORDER BY start_s, end_s, turn), false) AS fore FROM c),
n AS (SELECT *, CASE WHEN back OR coalesce(lag(fore) OVER (PARTITION BY call_id ORDER BY start_s, end_s, turn), false) THEN 0 ELSE 1 END AS new FROM j)
SELECT call_id, turn, start_s, end_s, speaker, num_words, CAST(sum(new) OVER (PARTITION BY call_id ORDER BY start_s, end_s, turn ROWS UNBOUNDED PRECEDING) - 1 AS INT) AS unit FROM n""")
def merge_short(s: Source) -> DataFrame:
    u = s.view("utterances").select("call_id", "turn", "start_s", "end_s", F.coalesce("speaker", F.lit(-1)).alias("speaker"), "num_words")
    return sequential.merged_short(u, keys="call_id", start="start_s", end="end_s", speaker="speaker", words="num_words", least=20, gap=1.0, order=["start_s", "end_s", "turn"])


@query("W25_merge_speaker", f"""WITH {TOP}, a AS (SELECT *, CASE WHEN row_number() {ONC} > 1 AND (supp_id % 2 <> lag(supp_id % 2) {ONC} OR start_s - lag(end_s) {ONC} > 5) THEN 1 ELSE 0 END AS new FROM call_topics), b AS (SELECT *, sum(new) OVER (PARTITION BY call_id ORDER BY line, part_id, supp_id, price ROWS UNBOUNDED PRECEDING) AS g FROM a)
SELECT call_id, CAST(g AS BIGINT) AS unit, min(start_s) AS start_s, max(end_s) AS end_s, string_agg(CAST(part_id AS VARCHAR), ' ' ORDER BY line, part_id, supp_id, price) AS text FROM b GROUP BY 1, 2""")
def merge_speaker(s: Source) -> DataFrame:
    speaker = F.col("supp_id") % 2
    changed = (speaker != F.lag(speaker).over(by_call())) | (F.col("start_s") - F.lag("end_s").over(by_call()) > 5)
    x = O.change_ids(s.view("call_topics"), changed, keys=["call_id"], order=LINE, name="g")
    rows = F.array_sort(F.collect_list(F.struct(*LINE)))
    return x.groupBy("call_id", F.col("g").cast("long").alias("unit")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.array_join(F.transform(rows, lambda r: r.part_id.cast("string")), " ").alias("text"))


@query("W26_split_units", f"WITH {UTT} SELECT call_id, turn, CAST(k AS INT) AS start, array_to_string(words[k + 1:k + 50], ' ') AS text FROM (SELECT *, unnest(range(0, num_words, 50)) AS k FROM utterances WHERE num_words > 0)")
def split_units(s: Source) -> DataFrame:
    u = s.view("utterances").where("num_words > 0").withColumn("start", F.explode(F.sequence(F.lit(0), F.col("num_words") - 1, F.lit(50))))
    return u.select("call_id", "turn", "start", F.array_join(F.slice("words", F.col("start") + 1, 50), " ").alias("text"))


@query("W27_chunks_of_rows", f"WITH {WIN} SELECT event_id, CAST(floor((row_number() {ON} - 1) / 70) AS BIGINT) AS chunk, (row_number() {ON} - 1) % 70 AS local_idx FROM windows")
def chunks_of_rows(s: Source) -> DataFrame:
    n = (F.row_number().over(by_file()) - 1).cast("long")
    return s.view("windows").select("event_id", F.floor(n / 70).alias("chunk"), (n % 70).alias("local_idx"))


@query("W28_latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_per_key(s: Source) -> DataFrame:
    return O.first_rows(s.table("events"), 1, keys=["user_id"], order=[F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("W29_second_best", f"""WITH {TOP}, n AS (SELECT *, row_number() {ONC} - 1 AS turn FROM call_topics) SELECT call_id, line, part_id, supp_id, price, CASE WHEN label = 'SALUDO' AND turn > 3 OR label = 'DESPEDIDA' AND turn < 2 THEN CASE WHEN part_id % 3 >= supp_id % 3 THEN 'MAC' ELSE 'PRECIO' END ELSE label END AS label FROM n""")
def second_best(s: Source) -> DataFrame:
    """A greeting that comes late, or a farewell that comes early, takes the next label by probability."""
    n = s.view("call_topics").withColumn("turn", F.row_number().over(by_call()) - 1)
    ranked = F.array_sort(F.array(F.struct(F.lit(-9).cast("long").alias("p"), F.lit(0).alias("o"), F.col("label").alias("l")), F.struct((-(F.col("part_id") % 3)).alias("p"), F.lit(1).alias("o"), F.lit("MAC").alias("l")), F.struct((-(F.col("supp_id") % 3)).alias("p"), F.lit(2).alias("o"), F.lit("PRECIO").alias("l"))))
    odd = ((F.col("label") == "SALUDO") & (F.col("turn") > 3)) | ((F.col("label") == "DESPEDIDA") & (F.col("turn") < 2))
    return n.select("call_id", *LINE, F.when(odd, ranked[1].l).otherwise(F.col("label")).alias("label"))


@query("W30_viterbi", f"""WITH RECURSIVE {WIN}, w AS (SELECT file_id, event_id, row_number() OVER (PARTITION BY file_id ORDER BY event_id) AS n, ln(greatest(least(level / 100, 0.99), 1e-12)) AS ea, ln(greatest(1 - least(level / 100, 0.99), 1e-12)) AS eb FROM windows),
f AS (SELECT file_id, n, ln(0.5) + ea AS a, ln(0.5) + eb AS b, 0 AS pa, 0 AS pb FROM w WHERE n = 1 UNION ALL SELECT w.file_id, w.n, greatest(f.a + ln(0.8), f.b + ln(0.3)) + ea, greatest(f.a + ln(0.2), f.b + ln(0.7)) + eb,
CASE WHEN f.a + ln(0.8) >= f.b + ln(0.3) THEN 0 ELSE 1 END, CASE WHEN f.a + ln(0.2) >= f.b + ln(0.7) THEN 0 ELSE 1 END FROM f JOIN w ON w.file_id = f.file_id AND w.n = f.n + 1), z AS (SELECT *, max(n) OVER (PARTITION BY file_id) AS last FROM f),
t AS (SELECT file_id, n, CASE WHEN a >= b THEN 0 ELSE 1 END AS l, pa, pb FROM z WHERE n = last UNION ALL SELECT f.file_id, f.n, CASE WHEN t.l = 0 THEN t.pa ELSE t.pb END, f.pa, f.pb FROM t JOIN f ON f.file_id = t.file_id AND f.n = t.n - 1)
SELECT file_id, event_id, CASE l WHEN 0 THEN 'loud' ELSE 'quiet' END AS label FROM t JOIN w USING (file_id, n)""")
def viterbi(s: Source) -> DataFrame:
    w = s.view("windows").withColumn("p", F.least(F.col("level") / 100, F.lit(0.99)))
    e = w.select("file_id", "event_id", F.array(F.col("p"), 1 - F.col("p")).alias("e"))
    move = np.log(np.array([[0.8, 0.2], [0.3, 0.7]]))
    return sequential.viterbi(e, keys="file_id", order="event_id", column="e", labels=["loud", "quiet"], transition=move, start=np.log(np.array([0.5, 0.5])), probabilities=True)


@query("W31_max_normalised", f"WITH {ctes('calls')} SELECT call_id, round(score / max(score) OVER (), 8) AS share, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 8) AS scaled FROM calls")
def max_normalised(s: Source) -> DataFrame:
    """Extremes are one broadcast row, so no window gathers all rows."""
    c = s.view("calls").select("call_id", "score")
    x = c.crossJoin(F.broadcast(c.agg(F.max("score").alias("hi"), F.min("score").alias("lo"))))
    return x.select("call_id", R(F.col("score") / F.col("hi")).alias("share"), R((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("scaled"))


@query("W32_forward_fill", f"WITH {WIN} SELECT event_id, coalesce(last_value(CASE WHEN state = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), -1) AS source FROM windows")
def forward_fill(s: Source) -> DataFrame:
    last = F.last(F.when(F.col("state") == "view", F.col("event_id")), ignorenulls=True).over(by_file().rowsBetween(Window.unboundedPreceding, 0))
    return s.view("windows").select("event_id", F.coalesce(last, F.lit(-1)).alias("source"))


@query("W33_first_appearance_codes", "SELECT p_partkey, c.code FROM part JOIN (SELECT p_type, row_number() OVER (ORDER BY min(p_partkey)) - 1 AS code FROM part GROUP BY 1) c USING (p_type)")
def first_appearance(s: Source) -> DataFrame:
    """Codes by first appearance: how many values appear earlier, counted in ranges of first places."""
    p = s.table("part").select("p_partkey", "p_type")
    first = p.groupBy("p_type").agg(F.min("p_partkey").alias("f"))
    codes = first.join(calibrate.counts_below(first, "f"), "f").select("p_type", F.col("below").cast("long").alias("code"))
    return p.join(codes, "p_type").select("p_partkey", "code")
