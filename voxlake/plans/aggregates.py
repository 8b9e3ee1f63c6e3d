"""Roll-ups of calls, topics, agents, campaigns and sponsors (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import calibrate, merge
from voxlake.plans.registry import Source, query
from voxlake.views import SCRIPT_ORDER, ctes

R = lambda c, n=8: F.round(c, n) + F.lit(0.0)  # noqa: E731  no negative zeros


def quality_base(s: Source) -> DataFrame:
    """Calls with the latest affected row per call and the latest dialer row per agent slot (W28, J11)."""
    affected = merge.latest(s.view("affected"), keys=["call_id"], order=[F.desc("line"), "part_id", "supp_id", "price"]).select("call_id", "summary_rejection")
    dialer = merge.latest(s.view("dialer"), keys=["user_id"], order=[F.desc("ts"), F.desc("event_id")]).select("user_id", "vici_status")
    calls = s.view("calls").withColumn("user_id", F.col("agent_id") % 150)
    return calls.join(affected, "call_id", "left").join(dialer, "user_id", "left")


BASE = f"""WITH {ctes("calls", "affected", "dialer")},
a1 AS (SELECT call_id, summary_rejection FROM (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY line DESC, part_id, supp_id, price) AS rn FROM affected) WHERE rn = 1),
d1 AS (SELECT user_id, vici_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM dialer) WHERE rn = 1),
base AS (SELECT calls.*, a1.summary_rejection, d1.vici_status FROM calls LEFT JOIN a1 ON a1.call_id = calls.call_id LEFT JOIN d1 ON d1.user_id = calls.agent_id % 150)"""


def starts(column: str, prefix: str):
    return F.upper(F.coalesce(column, F.lit(""))).startswith(prefix)


def level(share, high: float = 95.0, low: float = 90.0):
    return F.when(share > high, "NORMAL").when(share >= low, "REVIEW").otherwise("CRITICAL")


@query("A07_campaign_quality", f"""{BASE}, g AS (SELECT campaign_id, count(*) AS processed, count(*) FILTER (WHERE upper(coalesce(summary_rejection, '')) <> 'NO AUDITABLE') AS audited,
count(*) FILTER (WHERE upper(coalesce(vici_status, '')) LIKE 'V%') AS sales, count(*) FILTER (WHERE upper(coalesce(vici_status, '')) LIKE 'AUD%') AS rejections FROM base GROUP BY campaign_id)
SELECT campaign_id, processed, audited, round(audited * 100.0 / processed, 2) AS audited_pct, sales, round(sales * 100.0 / processed, 2) AS sales_pct, rejections, CASE WHEN sales * 100.0 / processed > 95 THEN 'NORMAL' WHEN sales * 100.0 / processed >= 90 THEN 'REVIEW' ELSE 'CRITICAL' END AS level FROM g""")
def campaign_quality(s: Source) -> DataFrame:
    g = quality_base(s).groupBy("campaign_id").agg(F.count("*").alias("processed"), F.count_if(F.upper(F.coalesce("summary_rejection", F.lit(""))) != "NO AUDITABLE").alias("audited"), F.count_if(starts("vici_status", "V")).alias("sales"), F.count_if(starts("vici_status", "AUD")).alias("rejections"))
    share = F.col("sales") * 100.0 / F.col("processed")
    return g.select("campaign_id", "processed", "audited", R(F.col("audited") * 100.0 / F.col("processed"), 2).alias("audited_pct"), "sales", R(share, 2).alias("sales_pct"), "rejections", level(share).alias("level"))


@query("A08_agent_quality", f"""{BASE} SELECT agent_id, campaign_id, count(*) AS calls, count(*) FILTER (WHERE upper(coalesce(vici_status, '')) LIKE 'V%') AS sales, count(*) FILTER (WHERE upper(coalesce(summary_rejection, '')) NOT LIKE '%MAC%') AS macs_ok,
count(*) FILTER (WHERE upper(coalesce(summary_rejection, '')) NOT LIKE '%PRECIO%') AS prices_ok, count(*) FILTER (WHERE trim(coalesce(summary_rejection, '')) <> '') AS critical, round(round_even(count(*) FILTER (WHERE upper(coalesce(vici_status, '')) LIKE 'V%') / count(*), 2) * 100, 2) AS sales_pct FROM base GROUP BY 1, 2""")
def agent_quality(s: Source) -> DataFrame:
    reason = F.upper(F.coalesce("summary_rejection", F.lit("")))
    g = quality_base(s).groupBy("agent_id", "campaign_id").agg(F.count("*").alias("calls"), F.count_if(starts("vici_status", "V")).alias("sales"), F.count_if(~reason.contains("MAC")).alias("macs_ok"), F.count_if(~reason.contains("PRECIO")).alias("prices_ok"), F.count_if(F.trim(reason) != "").alias("critical"))
    return g.withColumn("sales_pct", R(F.bround(F.col("sales") / F.col("calls"), 2) * 100, 2))


@query("A01_call_topics", f"""WITH {ctes("call_topics")} SELECT call_id, label, round(avg(start_s), 8) AS start_s, round(avg(end_s), 8) AS end_s, round(avg(confidence), 8) AS confidence, round(avg(words), 8) AS words, count(*) AS occurrence,
round((avg(start_s) + avg(end_s)) / 2, 8) AS centroid, string_agg(CAST(part_id AS VARCHAR), ' ' ORDER BY line, part_id, supp_id, price) AS parts FROM call_topics GROUP BY 1, 2""")
def call_topics(s: Source) -> DataFrame:
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "part_id", "supp_id", "price"))), lambda x: x.part_id.cast("string")), " ")
    return s.view("call_topics").groupBy("call_id", "label").agg(R(F.avg("start_s")).alias("start_s"), R(F.avg("end_s")).alias("end_s"), R(F.avg("confidence")).alias("confidence"), R(F.avg("words")).alias("words"), F.count("*").alias("occurrence"), R((F.avg("start_s") + F.avg("end_s")) / 2).alias("centroid"), parts.alias("parts"))


@query("A02_topic_statistics", f"""WITH {ctes("call_topics")}, m AS (SELECT max(end_s) AS top FROM call_topics) SELECT label, round(avg(100 * (start_s + end_s) / 2 / top), 8) AS mean_centroid, round(stddev_samp(100 * (start_s + end_s) / 2 / top), 8) AS std_centroid, round(min(100 * (start_s + end_s) / 2 / top), 8) AS min_centroid,
round(max(100 * (start_s + end_s) / 2 / top), 8) AS max_centroid, round(avg(confidence), 8) AS confidence, count(*) AS frequency FROM call_topics, m GROUP BY label""")
def topic_statistics(s: Source) -> DataFrame:
    t = s.view("call_topics")
    c = 100 * (F.col("start_s") + F.col("end_s")) / 2 / F.col("top")
    x = t.crossJoin(F.broadcast(t.agg(F.max("end_s").alias("top")))).withColumn("c", c)
    return x.groupBy("label").agg(R(F.avg("c")).alias("mean_centroid"), R(F.stddev_samp("c")).alias("std_centroid"), R(F.min("c")).alias("min_centroid"), R(F.max("c")).alias("max_centroid"), R(F.avg("confidence")).alias("confidence"), F.count("*").alias("frequency"))


@query("A03_confidence_by_topic", f"""WITH {ctes("call_topics")} SELECT call_id, round(avg(confidence), 8) AS all_rows, round(avg(confidence) FILTER (WHERE label IN ('MAC', 'MAC REFUERZO')), 8) AS mac, round(avg(confidence) FILTER (WHERE label = 'PRECIO'), 8) AS price FROM call_topics GROUP BY call_id""")
def confidence_by_topic(s: Source) -> DataFrame:
    c = F.col("confidence")
    return s.view("call_topics").groupBy("call_id").agg(R(F.avg(c)).alias("all_rows"), R(F.avg(F.when(F.col("label").isin("MAC", "MAC REFUERZO"), c))).alias("mac"), R(F.avg(F.when(F.col("label") == "PRECIO", c))).alias("price"))


@query("A04_array_statistics", "SELECT vec_id, round(list_avg(e), 8) + 0.0 AS mean, round(list_min(e), 8) AS least, round(list_max(e), 8) AS most, round(list_stddev_samp(e), 8) AS std, CAST(len(e) AS INT) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)")
def array_statistics(s: Source) -> DataFrame:
    e = F.col("e")
    mean = F.aggregate(e, F.lit(0.0), lambda a, x: a + x) / F.size(e)
    spread = F.sqrt(F.aggregate(e, F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (F.size(e) - 1))
    x = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("m", mean)
    return x.select("vec_id", R(F.col("m")).alias("mean"), R(F.array_min(e)).alias("least"), R(F.array_max(e)).alias("most"), R(spread).alias("std"), F.size(e).alias("n"))


@query("A05_agent_rollup", f"""WITH {ctes("calls")}, m AS (SELECT agent_id, status, count(*) AS n FROM calls GROUP BY 1, 2), k AS (SELECT agent_id, status AS usual_status FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY n DESC, status) AS rn FROM m) WHERE rn = 1),
l AS (SELECT agent_id, priority AS last_priority FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY call_ts DESC, call_id DESC) AS rn FROM calls) WHERE rn = 1)
SELECT agent_id, round(avg(score), 8) AS score, round(sum(tmo_s), 2) AS tmo_s, count(*) AS calls, any_value(usual_status) AS usual_status, any_value(last_priority) AS last_priority FROM calls JOIN k USING (agent_id) JOIN l USING (agent_id) GROUP BY agent_id""")
def agent_rollup(s: Source) -> DataFrame:
    return s.view("calls").groupBy("agent_id").agg(R(F.avg("score")).alias("score"), R(F.sum("tmo_s"), 2).alias("tmo_s"), F.count("*").alias("calls"), F.expr("mode() within group (order by status)").alias("usual_status"), F.max_by("priority", F.struct("call_ts", "call_id")).alias("last_priority"))


@query("A06_topic_means", f"""WITH {ctes("call_topics")}, m AS (SELECT label, words, count(*) AS n FROM call_topics GROUP BY 1, 2), k AS (SELECT label, words AS usual_words FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, words) AS rn FROM m) WHERE rn = 1)
SELECT label, round(avg(words), 8) AS words, round(avg(confidence), 8) AS confidence, any_value(usual_words) AS usual_words FROM call_topics JOIN k USING (label) GROUP BY label""")
def topic_means(s: Source) -> DataFrame:
    return s.view("call_topics").groupBy("label").agg(R(F.avg("words")).alias("words"), R(F.avg("confidence")).alias("confidence"), F.expr("mode() within group (order by words)").alias("usual_words"))


def campaign_kpis(s: Source) -> DataFrame:
    return s.view("calls").groupBy("campaign_id").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "F").alias("rejected"), R(F.avg(F.bround("mac_likelihood", 2) * 100)).alias("mac_pct"), R(F.avg("score")).alias("score"))


KPI = f"""WITH {ctes("calls", "campaigns")}, k AS (SELECT campaign_id, count(*) AS calls, count(*) FILTER (WHERE status = 'F') AS rejected, round(avg(round_even(mac_likelihood, 2) * 100), 8) AS mac_pct, round(avg(score), 8) AS score FROM calls GROUP BY campaign_id)"""


@query("A09_sponsor_kpis", f"{KPI} SELECT sponsor_id, sponsor, round(avg(mac_pct), 8) AS mac_pct, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(rejected) AS BIGINT) AS rejected, round(avg(score), 8) AS score FROM k JOIN campaigns USING (campaign_id) GROUP BY 1, 2")
def sponsor_kpis(s: Source) -> DataFrame:
    return campaign_kpis(s).join(s.view("campaigns"), "campaign_id").groupBy("sponsor_id", "sponsor").agg(R(F.avg("mac_pct")).alias("mac_pct"), F.sum("calls").alias("calls"), F.sum("rejected").alias("rejected"), R(F.avg("score")).alias("score"))


query("A10_campaign_kpis", f"{KPI} SELECT * FROM k")(campaign_kpis)

REASONS = ["NO AUDITABLE", "MAC INCORRECTO", "PRECIO INCORRECTO", "MAC FORZADO"]


@query("A11_report_counters", f"""WITH {ctes("affected")} SELECT supp_id, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE upper(summary_rejection) LIKE '%{r}%') AS n_{k}" for k, r in enumerate(REASONS))} FROM affected GROUP BY supp_id""")
def report_counters(s: Source) -> DataFrame:
    return s.view("affected").groupBy("supp_id").agg(F.count("*").alias("n"), *(F.count_if(F.upper("summary_rejection").contains(r)).alias(f"n_{k}") for k, r in enumerate(REASONS)))


@query("A12_guarded_counts", "SELECT l_returnflag AS flag, count(*) FILTER (WHERE l_linestatus = 'F') AS concat, CAST(0 AS BIGINT) AS recovered FROM lineitem GROUP BY 1")
def guarded_counts(s: Source) -> DataFrame:
    """A counter whose column does not exist is 0."""
    t = s.table("lineitem")
    count = lambda c, v: F.count_if(F.col(c) == v) if c in t.columns else F.lit(0).cast("long")
    return t.groupBy(F.col("l_returnflag").alias("flag")).agg(count("l_linestatus", "F").alias("concat"), count("l_recovered", 1).alias("recovered"))


@query("A13_having", "SELECT l_orderkey AS lead_id, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def having(s: Source) -> DataFrame:
    return s.table("lineitem").groupBy(F.col("l_orderkey").alias("lead_id"), F.col("l_linenumber").alias("line")).agg(F.count("*").alias("n")).where("n > 1")


@query("A14_target_day", "WITH p AS (SELECT CAST(max(ts) AS DATE) AS last FROM events) SELECT CAST(last AS VARCHAR) AS target, count(*) AS files, round(coalesce(sum(value), 0), 8) AS total FROM p LEFT JOIN events ON CAST(ts AS DATE) = last GROUP BY last")
def target_day(s: Source) -> DataFrame:
    """Totals of the latest day; the as-of day is the data's own."""
    e = s.table("events").withColumn("day", F.to_date("ts"))
    last = e.agg(F.max("day").alias("target"))
    return e.join(F.broadcast(last), e.day == last.target).groupBy(F.col("target").cast("string").alias("target")).agg(F.count("*").alias("files"), R(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"))


@query("A15_histogram_average", """WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events), x AS (SELECT value, CAST(CASE WHEN value <= lo THEN 0 ELSE least(9, ceil((value - lo) / ((hi - lo) / 10)) - 1) END AS INT) AS bin FROM events, b)
SELECT bin, round(avg(value), 8) AS mean, count(*) AS n FROM x GROUP BY bin""")
def histogram_average(s: Source) -> DataFrame:
    """Ten equal bins over the range, closed on the right; the least value is in the first."""
    e = s.table("events").select("value")
    x = e.crossJoin(F.broadcast(e.agg(F.min("value").alias("lo"), F.max("value").alias("hi"))))
    bin_ = F.when(F.col("value") <= F.col("lo"), 0).otherwise(F.least(F.lit(9), F.ceil((F.col("value") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 10)) - 1)).cast("int")
    return x.withColumn("bin", bin_).groupBy("bin").agg(R(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("A16_global_curve", f"""WITH {ctes("windows")}, x AS (SELECT vol, CAST(round_even(second_of_day * 1.0 / max(second_of_day) OVER (PARTITION BY file_id, day) * 19, 0) AS INT) AS bin FROM windows), g AS (SELECT bin, avg(vol) AS vol, count(*) AS n FROM x GROUP BY bin)
SELECT CAST(b.bin AS INT) AS bin, round(vol, 8) AS vol, coalesce(n, 0) AS n FROM range(20) b(bin) LEFT JOIN g USING (bin)""")
def global_curve(s: Source) -> DataFrame:
    """Mean volume over 20 steps of normalised time, empty steps included."""
    w = s.view("windows")
    top = F.max("second_of_day").over(Window.partitionBy("file_id", "day"))
    x = w.withColumn("bin", F.bround(F.try_divide(F.col("second_of_day") * F.lit(1.0), top) * 19, 0).cast("int"))
    steps = s.spark.range(20).select(F.col("id").cast("int").alias("bin"))
    return steps.join(x.groupBy("bin").agg(F.avg("vol").alias("vol"), F.count("*").alias("n")), "bin", "left").select("bin", R(F.col("vol")).alias("vol"), F.coalesce("n", F.lit(0)).alias("n"))


@query("A17_participation", f"""WITH {ctes("utterances")}, g AS (SELECT call_id, coalesce(speaker, -1) AS speaker, CAST(sum(num_words) AS BIGINT) AS words, sum(end_s - start_s) AS seconds FROM utterances GROUP BY 1, 2)
SELECT call_id, speaker, words, round(seconds, 8) AS seconds, round(words / nullif(sum(words) OVER (PARTITION BY call_id), 0), 8) AS word_share, round(seconds / nullif(sum(seconds) OVER (PARTITION BY call_id), 0), 8) AS time_share FROM g""")
def participation(s: Source) -> DataFrame:
    g = s.view("utterances").groupBy("call_id", F.coalesce("speaker", F.lit(-1)).alias("speaker")).agg(F.sum("num_words").alias("words"), F.sum(F.col("end_s") - F.col("start_s")).alias("seconds"))
    w = Window.partitionBy("call_id")
    return g.select("call_id", "speaker", "words", R(F.col("seconds")).alias("seconds"), R(F.try_divide("words", F.sum("words").over(w))).alias("word_share"), R(F.try_divide("seconds", F.sum("seconds").over(w))).alias("time_share"))


@query("A18_ambiguous_keys", "SELECT l_partkey AS part_id, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def ambiguous_keys(s: Source) -> DataFrame:
    return s.table("lineitem").groupBy(F.col("l_partkey").alias("part_id")).agg(F.countDistinct("l_suppkey").alias("targets")).where("targets > 1")


@query("A19_class_distribution", f"WITH {ctes('call_topics')} SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 8) AS pct FROM call_topics GROUP BY label")
def class_distribution(s: Source) -> DataFrame:
    t = s.view("call_topics")
    n = t.groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("label", "n", R(F.col("n") * 100.0 / F.col("total")).alias("pct"))


@query("A20_mapping_audit", """WITH u AS (SELECT DISTINCT c_nationkey AS k FROM customer), m AS (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_nationkey % 3 <> 0)
SELECT k, CASE WHEN v IS NULL THEN 'unmapped' ELSE 'mapped' END AS state, coalesce(v, '') AS target FROM u LEFT JOIN m USING (k) UNION ALL SELECT k, 'unused', v FROM m WHERE k NOT IN (SELECT k FROM u)""")
def mapping_audit(s: Source) -> DataFrame:
    used = s.table("customer").select(F.col("c_nationkey").alias("k")).distinct()
    mapping = s.table("nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v"))
    both = used.join(mapping, "k", "left").select("k", F.when(F.col("v").isNull(), "unmapped").otherwise("mapped").alias("state"), F.coalesce("v", F.lit("")).alias("target"))
    return both.unionByName(mapping.join(used, "k", "left_anti").select("k", F.lit("unused").alias("state"), F.col("v").alias("target")))


@query("A21_time_priors", f"""WITH {ctes("call_topics")}, x AS (SELECT label, CASE WHEN start_s / 70 <= 0.15 THEN 'early' WHEN start_s / 70 <= 0.65 THEN 'mid' ELSE 'late' END AS bin FROM call_topics), l AS (SELECT DISTINCT label FROM x), b AS (SELECT unnest(['early', 'mid', 'late', 'unknown']) AS bin),
c AS (SELECT label, bin, count(*) AS n FROM x GROUP BY 1, 2) SELECT l.label, b.bin, round((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY l.label) + 4), 6) AS p FROM l CROSS JOIN b LEFT JOIN c ON c.label = l.label AND c.bin = b.bin""")
def time_priors(s: Source) -> DataFrame:
    """P(time bin | label) with one added to each count. Labels times bins is a small table."""
    at = F.col("start_s") / 70
    x = s.view("call_topics").withColumn("bin", F.when(at <= 0.15, "early").when(at <= 0.65, "mid").otherwise("late")).groupBy("label", "bin").agg(F.count("*").alias("n"))
    grid = x.select("label").distinct().withColumn("bin", F.explode(F.array(*map(F.lit, ("early", "mid", "late", "unknown")))))
    n = F.coalesce("n", F.lit(0))
    return grid.join(x, ["label", "bin"], "left").select("label", "bin", R((n + 1.0) / (F.sum(n).over(Window.partitionBy("label")) + 4), 6).alias("p"))


@query("A22_transitions", f"""WITH {ctes("windows")}, t AS (SELECT state, lead(state) OVER (PARTITION BY file_id ORDER BY ts, event_id) AS next FROM windows), l AS (SELECT DISTINCT state FROM windows), c AS (SELECT state, next, count(*) AS n FROM t WHERE next IS NOT NULL GROUP BY 1, 2)
SELECT a.state, b.state AS next, round(ln((coalesce(n, 0) + 1.0) / (sum(coalesce(n, 0)) OVER (PARTITION BY a.state) + count(*) OVER (PARTITION BY a.state))), 6) AS log_p FROM l a CROSS JOIN l b LEFT JOIN c ON c.state = a.state AND c.next = b.state""")
def transitions(s: Source) -> DataFrame:
    w = s.view("windows").withColumn("next", F.lead("state").over(Window.partitionBy("file_id").orderBy("ts", "event_id")))
    c = w.where("next is not null").groupBy("state", "next").agg(F.count("*").alias("n"))
    states = w.select("state").distinct()
    grid = states.crossJoin(F.broadcast(states.select(F.col("state").alias("next"))))
    by = Window.partitionBy("state")
    n = F.coalesce("n", F.lit(0))
    return grid.join(c, ["state", "next"], "left").select("state", "next", R(F.ln((n + 1.0) / (F.sum(n).over(by) + F.count("*").over(by))), 6).alias("log_p"))


@query("A23_class_weights", f"WITH {ctes('call_topics')} SELECT label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM call_topics GROUP BY label")
def class_weights(s: Source) -> DataFrame:
    n = s.view("call_topics").groupBy("label").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t"), F.count("*").alias("k")))).select("label", R(F.col("t") / (F.col("k") * F.col("n")), 6).alias("weight"))


@query("A24_majority_mapping", f"WITH {ctes('calls')}, g AS (SELECT agent_id, status, count(*) AS n, sum(count(*)) OVER (PARTITION BY agent_id) AS t FROM calls GROUP BY 1, 2) SELECT agent_id, status, round(n / t, 8) AS share FROM g WHERE n * 2 > t")
def majority_mapping(s: Source) -> DataFrame:
    g = s.view("calls").groupBy("agent_id", "status").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("agent_id")))
    return g.where("n * 2 > t").select("agent_id", "status", R(F.col("n") / F.col("t")).alias("share"))


@query("A25_rejection_map", f"""WITH {ctes("affected")}, f AS (SELECT call_id, bool_or(upper(coalesce(summary_rejection, '')) LIKE '%MAC%') AS mac, bool_or(upper(coalesce(summary_rejection, '')) LIKE '%PRECIO%') AS price, bool_or(summary_rejection = 'NO AUDITABLE') AS na FROM affected GROUP BY call_id)
SELECT call_id, concat_ws(', ', CASE WHEN mac THEN 'MAC' END, CASE WHEN price THEN 'PRECIO' END, CASE WHEN na THEN 'NO AUDITABLE' END) AS reasons FROM f""")
def rejection_map(s: Source) -> DataFrame:
    r = F.upper(F.coalesce("summary_rejection", F.lit("")))
    f = s.view("affected").groupBy("call_id").agg(F.bool_or(r.contains("MAC")).alias("mac"), F.bool_or(r.contains("PRECIO")).alias("price"), F.bool_or(F.col("summary_rejection") == "NO AUDITABLE").alias("na"))
    return f.select("call_id", F.concat_ws(", ", F.when(F.col("mac"), "MAC"), F.when(F.col("price"), "PRECIO"), F.when(F.col("na"), "NO AUDITABLE")).alias("reasons"))


@query("A26_affected_by_agent", f"WITH {ctes('calls')} SELECT agent_id, count(*) AS affected FROM calls WHERE status = 'F' GROUP BY 1")
def affected_by_agent(s: Source) -> DataFrame:
    return s.view("calls").where("status = 'F'").groupBy("agent_id").agg(F.count("*").alias("affected"))


@query("A27_words_per_call", f"WITH {ctes('utterances')}, c AS (SELECT call_id, sum(num_words) AS w FROM utterances GROUP BY 1) SELECT round(quantile_cont(w, 0.95), 8) AS p95, round(avg(w), 8) AS mean, count(*) AS calls FROM c")
def words_per_call(s: Source) -> DataFrame:
    c = s.view("utterances").groupBy("call_id").agg(F.sum("num_words").alias("w"))
    p = calibrate.percentile(c, "w", 0.95)
    return c.agg(R(F.avg("w")).alias("mean"), F.count("*").alias("calls")).crossJoin(p).select(R(F.col("p")).alias("p95"), "mean", "calls")


@query("A28_lists_by_cluster", "SELECT r_name AS cluster, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def lists_by_cluster(s: Source) -> DataFrame:
    return s.view("campaigns").groupBy(F.col("sponsor").alias("cluster")).agg(F.array_join(F.array_sort(F.collect_list("campaign")), "|").alias("names"))


@query("A29_minutes_per_file", f"WITH {ctes('calls')} SELECT campaign_id, count(*) AS files, round(sum(tmo_s) / 60 / count(*), 8) AS tmo_min FROM calls GROUP BY 1")
def minutes_per_file(s: Source) -> DataFrame:
    return s.view("calls").groupBy("campaign_id").agg(F.count("*").alias("files"), R(F.sum("tmo_s") / 60 / F.count("*")).alias("tmo_min"))


@query("A30_order_by_variance", "SELECT vec_id, round(list_var_pop(CAST(embedding AS DOUBLE[])), 6) AS variance FROM embeddings ORDER BY variance DESC, vec_id")
def order_by_variance(s: Source) -> DataFrame:
    """All arrays, the most varied first."""
    e = F.col("e")
    x = s.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).withColumn("m", F.aggregate(e, F.lit(0.0), lambda a, v: a + v) / F.size(e))
    var = F.aggregate(e, F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / F.size(e)
    return x.select("vec_id", R(var, 6).alias("variance")).orderBy(F.desc("variance"), "vec_id")


EVALUATE = """WITH x AS (SELECT {y} AS y, {p} AS p FROM {t}), k AS (SELECT y AS c FROM x UNION SELECT p FROM x), s AS (SELECT c, count(*) FILTER (WHERE y = c AND p = c) AS tp, count(*) FILTER (WHERE y <> c AND p = c) AS fp, count(*) FILTER (WHERE y = c AND p <> c) AS fn FROM k, x GROUP BY c)
SELECT c AS class, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s"""


def class_report(pairs: DataFrame, y: str, p: str) -> DataFrame:
    """class, tp, fp, fn, prec, recall, f1: from one count of the confusion table."""
    c = pairs.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))
    same = F.col("y") == F.col("p")
    true = c.groupBy(F.col("y").alias("class")).agg(F.sum(F.when(same, F.col("n")).otherwise(0)).alias("tp1"), F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("fn1"))
    said = c.groupBy(F.col("p").alias("class")).agg(F.sum(F.when(~same, F.col("n")).otherwise(0)).alias("fp1"))
    x = true.join(said, "class", "full_outer").select("class", *(F.coalesce(f"{k}1", F.lit(0)).alias(k) for k in ("tp", "fp", "fn")))
    ratio = lambda a, b: R(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    tp, fp, fn = (F.col(k) for k in ("tp", "fp", "fn"))
    return x.select("class", "tp", "fp", "fn", ratio(tp, tp + fp).alias("prec"), ratio(tp, tp + fn).alias("recall"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


@query("A31_class_report", EVALUATE.format(y="l_linenumber", p="CAST(1 + l_partkey % 7 AS INT)", t="lineitem"))
def evaluation(s: Source) -> DataFrame:
    return class_report(s.table("lineitem").select("l_linenumber", (1 + F.col("l_partkey") % 7).cast("int").alias("p")), "l_linenumber", "p")


@query("A32_first_and_last", f"""WITH {ctes("calls")} SELECT agent_id, arg_min(status, (call_ts, call_id)) AS first_status, arg_max(status, (call_ts, call_id)) AS last_status FROM calls GROUP BY agent_id""")
def first_and_last(s: Source) -> DataFrame:
    key = F.struct("call_ts", "call_id")
    return s.view("calls").groupBy("agent_id").agg(F.min_by("status", key).alias("first_status"), F.max_by("status", key).alias("last_status"))


@query("A33_rollup", f"WITH {ctes('calls', 'campaigns')} SELECT sponsor, campaign, count(*) AS calls, round(avg(score), 8) AS score FROM calls JOIN campaigns USING (campaign_id) GROUP BY ROLLUP (sponsor, campaign)")
def rollup(s: Source) -> DataFrame:
    return s.view("calls").join(s.view("campaigns"), "campaign_id").rollup("sponsor", "campaign").agg(F.count("*").alias("calls"), R(F.avg("score")).alias("score"))


__all__ = ["SCRIPT_ORDER", "class_report", "quality_base"]
