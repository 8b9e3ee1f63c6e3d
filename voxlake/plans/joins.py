"""Joins, scans, predicates, set operations, sorts and upserts (J, S, P, U, L, K)."""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.operators import likelihood, merge, ordered, small
from voxlake.plans.aggregates import BASE, R, quality_base
from voxlake.plans.registry import Source, query
from voxlake.sources import transcripts
from voxlake.views import ctes

UTT = ctes("utterances")


@query("J01_words_into_sentences", f"""WITH {UTT}, s AS (SELECT call_id, turn, start_s, end_s - 1.0 AS end_s FROM utterances WHERE num_words > 0), w AS (SELECT call_id, turn AS word_turn, i, start_s + 0.4 * (i - 1) AS w_start, start_s + 0.4 * i AS w_end FROM (SELECT *, unnest(range(1, num_words + 1)) AS i FROM utterances))
SELECT w.call_id, word_turn, CAST(i AS INT) AS i, s.turn AS sentence FROM w ASOF JOIN s ON w.call_id = s.call_id AND w.w_start >= s.start_s WHERE round(w_end, 6) <= round(s.end_s, 6)""")
def words_into_sentences(s: Source) -> DataFrame:
    """Each word goes to the last sentence that starts at or before it, if it ends within."""
    u = s.view("utterances").where("num_words > 0")
    words = u.select("call_id", F.col("turn").alias("word_turn"), F.col("start_s").alias("s0"), F.explode(F.sequence(F.lit(1), F.col("num_words"))).alias("i"))
    words = words.withColumn("w_start", F.col("s0") + 0.4 * (F.col("i") - 1)).withColumn("w_end", F.col("s0") + 0.4 * F.col("i"))
    sentences = u.select("call_id", F.col("turn").alias("sentence"), "start_s", (F.col("end_s") - 1.0).alias("end_s"))
    hit = ordered.asof_join(words, sentences, keys=["call_id"], left_time="w_start", right_time="start_s", take=["sentence", "end_s"], right_order=["sentence"])
    return hit.where(F.round("w_end", 6) <= F.round("end_s", 6)).select("call_id", "word_turn", "i", "sentence")


@query("J02_overlapping_spans", f"""WITH {ctes("call_topics")}, a AS (SELECT * FROM call_topics WHERE line % 2 = 0), b AS (SELECT * FROM call_topics WHERE line % 2 = 1)
SELECT a.call_id, a.line, a.part_id, b.line AS other_line, b.part_id AS other_part, count(*) AS n FROM a JOIN b ON a.call_id = b.call_id AND b.start_s < a.end_s AND b.end_s > a.start_s GROUP BY ALL""")
def overlapping_spans(s: Source) -> DataFrame:
    t = s.view("call_topics").select("call_id", "line", "part_id", "start_s", "end_s")
    b = t.where("line % 2 = 1").select("call_id", F.col("line").alias("other_line"), F.col("part_id").alias("other_part"), F.col("start_s").alias("b0"), F.col("end_s").alias("b1"))
    hit = ordered.overlap_join(t.where("line % 2 = 0"), b, keys=["call_id"], left_span=("start_s", "end_s"), right_span=("b0", "b1"), width=20.0)
    return hit.groupBy("call_id", "line", "part_id", "other_line", "other_part").agg(F.count("*").alias("n"))


@query("J03_window_at_time", f"""WITH {ctes("windows")}, q AS (SELECT DISTINCT file_id, day, 3600 * k AS t FROM windows, range(0, 25, 6) r(k)), g AS (SELECT file_id, day, t, arg_min(level, (second_of_day, event_id)) FILTER (WHERE second_of_day >= t) AS hit, arg_max(level, (second_of_day, event_id)) AS tail FROM q JOIN windows USING (file_id, day) GROUP BY ALL)
SELECT file_id, CAST(day AS VARCHAR) AS day, CAST(t AS BIGINT) AS t, round(coalesce(hit, tail), 8) AS level FROM g""")
def window_at_time(s: Source) -> DataFrame:
    """The first window that ends at or after a time, or the last."""
    w = s.view("windows")
    q = w.select("file_id", "day").distinct().withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(86400).cast("long"), F.lit(21600).cast("long"))))
    key = F.struct("second_of_day", "event_id")
    g = q.join(w, ["file_id", "day"]).groupBy("file_id", "day", "t").agg(F.min_by("level", F.when(F.col("second_of_day") >= F.col("t"), key)).alias("at"), F.max_by("level", key).alias("tail"))
    return g.select("file_id", F.col("day").cast("string").alias("day"), "t", R(F.coalesce("at", "tail")).alias("level"))


@query("J04_point_in_span", f"WITH {ctes('call_topics')} SELECT call_id, line, part_id, supp_id, price, 30 BETWEEN start_s AND end_s AS has_30, 60 BETWEEN start_s AND end_s AS has_60 FROM call_topics")
def point_in_span(s: Source) -> DataFrame:
    inside = lambda t: F.lit(t).between(F.col("start_s"), F.col("end_s"))
    return s.view("call_topics").select("call_id", "line", "part_id", "supp_id", "price", inside(30).alias("has_30"), inside(60).alias("has_60"))


@query("J05_left_join_metrics", f"WITH {ctes('calls', 'windows')}, m AS (SELECT file_id, avg(vol) AS vol FROM windows GROUP BY 1) SELECT call_id, round(vol, 8) AS vol FROM calls LEFT JOIN m ON file_id = agent_id % 200")
def left_join_metrics(s: Source) -> DataFrame:
    m = s.view("windows").groupBy("file_id").agg(F.avg("vol").alias("vol"))
    return s.view("calls").withColumn("file_id", F.col("agent_id") % 200).join(m, "file_id", "left").select("call_id", R(F.col("vol")).alias("vol"))


@query("J06_null_agent", f"WITH {ctes('calls', 'agents')} SELECT call_id, coalesce(a.agent_id, 0) AS agent_id, coalesce(agent_name, 'Agente Nulo') AS agent_name FROM calls c LEFT JOIN (SELECT * FROM agents WHERE agent_id % 7 <> 0) a ON a.agent_id = c.agent_id")
def null_agent(s: Source) -> DataFrame:
    a = s.view("agents").where("agent_id % 7 <> 0").select("agent_id", "agent_name").withColumn("found", F.col("agent_id"))
    return s.view("calls").join(a, "agent_id", "left").select("call_id", F.coalesce("found", F.lit(0)).alias("agent_id"), F.coalesce("agent_name", F.lit("Agente Nulo")).alias("agent_name"))


@query("J07_topic_against_campaign", f"WITH {ctes('call_topics')}, g AS (SELECT label, avg(confidence) AS general FROM call_topics GROUP BY 1), m AS (SELECT supp_id, label, avg(confidence) AS own FROM call_topics GROUP BY 1, 2) SELECT supp_id, label, round(own, 8) AS own, round(own - general, 8) + 0.0 AS above FROM m JOIN g USING (label)")
def topic_against_campaign(s: Source) -> DataFrame:
    t = s.view("call_topics")
    g, m = t.groupBy("label").agg(F.avg("confidence").alias("general")), t.groupBy("supp_id", "label").agg(F.avg("confidence").alias("own"))
    return m.join(g, "label").select("supp_id", "label", R(F.col("own")).alias("own"), R(F.col("own") - F.col("general")).alias("above"))


@query("J08_chain_of_joins", f"""WITH {ctes("calls", "call_topics", "affected")}, m AS (SELECT call_id, avg(confidence) AS mac FROM call_topics WHERE label = 'MAC' GROUP BY 1), p AS (SELECT call_id, avg(confidence) AS price FROM call_topics WHERE label = 'PRECIO' GROUP BY 1), f AS (SELECT call_id, count(*) AS n FROM affected GROUP BY 1)
SELECT call_id, round(mac, 8) AS mac, round(price, 8) AS price, n FROM calls LEFT JOIN m USING (call_id) LEFT JOIN p USING (call_id) LEFT JOIN f USING (call_id)""")
def chain_of_joins(s: Source) -> DataFrame:
    """Each side is one row per call before it is joined, so no row is doubled; all share one partitioning."""
    t = s.view("call_topics")
    side = lambda label, name: t.where(F.col("label") == label).groupBy("call_id").agg(R(F.avg("confidence")).alias(name))
    f = s.view("affected").groupBy("call_id").agg(F.count("*").alias("n"))
    return s.view("calls").select("call_id").join(side("MAC", "mac"), "call_id", "left").join(side("PRECIO", "price"), "call_id", "left").join(f, "call_id", "left")


@query("J09_right_join", f"WITH {ctes('calls', 'call_topics')}, t AS (SELECT call_id, label FROM call_topics WHERE label = 'SALUDO' GROUP BY ALL) SELECT calls.call_id, coalesce(label, '') AS label FROM t RIGHT JOIN calls ON t.call_id = calls.call_id")
def right_join(s: Source) -> DataFrame:
    t = s.view("call_topics").where("label = 'SALUDO'").select("call_id", "label").distinct()
    return t.join(s.view("calls").select("call_id"), "call_id", "right").select("call_id", F.coalesce("label", F.lit("")).alias("label"))


@query("J10_rows_at_group_max", "SELECT user_id, event_id, event_type FROM events JOIN (SELECT user_id AS u, max(value) AS m FROM events GROUP BY 1) ON u = user_id AND m = value")
def rows_at_group_max(s: Source) -> DataFrame:
    return s.table("events").withColumn("r", F.rank().over(Window.partitionBy("user_id").orderBy(F.desc("value")))).where("r = 1").select("user_id", "event_id", "event_type")


@query("J11_three_way", f"{BASE} SELECT call_id, agent_id, summary_rejection, vici_status FROM base")
def three_way(s: Source) -> DataFrame:
    return quality_base(s).select("call_id", "agent_id", "summary_rejection", "vici_status")


@query("J12_surrogate_keys", f"WITH {ctes('calls', 'campaigns', 'agents')} SELECT call_id, sponsor_id, segment FROM calls LEFT JOIN campaigns ON campaigns.campaign_id = calls.campaign_id LEFT JOIN agents ON agents.agent_id = calls.agent_id AND agents.campaign_id = calls.campaign_id")
def surrogate_keys(s: Source) -> DataFrame:
    """One key, then a pair of keys; campaigns are as few as nations, and are broadcast."""
    return s.view("calls").join(s.view("campaigns").select("campaign_id", "sponsor_id"), "campaign_id", "left").join(s.view("agents").select("agent_id", "campaign_id", "segment"), ["agent_id", "campaign_id"], "left").select("call_id", "sponsor_id", "segment")


@query("J13_tuple_lookup", "SELECT l_orderkey AS call_id, l_linenumber AS line, l_returnflag || '/' || l_linestatus AS pair, m.code FROM lineitem JOIN (VALUES ('A', 'F', 1), ('N', 'O', 2), ('R', 'F', 3)) m(f, s, code) ON f = l_returnflag AND s = l_linestatus")
def tuple_lookup(s: Source) -> DataFrame:
    m = s.spark.createDataFrame([("A", "F", 1), ("N", "O", 2), ("R", "F", 3)], "l_returnflag string, l_linestatus string, code int")
    return s.table("lineitem").join(F.broadcast(m), ["l_returnflag", "l_linestatus"]).select(F.col("l_orderkey").alias("call_id"), F.col("l_linenumber").alias("line"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("pair"), "code")


@query("J14_semi_of_repeated", f"WITH {ctes('calls')} SELECT call_id FROM calls WHERE (agent_id, campaign_id, status) IN (SELECT agent_id, campaign_id, status FROM calls GROUP BY 1, 2, 3 HAVING count(*) > 1)")
def semi_of_repeated(s: Source) -> DataFrame:
    return s.view("calls").withColumn("n", F.count("*").over(Window.partitionBy("agent_id", "campaign_id", "status"))).where("n > 1").select("call_id")


@query("J15_report_join", f"WITH {ctes('calls', 'agents', 'campaigns')} SELECT call_id, agent_name, campaign, sponsor FROM calls LEFT JOIN agents USING (agent_id) LEFT JOIN campaigns ON campaigns.campaign_id = calls.campaign_id WHERE call_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND status IN ('F', 'O')")
def report_join(s: Source) -> DataFrame:
    calls = s.view("calls").where(F.col("call_ts").between(F.lit("1996-01-01").cast("timestamp"), F.lit("1997-12-31").cast("timestamp")) & F.col("status").isin("F", "O"))
    return calls.join(s.view("agents").select("agent_id", "agent_name"), "agent_id", "left").join(s.view("campaigns"), "campaign_id", "left").select("call_id", "agent_name", "campaign", "sponsor")


@query("J16_feedback", "SELECT DISTINCT d.doc_id, d.lang, l.quality, l.toxic FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def feedback(s: Source) -> DataFrame:
    return s.table("labels").join(s.table("documents").select("doc_id", "lang"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic").distinct()


@query("J17_normalised_key", "WITH a AS (SELECT c_custkey, 'X_' || c_custkey % 40 || '-all.mp3' AS name FROM customer), b AS (SELECT s_suppkey, 'X_' || s_suppkey || '-all-concat.mp3' AS name FROM supplier), f AS (SELECT k, min(s_suppkey) AS s_suppkey FROM (SELECT split_part(name, '-all', 1) AS k, s_suppkey FROM b) GROUP BY k) SELECT c_custkey, s_suppkey FROM a LEFT JOIN f ON k = split_part(name, '-all', 1)")
def normalised_key(s: Source) -> DataFrame:
    key = F.substring_index("name", "-all", 1)
    a = s.table("customer").select("c_custkey", F.concat(F.lit("X_"), F.col("c_custkey") % 40, F.lit("-all.mp3")).alias("name")).withColumn("k", key)
    b = s.table("supplier").select("s_suppkey", F.concat(F.lit("X_"), F.col("s_suppkey"), F.lit("-all-concat.mp3")).alias("name")).withColumn("k", key)
    return a.join(merge.latest(b, keys=["k"], order=["s_suppkey"]).select("k", "s_suppkey"), "k", "left").select("c_custkey", "s_suppkey")


@query("J20_best_name_match", """WITH p AS (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a FROM part), b AS (SELECT DISTINCT p_brand, list_distinct(string_split(lower(p_brand || ' part ' || p_type), ' ')) AS b FROM part),
x AS (SELECT p_partkey, p_brand, round(0.4 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) + 0.6 * len(list_intersect(a, b)) / least(len(a), len(b)), 8) AS score FROM p, b WHERE len(list_intersect(a, b)) > 0)
SELECT p_partkey, p_brand, score FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, p_brand) AS rn FROM (SELECT p_partkey, p_brand, max(score) AS score FROM x GROUP BY 1, 2)) WHERE rn = 1""")
def best_name_match(s: Source) -> DataFrame:
    """0.4 Jaccard + 0.6 overlap of token sets; candidates share a token, so no cross join."""
    tokens = lambda c: F.array_distinct(F.split(F.lower(c), " "))
    p = s.table("part").select("p_partkey", tokens(F.col("p_name")).alias("a")).withColumn("t", F.explode("a"))
    b = s.table("part").select("p_brand", tokens(F.concat_ws(" ", "p_brand", F.lit("part"), "p_type")).alias("b")).distinct().withColumn("t", F.explode("b"))
    both = F.size(F.array_intersect("a", "b"))
    score = R(0.4 * both / F.size(F.array_union("a", "b")) + 0.6 * both / F.least(F.size("a"), F.size("b")))
    x = p.join(b, "t").select("p_partkey", "p_brand", "a", "b").distinct().withColumn("score", score).groupBy("p_partkey", "p_brand").agg(F.max("score").alias("score"))
    return ordered.first_rows(x, 1, keys=["p_partkey"], order=[F.desc("score"), "p_brand"]).drop("rank")


@query("J21_nearest_cluster", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT label AS cluster, list(x ORDER BY i) AS c FROM (SELECT label, i, avg(v[i]) AS x FROM e, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id, cluster, round(list_cosine_similarity(v, c), 8) AS s FROM e, c UNION ALL SELECT a.vec_id, b.label, round(max(list_cosine_similarity(a.v, b.v)), 8) FROM e a JOIN e b ON a.vec_id <> b.vec_id GROUP BY 1, 2)
SELECT vec_id, arg_max(cluster, (s, -cluster)) AS cluster, round(max(s), 6) AS score FROM (SELECT vec_id, cluster, max(s) AS s FROM s GROUP BY 1, 2) GROUP BY vec_id""")
def nearest_cluster(s: Source) -> DataFrame:
    """The greater of the cosine to a cluster's mean and that to its best member other than the row itself, over all clusters; of equals the least cluster."""
    return nearest_of(s.table("embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")))


def nearest_of(e: DataFrame, **how) -> DataFrame:
    """vec_id, cluster, score. Rows that share a direction are one vector, and are at 1 of each other; a zero vector is at 0 of everything; a null label is no cluster.

    The search over vectors is neighbours.nearest; means meet rows as vectors of their own, so neither clusters nor rows are limited in number. Runs jobs before it returns: vectors and cells are written.
    """
    from voxlake.operators import neighbours
    from voxlake.storage import written

    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    mean = e.where("label is not null").select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda t: t.x).alias("v"))
    unit = F.transform("v", lambda x: x / F.sqrt(dot(F.col("v"), F.col("v"))))
    some = F.exists("v", lambda x: x != 0)
    # a row of the same direction as another, or as a mean, is one vector with it; those without a cluster mark nothing
    every = e.select("vec_id", "label", "v").unionByName(mean.select(F.lit(None).cast(e.schema["vec_id"].dataType).alias("vec_id"), "label", "v")).where(some).withColumn("u", unit)
    every = written(every.withColumn("key", F.xxhash64(F.transform("u", lambda x: F.round(x, 12) + 0.0))))
    none = F.lit((1 << 63) - 1)
    held = every.groupBy("key").agg(F.first("u").alias("v"), F.coalesce(F.min("label").cast("long"), none).alias("mark"), F.min(F.struct(F.coalesce(F.col("label").cast("long"), none).alias("label"), F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)).alias("vec_id"))).alias("first"))
    rows = every.where("vec_id is not null").select("key", "vec_id", "label")
    rank = Window.partitionBy("key").orderBy(F.col("label").cast("long").asc_nulls_last(), F.coalesce(F.col("vec_id").cast("long"), F.lit(-1)))
    second = every.where("label is not null").withColumn("r", F.row_number().over(rank)).where("r = 2").select("key", F.col("label").cast("long").alias("second"))
    found = neighbours.nearest(held.where(F.col("mark") != none).select("key", "mark", "v").unionByName(held.where(F.col("mark") == none).select("key", "mark", "v")), **how).found
    x = rows.join(held.select("key", "mark", "first"), "key").join(second, "key", "left").join(found.select("key", "cosine", F.col("mark").alias("near")), "key", "left")
    own = F.when((F.col("first.vec_id") == F.col("vec_id").cast("long")) & (F.col("first.label") == F.coalesce(F.col("label").cast("long"), none)), F.col("second")).otherwise(F.nullif(F.col("mark"), none))
    choices = F.array(F.struct(F.lit(1.0).alias("s"), (-own).alias("c")), F.struct(F.col("cosine").alias("s"), (-F.nullif(F.col("near"), none)).alias("c")))
    top = F.array_max(F.filter(choices, lambda c: c.s.isNotNull() & c.c.isNotNull()))
    kind = e.schema["label"].dataType
    least = mean.agg(F.min("label").alias("least"))
    zero = e.where(~some).select("vec_id").crossJoin(F.broadcast(least)).where("least is not null").select("vec_id", F.col("least").alias("cluster"), F.lit(0.0).alias("score"))
    return x.select("vec_id", (-top["c"]).cast(kind).alias("cluster"), R(top["s"], 6).alias("score")).where("cluster is not null").unionByName(zero)


@query("J22_anti_join", f"WITH {ctes('calls', 'affected')} SELECT call_id FROM calls WHERE call_id NOT IN (SELECT call_id FROM affected WHERE line = 1)")
def anti_join(s: Source) -> DataFrame:
    return s.view("calls").select("call_id").join(s.view("affected").where("line = 1"), "call_id", "left_anti")


@query("J23_concat_groups", f"WITH {ctes('calls')} SELECT agent_id AS lead_id, string_agg(CAST(call_id AS VARCHAR), ',' ORDER BY call_ts, call_id) AS files, count(*) AS n, max_by(call_id, (call_ts, call_id)) AS named_after FROM calls GROUP BY 1 HAVING count(*) > 1")
def concat_groups(s: Source) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct("call_ts", "call_id")))
    g = s.view("calls").groupBy(F.col("agent_id").alias("lead_id")).agg(order.alias("o"), F.count("*").alias("n")).where("n > 1")
    return g.select("lead_id", F.array_join(F.transform("o", lambda t: t.call_id.cast("string")), ",").alias("files"), "n", F.element_at("o", -1).call_id.alias("named_after"))


@query("J24_natural_join", "SELECT n_nationkey, n_name, n_regionkey, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
def natural_join(s: Source) -> DataFrame:
    n, r = s.table("nation"), s.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
    return n.join(r, [c for c in n.columns if c in r.columns]).select("n_nationkey", "n_name", "n_regionkey", "r_name")


@query("S01_transcript_scan", "SELECT conv_id AS call_id, turn, role AS speaker, text FROM conversations")
def transcript_scan(s: Source) -> DataFrame:
    """Nested transcripts, as JSON, back to sentences."""
    return transcripts.sentences(transcripts.parse(transcripts.nested(s.table("conversations"))))


@query("S05_call_transcripts", f"""WITH {UTT}, g AS (SELECT call_id, coalesce(speaker, -1) AS speaker, sum(num_words) AS w FROM utterances GROUP BY 1, 2), p AS (SELECT call_id, greatest(coalesce(sum(w) FILTER (WHERE speaker = 0), 0), coalesce(sum(w) FILTER (WHERE speaker = 1), 0)) / nullif(sum(w), 0) AS share FROM g GROUP BY 1)
SELECT call_id, string_agg(array_to_string(words, ' '), ' ' ORDER BY turn) AS transcript, string_agg(CAST(coalesce(speaker, -1) AS VARCHAR), ',' ORDER BY turn) AS speaker_order, round(max(end_s) / 60, 8) AS tmo_min, round(any_value(share), 8) AS participation FROM utterances JOIN p USING (call_id) GROUP BY call_id""")
def call_transcripts(s: Source) -> DataFrame:
    u = s.view("utterances").withColumn("speaker", F.coalesce("speaker", F.lit(-1)))
    rows = F.array_sort(F.collect_list(F.struct("turn", "speaker", F.array_join("words", " ").alias("t"))))
    said = lambda k: F.sum(F.when(F.col("speaker") == k, F.col("num_words")).otherwise(0))
    g = u.groupBy("call_id").agg(rows.alias("r"), F.max("end_s").alias("e"), F.greatest(said(0), said(1)).alias("most"), F.sum("num_words").alias("w"))
    return g.select("call_id", F.array_join(F.transform("r", lambda t: t.t), " ").alias("transcript"), F.array_join(F.transform("r", lambda t: t.speaker.cast("string")), ",").alias("speaker_order"), R(F.col("e") / 60).alias("tmo_min"), R(F.try_divide("most", "w")).alias("participation"))


@query("S06_two_columns", "SELECT p_partkey, regexp_extract(x, '^(.*),([^,]*)$', 1) AS phrase, regexp_extract(x, '^(.*),([^,]*)$', 2) AS topic FROM (SELECT p_partkey, p_name || ', ' || p_type || ',' || p_brand AS x FROM part)")
def two_columns(s: Source) -> DataFrame:
    """A line's last comma parts phrase and topic."""
    x = s.table("part").select("p_partkey", F.concat("p_name", F.lit(", "), "p_type", F.lit(","), "p_brand").alias("x"))
    return x.select("p_partkey", *(F.regexp_extract("x", "^(.*),([^,]*)$", k).alias(n) for k, n in ((1, "phrase"), (2, "topic"))))


@query("S09_json_membership", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) IN (1, 2)")
def json_membership(s: Source) -> DataFrame:
    ids = F.from_json(F.concat(F.lit("["), F.get_json_object("props", "$.k"), F.lit("]")), "array<int>")
    return s.table("events").where(F.array_contains(ids, 1) | F.array_contains(ids, 2)).select("event_id")


@query("S10_latest_or_default", "SELECT u.user_id, coalesce(e.value, 0.0) AS value FROM (SELECT unnest(range(0, 400)) AS user_id) u LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e ON e.user_id = u.user_id AND rn = 1")
def latest_or_default(s: Source) -> DataFrame:
    last = s.table("events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return s.spark.range(400).withColumnRenamed("id", "user_id").join(last, "user_id", "left").select("user_id", F.coalesce("v", F.lit(0.0)).alias("value"))


PATHS = "SELECT o_orderkey, 'bucket/' || strftime(o_orderdate, '%Y-%m-%d') || '/call_' || o_orderkey || CASE WHEN o_orderkey % 9 = 0 THEN '.txt' ELSE '.mp3' END AS path FROM orders"


def paths(s: Source) -> DataFrame:
    return s.table("orders").select("o_orderkey", F.concat(F.lit("bucket/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/call_"), "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, ".txt").otherwise(".mp3")).alias("path"))


@query("S11_newest_folder", f"WITH p AS ({PATHS}), d AS (SELECT *, split_part(path, '/', 2) AS folder FROM p WHERE path LIKE '%.mp3') SELECT folder, count(*) AS files FROM d WHERE folder = (SELECT max(folder) FROM d) GROUP BY folder")
def newest_folder(s: Source) -> DataFrame:
    d = paths(s).where(F.col("path").endswith(".mp3")).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(2)))
    return d.join(F.broadcast(d.agg(F.max("folder").alias("folder"))), "folder").groupBy("folder").agg(F.count("*").alias("files"))


@query("S12_only_new_keys", f"WITH p AS ({PATHS}) SELECT o_orderkey FROM p WHERE regexp_extract(path, 'call_(\\d+)', 1) NOT IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_linenumber = 2)")
def only_new_keys(s: Source) -> DataFrame:
    have = s.table("lineitem").where("l_linenumber = 2").select(F.col("l_orderkey").cast("string").alias("k"))
    return paths(s).withColumn("k", F.regexp_extract("path", r"call_(\d+)", 1)).join(have, "k", "left_anti").select("o_orderkey")


@query("S13_model_discovery", f"WITH p AS ({PATHS}) SELECT split_part(path, '/', 2) AS model, count(*) AS files, max(CASE WHEN path LIKE '%.txt' THEN path END) AS priors FROM p GROUP BY 1")
def model_discovery(s: Source) -> DataFrame:
    return paths(s).groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("model")).agg(F.count("*").alias("files"), F.max(F.when(F.col("path").endswith(".txt"), F.col("path"))).alias("priors"))


@query("S14_best_model", "SELECT c_nationkey AS sponsor, c_custkey AS model FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END DESC, c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1")
def best_model(s: Source) -> DataFrame:
    c = s.table("customer")
    tested = (F.col("c_mktsegment") == "BUILDING").cast("int")
    return ordered.first_rows(c, 1, keys=["c_nationkey"], order=[F.desc(tested), F.desc("c_acctbal"), "c_custkey"]).select(F.col("c_nationkey").alias("sponsor"), F.col("c_custkey").alias("model"))


@query("S15_comma_list_lookup", "SELECT p_partkey FROM (SELECT p_partkey, p_brand || ' , ' || p_type || ',X' AS path FROM part) WHERE list_contains(string_split(replace(path, ' ', ''), ','), 'Brand#11') OR list_contains(string_split(replace(path, ' ', ''), ','), 'Brand#12')")
def comma_list_lookup(s: Source) -> DataFrame:
    x = s.table("part").select("p_partkey", F.split(F.regexp_replace(F.concat("p_brand", F.lit(" , "), "p_type", F.lit(",X")), " ", ""), ",").alias("l"))
    return x.where(F.array_contains("l", "Brand#11") | F.array_contains("l", "Brand#12")).select("p_partkey")


@query("S16_substring_lookup", "SELECT p_type, count(*) AS n, count(*) > 1 AS ambiguous FROM part WHERE contains(p_name, '1') GROUP BY 1")
def substring_lookup(s: Source) -> DataFrame:
    return s.table("part").where(F.contains("p_name", F.lit("1"))).groupBy("p_type").agg(F.count("*").alias("n"), (F.count("*") > 1).alias("ambiguous"))


@query("S18_crm_reply", "SELECT event_id, coalesce(json_extract_string(j, '$.items[0].dni'), '') AS dni, coalesce(json_extract_string(j, '$.items[0].email'), 'sin dato') AS email FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"count\":0,\"items\":[]}' ELSE '{\"count\":1,\"items\":[{\"dni\":\"' || user_id || '\"}]}' END AS j FROM events)")
def crm_reply(s: Source) -> DataFrame:
    j = F.when(F.col("event_id") % 3 == 0, F.lit('{"count":0,"items":[]}')).otherwise(F.concat(F.lit('{"count":1,"items":[{"dni":"'), "user_id", F.lit('"}]}')))
    x = s.table("events").select("event_id", j.alias("j"))
    return x.select("event_id", F.coalesce(F.get_json_object("j", "$.items[0].dni"), F.lit("")).alias("dni"), F.coalesce(F.get_json_object("j", "$.items[0].email"), F.lit("sin dato")).alias("email"))


@query("S19_name_lookup", "SELECT n_nationkey FROM nation WHERE lower(replace(n_name, ' ', '')) = (SELECT lower(replace(n_name, ' ', '')) FROM nation WHERE n_nationkey = 3)")
def name_lookup(s: Source) -> DataFrame:
    n = s.table("nation").withColumn("k", F.lower(F.regexp_replace("n_name", r"\s", "")))
    return n.join(F.broadcast(n.where("n_nationkey = 3").select("k")), "k", "left_semi").select("n_nationkey")


@query("S20_get_or_make_key", """WITH e AS (SELECT c_custkey, 100 + row_number() OVER (ORDER BY c_custkey) AS id FROM customer WHERE c_custkey % 3 = 0) SELECT count(*) AS n, count(DISTINCT id) AS ids, max(id) AS top, CAST(sum(CASE WHEN old THEN 1 ELSE 0 END) AS BIGINT) AS kept FROM (
SELECT c.c_custkey, coalesce(e.id, (SELECT max(id) FROM e) + row_number() OVER (PARTITION BY e.id IS NULL ORDER BY c.c_custkey)) AS id, e.id IS NOT NULL AS old FROM customer c LEFT JOIN e ON e.c_custkey = c.c_custkey)""")
def get_or_make_key(s: Source) -> DataFrame:
    """Existing ids stay; others get new, distinct ones without a gap."""
    c = s.table("customer").select("c_custkey")
    none = s.spark.createDataFrame([(None, 100)], "c_custkey long, id long").select(F.col("c_custkey").cast(c.schema["c_custkey"].dataType), "id")
    have = merge.with_keys(c.where("c_custkey % 3 = 0"), none, on=["c_custkey"], key="id")
    made = merge.with_keys(c, have, on=["c_custkey"], key="id").join(have.select("c_custkey", F.col("id").alias("o")), "c_custkey", "left")
    return made.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("id").alias("top"), F.sum(F.when(F.col("id") == F.col("o"), 1).otherwise(0)).alias("kept"))


NAMES = "SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'AC_' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '_' || o_orderkey || '_222_' || o_custkey || '_555' || o_orderkey || '-all.mp3' WHEN 1 THEN 'AC_' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '_' || o_orderkey || '_' || o_custkey || '_555-all.mp3' WHEN 2 THEN 'AC_X_' || strftime(o_orderdate, '%Y%m%d-%H%M%S') || '_' || o_orderkey || '_222_' || o_custkey || '_555-all.mp3' ELSE 'bad' || o_orderkey END AS name FROM orders"


def names(s: Source) -> DataFrame:
    d = F.date_format("o_orderdate", "yyyyMMdd-HHmmss")
    k = F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat(F.lit("AC_"), d, F.lit("_"), "o_orderkey", F.lit("_222_"), "o_custkey", F.lit("_555"), "o_orderkey", F.lit("-all.mp3"))).when(k == 1, F.concat(F.lit("AC_"), d, F.lit("_"), "o_orderkey", F.lit("_"), "o_custkey", F.lit("_555-all.mp3"))).when(k == 2, F.concat(F.lit("AC_X_"), d, F.lit("_"), "o_orderkey", F.lit("_222_"), "o_custkey", F.lit("_555-all.mp3"))).otherwise(F.concat(F.lit("bad"), "o_orderkey"))
    return s.table("orders").select("o_orderkey", name.alias("name"))


@query("P01_parse_file_name", f"""WITH n AS (SELECT o_orderkey, name, string_split(name, '_') AS p FROM ({NAMES})) SELECT o_orderkey, CASE WHEN len(p) >= 5 THEN p[CASE WHEN len(p) = 5 THEN -4 ELSE -5 END] ELSE '0' END AS date, CASE WHEN len(p) >= 5 THEN p[CASE WHEN len(p) = 5 THEN -3 ELSE -4 END] ELSE '0' END AS lead,
CASE WHEN len(p) > 5 THEN p[-3] ELSE '0' END AS epoch, CASE WHEN len(p) >= 5 THEN p[-2] ELSE '0' END AS agent, CASE WHEN len(p) >= 5 THEN p[-1] ELSE '0' END AS last FROM n""")
def parse_file_name(s: Source) -> DataFrame:
    """Parts counted from the end; five parts have no epoch, fewer none at all."""
    p = F.split("name", "_")
    n = F.size(p)
    at = lambda five, six: F.when(n == 5, F.try_element_at(p, F.lit(five))).when(n > 5, F.try_element_at(p, F.lit(six))).otherwise("0")
    return names(s).select("o_orderkey", at(-4, -5).alias("date"), at(-3, -4).alias("lead"), F.when(n > 5, F.try_element_at(p, F.lit(-3))).otherwise("0").alias("epoch"), at(-2, -2).alias("agent"), at(-1, -1).alias("last"))


@query("P02_phone", f"WITH n AS ({NAMES}) SELECT o_orderkey, string_split(string_split(name, '_')[-1], '-')[1] AS phone FROM n")
def phone(s: Source) -> DataFrame:
    return names(s).select("o_orderkey", F.split_part(F.element_at(F.split("name", "_"), -1), F.lit("-"), F.lit(1)).alias("phone"))


@query("P03_date_and_agent", rf"WITH n AS ({NAMES}) SELECT o_orderkey, coalesce(nullif(regexp_extract(name, '(\d{{8}})-\d{{6}}', 1), ''), 'none') AS day, coalesce(nullif(regexp_extract(name, '_(\d+)_\d+-all', 1), ''), '0') AS agent FROM n")
def date_and_agent(s: Source) -> DataFrame:
    found = lambda pattern, other: F.coalesce(F.nullif(F.regexp_extract("name", pattern, 1), F.lit("")), F.lit(other))
    return names(s).select("o_orderkey", found(r"(\d{8})-\d{6}", "none").alias("day"), found(r"_(\d+)_\d+-all", "0").alias("agent"))


@query("P04_repair_names", rf"WITH n AS ({NAMES}) SELECT o_orderkey, CASE len(string_split(name, '_')) WHEN 5 THEN regexp_replace(name, '^([^_]+_[^_]+_[^_]+)_', '\1_000_') ELSE name END AS name FROM n")
def repair_names(s: Source) -> DataFrame:
    return names(s).select("o_orderkey", F.when(F.size(F.split("name", "_")) == 5, F.regexp_replace("name", "^([^_]+_[^_]+_[^_]+)_", "$1_000_")).otherwise(F.col("name")).alias("name"))


@query("P05_epoch_and_extension", "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS at, coalesce(id, 'unknown') AS cedula FROM events LEFT JOIN (VALUES ('view', '1'), ('click', '2')) m(ext, id) ON ext = event_type")
def epoch_and_extension(s: Source) -> DataFrame:
    m = s.spark.createDataFrame([("view", "1"), ("click", "2")], "event_type string, id string")
    return s.table("events").join(F.broadcast(m), "event_type", "left").select("event_id", F.date_format(F.from_unixtime(F.unix_timestamp("ts")), "yyyy-MM-dd HH:mm:ss").alias("at"), F.coalesce("id", F.lit("unknown")).alias("cedula"))


@query("P07_eligible_latest_load", "SELECT o_orderkey FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders) AND o_orderkey > 0 AND o_orderstatus <> 'P'")
def eligible_latest_load(s: Source) -> DataFrame:
    o = s.table("orders")
    return o.join(F.broadcast(o.agg(F.max("o_orderdate").alias("o_orderdate"))), "o_orderdate").where("o_orderkey > 0 and o_orderstatus <> 'P'").select("o_orderkey")


DATES = "SELECT o_orderkey, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE 'n/a' END AS folder FROM orders"


def folders(s: Source) -> DataFrame:
    k = F.col("o_orderkey") % 3
    return s.table("orders").select("o_orderkey", F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise("n/a").alias("folder"))


def folder_date(c: str):
    """Two formats; NULL for others."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\d$"), F.to_date(c, "yyyy-MM-dd")).when(F.col(c).rlike(r"^\d\d-\d\d-\d{4}$"), F.to_date(c, "dd-MM-yyyy"))


PARSED = rf"CASE WHEN regexp_matches(folder, '^\d{{4}}-\d\d-\d\d$') THEN CAST(strptime(folder, '%Y-%m-%d') AS DATE) WHEN regexp_matches(folder, '^\d\d-\d\d-\d{{4}}$') THEN CAST(strptime(folder, '%d-%m-%Y') AS DATE) END"


@query("P08_older_than_a_day", f"WITH f AS (SELECT o_orderkey, {PARSED} AS d FROM ({DATES})) SELECT o_orderkey FROM f WHERE d <= (SELECT max(d) FROM f) - 1")
def older_than_a_day(s: Source) -> DataFrame:
    f = folders(s).withColumn("d", folder_date("folder"))
    return f.crossJoin(F.broadcast(f.agg(F.max("d").alias("top")))).where(F.col("d") <= F.date_sub("top", 1)).select("o_orderkey")


@query("P09_two_date_formats", f"SELECT o_orderkey, CAST({PARSED} AS VARCHAR) AS day FROM ({DATES})")
def two_date_formats(s: Source) -> DataFrame:
    return folders(s).select("o_orderkey", folder_date("folder").cast("string").alias("day"))


@query("P10_optional_filters", "SELECT n_nationkey FROM nation WHERE n_regionkey = 1 AND n_name LIKE '%A%'")
def optional_filters(s: Source) -> DataFrame:
    """Conditions that are given are applied; None is no condition."""
    n = s.table("nation")
    for column, test in {"n_regionkey": 1, "n_nationkey": None}.items():
        n = n if test is None else n.where(F.col(column) == test)
    return n.where(F.col("n_name").contains("A")).select("n_nationkey")


@query("P11_low_likelihood", f"WITH {ctes('calls')} SELECT call_id FROM calls WHERE hangup_s IS NULL OR hangup_s < 100")
def low_likelihood(s: Source) -> DataFrame:
    """Missing counts as low."""
    return s.view("calls").where(F.col("hangup_s").isNull() | (F.col("hangup_s") < 100)).select("call_id")


@query("P12_membership", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def membership(s: Source) -> DataFrame:
    return s.table("orders").join(s.table("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("P13_small_files", "SELECT doc_id, CASE WHEN n_chars < 400 THEN 1 ELSE 0 END AS vacia, CASE WHEN n_chars >= 400 THEN lang END AS lang FROM documents")
def small_files(s: Source) -> DataFrame:
    d = s.table("documents")
    small = d.where("n_chars < 400").select("doc_id", F.lit(1).alias("vacia"))
    return d.where("n_chars >= 400").select("doc_id", F.lit(0).alias("vacia"), "lang").unionByName(small, allowMissingColumns=True)


@query("P14_cast_and_clean", "SELECT c_custkey, trim(c_mktsegment) AS segment, CAST(round_even(coalesce(c_acctbal, 0), 0) AS BIGINT) AS balance, c_acctbal > 0 AS positive FROM customer")
def cast_and_clean(s: Source) -> DataFrame:
    return s.table("customer").select("c_custkey", F.trim("c_mktsegment").alias("segment"), F.bround(F.coalesce("c_acctbal", F.lit(0.0)), 0).cast("long").alias("balance"), (F.col("c_acctbal") > 0).alias("positive"))


@query("P15_keep_right", "SELECT n.n_nationkey, n.n_regionkey, s.n_name FROM nation n JOIN (SELECT s_nationkey, min(s_name) AS n_name FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def keep_right(s: Source) -> DataFrame:
    """Where both sides have a column, the right one's stays."""
    right = s.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_name").alias("n_name"))
    left = s.table("nation")
    return left.drop(*(c for c in left.columns if c in right.columns and c != "n_nationkey")).join(right, "n_nationkey")


@query("P16_renames", "SELECT o_orderkey AS call_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS score FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END AS x FROM orders)")
def renames(s: Source) -> DataFrame:
    x = s.table("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"))
    return x.withColumnsRenamed({"o_orderkey": "call_id", "x": "score"}).withColumn("score", F.when(~F.isnan("score"), F.col("score")))


@query("P17_rare_classes", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 5)")
def rare_classes(s: Source) -> DataFrame:
    c = s.table("customer")
    return c.join(c.groupBy("c_nationkey").count().where("count < 5"), "c_nationkey", "left_anti").select("c_custkey")


@query("P18_existence_flags", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS labelled, doc_id IN (SELECT item_id FROM benchmark) AS listed FROM documents")
def existence_flags(s: Source) -> DataFrame:
    flag = lambda t, c, n: s.table(t).select(F.col(c).alias("doc_id")).distinct().withColumn(n, F.lit(True))
    x = s.table("documents").select("doc_id").join(flag("labels", "doc_id", "labelled"), "doc_id", "left").join(flag("benchmark", "item_id", "listed"), "doc_id", "left")
    return x.fillna(False, ["labelled", "listed"])


@query("U01_union_aligned", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_aligned(s: Source) -> DataFrame:
    a = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(s.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id")), allowMissingColumns=True)


@query("U02_keep_first", "SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS rn FROM lineitem) WHERE rn = 1")
def keep_first(s: Source) -> DataFrame:
    return merge.latest(s.table("lineitem"), keys=["l_orderkey", "l_linenumber"], order=["l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@query("U03_set_operations", "SELECT 'minus' AS op, k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def set_operations(s: Source) -> DataFrame:
    a, b = s.table("customer").select(F.col("c_nationkey").alias("k")), s.table("supplier").select(F.col("s_nationkey").alias("k"))
    return a.subtract(b).select(F.lit("minus").alias("op"), "k").unionByName(a.intersect(b).select(F.lit("both").alias("op"), "k"))


@query("U05_explode_list", "SELECT p_partkey, trim(unnest(string_split(p_name || ', ' || p_brand || ',' || p_type, ','))) AS path FROM part")
def explode_list(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", F.explode(F.split(F.concat("p_name", F.lit(", "), "p_brand", F.lit(","), "p_type"), ",")).alias("path")).withColumn("path", F.trim("path"))


@query("U06_dedupe_in_order", "SELECT l_orderkey, string_agg(l_returnflag, '' ORDER BY f) AS flags FROM (SELECT l_orderkey, l_returnflag, min((l_linenumber, l_partkey, l_suppkey)) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def dedupe_in_order(s: Source) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    return s.table("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda r: r.l_returnflag)), "").alias("flags"))


@query("U07_melt", "SELECT o_orderkey, unnest(['price', 'cust']) AS name, unnest([o_totalprice, CAST(o_custkey AS DOUBLE)]) AS value FROM orders")
def melt(s: Source) -> DataFrame:
    x = s.table("orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("cust"))
    return x.unpivot("o_orderkey", ["price", "cust"], "name", "value")


@query("U08_struct_columns", "SELECT o_orderkey, o_totalprice > 100000 AS high, CAST(length(o_orderpriority) AS INT) AS n FROM orders")
def struct_columns(s: Source) -> DataFrame:
    return s.table("orders").select("o_orderkey", F.struct((F.col("o_totalprice") > 100000).alias("high"), F.length("o_orderpriority").alias("n")).alias("s")).select("o_orderkey", "s.*")


@query("L01_nulls_last", f"WITH {ctes('calls')} SELECT call_id, hangup_s FROM calls ORDER BY hangup_s NULLS LAST, call_id")
def nulls_last(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", "hangup_s").orderBy(F.asc_nulls_last("hangup_s"), "call_id")


@query("L02_last_row", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def last_row(s: Source) -> DataFrame:
    return s.table("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1).select("event_id")


@query("L03_top_k", "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 3")
def top_k(s: Source) -> DataFrame:
    return ordered.first_rows(s.table("lineitem"), 3, keys=["l_suppkey"], order=[F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("L04_stratified_sample", "SELECT c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS rn FROM customer) WHERE rn <= 20")
def stratified_sample(s: Source) -> DataFrame:
    """Twenty of each class, the same on every run."""
    return ordered.first_rows(s.table("customer"), 20, keys=["c_mktsegment"], order=[F.md5(F.col("c_custkey").cast("string").cast("binary")), "c_custkey"]).select("c_custkey")


@query("L05_first_files", f"WITH p AS ({PATHS}) SELECT path FROM p ORDER BY path LIMIT 25")
def first_files(s: Source) -> DataFrame:
    return paths(s).orderBy("path").limit(25).select("path")


@query("L06_first_ranked", f"WITH {ctes('call_topics')} SELECT call_id, arg_max(line, (end_s - start_s, -line, -part_id)) AS line FROM call_topics GROUP BY 1")
def first_ranked(s: Source) -> DataFrame:
    return s.view("call_topics").groupBy("call_id").agg(F.max_by("line", F.struct(F.col("end_s") - F.col("start_s"), -F.col("line"), -F.col("part_id"))).alias("line"))


@query("L07_stratified_split", "SELECT c_custkey, rn * 10 > 9 * n AS validation FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(CAST(c_custkey AS VARCHAR)), c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)")
def stratified_split(s: Source) -> DataFrame:
    by = Window.partitionBy("c_mktsegment")
    rn = F.row_number().over(by.orderBy(F.md5(F.col("c_custkey").cast("string").cast("binary")), "c_custkey"))
    return s.table("customer").select("c_custkey", (rn * 10 > 9 * F.count("*").over(by)).alias("validation"))


@query("L08_descending", f"WITH p AS ({PATHS}) SELECT DISTINCT split_part(path, '/', 2) AS folder FROM p ORDER BY folder DESC")
def descending(s: Source) -> DataFrame:
    return paths(s).select(F.split_part("path", F.lit("/"), F.lit(2)).alias("folder")).distinct().orderBy(F.desc("folder"))


@query("L09_best_source", "SELECT arg_max(source, (n, source)) AS source, max(n) AS n FROM (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1)")
def best_source(s: Source) -> DataFrame:
    n = s.table("documents").groupBy("source").agg(F.sum("n_chars").alias("n"))
    return n.agg(F.max_by("source", F.struct("n", "source")).alias("source"), F.max("n").alias("n"))


TARGET = "SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS v FROM customer WHERE c_custkey % 2 = 0"
CHANGES = "SELECT c_custkey AS id, CAST(c_custkey % 25 AS BIGINT) AS v FROM customer WHERE c_custkey % 3 = 0"


def target(s: Source) -> DataFrame:
    return s.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("v"))


def changes(s: Source) -> DataFrame:
    return s.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("v"))


@query("K03_upsert", f"SELECT * FROM ({TARGET}) WHERE id NOT IN (SELECT id FROM ({CHANGES})) UNION ALL SELECT * FROM ({CHANGES})")
def upsert(s: Source) -> DataFrame:
    return merge.upsert(target(s), changes(s), keys=["id"])


@query("K04_upsert_with_reset", f"SELECT id, coalesce(c.v, t.v) AS v, CASE WHEN c.v IS NULL OR c.v = t.v THEN CAST(id % 5 AS BIGINT) ELSE 0 END AS processed FROM ({TARGET}) t FULL JOIN ({CHANGES}) c USING (id)")
def upsert_with_reset(s: Source) -> DataFrame:
    return merge.upsert_with_reset(target(s).withColumn("processed", F.col("id") % 5), changes(s), key="id", watched="v", flag="processed")


@query("K05_split_new", f"SELECT id, v, id NOT IN (SELECT id FROM ({TARGET})) AS is_new FROM ({CHANGES})")
def split_new(s: Source) -> DataFrame:
    return merge.split_new(changes(s), target(s), keys=["id"])


@query("K06_update_by_list", f"SELECT t.id, coalesce(c.v, t.v) AS v FROM ({TARGET}) t LEFT JOIN ({CHANGES}) c USING (id)")
def update_by_list(s: Source) -> DataFrame:
    return target(s).withColumnRenamed("v", "old").join(changes(s), "id", "left").select("id", F.coalesce("v", "old").alias("v"))


@query("K08_conditional_update", "SELECT n_nationkey, CASE WHEN n_name LIKE 'A%' THEN 1 ELSE 0 END AS processed, CASE WHEN n_name LIKE 'A%' OR n_regionkey = 2 THEN 0 ELSE n_regionkey END AS assigned FROM nation")
def conditional_update(s: Source) -> DataFrame:
    a = F.col("n_name").startswith("A")
    return s.table("nation").select("n_nationkey", a.cast("int").alias("processed"), F.when(a | (F.col("n_regionkey") == 2), 0).otherwise(F.col("n_regionkey")).alias("assigned"))


@query("K11_latest_report", f"WITH {ctes('calls', 'campaigns')}, d AS (SELECT sponsor, CAST(call_ts AS DATE) AS day, count(*) AS n, round(avg(score), 8) AS score FROM calls JOIN campaigns USING (campaign_id) GROUP BY 1, 2) SELECT sponsor, CAST(max(day) AS VARCHAR) AS day, arg_max(n, day) AS n, arg_max(score, day) AS score FROM d GROUP BY 1")
def latest_report(s: Source) -> DataFrame:
    d = s.view("calls").join(s.view("campaigns"), "campaign_id").groupBy("sponsor", F.to_date("call_ts").alias("day")).agg(F.count("*").alias("n"), R(F.avg("score")).alias("score"))
    return d.groupBy("sponsor").agg(F.max("day").cast("string").alias("day"), F.max_by("n", "day").alias("n"), F.max_by("score", "day").alias("score"))


@query("K12_append_new", f"SELECT id FROM ({CHANGES}) WHERE id NOT IN (SELECT id FROM ({TARGET}))")
def append_new(s: Source) -> DataFrame:
    return changes(s).join(target(s), "id", "left_anti").select("id")


@query("K13_chart_markers", "SELECT vec_id, k, CAST(embedding[k * 8 + 1] AS DOUBLE) AS value FROM embeddings, range(0, 6) r(k)")
def chart_markers(s: Source) -> DataFrame:
    """Six markers into each chart's array."""
    return s.table("embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("k"), "embedding").select("vec_id", "k", F.element_at("embedding", (F.col("k") * 8 + 1).cast("int")).cast("double").alias("value"))


LETTERS = "list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda w: w <> '')"


def windows_sql(size: int, step: int, tail: bool, groups: str, top: int) -> str:
    """Scores (x) of all windows of all documents and all whole phrases that can be among the first ``top`` of a document's groups.

    A distance is at least the difference of the lengths. Each window is first compared with its group's phrase of the nearest length (f); what cannot reach the
    score that this gives the group's top-th pair is not compared.
    """
    last = f"greatest(len(w) - {size}, 0)"
    starts = f"range(0, {last} + 1, {step})" + (f" || CASE WHEN {last} % {step} = 0 THEN [] ELSE [{last}] END" if tail else "")
    score = "round(1 - levenshtein(span, phrase) * 1.0 / greatest(length(span), length(phrase)), 6)"
    return f"""WITH p AS (SELECT item_id, CAST(item_id % 14 AS BIGINT) AS cluster, array_to_string({LETTERS}, ' ') AS phrase FROM benchmark), d AS (SELECT doc_id, coalesce({LETTERS}, []) AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k + 1:k + {size}], ' ') AS span FROM (SELECT doc_id, w, unnest({starts}) AS k FROM d WHERE len(w) > 0)),
b AS (SELECT doc_id, k, span, item_id, cluster, phrase, least(length(span), length(phrase)) * 1.0 / greatest(length(span), length(phrase), 1) AS most FROM s, p),
f AS (SELECT doc_id, {groups} AS g, {score} AS score FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, k, {groups} ORDER BY most DESC, item_id) = 1),
t AS (SELECT doc_id, g, score AS least FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, g ORDER BY score DESC) = {top}),
x AS (SELECT b.doc_id, k, item_id, cluster, {score} AS score FROM b LEFT JOIN t ON t.doc_id = b.doc_id AND t.g = {groups} WHERE least IS NULL OR most >= least - 1e-6)"""


def likelihoods(s: Source, clusters: int = 14, **how) -> DataFrame:
    """The best pairs of all documents' windows and all whole script phrases (how: see best_pairs)."""
    words = likelihood.words
    p = s.table("benchmark").select("item_id", (F.col("item_id") % clusters).cast("long").alias("cluster"), F.array_join(words("text"), " ").alias("phrase"))
    return likelihood.best_pairs(s.table("documents").select("doc_id", words("text").alias("w")), p, **how)


@query("J18_best_phrase", f"{windows_sql(6, 1, False, '0', 1)} SELECT doc_id, max(score) AS score, arg_max(item_id, (score, -item_id, -k)) AS item_id FROM x GROUP BY 1 UNION ALL SELECT doc_id, 0, NULL FROM d WHERE len(w) = 0")
def best_phrase(s: Source) -> DataFrame:
    """The best of every window of six words, at each word, against every phrase; a document without words has score 0 and no phrase."""
    return likelihoods(s, clusters=1, size=6, step=1, tail=False, top=1).select("doc_id", "score", "item_id")


@query("J19_cluster_evidence", f"{windows_sql(18, 6, True, 'cluster', 3)} SELECT doc_id, cluster, CAST(rn AS INT) AS rank, item_id, k, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY score DESC, item_id, k) AS rn FROM x) WHERE rn <= 3")
def cluster_evidence(s: Source) -> DataFrame:
    """The three best pieces of evidence for each cluster, in windows of 18 words at each sixth and the last 18."""
    x = likelihoods(s, size=18, step=6, tail=True, top=3).where("item_id is not null")
    return ordered.first_rows(x, 3, keys=["doc_id", "cluster"], order=[F.desc("score"), "item_id", "k"]).select("doc_id", "cluster", "rank", "item_id", "k", "score")


@query("J19b_blended_evidence")
def blended_evidence(s: Source) -> DataFrame:
    """The three best windows for each cluster by 0.55 edit score + 0.45 likeness of meaning."""
    words = likelihood.words
    p = s.table("benchmark").select("item_id", (F.col("item_id") % 14).cast("long").alias("cluster"), F.array_join(words("text"), " ").alias("phrase"))
    return likelihood.evidence(s.table("documents").select("doc_id", words("text").alias("w")), p)


@query("S02_words_of_sentences", f"WITH {UTT} SELECT call_id, turn, CASE WHEN num_words = 0 THEN ['BLANK'] ELSE words END AS words FROM utterances")
def words_of_sentences(s: Source) -> DataFrame:
    """Words from the text itself; an empty sentence has a placeholder."""
    return s.view("utterances").select("call_id", "turn", F.when(F.size("words") == 0, F.array(F.lit("BLANK"))).otherwise(F.col("words")).alias("words"))


@query("S03_filled_gaps", f"WITH {UTT}, u AS (SELECT call_id, turn, CASE WHEN num_words = 0 THEN ['BLANK'] ELSE words END AS words FROM utterances) SELECT d.doc_id AS call_id, coalesce(u.turn, k) AS turn, coalesce(words, ['BLANK']) AS words, u.call_id IS NULL AS filler FROM documents d LEFT JOIN u ON u.call_id = d.doc_id, range(0, 2) r(k) WHERE u.call_id IS NULL OR k = 0")
def filled_gaps(s: Source) -> DataFrame:
    """Sentences with their words; a call without a transcript has two blank rows."""
    u = s.view("utterances").select("call_id", "turn", F.when(F.size("words") == 0, F.array(F.lit("BLANK"))).otherwise(F.col("words")).alias("words"), F.lit(False).alias("filler"))
    have = s.table("documents").select(F.col("doc_id").alias("call_id"))
    blanks = have.join(u, "call_id", "left_anti").withColumn("turn", F.explode(F.array(*(F.lit(k).cast(u.schema["turn"].dataType) for k in (0, 1)))))
    return have.join(u, "call_id").unionByName(blanks.withColumn("words", F.array(F.lit("BLANK"))).withColumn("filler", F.lit(True)))


@query("S04_two_folders", "SELECT conv_id AS call_id, turn, 'first' AS origin FROM conversations WHERE conv_id % 2 = 0 UNION ALL SELECT conv_id, turn, 'memory' FROM conversations WHERE conv_id % 2 = 1")
def two_folders(s: Source) -> DataFrame:
    c = s.table("conversations").select(F.col("conv_id").alias("call_id"), "turn")
    return c.where("call_id % 2 = 0").withColumn("origin", F.lit("first")).unionByName(c.where("call_id % 2 = 1").withColumn("origin", F.lit("memory")))


@query("S07_script_columns", "SELECT 'p_brand' AS cluster, arg_max(name, m) AS phrase FROM (SELECT 'p_type' AS name, avg(length(p_name || ' ' || p_type)) AS m FROM part UNION ALL SELECT 'p_size', avg(length(CAST(p_size AS VARCHAR))) FROM part)")
def script_columns(s: Source) -> DataFrame:
    from voxlake.sources import tables

    df = s.table("part").select(F.col("p_brand").alias("Cluster"), F.col("p_size").alias("size"), F.concat_ws(" ", "p_name", "p_type").alias("texto"))
    found = tables.script_columns(df)
    names = {"Cluster": "p_brand", "texto": "p_type", "size": "p_size"}
    return s.spark.createDataFrame([(names[found["cluster"]], names[found["phrase"]])], "cluster string, phrase string")


@query("S08_filtered_read", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filtered_read(s: Source) -> DataFrame:
    """Both filters and the three columns reach the scan."""
    return s.table("orders").where("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("P06_range_and_list", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-09-30' AND o_custkey % 10 IN (1, 3, 5)")
def range_and_list(s: Source) -> DataFrame:
    o = s.table("orders")
    kind = o.schema["o_orderdate"].dataType
    return o.where(F.col("o_orderdate").between(F.lit("1996-03-01 00:00:00").cast(kind), F.lit("1996-09-30 00:00:00").cast(kind)) & (F.col("o_custkey") % 10).isin(1, 3, 5)).select("o_orderkey")


@query("K01_K02_append_and_read", "SELECT c_custkey AS id, CAST(c_custkey % 2 AS INT) AS part FROM customer")
def append_and_read(s: Source) -> DataFrame:
    """Two appends to one table, in folders by a column, read back."""
    from voxlake.sources import tables
    from voxlake.storage import shared_folder

    path = shared_folder(s.spark)
    c = s.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).cast("int").alias("part"))
    tables.append(c.where("part = 0"), path, by=("part",))
    tables.append(c.where("part = 1"), path, by=("part",))
    return s.spark.read.schema("id long, part int").parquet(path)


def database(s: Source) -> tuple[str, str, dict[str, str]] | None:
    """Address, a table's name and options of a database: that of spark.voxlake.jdbc.url, else one in this process's memory where there are no executors. None where executors can reach neither."""
    name = f"t_{uuid.uuid4().hex}"
    url = s.spark.conf.get("spark.voxlake.jdbc.url", None)
    if not url:
        if not re.fullmatch(r"local(\[.*\])?", s.spark.sparkContext.master):
            return None
        s.spark._jvm.java.lang.System.setProperty("derby.stream.error.file", os.devnull)  # else it leaves a log in the working folder
    return (url, name, {}) if url else ("jdbc:derby:memory:voxlake;create=true", name, {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"})


@query("K07_batched_insert", "SELECT c_custkey AS id, c_mktsegment AS segment, CAST(round(c_acctbal, 2) AS DOUBLE) AS balance FROM customer")
def batched_insert(s: Source) -> DataFrame:
    """Rows into a database in batches of 500, and back. The table stays: the rows are read from it when they are asked for; one in the process's memory goes with the process.
    Executors that can reach no database write files of one (tables.write_files)."""
    from voxlake.sources import tables

    rows = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal").cast("double"), 2).alias("balance"))
    if (found := database(s)) is None:
        return tables.read_files(tables.write_files(rows, "t", batch=500), "t", "id long, segment string, balance double")
    url, name, how = found
    tables.write_jdbc(rows, url, name, batch=500, **how)
    back = tables.read_jdbc(s.spark, url, name, **how)
    return back.toDF(*(c.lower() for c in back.columns))


@query("S08b_database_read", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer WHERE c_nationkey < 10 AND c_custkey % 2 = 1")
def database_read(s: Source) -> DataFrame:
    """A filtered read (the table stays, as in K07); the predicates cut the table into partitions that are read side by side, and the filter on top goes to the database."""
    from voxlake.sources import tables

    rows = s.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("nation"))
    if (found := database(s)) is None:
        return tables.read_files(tables.write_files(rows, "t"), "t", "id long, nation long", predicates=['"id" % 2 = 1 AND "nation" < 5', '"id" % 2 = 1 AND "nation" >= 5 AND "nation" < 10'])
    url, name, how = found
    tables.write_jdbc(rows, url, name, **how)
    quoted = lambda c: f'"{c}"'
    back = tables.read_jdbc(s.spark, url, name, predicates=[f"MOD({quoted('id')}, 2) = 1 AND {quoted('nation')} < 5", f"MOD({quoted('id')}, 2) = 1 AND {quoted('nation')} >= 5"], **how)
    return back.where("nation < 10").select("id", "nation")


@query("K09_report", "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey IN (1, 2)")
def report(s: Source) -> DataFrame:
    """A report that replaces an older one, and rows added to it."""
    from voxlake.sources import tables
    from voxlake.storage import shared_folder

    path = shared_folder(s.spark)
    n = s.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), "n_regionkey")
    tables.write_csv(n.where("n_regionkey = 0").drop("n_regionkey"), path)
    tables.write_csv(n.where("n_regionkey = 1").drop("n_regionkey"), path)
    tables.write_csv(n.where("n_regionkey = 2").drop("n_regionkey"), path, append=True)
    return tables.read_csv(s.spark, path, f"id {n.schema['id'].dataType.simpleString()}, name string")


@query("S04b_spreadsheets", "SELECT conv_id AS call_id, turn, role AS speaker, text FROM conversations WHERE text IS NULL OR length(text) <= 32767")
def memory_spreadsheets(s: Source) -> DataFrame:
    """Transcripts of the second kind: JSON to sentences, to spreadsheets, and back. A sentence that no cell holds can't go into a spreadsheet."""
    from voxlake.sources import spreadsheets
    from voxlake.storage import shared_folder

    rows = transcripts.sentences(transcripts.parse(transcripts.nested(s.table("conversations")))).where("text is null or length(text) <= 32767")
    path = shared_folder(s.spark)
    spreadsheets.write(rows, path)
    return spreadsheets.read(s.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))


@query("S06b_script_sheets", "SELECT p_brand AS cluster, p_name || ' ' || p_type AS phrase, count(*) AS n FROM part GROUP BY 1, 2")
def script_sheets(s: Source) -> DataFrame:
    """Grading scripts as spreadsheets whose columns are told apart by name and by length."""
    from voxlake.sources import spreadsheets, tables
    from voxlake.storage import shared_folder

    path = shared_folder(s.spark)
    spreadsheets.write(s.table("part").select(F.col("p_size").alias("Size"), F.col("p_brand").alias("Topic"), F.concat_ws(" ", "p_name", "p_type").alias("Texto")), path, sheet="Matriz")
    df = spreadsheets.read(s.spark, path, sheet="Matriz")
    found = tables.script_columns(df)
    return df.groupBy(F.col(found["cluster"]).alias("cluster"), F.col(found["phrase"]).alias("phrase")).agg(F.count("*").alias("n"))


@query("K01b_spreadsheet_dump", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipped, round(l_extendedprice, 2) AS price, l_returnflag = 'R' AS returned FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'")
def spreadsheet_dump(s: Source) -> DataFrame:
    """A stage's table as spreadsheets of at most 10,000 rows, with dates, numbers and truth values, read back with its types."""
    from voxlake.sources import spreadsheets
    from voxlake.storage import shared_folder

    x = s.table("lineitem").where(F.col("l_shipdate") < F.lit("1996-01-01 00:00:00").cast(s.table("lineitem").schema["l_shipdate"].dataType))
    x = x.select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("shipped"), F.round("l_extendedprice", 2).alias("price"), (F.col("l_returnflag") == "R").alias("returned"))
    path = shared_folder(s.spark)
    spreadsheets.write(x, path, rows_per_file=10_000)
    return spreadsheets.read(s.spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in x.schema))


@query("K09b_sheet_report", "SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS VARCHAR) AS remark FROM nation WHERE n_regionkey IN (1, 2)")
def sheet_report(s: Source) -> DataFrame:
    """A spreadsheet that replaces an older one, and rows added to it."""
    from voxlake.sources import spreadsheets
    from voxlake.storage import shared_folder

    path = shared_folder(s.spark)
    n = s.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("remark"), "n_regionkey").coalesce(1)
    for region, append in ((0, False), (1, False), (2, True)):
        spreadsheets.write(n.where(F.col("n_regionkey") == region).drop("n_regionkey"), path, append=append)
    return spreadsheets.read(s.spark, path, f"id {n.schema['id'].dataType.simpleString()}, name string, remark string")


@query("S17_pdf_scripts", r"SELECT item_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^\x20-\x7E]', '', 'g'), ' +', ' ', 'g')), ' '), lambda w: w <> ''), ' ') AS text FROM benchmark")
def pdf_scripts(s: Source) -> DataFrame:
    """Scripts as PDF files, written and read."""
    from voxlake.functions.python import by_value
    from voxlake.sources import pdf

    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^\x20-\x7E]", ""), " +", " "))
    files = s.table("benchmark").select("item_id", by_value(lambda t: pdf.written((t or "").split("\n")), "binary")(plain).alias("content"))
    return pdf.texts(files, "item_id", "content")


@query("K10_annotated_json", "SELECT conv_id AS call_id, CAST(sum(CASE WHEN contains(text, 'the') THEN 1 ELSE 0 END) AS BIGINT) AS marked FROM conversations GROUP BY 1")
def annotated_json(s: Source) -> DataFrame:
    """Sentences are marked inside the document, which is written as JSON and read again."""
    from voxlake.storage import shared_folder

    t = transcripts.parse(transcripts.nested(s.table("conversations")))
    paragraphs = F.col("results.channels")[0].alternatives[0].paragraphs.paragraphs
    marked = F.transform(paragraphs, lambda p: p.withField("sentences", F.transform(p.sentences, lambda x: x.withField("highlight", F.contains(x.text, F.lit("the"))))))
    path = shared_folder(s.spark)
    t.select("call_id", marked.alias("paragraphs")).write.json(path)
    back = s.spark.read.schema("call_id long, paragraphs array<struct<sentences:array<struct<text:string,highlight:boolean>>>>").json(path)
    n = F.size(F.filter(F.flatten(F.transform("paragraphs", lambda p: p.sentences)), lambda x: x.highlight))
    return back.select("call_id", n.cast("long").alias("marked"))
