"""Streams (T), models (M) and signals (V)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import numeric
from voxlake.ml import hosted, topics
from voxlake.operators import sequential
from voxlake.plans.aggregates import R
from voxlake.plans.registry import Source, query
from voxlake.plans.scoring import ALPHA, BETA, GAMMA, REL_BINS
from voxlake.signal import activity, chain, frames, kernels, spectral
from voxlake.storage import written
from voxlake.streaming import events as E
from voxlake.views import SCRIPT_ORDER, ctes


def stream(s: Source) -> DataFrame:
    return E.read(s.spark, s.sf_dir, "events.parquet")


@query("T01_tumbling", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def tumbling(s: Source) -> DataFrame:
    return E.available(E.tumbling(stream(s)), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", R(F.col("total"), 6).alias("total"))


@query("T02_sliding", "SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS w FROM events, range(0, 4) r(k)) GROUP BY 1")
def sliding(s: Source) -> DataFrame:
    return E.available(E.sliding(stream(s)), "complete").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@query("T03_sessions", "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY user_id, g")
def sessions(s: Source) -> DataFrame:
    return E.available(E.sessions(stream(s)), "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", R(F.col("total"), 6).alias("total"))


@query("T04_once", "SELECT DISTINCT event_id FROM events")
def once(s: Source) -> DataFrame:
    return E.available(E.once(stream(s)), "append").select("event_id")


@query("T05_running_totals", "SELECT user_id, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def running_totals(s: Source) -> DataFrame:
    """The last state of each user."""
    out = E.available(E.running_totals(stream(s)), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"), R(F.max_by("total", "n"), 6).alias("total"))


@query("T06_merged", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def merged(s: Source) -> DataFrame:
    return E.merged(stream(s), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def labelled(s: Source) -> DataFrame:
    return s.table("documents").join(s.table("labels"), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))


def judged(rows: DataFrame, key: str, **how) -> DataFrame:
    """Predictions for all rows by a model of those not held out."""
    model = topics.fit(rows.where(~topics.held_out(key)), **how)
    return topics.predict(model, rows).select(key, "label", "predicted", topics.held_out(key).alias("held_out"))


@query("M01_text_classifier")
def text_classifier(s: Source) -> DataFrame:
    return judged(labelled(s), "doc_id")


def timed_windows(s: Source) -> DataFrame:
    """Windows of 14 words of every utterance with their place in the call, their time bins and, as the classifier reads it, the text with a tail that says when."""
    from voxlake.operators import ordered as O

    u = s.view("utterances")
    ends = u.groupBy("call_id").agg(F.max("end_s").alias("call_s"))
    w = O.word_windows(u, "words", size=14, step=6, tail=False).join(ends, "call_id")
    middle = F.col("start_s") + (F.col("end_s") - F.col("start_s")) * (F.col("window_start") + F.size("window_words") / 2.0) / F.col("num_words")
    w = w.withColumn("t", middle).withColumn("rel", F.coalesce(F.try_divide("t", "call_s"), F.lit(0.0)))
    w = w.withColumn("bin", F.when(F.col("rel") <= 0.15, "early").when(F.col("rel") <= 0.65, "mid").otherwise("late")).withColumn("place_bin", sum(((F.col("rel") >= e).cast("int") for e in REL_BINS), F.lit(0)))
    tail = F.format_string(" [rt=%.2f][bin=%s][t=%02d:%02d]", "rel", "bin", F.floor(F.col("t") / 60).cast("int"), F.floor(F.col("t") % 60).cast("int"))
    return w.select("call_id", (F.col("turn") * 10_000 + F.col("window_start")).alias("place"), F.concat(F.array_join("window_words", " "), tail).alias("text"), F.when(F.col("speaker") == 1, "client").otherwise("agent").alias("label"), "bin", "place_bin")


@query("M03_conversation_classifier")
def conversation_classifier(s: Source) -> DataFrame:
    """Word windows with their times; a text model's log-probabilities with the weighted logarithms of the label's shares of the time bin, of the place in the call and of all windows added;
    then each call's best sequence of labels under counted transitions. Everything is learned from the calls that are not held out. A call that can't be decoded has no rows and
    stops no other (see M03b). Runs jobs before it returns: the model is fitted, transitions are counted, chunks written."""
    labels = ["agent", "client"]
    w = timed_windows(s)
    known = w.where(~topics.held_out("call_id"))
    scored = topics.predict(topics.fit(known), w)
    count = known.groupBy("label").agg(F.count("*").alias("of"))
    total = count.agg(F.sum("of").alias("all"))

    def share(column: str, kinds: int) -> DataFrame:
        """log P(column | label), smoothed, as an array by label."""
        n = known.groupBy("label", column).agg(F.count("*").alias("n"))
        every = known.select(column).distinct().crossJoin(F.broadcast(count)).join(n, ["label", column], "left")
        p = every.select(column, "label", F.ln((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("of") + kinds)).alias("p"))
        return p.groupBy(column).agg(*(F.coalesce(F.max(F.when(F.col("label") == y, F.col("p"))), F.lit(0.0)).alias(f"{column}_{y}") for y in labels))

    prior = count.crossJoin(F.broadcast(total)).agg(*(F.coalesce(F.max(F.when(F.col("label") == y, F.ln(F.col("of") / F.col("all")))), F.lit(0.0)).alias(f"prior_{y}") for y in labels))
    x = scored.join(share("bin", 3), "bin", "left").join(share("place_bin", len(REL_BINS) + 1), "place_bin", "left").crossJoin(F.broadcast(prior))
    term = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    said = [F.ln(F.greatest(F.coalesce(F.try_element_at("probabilities", F.lit(k + 1)), F.lit(0.0)), F.lit(1e-12))) + ALPHA * term(f"bin_{y}") + BETA * term(f"place_bin_{y}") + GAMMA * term(f"prior_{y}") for k, y in enumerate(labels)]
    e = x.select("call_id", "place", F.array(*said).alias("e"))
    steps = known.select("call_id", "label", F.lead("label").over(Window.partitionBy("call_id").orderBy("place")).alias("next")).where("next is not null").groupBy("label", "next").count()
    n = {(r["label"], r["next"]): r["count"] for r in steps.collect()}  # labels are few
    counts = np.array([[n.get((a, b), 0) + 1.0 for b in labels] for a in labels])
    firsts = known.withColumn("r", F.row_number().over(Window.partitionBy("call_id").orderBy("place"))).where("r = 1").groupBy("label").count()
    begin = {r["label"]: r["count"] for r in firsts.collect()}
    start = np.array([begin.get(y, 0) + 1.0 for y in labels])
    good, _ = sequential.decodable(e, keys="call_id", order="place", column="e", labels=len(labels))
    return sequential.viterbi(good, keys="call_id", order="place", column="e", labels=labels, transition=np.log(counts / counts.sum(axis=1, keepdims=True)), start=np.log(start / start.sum()))


@query("M03b_call_status", f"WITH {ctes('utterances')}, w AS (SELECT call_id, sum(CASE WHEN num_words = 0 THEN 0 WHEN num_words <= 14 THEN 1 ELSE (num_words - 14) // 6 + 1 END) AS windows, count(*) AS turns, count(*) FILTER (WHERE num_words = 0) AS empty FROM utterances GROUP BY 1) SELECT call_id, CAST(turns AS BIGINT) AS turns, CAST(windows AS BIGINT) AS windows, CAST(empty AS BIGINT) AS empty, CASE WHEN windows = 0 THEN 'no words' WHEN empty > 0 THEN 'turns without words' ELSE 'ok' END AS status FROM w")
def call_status(s: Source) -> DataFrame:
    """What the classifier's batch reports of every call, so that one that fails is seen and doesn't stop the others: turns, windows, turns without words, and why it is left out."""
    windows = timed_windows(s).groupBy("call_id").agg(F.count("*").alias("windows"))
    calls = s.view("utterances").groupBy("call_id").agg(F.count("*").alias("turns"), F.count(F.when(F.col("num_words") == 0, 1)).alias("empty"))
    x = calls.join(windows, "call_id", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))
    return x.select("call_id", "turns", "windows", "empty", F.when(F.col("windows") == 0, "no words").when(F.col("empty") > 0, "turns without words").otherwise("ok").alias("status"))


@query("M04_weighted_classifier")
def weighted_classifier(s: Source) -> DataFrame:
    return judged(labelled(s), "doc_id", kind="logistic", balanced=True)


TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@query("M07_nearest_phrases", f"""WITH t AS (SELECT 'r' || (conv_id * 1000 + turn) AS id, {TERMS} AS w FROM conversations UNION ALL SELECT 'p' || item_id, {TERMS} FROM benchmark),
g AS (SELECT id, unnest(w || [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS term FROM t), n AS (SELECT id, term, count(*) AS tf FROM g GROUP BY 1, 2),
f AS (SELECT term, ln(((SELECT count(*) FROM t) + 1) / (count(*) + 1)) AS idf FROM n GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT id, term, tf * idf AS x FROM n JOIN f USING (term) WHERE tf * idf > 0),
v AS MATERIALIZED (SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS w FROM x), p AS MATERIALIZED (SELECT CAST(substr(id, 2) AS BIGINT) AS p, term, w FROM v WHERE id LIKE 'p%'),
d AS (SELECT id, p, sum(v.w * p.w) AS dot FROM v JOIN p USING (term) WHERE id LIKE 'r%' GROUP BY 1, 2),
a AS (SELECT t.id, item_id AS p, round(sqrt(greatest(2 - 2 * coalesce(dot, 0), 0)), 9) AS d FROM t, benchmark LEFT JOIN d ON d.id = t.id AND d.p = item_id WHERE t.id LIKE 'r%'),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, p) AS r FROM a)
SELECT CAST(substr(id, 2) AS BIGINT) AS id, {SCRIPT_ORDER!r}[CAST(min(p) FILTER (WHERE r = 1) % 14 AS INT) + 1] AS topic, round(1 / (avg(d) + 1e-5), 6) AS confidence FROM o WHERE r <= 3 GROUP BY 1""")
def nearest_phrases(s: Source) -> DataFrame:
    phrases = s.table("benchmark").select((F.col("item_id") % 14).cast("int").alias("k"), F.col("item_id").alias("phrase_id"), "text")
    names = F.array(*map(F.lit, SCRIPT_ORDER))
    turns = s.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    found = topics.nearest_phrases(turns, phrases.select(names[F.col("k")].alias("topic"), "phrase_id", "text"), key="id")
    return found.select("id", "topic", R(F.col("confidence"), 6).alias("confidence"))


@query("M08_forest")
def forest(s: Source) -> DataFrame:
    """Windows of 15 words, each seventh, by TF-IDF and word vectors. They are dealt anew, as a single file may hold all turns, and written, as the model reads them in many passes. Runs jobs before it returns."""
    from voxlake.operators import ordered as O

    u = s.view("utterances").select("call_id", "turn", "words", F.when(F.col("speaker") == 1, "client").otherwise("agent").alias("label"))
    u = u.repartition("call_id", "turn").sortWithinPartitions("call_id", "turn")
    w = O.word_windows(u, "words", size=15, step=7, tail=False).select(F.format_string("%d/%d/%d", "call_id", F.col("turn").cast("long"), F.col("window_start").cast("long")).alias("id"), F.array_join("window_words", " ").alias("text"), "label")
    return judged(written(w), "id", kind="forest", embedding=16)


@query("M09_embedding_classifier")
def embedding_classifier(s: Source) -> DataFrame:
    """Word vectors and the edit distances from the labels' names, in a logistic model."""
    turns = s.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", F.coalesce("role", F.lit("none")).alias("label"))
    far = topics.label_distances("text", ["user", "assistant", "system"])
    rows = turns.withColumns(far).withColumn("text", F.coalesce("text", F.lit("")))
    return judged(rows, "id", kind="logistic", embedding=16, more=tuple(far))


@query("M10_two_means", """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c AS (SELECT vec_id, v, 0 AS k, list_aggregate(v, 'quantile_cont', 0.2) AS a, list_aggregate(v, 'quantile_cont', 0.8) AS b FROM v UNION ALL
SELECT vec_id, v, k + 1, CASE WHEN len(hi) BETWEEN 1 AND len(v) - 1 THEN list_avg([x FOR x IN v IF NOT abs(x - b) < abs(x - a)]) ELSE a END, CASE WHEN len(hi) BETWEEN 1 AND len(v) - 1 THEN list_avg(hi) ELSE b END FROM (SELECT *, [x FOR x IN v IF abs(x - b) < abs(x - a)] AS hi FROM c WHERE k < 20))
SELECT vec_id, array_to_string([CASE WHEN abs(x - b) < abs(x - a) THEN 1 ELSE 0 END FOR x IN v], '') AS speech FROM c WHERE k = 20""")
def two_means(s: Source) -> DataFrame:
    """Each sample's part of the louder or the quieter half, by two means over the file: a fold of built-ins."""
    return s.table("embeddings").select("vec_id", F.array_join(F.transform(numeric.two_means("embedding"), lambda x: x.cast("string")), "").alias("speech"))


@query("M11_mixture")
def mixture(s: Source) -> DataFrame:
    """Two components over each file's minutes, by level and spread; then a change to another one for a single quiet or loud minute is none."""
    m = s.view("windows").groupBy("file_id", F.floor(F.unix_timestamp("ts") / 60).alias("minute")).agg(F.avg("level").alias("mean"), F.coalesce(F.stddev_pop("level"), F.lit(0.0)).alias("spread"))
    x = topics.mixture(m, ["mean", "spread"])
    cut = x.agg(F.percentile_approx("mean", F.lit(0.2), F.lit(10_000)).alias("quiet"), F.percentile_approx("mean", F.lit(0.8), F.lit(10_000)).alias("loud"))
    odd = (F.col("mean") < F.col("quiet")) | (F.col("component") != F.col("__after")) & (F.col("mean") > F.col("loud"))
    x = frames.steady_labels(x.crossJoin(F.broadcast(cut)), "component", odd, keys=["file_id"], order=["minute"], name="smooth")
    return x.select("file_id", "minute", "component", "smooth")


INSTRUCTIONS = "Label every line of the call."
HOSTED = ["SALUDO", "MAC", "PRECIO", "DESPEDIDA"]


def pretended(prompt: str) -> str:
    """Stands for the hosted model: a label for each line by its length, one of them unknown until it is told so."""
    lines = prompt.split("\n\n", 1)[1].split("\n") if prompt.startswith(INSTRUCTIONS) else [x.split("\t")[0] for x in prompt.split("\n")[2:]]
    names = HOSTED if not prompt.startswith(INSTRUCTIONS) else [*HOSTED[:3], "ADIOS"]
    return "\n".join(f"{t}\t{names[len(t) % 4].lower()}\t{k}" for k, t in enumerate(lines))


@query("M13_hosted_labels", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS line, ['SALUDO', 'MAC', 'PRECIO', 'DESPEDIDA'][CAST(length(role || ': ' || text) % 4 AS INT) + 1] AS label FROM conversations")
def hosted_labels(s: Source) -> DataFrame:
    """Prompts, replies, and their repair where a label is not allowed; the model is a function that stands for it."""
    c = s.table("conversations").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), "[\t\n]", " "))
    asked = hosted.prompts(c, "conv_id", instructions=INSTRUCTIONS, labels=HOSTED)
    return hosted.labelled(asked, "conv_id", pretended, HOSTED).select("conv_id", "line", "label")


@query("M14_transcripts", "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'default' WHEN sum(length(text)) >= 4000 THEN 'whole' ELSE 'short' END AS status FROM conversations GROUP BY 1")
def hosted_transcripts(s: Source) -> DataFrame:
    """Transcripts by a function that stands for the service: it fails for each third call."""

    def service(audio: bytes) -> str:
        if audio.startswith(b"0"):
            raise TimeoutError
        return '{"t":"' + "x" * (int(audio[1:]) - len('{"t":""}')) + '"}' if int(audio[1:]) >= 4000 else '{"t":""}'

    files = s.table("conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).select("conv_id", F.concat((F.col("conv_id") % 3).cast("string"), F.coalesce("n", F.lit(0)).cast("string")).cast("binary").alias("audio"))
    return hosted.transcribed(files, "conv_id", "audio", service).select("conv_id", "status")


@query("V06_frame_levels", "SELECT vec_id, CAST(k AS INT) AS frame, round(20 * log10(sqrt(list_avg(list_transform(list_slice(CAST(embedding AS DOUBLE[]), 16 * k + 1, 16 * k + 16), lambda x: x * x))) + 1e-12), 6) AS db FROM embeddings, range(0, 4) r(k)")
def frame_levels(s: Source) -> DataFrame:
    """dB of the root mean square of each 16 samples."""
    e = F.col("embedding").cast("array<double>")
    square = lambda k: F.aggregate(F.slice(e, k * 16 + 1, F.lit(16)), F.lit(0.0), lambda t, x: t + x * x)
    levels = F.transform(F.sequence(F.lit(0), F.floor(F.size(e) / 16).cast("int") - 1), lambda k: 20 * F.log10(F.sqrt(square(k) / 16) + 1e-12))
    return s.table("embeddings").where("size(embedding) >= 16").select("vec_id", F.posexplode(levels).alias("frame", "db")).select("vec_id", "frame", R(F.col("db"), 6).alias("db"))


def power_sql(s: str, n: int, weight: str = "1") -> str:
    """The power spectrum of a list of n samples, by its definition."""
    part = lambda f: f"list_sum([{s}[i + 1] * ({weight}) * {f}(2 * pi() * i * k / {n}) FOR i IN range(0, {n})]) ** 2"
    return f"[{part('cos')} + {part('sin')} FOR k IN range(0, {n // 2 + 1})]"


@query("V08_flatness", f"WITH f AS (SELECT vec_id, CAST(t AS INTEGER) AS frame, x[32 * t + 1:32 * t + 32] AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest(range(0, (len(embedding) - 32) // 32 + 1)) AS t FROM embeddings WHERE len(embedding) >= 32)), p AS (SELECT vec_id, frame, {power_sql('s', 32)} AS p FROM f) SELECT vec_id, frame, round(exp(list_avg([ln(v + 1e-12) FOR v IN p])) / list_avg([v + 1e-12 FOR v IN p]), 6) AS flatness FROM p")
def flatness(s: Source) -> DataFrame:
    return s.table("embeddings").select("vec_id", F.posexplode(kernels.flatness_of("embedding")).alias("frame", "f")).select("vec_id", "frame", R(F.col("f"), 6).alias("flatness"))


@query("V09_activity_metrics", "SELECT user_id AS file_id, round(avg(CASE WHEN value >= 99 THEN 1.0 ELSE 0 END), 8) AS saturation, round(avg(CASE WHEN value > 20 THEN 1.0 ELSE 0 END), 8) AS activity, round(avg(value * value), 4) AS energy FROM events GROUP BY 1")
def activity_metrics(s: Source) -> DataFrame:
    v = F.col("value")
    return s.table("events").groupBy(F.col("user_id").alias("file_id")).agg(R(F.avg((v >= 99).cast("double"))).alias("saturation"), R(F.avg((v > 20).cast("double"))).alias("activity"), R(F.avg(v * v), 4).alias("energy"))


def wave(fn, kind: str):
    """A kernel over an embedding taken for a waveform of 640 samples a second."""
    from voxlake.functions.python import by_value

    return by_value(lambda x: None if x is None else fn(np.asarray(x, float)), kind)("embedding")


RATE = 640


@query("V01_dial_seconds", f"WITH p AS (SELECT vec_id, {power_sql('x', 64, '0.5 - 0.5 * cos(2 * pi() * i / 63)')} AS p FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)) SELECT vec_id, CASE WHEN list_sum(p[7:13]) / (list_sum(p) + 1e-12) >= 0.5 THEN 0.1 ELSE 0.0 END AS dial_s FROM p")
def dial_seconds(s: Source) -> DataFrame:
    return s.table("embeddings").select("vec_id", wave(lambda x: kernels.dial_seconds(x, RATE, 60, 120, 0.5), "double").alias("dial_s"))


@query("V02_signatures")
def signatures(s: Source) -> DataFrame:
    """Where a template stands, by correlation of deviations and a threshold that adapts to the file."""
    template = np.sin(np.arange(8) * 0.8)
    found = wave(lambda x: kernels.detect(x, template, RATE, 0.7, zero_mean=True, adaptive=True, merge=0.02), "array<double>")
    return s.table("embeddings").select("vec_id", found.alias("at")).select("vec_id", F.size("at").alias("hits"), R(F.try_element_at("at", F.lit(-1)), 6).alias("last_s"))


@query("V03_prepared")
def prepared(s: Source) -> DataFrame:
    """What the preparation chain leaves of each file: peak, level, crest, clipped share, noise floor."""
    names = ("peak_db", "rms_db", "crest_db", "clipped", "floor_db", "snr_db")

    def run(x):
        m = chain.measured(chain.prepared(x, RATE, low=20, high=250), RATE)
        return [m[n] for n in names]

    m = s.table("embeddings").select("vec_id", wave(run, "array<double>").alias("m"))
    return m.select("vec_id", *(R(F.col("m")[k], 6).alias(n) for k, n in enumerate(names)))


WAVES = "w AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(embedding) > 0)"


def framed_sql(size: int, hop: int, least: int = 1) -> str:
    """Centred frames as lists, zeros beyond the ends."""
    return f"""f AS MATERIALIZED (SELECT vec_id, CAST(t AS INTEGER) AS frame, [CASE WHEN {hop} * t + i - {size // 2} BETWEEN 0 AND len(x) - 1 THEN x[{hop} * t + i - {size // 2} + 1] ELSE 0 END FOR i IN range(0, {size})] AS s
 FROM (SELECT vec_id, x, unnest(range(0, (len(x) + 2 * {size // 2} - {size}) // {hop} + 1)) AS t FROM w WHERE len(x) >= {least}))"""


def mean_sql(v: str, size: int, name: str) -> str:
    """Moving mean over frames, ends repeated."""
    left, right = size // 2, size - 1 - size // 2
    w = "OVER (PARTITION BY vec_id ORDER BY frame"
    return f"""(sum({v}) {w} ROWS BETWEEN {left} PRECEDING AND {right} FOLLOWING) + greatest({left} - frame, 0) * first_value({v}) {w}) + greatest(frame + {right} - max(frame) OVER (PARTITION BY vec_id), 0) * last_value({v}) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {size} AS {name}"""


def runs_sql(source: str, flag: str, name: str) -> str:
    """Numbered runs of frames with a flag."""
    w = "OVER (PARTITION BY vec_id ORDER BY frame"
    return f"""{name}0 AS (SELECT *, CASE WHEN {flag} AND NOT coalesce(lag({flag}) {w}), false) THEN 1 ELSE 0 END AS new FROM {source}), {name} AS (SELECT *, CASE WHEN {flag} THEN sum(new) {w} ROWS UNBOUNDED PRECEDING) ELSE 0 END AS run FROM {name}0)"""


def joined_sql(source: str, gap: float, name: str) -> str:
    """Spans (a, b) joined over gaps."""
    return f"""{name}0 AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY vec_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {gap} THEN 1 ELSE 0 END AS new FROM {source}),
{name} AS (SELECT vec_id, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM {name}0) GROUP BY vec_id, g)"""


SECOND = 3 / RATE
#: Frames of 25 ms, each 5 ms: RMS, level, thresholds, on and off, runs of two, the majority of two.
ACTIVE = f"""{WAVES}, {framed_sql(16, 3)},
l0 AS (SELECT vec_id, frame, 20 * log10(sqrt(list_sum([v * v FOR v IN s]) / 16) + 1e-10) AS db FROM f),
l1 AS (SELECT vec_id, frame, greatest(db - max(db) OVER (PARTITION BY vec_id), -80) AS db FROM l0),
l2 AS (SELECT *, quantile_cont(db, 0.1) OVER (PARTITION BY vec_id) AS p10, quantile_cont(db, 0.35) OVER (PARTITION BY vec_id) AS p35, {mean_sql('db', 8, 'here')} FROM l1),
l3 AS (SELECT *, (1 - 0.7) * greatest(p35 + 3, p10 + 1) + 0.7 * greatest(here + 3, p10 + 1) AS lim FROM l2),
l4 AS (SELECT *, coalesce(last_value(CASE WHEN db >= lim THEN 1 WHEN db < lim - 1.5 THEN 0 END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY frame ROWS UNBOUNDED PRECEDING), 0) = 1 AS up FROM l3),
{runs_sql('l4', 'up', 'r')}, k AS (SELECT vec_id, frame, db, CASE WHEN run > 0 AND count(*) OVER (PARTITION BY vec_id, run) >= 2 THEN 1 ELSE 0 END AS kept FROM r),
act AS (SELECT vec_id, frame, db, 2 * m >= 1 AS active FROM (SELECT *, {mean_sql('kept', 2, 'm')} FROM k))"""


def speech_frames(s: Source) -> DataFrame:
    """The waveforms' frames of 25 ms, each 5 ms, with whether somebody speaks."""
    return frames.active(frames.table(s.table("embeddings"), "vec_id", "embedding", frames.rms_of(16, 3), ["rms"]), "vec_id", least=2, smooth=2, local=8)


def speech_spans(s: Source) -> DataFrame:
    return frames.padded(frames.segments(speech_frames(s), F.col("active") == 1, "vec_id", SECOND), "vec_id", 0.005)


@query("V04_voice_activity", f"WITH {ACTIVE}, {runs_sql('act', 'active', 's')}, sp AS (SELECT vec_id, greatest(min(frame) * {SECOND} - 0.005, 0) AS a, (max(frame) + 1) * {SECOND} + 0.005 AS b FROM s WHERE run > 0 GROUP BY vec_id, run), {joined_sql('sp', 0.0, 'j')} SELECT e.vec_id, CASE WHEN a IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY e.vec_id ORDER BY a) - 1 AS INTEGER) END AS segment, round(a, 8) AS start_s, round(b, 8) AS end_s FROM embeddings e LEFT JOIN j USING (vec_id)")
def voice_activity(s: Source) -> DataFrame:
    """Speech segments in seconds, by energy with mixed global and local thresholds; a file without any has a row of nulls."""
    number = F.row_number().over(Window.partitionBy("vec_id").orderBy("start")) - 1
    x = s.table("embeddings").select("vec_id").join(speech_spans(s).withColumn("segment", number), "vec_id", "left")
    return x.select("vec_id", "segment", R(F.col("start"), 8).alias("start_s"), R(F.col("end"), 8).alias("end_s"))  # a frame's length has seven decimals


@query("V09b_active_frames", f"WITH {ACTIVE} SELECT vec_id, round(avg(CASE WHEN active THEN 1.0 ELSE 0 END), 8) AS activity, round(avg(db) FILTER (WHERE active), 6) AS active_db, round(avg(db) FILTER (WHERE NOT active), 6) AS other_db, round(quantile_cont(db, 0.9) FILTER (WHERE active), 6) AS loud_db FROM act GROUP BY vec_id")
def active_frames(s: Source) -> DataFrame:
    """Share of active frames after smoothing, and the levels of active and other frames, which are the two metrics' parts of each file."""
    on = F.col("active") == 1
    return speech_frames(s).groupBy("vec_id").agg(R(F.avg("active")).alias("activity"), R(F.avg(F.when(on, F.col("db"))), 6).alias("active_db"), R(F.avg(F.when(~on, F.col("db"))), 6).alias("other_db"), R(F.percentile(F.when(on, F.col("db")), F.lit(0.9)), 6).alias("loud_db"))


#: Magnitudes of 16 samples' spectrum by its definition, and what they look like.
SHAPES = f"""{WAVES}, {framed_sql(16, 4, 16)},
m0 AS (SELECT vec_id, frame, [sqrt(list_sum([s[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * cos(2 * pi() * i * k / 16) FOR i IN range(0, 16)]) ** 2 + list_sum([s[i + 1] * (0.5 - 0.5 * cos(2 * pi() * i / 16)) * sin(2 * pi() * i * k / 16) FOR i IN range(0, 16)]) ** 2) FOR k IN range(0, 9)] AS m FROM f),
m1 AS (SELECT vec_id, frame, m, list_sum(m) + 1e-10 AS total, list_sum([m[k + 1] * 40 * k FOR k IN range(0, 9)]) / (list_sum(m) + 1e-10) AS centre FROM m0),
z0 AS (SELECT vec_id, frame, CAST(len([v FOR v IN m IF v > list_aggregate(m, 'quantile_cont', 0.75)]) AS DOUBLE) AS rich, exp(list_avg([ln(v + 1e-10) FOR v IN m])) / list_avg([v + 1e-10 FOR v IN m]) AS flat,
 sqrt(list_sum([m[k + 1] * (40 * k - centre) ** 2 FOR k IN range(0, 9)]) / total) AS spread, list_max(m) / (list_avg(m) + 1e-10) AS crest FROM m1)"""


def far_sql(c: str) -> str:
    q = lambda p: f"quantile_cont({c}, {p}) OVER (PARTITION BY vec_id)"
    return f"({c} - {q(0.5)}) / (CASE WHEN {q(0.75)} - {q(0.25)} >= 1e-8 THEN {q(0.75)} - {q(0.25)} ELSE stddev_pop({c}) OVER (PARTITION BY vec_id) + 1e-8 END + 1e-8)"


OVER = "OVER (PARTITION BY vec_id)"


@query("V05_overlap", f"""WITH {SHAPES}, z1 AS (SELECT vec_id, frame, 1.3 * {far_sql('rich')} + {far_sql('flat')} + {far_sql('spread')} - 0.8 * {far_sql('crest')} AS raw FROM z0),
z2 AS MATERIALIZED (SELECT vec_id, frame, {mean_sql('raw', 2, 'score')} FROM z1),
z3 AS (SELECT *, score >= greatest(0.8, quantile_cont(score, 0.5) {OVER} + 0.5 * greatest(quantile_cont(score, 0.75) {OVER} - quantile_cont(score, 0.25) {OVER}, 1e-6)) AS strong FROM z2),
{runs_sql('z3', 'strong', 'r')}, sp AS (SELECT vec_id, min(frame) / 160 AS a, (max(frame) + 1) / 160 AS b FROM r WHERE run > 0 GROUP BY vec_id, run HAVING count(*) >= 2), {joined_sql('sp', 0.008, 'j')},
pa AS (SELECT vec_id, greatest(a - 0.004, 0) AS a, least(b + 0.004, (SELECT max(frame) + 1 FROM z2 WHERE z2.vec_id = j.vec_id) / 160) AS b FROM j), {joined_sql('pa', 0.0, 'g')},
o AS (SELECT vec_id, a, b, avg(score) AS mean, quantile_cont(score, 0.95) AS p95, max(score) AS max FROM g JOIN z2 USING (vec_id) WHERE frame >= floor(a * 160 + 1e-9) AND frame < ceil(b * 160 - 1e-9) GROUP BY vec_id, a, b)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p95 DESC, a) AS INTEGER) AS rank, round(a, 6) AS start, round(b, 6) AS "end", round(b - a, 6) AS duration, round(mean, 6) AS mean, round(p95, 6) AS p95, round(max, 6) AS max FROM o""")
def overlap(s: Source) -> DataFrame:
    """Segments where voices overlap, ranked by score within each file."""
    shapes = frames.table(s.table("embeddings"), "vec_id", "embedding", frames.shape_of(RATE, 16, 4), [*frames.WEIGHTS]).withColumn("spoken", F.lit(True))
    x = frames.overlaps(shapes, "vec_id", second=4 / RATE, smooth=2, least=2, gap=0.008, pad=0.004, quartiles=0.5)
    return x.select("vec_id", "rank", *(R(F.col(c), 6).alias(c) for c in ("start", "end", "duration", "mean", "p95", "max")))


@query("V07_activity_variants")
def activity_variants(s: Source) -> DataFrame:
    """Frames that the energy, PCEN, pitch and band-model variants call active, and those on which more than half agree."""
    file = Window.partitionBy("vec_id")
    x = frames.table(s.table("embeddings"), "vec_id", "embedding", lambda x: activity.variants(x, RATE, 32, 8, low=40, high=160, bands=6), ["rms", "pcen", "f0", "bands"])
    x = x.withColumn("db", 20 * F.log10(F.col("rms") + frames.EPS)).withColumn("least", F.percentile("db", F.lit(0.6)).over(file) + 2).withColumn("normal", F.percentile("pcen", F.lit(0.88)).over(file))
    votes = {"energy": F.col("db") >= F.col("least"), "pcen": F.col("pcen") >= F.col("normal"), "pitch": ~F.isnan("f0"), "bands": F.col("bands") == 1}
    x = x.select("vec_id", *(v.cast("int").alias(n) for n, v in votes.items()))
    most = (2 * sum((F.col(n) for n in votes), F.lit(0)) > len(votes)).cast("int")
    return x.withColumn("most", most).groupBy("vec_id").agg(*(F.sum(n).alias(n) for n in (*votes, "most")))


@query("V08b_mel_and_richest")
def mel_and_richest(s: Source) -> DataFrame:
    """Mean mel energy in dB, distance of speech from noise, and the window with the richest spectrum."""

    def run(x):
        a, b = spectral.richest_window(x, RATE, 0.05, 0.0125, 16)
        return [float(10 * np.log10(spectral.mel(x, RATE, 16, 8, 6).mean() + 1e-10)), kernels.snr(x, RATE), a, b]

    m = s.table("embeddings").select("vec_id", wave(run, "array<double>").alias("m"))
    return m.select("vec_id", *(R(F.col("m")[k], 6).alias(n) for k, n in enumerate(("mel_db", "snr_db", "start_s", "end_s"))))


def speaker_turns(s: Source) -> DataFrame:
    """Turns of two speakers, the first to speak being 0: a mixture over cepstra; a change in a quiet frame, or for one loud frame alone, is none."""
    x = frames.table(s.table("embeddings"), "vec_id", "embedding", lambda x: activity.cepstral(x, RATE, 16, 8), ["component", "loudness"])
    x = x.withColumn("__loud", F.percentile("loudness", F.lit(0.8)).over(Window.partitionBy("vec_id")))
    odd = (F.col("loudness") < 0.05) | (F.col("component") != F.col("__after")) & (F.col("loudness") > F.col("__loud"))
    x = frames.steady_labels(x, "component", odd, keys=["vec_id"], order=["frame"], name="label")
    first = F.first("label").over(Window.partitionBy("vec_id").orderBy("frame"))
    return frames.turns(x.withColumn("speaker", (F.col("label") != first).cast("int")), "speaker", "vec_id", 8 / RATE)


@query("V10_tracks")
def tracks(s: Source) -> DataFrame:
    """Active and other samples, the two channels that the speakers' turns make, and the length of both parts joined again."""
    from voxlake.functions.python import by_value

    def run(x, spans, turns):
        x = np.asarray([] if x is None else x, float)
        on, off = activity.split(x, RATE, [tuple(p) for p in ([] if spans is None else spans)])
        left, right = activity.stereo(x, RATE, [(a, b, str(int(n))) for a, b, n in ([] if turns is None else turns)])
        return [len(on), len(off), float((left != 0).sum()), float((right != 0).sum()), len(activity.joined_calls([on, off], RATE, 0.01))]

    listed = lambda df, name, *columns: df.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.array(*(F.col(c).cast("double") for c in columns)))).alias(name))
    x = s.table("embeddings").select("vec_id", "embedding").join(listed(speech_spans(s), "spans", "start", "end"), "vec_id", "left").join(listed(speaker_turns(s), "turns", "start", "end", "speaker"), "vec_id", "left")
    m = x.select("vec_id", by_value(run, "array<double>")("embedding", "spans", "turns").alias("m"))
    return m.select("vec_id", *(F.col("m")[k].cast("int").alias(n) for k, n in enumerate(("active", "other", "left", "right", "joined"))))


@query("V11_audio_metrics")
def audio_metrics(s: Source) -> DataFrame:
    """All metrics of a batch of files; a file that fails has NULLs."""
    m = chain.batch_metrics(s.table("embeddings"), "vec_id", "embedding", RATE, np.sin(np.arange(8) * 0.8))
    return m.select("vec_id", *(R(F.col(c), 6).alias(c) for c in chain.COLUMNS))


@query("V12_diarised")
def diarised(s: Source) -> DataFrame:
    """Turns of two speakers: cepstra, a Gaussian mixture, rules."""
    return speaker_turns(s).select("vec_id", "turn", R(F.col("start"), 6).alias("start_s"), R(F.col("end"), 6).alias("end_s"), "speaker")


@query("M12_search")
def settings_search(s: Source) -> DataFrame:
    """Macro F1 on the rows held out for every setting, and which is best (of equals the first)."""
    found = topics.search(labelled(s), key="doc_id")
    best = max(range(len(found)), key=lambda k: (found[k][2], -k))
    return s.spark.createDataFrame([(r, e, float(f), k == best) for k, (r, e, f) in enumerate(found)], "reg double, elastic double, macro_f1 double, best boolean")
