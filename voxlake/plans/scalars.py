"""Scalar functions (F), arrays and nested JSON (N), and row splits (U04)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions import fuzzy as fuzzy_ratio
from voxlake.functions import matching
from voxlake.functions import numeric as Nu
from voxlake.functions import snowball
from voxlake.functions import text as T
from voxlake.functions.python import by_value
from voxlake.operators import calibrate
from voxlake.plans.aggregates import R
from voxlake.plans.joins import names
from voxlake.plans.registry import Source, query
from voxlake.sources import transcripts
from voxlake.views import REQUIRED_TOPICS, SCRIPT_ORDER, ctes

UTT, TOP = ctes("utterances"), ctes("call_topics")
CALLS = ctes("calls")
NORM = r"regexp_replace(translate(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), 'áàâäãåéèêëíìîïóòôöõúùûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync'), '\d+', '', 'g')"
WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[ \n\t\r]+'), lambda x: x <> '')"
LIST = "(" + ", ".join(f"'{w}'" for w in T.CONNECTORS) + ")"


def docs(s: Source, *columns) -> DataFrame:
    return s.table("documents").select("doc_id", *columns)


@query("F01_normalize", f"SELECT doc_id, {NORM} AS norm FROM documents")
def normalize(s: Source) -> DataFrame:
    return docs(s, T.normalize("text").alias("norm"))


@query("F02_tag_text", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:https?://|www\.)[^\s]+', '<URL>', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\d+(?:[.,]\d+)?', '<NUM>', 'g'), '!+', ' <EXCL> ', 'g') AS tagged FROM documents")
def tag_text(s: Source) -> DataFrame:
    x = F.col("text")
    for pattern, tag in ((T.URL, "<URL>"), (T.EMAIL, "<EMAIL>"), (T.NUMBER, "<NUM>"), ("!+", " <EXCL> ")):
        x = F.regexp_replace(x, pattern, tag)
    return docs(s, x.alias("tagged"))


@query("F03_lists_and_counts", f"SELECT doc_id, CAST(len({WORDS.format('text')}) AS INT) AS n_words, CAST(len(regexp_split_to_array(text, '[,\\n]')) AS INT) AS n_parts FROM documents")
def lists_and_counts(s: Source) -> DataFrame:
    return docs(s, F.size(T.words("text")).alias("n_words"), F.size(F.split("text", "[,\\n]")).alias("n_parts"))


@query("F04_stop_words", f"SELECT doc_id, array_to_string(list_filter({WORDS.format('lower(text)')}, lambda w: w NOT IN {LIST}), ' ') AS kept FROM documents")
def stop_words(s: Source) -> DataFrame:
    return docs(s, F.array_join(T.without(T.words(F.lower("text")), T.CONNECTORS), " ").alias("kept"))


def stem_set(words: list[str]) -> list[str]:
    return sorted({snowball.stem(w) for w in words})


stems = by_value(stem_set, "array<string>")


@query("F05_keywords")
def keywords(s: Source) -> DataFrame:
    """Distinct stems of the words that are no connectors."""
    return docs(s, F.array_join(stems(T.without(T.words(T.normalize("text")), T.CONNECTORS)), " ").alias("stems"))


@query("F06_token_sets", f"SELECT p_partkey, list_sort(list_distinct(list_filter(string_split(lower(p_name || ' ' || p_type), ' '), lambda w: w NOT IN {LIST}))) AS tokens FROM part")
def token_sets(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", F.array_sort(F.array_distinct(T.without(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " "), T.CONNECTORS))).alias("tokens"))


@query("F07_keep_enye", r"SELECT doc_id, trim(regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüýÿç', 'aaaaaaeeeeiiiiooooouuuuyyc'), '\s+', ' ', 'g')) AS norm FROM documents")
def keep_enye(s: Source) -> DataFrame:
    return docs(s, F.trim(F.regexp_replace(T.strip_accents(F.lower("text"), keep_enye=True), r"\s+", " ")).alias("norm"))


@query("F08_plain_ascii", r"SELECT doc_id, regexp_replace(translate(lower(text), 'áàâäãåéèêëíìîïóòôöõúùûüýÿñç', 'aaaaaaeeeeiiiiooooouuuuyync'), '[^a-z0-9 ]', '', 'g') AS plain FROM documents")
def plain_ascii(s: Source) -> DataFrame:
    return docs(s, F.regexp_replace(T.strip_accents(F.lower("text")), "[^a-z0-9 ]", "").alias("plain"))


ALIASES = {"MAC R": "MAC REFUERZO", "PRECIOS": "PRECIO", "LEGALES": "TERMINOS LEGALES"}
RAW = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE CAST(l_partkey % 5 AS INT) WHEN 0 THEN ' mac r ' WHEN 1 THEN 'Precios' WHEN 2 THEN 'LEGALES' WHEN 3 THEN 'saludo inicial' ELSE 'otra cosa' END AS raw FROM lineitem"


def raw_topics(s: Source) -> DataFrame:
    k = F.col("l_partkey") % 5
    return s.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(k == 0, " mac r ").when(k == 1, "Precios").when(k == 2, "LEGALES").when(k == 3, "saludo inicial").otherwise("otra cosa").alias("raw"))


@query("F09_canonical_topic", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE upper(trim(raw)) WHEN 'MAC R' THEN 'MAC REFUERZO' WHEN 'PRECIOS' THEN 'PRECIO' WHEN 'LEGALES' THEN 'TERMINOS LEGALES' ELSE upper(trim(raw)) END AS topic FROM ({RAW})")
def canonical_topic(s: Source) -> DataFrame:
    known = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    up = F.upper(F.trim("raw"))
    return raw_topics(s).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.coalesce(F.try_element_at(known, up), up).alias("topic"))


_TOPICS = "(VALUES " + ", ".join(f"('{t}', {k})" for k, t in enumerate(SCRIPT_ORDER)) + ")"


@query("F10_resolve_topics", f"""WITH r AS (SELECT DISTINCT upper(trim(raw)) AS u FROM ({RAW})), c AS (SELECT * FROM {_TOPICS} t(topic, k)), x AS (SELECT u, topic, k, CASE WHEN contains(u, topic) OR contains(topic, u) THEN 0 WHEN len(list_intersect(string_split(u, ' '), string_split(topic, ' '))) * 2 >= len(string_split(topic, ' ')) THEN 1 END AS method FROM r, c)
SELECT u AS raw, coalesce(arg_min(topic, (method, k)) FILTER (WHERE method IS NOT NULL), 'NONE') AS topic FROM x GROUP BY u""")
def resolve_topics(s: Source) -> DataFrame:
    """Contained either way, else half of a canonical topic's words; the first canonical wins. Distinct names only."""
    r = raw_topics(s).select(F.upper(F.trim("raw")).alias("raw")).distinct()
    c = s.spark.createDataFrame([(t, k) for k, t in enumerate(SCRIPT_ORDER)], "topic string, k int")
    common = F.size(F.array_intersect(F.split("raw", " "), F.split("topic", " ")))
    method = F.when(F.contains("raw", "topic") | F.contains("topic", "raw"), 0).when(common * 2 >= F.size(F.split("topic", " ")), 1)
    x = r.crossJoin(F.broadcast(c)).withColumn("m", method)
    return x.groupBy("raw").agg(F.coalesce(F.min_by("topic", F.when(F.col("m").isNotNull(), F.struct("m", "k"))), F.lit("NONE")).alias("topic"))


@query("F11_dictionary_replace", f"WITH {TOP} SELECT call_id, line, part_id, supp_id, price, coalesce(v, label) AS label FROM call_topics LEFT JOIN (VALUES ('MAC', 'ACTIVACION'), ('PRECIO', 'COSTO')) m(k, v) ON k = label")
def dictionary_replace(s: Source) -> DataFrame:
    m = s.spark.createDataFrame([("MAC", "ACTIVACION"), ("PRECIO", "COSTO")], "label string, v string")
    return s.view("call_topics").join(F.broadcast(m), "label", "left").select("call_id", "line", "part_id", "supp_id", "price", F.coalesce("v", "label").alias("label"))


KEYS = ["worthless", "the", "idiot", "license", "released"]


@query("F12_keyword_rates", f"SELECT doc_id, CAST({' + '.join(f'CAST(contains(n, {chr(39)}{k}{chr(39)}) AS INT)' for k in KEYS)} AS INT) AS hits, round(100.0 * ({' + '.join(f'CAST(contains(n, {chr(39)}{k}{chr(39)}) AS INT)' for k in KEYS)}) / greatest(length(n), 1), 8) AS rate FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def keyword_rates(s: Source) -> DataFrame:
    x = docs(s, T.normalize("text").alias("n"))
    hits = T.keyword_hits(F.col("n"), KEYS)
    return x.select("doc_id", hits.alias("hits"), R(100.0 * hits / F.greatest(F.length("n"), F.lit(1))).alias("rate"))


similarity = by_value(lambda a, b: matching.ratio(a or "", b or ""), "double")


fuzzy = by_value(lambda a, b: fuzzy_ratio.score(a or "", b or ""), "double")


def pairs(s: Source) -> DataFrame:
    p = s.table("part").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat_ws(" ", "p_type", F.lit("part"))).alias("b"))
    return p


@query("F13_similarity")
def similarity_query(s: Source) -> DataFrame:
    return pairs(s).select("p_partkey", R(similarity("a", "b")).alias("ratio"))


@query("F13b_levenshtein_ratio", "SELECT p_partkey, round(1 - levenshtein(lower(p_name), lower(p_type)) * 1.0 / greatest(length(p_name), length(p_type)), 8) AS ratio FROM part")
def levenshtein_ratio(s: Source) -> DataFrame:
    return s.table("part").select("p_partkey", R(1 - F.levenshtein(F.lower("p_name"), F.lower("p_type")) * F.lit(1.0) / F.greatest(F.length("p_name"), F.length("p_type"))).alias("ratio"))


@query("F14_fuzzy")
def fuzzy_query(s: Source) -> DataFrame:
    return pairs(s).select("p_partkey", R(fuzzy("a", "b")).alias("score"))


@query("F15_presence", f"WITH {CALLS} SELECT call_id, CASE WHEN mac_likelihood >= 0.88 THEN 'ok' WHEN mac_likelihood >= 0.8 THEN 'warn' ELSE 'missing' END AS flag FROM calls")
def presence(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", T.presence(F.col("mac_likelihood")).alias("flag"))


@query("F16_strip_blanks", r"SELECT doc_id, regexp_replace(text, '[\s]', '', 'g') AS solid FROM documents")
def strip_blanks(s: Source) -> DataFrame:
    return docs(s, F.regexp_replace("text", r"[\s]", "").alias("solid"))


@query("F17_fillers", r"SELECT doc_id, regexp_matches(trim(lower(text)), '^(?:(?:the|of|is|and|a)[\s,.]*)+$') AS filler, trim(regexp_replace(text, '\s+', ' ', 'g')) AS tidy FROM documents")
def fillers(s: Source) -> DataFrame:
    return docs(s, F.trim(F.lower("text")).rlike(r"^(?:(?:the|of|is|and|a)[\s,.]*)++$").alias("filler"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("tidy"))


@query("F18_names_and_urls", r"SELECT page_id, regexp_extract(url, '^https?://([^/]+)/(.*)$', 1) AS host, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS safe FROM pages")
def names_and_urls(s: Source) -> DataFrame:
    return s.table("pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)/(.*)$", 1).alias("host"), F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "_").alias("safe"))


@query("F19_mask_pii", r"SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\d{4}|\.\d|@|https?:|www\.') THEN regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(?:https?://|www\.)[^\s]+', '<URL>', 'g'), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}', '<EMAIL>', 'g'), '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b', '<IP>', 'g'), '\b\d{6,}\b', '<NUM>', 'g') ELSE text END AS masked FROM documents")
def mask_pii(s: Source) -> DataFrame:
    return docs(s, T.mask_pii("text").alias("masked"))


@query("F20_mask_more", r"SELECT doc_id, regexp_replace(regexp_replace(text, '\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b', '<IBAN>', 'g'), '\b\d{16}\b', '<CARD>', 'g') AS masked FROM documents")
def mask_more(s: Source) -> DataFrame:
    """The entities that patterns can tell; names of persons need a model, which is a pluggable column function."""
    return docs(s, F.regexp_replace(F.regexp_replace("text", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "<IBAN>"), r"\b\d{16}\b", "<CARD>").alias("masked"))


@query("F21_entities", r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'))) AS INT) AS emails, CAST(len(list_distinct(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'))) AS INT) AS ips, CAST(len(list_distinct(regexp_extract_all(text, '\b\d{6,}\b'))) AS INT) AS numbers, list_sort(list_distinct(regexp_extract_all(text, '\b\d{16}\b'))) AS cards FROM documents")
def entities(s: Source) -> DataFrame:
    return docs(s, F.size(T.found("text", T.EMAIL)).alias("emails"), F.size(T.found("text", T.IPV4)).alias("ips"), F.size(T.found("text", T.LONG_NUMBER)).alias("numbers"), F.array_sort(T.found("text", r"\b\d{16}\b")).alias("cards"))


MONEY = "SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN '$ ' || (1 + o_orderkey % 9) || '.' || (100 + o_orderkey % 900) || ',50' WHEN 1 THEN (o_orderkey % 9) || ',5 millones' WHEN 2 THEN 'USD ' || (1000 + o_orderkey) ELSE '€ ' || (1 + o_orderkey % 9) || '.' || (100 + o_orderkey % 900) END AS m FROM orders"


@query("F22_money", rf"""WITH m AS (SELECT o_orderkey, m, regexp_extract(m, '(\d[\d.,]*)', 1) AS n FROM ({MONEY})) SELECT o_orderkey, round(TRY_CAST(CASE WHEN regexp_matches(n, ',\d{{1,2}}$') THEN replace(replace(n, '.', ''), ',', '.') WHEN regexp_matches(n, '^\d{{1,3}}(\.\d{{3}})+$') THEN replace(n, '.', '') ELSE replace(n, ',', '') END AS DOUBLE) * CASE WHEN contains(lower(m), 'millon') THEN 1e6 ELSE 1 END, 4) AS amount,
CASE WHEN contains(m, '$') THEN '$' WHEN contains(m, '€') THEN 'EUR' WHEN contains(upper(m), 'USD') THEN 'USD' ELSE '' END AS currency FROM m""")
def money(s: Source) -> DataFrame:
    k, o = F.col("o_orderkey") % 4, F.col("o_orderkey")
    m = F.when(k == 0, F.concat(F.lit("$ "), 1 + o % 9, F.lit("."), 100 + o % 900, F.lit(",50"))).when(k == 1, F.concat(o % 9, F.lit(",5 millones"))).when(k == 2, F.concat(F.lit("USD "), 1000 + o)).otherwise(F.concat(F.lit("€ "), 1 + o % 9, F.lit("."), 100 + o % 900))
    x = s.table("orders").select("o_orderkey", m.alias("m"))
    amount, currency = T.money("m")
    return x.select("o_orderkey", R(amount, 4).alias("amount"), F.coalesce(currency, F.lit("")).alias("currency"))


@query("F23_iso_dates", r"WITH x AS (SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || '/' || month(o_orderdate) || '/' || strftime(o_orderdate, '%y') AS d FROM orders) SELECT o_orderkey, CASE WHEN CAST(string_split(d, '/')[3] AS INT) <= 69 THEN '20' ELSE '19' END || string_split(d, '/')[3] || '-' || lpad(string_split(d, '/')[2], 2, '0') || '-' || lpad(string_split(d, '/')[1], 2, '0') AS iso FROM x")
def iso_dates(s: Source) -> DataFrame:
    """d/m/yy; years up to 69 are of this century."""
    d = F.split(F.concat_ws("/", F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.date_format("o_orderdate", "yy")), "/")
    year = F.concat(F.when(d[2].cast("int") <= 69, "20").otherwise("19"), d[2])
    return s.table("orders").select("o_orderkey", F.concat_ws("-", year, F.lpad(d[1], 2, "0"), F.lpad(d[0], 2, "0")).alias("iso"))


@query("F24_id_country", r"SELECT o_orderkey, CASE WHEN regexp_matches(x, '^[A-Z]{4}\d{6}') THEN 'MX' WHEN regexp_matches(x, '^\d{2}-\d{8}-\d$') THEN 'AR' WHEN regexp_matches(x, '^\d{6,10}$') THEN 'CO' ELSE 'NA' END AS country FROM (SELECT o_orderkey, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'ABCD' || (100000 + o_orderkey) WHEN 1 THEN '20-' || (10000000 + o_orderkey) || '-3' WHEN 2 THEN CAST(1000000 + o_orderkey AS VARCHAR) ELSE 'x' END AS x FROM orders)")
def id_country(s: Source) -> DataFrame:
    k, o = F.col("o_orderkey") % 4, F.col("o_orderkey")
    x = F.when(k == 0, F.concat(F.lit("ABCD"), 100000 + o)).when(k == 1, F.concat(F.lit("20-"), 10000000 + o, F.lit("-3"))).when(k == 2, (1000000 + o).cast("string")).otherwise("x")
    c = F.col("x")
    return s.table("orders").select("o_orderkey", x.alias("x")).select("o_orderkey", F.when(c.rlike(r"^[A-Z]{4}\d{6}"), "MX").when(c.rlike(r"^\d{2}-\d{8}-\d$"), "AR").when(c.rlike(r"^\d{6,10}$"), "CO").otherwise("NA").alias("country"))


@query("F25_scored_numbers", r"WITH m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\b\d{6,12}\b'))) AS n, text FROM documents), s AS (SELECT doc_id, n, strpos(text, n) AS p, contains(lower(substr(text, greatest(strpos(text, n) - 40, 1), 80 + length(n))), 'token') AS near FROM m) SELECT doc_id, arg_max(n, (near, -p)) AS number FROM s GROUP BY 1")
def scored_numbers(s: Source) -> DataFrame:
    """The number with a keyword within 40 characters, or the first."""
    m = docs(s, "text", F.explode(T.found("text", r"\b\d{6,12}\b")).alias("n")).withColumn("p", F.expr("locate(n, text)"))
    near = F.contains(F.lower(F.substring("text", F.greatest(F.col("p") - 40, F.lit(1)), F.length("n") + 80)), F.lit("token"))
    return m.groupBy("doc_id").agg(F.max_by("n", F.struct(near.alias("near"), (-F.col("p")).alias("q"))).alias("number"))


@query("F26_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+(?:[.,]\d+)?'), ' ') AS numbers FROM documents")
def numbers(s: Source) -> DataFrame:
    return docs(s, F.array_join(F.regexp_extract_all("text", F.lit(T.NUMBER), F.lit(0)), " ").alias("numbers"))


@query("F27_json_block", "SELECT event_id, props AS block FROM events")
def json_block_query(s: Source) -> DataFrame:
    return s.table("events").select("event_id", T.json_block(F.concat(F.lit("Reply: "), "props", F.lit(" done }"))).alias("block"))


@query("F28_brackets", "SELECT vec_id, translate(translate('[' || label || ',{' || vec_id || '}]', '[', ''), ']{}', '') AS flat FROM embeddings")
def brackets(s: Source) -> DataFrame:
    return s.table("embeddings").select("vec_id", F.translate(F.concat(F.lit("["), "label", F.lit(",{"), "vec_id", F.lit("}]")), "[]{}", "").alias("flat"))


@query("F29_replace_map", "SELECT doc_id, replace(replace(text, ' thh', ' th'), ' wh ', ' who ') AS fixed FROM documents")
def replace_map(s: Source) -> DataFrame:
    return docs(s, T.replace_all("text", {" thh": " th", " wh ": " who "}).alias("fixed"))


NAMED = "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'bad' ELSE strftime(o_orderdate, '%Y%m%d-%H%M%S') END AS x FROM orders"


@query("F30_stamps", f"SELECT o_orderkey, strftime(TRY_STRPTIME(x, '%Y%m%d-%H%M%S'), '%Y-%m-%d %H:%M:%S') AS at FROM ({NAMED})")
def stamps(s: Source) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 4 == 3, "bad").otherwise(F.date_format("o_orderdate", "yyyyMMdd-HHmmss"))
    return s.table("orders").select("o_orderkey", Nu.stamp(x).alias("at"))


@query("F31_F32_folders", r"SELECT o_orderkey, regexp_replace('a/' || strftime(o_orderdate, '%d-%m-%Y') || '/b', '(\d\d)-(\d\d)-(\d{4})', '\3-\2-\1') AS path, regexp_extract(regexp_replace('a/' || strftime(o_orderdate, '%d-%m-%Y') || '/b', '(\d\d)-(\d\d)-(\d{4})', '\3-\2-\1'), '(\d{4}-\d\d-\d\d)', 1) AS day FROM orders")
def folders(s: Source) -> DataFrame:
    path = Nu.iso_folder(F.concat(F.lit("a/"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.lit("/b")))
    return s.table("orders").select("o_orderkey", path.alias("path"), F.regexp_extract(path, r"(\d{4}-\d\d-\d\d)", 1).alias("day"))


@query("F33_comma_decimals", "SELECT o_orderkey, TRY_CAST(replace(replace(CAST(o_orderkey % 100 AS VARCHAR) || ',5' || CASE WHEN o_orderkey % 3 = 0 THEN 'x' ELSE '' END, '.', ','), ',', '.') AS DOUBLE) AS v FROM orders")
def comma_decimals(s: Source) -> DataFrame:
    x = F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(",5"), F.when(F.col("o_orderkey") % 3 == 0, "x").otherwise(""))
    return s.table("orders").select("o_orderkey", Nu.comma_decimal(x).alias("v"))


@query("F34_time_tags", "SELECT event_id, printf('%02d:%02d', CAST(floor(value / 60) AS BIGINT), CAST(round_even(value % 60, 0) AS BIGINT)) AS tag FROM events WHERE value >= 0")
def time_tags(s: Source) -> DataFrame:
    return s.table("events").where("value >= 0").select("event_id", Nu.minute_tag("value").alias("tag"))


@query("F35_time_bins", f"WITH {CALLS} SELECT call_id, CASE WHEN participation >= 0 AND participation <= 0.15 THEN 'early' WHEN participation >= 0 AND participation <= 0.65 THEN 'mid' ELSE 'late' END AS bin, CAST(CASE WHEN participation < 0 THEN 6 ELSE least(floor(participation * 7), 6) END AS INT) AS rel_bin FROM calls")
def time_bins(s: Source) -> DataFrame:
    p = F.col("participation")
    return s.view("calls").select("call_id", Nu.time_bin(p).alias("bin"), F.when(p < 0, 6).otherwise(F.least(F.floor(p * 7), F.lit(6))).cast("int").alias("rel_bin"))


@query("F36_minutes_seconds", f"WITH {CALLS} SELECT call_id, round(floor(tmo_s / 60) + (floor(tmo_s) % 60) / 100.0, 2) AS mmss FROM calls")
def minutes_seconds(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", R(Nu.minutes_seconds("tmo_s"), 2).alias("mmss"))


@query("F37_ratios", "SELECT o_orderkey, round(CASE CAST(o_orderkey % 4 AS INT) WHEN 3 THEN NULL ELSE (o_orderkey % 90 + 10) / 100.0 END, 8) AS v FROM orders")
def ratios(s: Source) -> DataFrame:
    n = F.col("o_orderkey") % 90 + 10
    k = F.col("o_orderkey") % 4
    x = F.when(k == 0, F.concat(n, F.lit("%"))).when(k == 1, n.cast("string")).when(k == 2, F.concat(F.lit("0,"), n.cast("string"))).otherwise("")
    return s.table("orders").select("o_orderkey", R(Nu.ratio(x)).alias("v"))


@query("F38_finite", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE round_even(value, 2) END AS v FROM events")
def finite(s: Source) -> DataFrame:
    x = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).when(F.col("event_id") % 6 == 3, F.lit(float("inf"))).otherwise(F.col("value"))
    return s.table("events").select("event_id", F.bround(Nu.finite(x), 2).alias("v"))


@query("F39_array_strings", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 3 ELSE 8 END AS n, CASE WHEN event_id % 2 = 0 THEN event_id + 3.5 ELSE 0 END AS total FROM events")
def array_strings(s: Source) -> DataFrame:
    """Text that is no array becomes eight zeros."""
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("[1, 2.5, "), "event_id", F.lit("]"))).otherwise("n/a")
    a = F.coalesce(F.from_json(x, "array<double>"), F.array_repeat(F.lit(0.0), 8))
    return s.table("events").select("event_id", F.size(a).alias("n"), F.aggregate(a, F.lit(0.0), lambda t, v: t + v).alias("total"))


@query("F40_classes", f"WITH {CALLS} SELECT call_id, CASE WHEN wpm < 120 THEN 'low' WHEN wpm < 250 THEN 'mid' ELSE 'high' END AS speed, CASE WHEN silence < 0.25 THEN 'low' WHEN silence < 0.6 THEN 'mid' ELSE 'high' END AS volume, CASE WHEN -wpm / 2 < -45 THEN 'low' WHEN -wpm / 2 < -20 THEN 'mid' ELSE 'high' END AS level, round(least(greatest((-wpm / 2 + 80) / 80, 0), 1), 8) AS share FROM calls")
def classes(s: Source) -> DataFrame:
    db = -F.col("wpm") / 2
    return s.view("calls").select("call_id", Nu.speed_class("wpm").alias("speed"), Nu.volume_class("silence").alias("volume"), Nu.level_class(db).alias("level"), R(Nu.level_share(db)).alias("share"))


@query("F41_relative_class", "SELECT event_id, CASE WHEN value >= 0.2 * avg(value) OVER () THEN 'high' ELSE 'low' END AS class FROM events")
def relative_class(s: Source) -> DataFrame:
    e = s.table("events").select("event_id", "value")
    return e.crossJoin(F.broadcast(e.agg(F.avg("value").alias("m")))).select("event_id", F.when(F.col("value") >= 0.2 * F.col("m"), "high").otherwise("low").alias("class"))


@query("F42_linear_ratio", f"WITH {CALLS} SELECT call_id, round(least(questions / 5.0, 1), 8) AS q, round(least(participation / 0.15, 1), 8) AS p FROM calls")
def linear_ratio(s: Source) -> DataFrame:
    return s.view("calls").select("call_id", R(Nu.linear_ratio("questions", 5.0)).alias("q"), R(Nu.linear_ratio("participation", 0.15)).alias("p"))


@query("F43_divergence", f"WITH {TOP}, p AS (SELECT label, count(*) * 1.0 / sum(count(*)) OVER () AS p FROM call_topics WHERE line <= 3 GROUP BY 1), q AS (SELECT label, count(*) * 1.0 / sum(count(*)) OVER () AS q FROM call_topics WHERE line > 3 GROUP BY 1) SELECT round(sum(p * ln(p / q)) / ln(count(*)), 8) + 0.0 AS kl FROM p JOIN q USING (label)")
def divergence(s: Source) -> DataFrame:
    t = s.view("call_topics")
    g = t.groupBy("label").agg(F.count_if(F.col("line") <= 3).alias("a"), F.count_if(F.col("line") > 3).alias("b"))
    x = g.crossJoin(F.broadcast(g.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")))).where("a > 0 and b > 0").select((F.col("a") / F.col("ta")).alias("p"), (F.col("b") / F.col("tb")).alias("q"))
    return x.agg(R(F.sum(F.col("p") * F.ln(F.col("p") / F.col("q"))) / F.ln(F.count("*"))).alias("kl"))


@query("F44_machines", "SELECT o_orderkey, CASE WHEN o_orderkey % 2400 < 600 THEN 1 WHEN o_orderkey % 2400 < 1200 THEN 2 WHEN o_orderkey % 2400 < 1800 THEN 3 ELSE 4 END AS machines FROM orders")
def machines(s: Source) -> DataFrame:
    return s.table("orders").select("o_orderkey", Nu.machines(F.col("o_orderkey") % 2400).alias("machines"))


@query("F45_capped", "SELECT event_id, round(least(value / p, 1), 8) AS capped FROM events, (SELECT quantile_cont(value, 0.99) AS p FROM events)")
def capped(s: Source) -> DataFrame:
    """Scaled to the 99th percentile."""
    e = s.table("events").select("event_id", "value")
    return e.crossJoin(F.broadcast(calibrate.percentile(e, "value", 0.99))).select("event_id", R(F.least(F.col("value") / F.col("p"), F.lit(1.0))).alias("capped"))


@query("U04_split_long", f"WITH {UTT} SELECT call_id, turn, 0 AS part, array_to_string(words[1:num_words // 2], ' ') AS text FROM utterances WHERE num_words > 30 UNION ALL SELECT call_id, turn, 1, array_to_string(words[num_words // 2 + 1:], ' ') FROM utterances WHERE num_words > 30 UNION ALL SELECT call_id, turn, 0, array_to_string(words, ' ') FROM utterances WHERE num_words <= 30")
def split_long(s: Source) -> DataFrame:
    """Utterances of over 30 words become two."""
    half = F.floor(F.col("num_words") / 2).cast("int")
    both = F.array(F.slice("words", F.lit(1), half), F.slice("words", half + 1, F.col("num_words")))
    return s.view("utterances").select("call_id", "turn", F.posexplode(F.when(F.col("num_words") > 30, both).otherwise(F.array("words"))).alias("part", "w")).select("call_id", "turn", "part", F.array_join("w", " ").alias("text"))


def nearest_cut(text: str, marks: str, whole: bool) -> F.Column:
    """struct(distance to the middle, k) of the best place for a cut: behind a mark (whole: False; the last character is none) or before a space; null without one. One pass over the text's parts."""
    t = F.col(text) if whole else F.expr(f"substring({text}, 1, length({text}) - 1)")
    sizes = F.transform(F.split(t, marks, -1), lambda x: F.length(x))
    step, middle = (0 if whole else 1), F.length(text) / 2.0
    none = F.struct(F.lit(1e18).alias("off"), F.lit(-1).alias("k"))

    def add(state, size):
        k = state["at"] + size + step
        return F.struct((state["at"] + size + 1).alias("at"), F.least(state["best"], F.struct(F.abs(k - middle).alias("off"), k.alias("k"))).alias("best"))

    found = F.aggregate(F.slice(sizes, F.lit(1), F.size(sizes) - 1), F.struct(F.lit(0).alias("at"), none.alias("best")), add)["best"]
    return F.when(found["k"] >= 0, found["k"])


@query("U04b_split_at_punctuation", f"""WITH {UTT}, u AS (SELECT call_id, turn, text, length(text) AS n FROM utterances WHERE num_words > 30), m AS (SELECT *, list_filter(range(1, n), lambda i: contains('.,;:?!', substring(text, i, 1))) AS marks, list_transform(list_filter(range(1, n + 1), lambda i: substring(text, i, 1) = ' '), lambda i: i - 1) AS spaces FROM u),
p AS (SELECT *, CASE WHEN len(marks) > 0 THEN marks WHEN len(spaces) > 0 THEN spaces ELSE [n] END AS places FROM m), k AS (SELECT *, list_sort(list_transform(places, lambda i: {{{{d: abs(i - n / 2.0), k: i}}}}))[1].k AS k FROM p)
SELECT call_id, turn, 0 AS part, trim(substring(text, 1, CAST(k AS BIGINT)), ' ') AS text FROM k UNION ALL SELECT call_id, turn, 1, trim(substring(text, CAST(k + 1 AS BIGINT)), ' ') FROM k""".replace("{{", "{").replace("}}", "}"))
def split_at_punctuation(s: Source) -> DataFrame:
    """Utterances of over 30 words are cut behind the punctuation nearest the middle; without any, at the space nearest it."""
    k = F.coalesce(nearest_cut("text", "[.,;:?!]", False), nearest_cut("text", " ", True), F.length("text"))
    u = s.view("utterances").where("num_words > 30").withColumn("k", k)
    return u.select("call_id", "turn", F.posexplode(F.array(F.expr("trim(substring(text, 1, k))"), F.expr("trim(substring(text, k + 1))"))).alias("part", "text"))


@query("N01_flatten", f"WITH {UTT} SELECT call_id, turn, CAST(num_words AS INT) AS n FROM utterances WHERE num_words > 0")
def flatten(s: Source) -> DataFrame:
    x = transcripts.sentences(transcripts.parse(transcripts.nested(s.table("conversations"))))
    return x.select("call_id", "turn", F.size(T.words("text")).alias("n")).where("n > 0")


@query("N02_tolerant_lists", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n FROM events")
def tolerant_lists(s: Source) -> DataFrame:
    x = F.when(F.col("event_id") % 2 == 0, '["a", "b"]').otherwise("[broken")
    return s.table("events").select("event_id", F.size(F.coalesce(F.from_json(x, "array<string>"), F.expr("cast(array() as array<string>)"))).alias("n"))


@query("N03_topic_sequence", f"""WITH {TOP} SELECT call_id, '[' || string_agg('{{"topic":"' || label || '","words":' || words || '}}', ',' ORDER BY line, part_id, supp_id, price) || ']' AS topics FROM call_topics GROUP BY 1""")
def topic_sequence(s: Source) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("line", "part_id", "supp_id", "price", "label", "words")))
    return s.view("call_topics").groupBy("call_id").agg(F.to_json(F.transform(rows, lambda r: F.struct(r.label.alias("topic"), r.words.alias("words")))).alias("topics"))


@query("N04_safe_get", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS INT), -1) AS k, coalesce(json_extract_string(props, '$.a.b[2]'), 'none') AS deep FROM events")
def safe_get(s: Source) -> DataFrame:
    return s.table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("int"), F.lit(-1)).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b[2]"), F.lit("none")).alias("deep"))


@query("N05_highlight", f"WITH {UTT} SELECT call_id, turn, array_to_string(list_filter(['the', 'worthless', 'idiot'], lambda k: contains(lower(text), k)), ',') AS forbidden FROM utterances")
def highlight(s: Source) -> DataFrame:
    """Sentences inside the nested transcript get the keywords they hold."""
    keys = F.array(*map(F.lit, ("the", "worthless", "idiot")))
    t = transcripts.parse(transcripts.nested(s.table("conversations")))
    paragraphs = F.col("results.channels")[0].alternatives[0].paragraphs.paragraphs
    marked = F.transform(paragraphs, lambda p: p.withField("sentences", F.transform(p.sentences, lambda x: x.withField("forbidden", F.filter(keys, lambda k: F.contains(F.lower(x.text), k))))))
    return t.select("call_id", F.explode(marked).alias("p")).select("call_id", F.explode("p.sentences").alias("s")).select("call_id", "s.turn", F.array_join("s.forbidden", ",").alias("forbidden"))


@query("N06_tag_spans", "SELECT conv_id AS call_id, turn, CASE WHEN 2 BETWEEN turn AND turn + 1 THEN 1 ELSE 0 END AS mac, CASE WHEN 5 BETWEEN turn AND turn + 1 THEN 1 ELSE 0 END AS price FROM conversations")
def tag_spans(s: Source) -> DataFrame:
    t = transcripts.parse(transcripts.nested(s.table("conversations")))
    at = lambda x, k: F.lit(float(k)).between(x.getField("start"), x.getField("end")).cast("int")
    paragraphs = F.col("results.channels")[0].alternatives[0].paragraphs.paragraphs
    marked = F.flatten(F.transform(paragraphs, lambda p: F.transform(p.sentences, lambda x: x.withField("mac", at(x, 2)).withField("price", at(x, 5)))))
    return t.select("call_id", F.explode(marked).alias("s")).select("call_id", "s.turn", "s.mac", "s.price")


def mark_errors(node, key: str = "text", word: str = "worthless"):
    """Every object that has key gets highlight_error, at any depth."""
    if isinstance(node, list):
        return [mark_errors(x, key, word) for x in node]
    if isinstance(node, dict):
        out = {k: mark_errors(v, key, word) for k, v in node.items()}
        if isinstance(node.get(key), str):
            out["highlight_error"] = word in node[key]
        return out
    return node


marked_json = by_value(lambda text: None if text is None else json.dumps(mark_errors(json.loads(text))), "string")


@query("N07_mark_any_depth")
def mark_any_depth(s: Source) -> DataFrame:
    return transcripts.nested(s.table("conversations")).select(F.get_json_object("json", "$.call_id").cast("long").alias("call_id"), marked_json("json").alias("json"))


@query("N08_project_json", "SELECT conv_id AS call_id, count(*) AS sentences FROM conversations GROUP BY 1")
def project_json(s: Source) -> DataFrame:
    t = transcripts.parse(transcripts.nested(s.table("conversations")))
    slim = F.struct(F.col("metadata"), F.col("results.channels")[0].alternatives[0].paragraphs.paragraphs.alias("paragraphs"))
    return t.select("call_id", F.size(slim.getField("paragraphs")).cast("long").alias("sentences"))


@query("N09_word_timeline", f"WITH {UTT}, w AS (SELECT call_id, turn, start_s, end_s, words, unnest(range(1, num_words + 1)) AS i FROM utterances), c AS (SELECT *, length(words[i]) AS n FROM w) SELECT call_id, turn, CAST(i - 1 AS INT) AS i, round(start_s + (end_s - start_s) * (sum(n) OVER (PARTITION BY call_id, turn ORDER BY i) - n) / sum(n) OVER (PARTITION BY call_id, turn), 6) AS word_start FROM c")
def word_timeline(s: Source) -> DataFrame:
    """Words share their utterance's time by their letters."""
    w = s.view("utterances").select("call_id", "turn", "start_s", "end_s", F.posexplode("words").alias("i", "w")).withColumn("n", F.length("w"))
    by = Window.partitionBy("call_id", "turn")
    upto = F.sum("n").over(by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return w.select("call_id", "turn", "i", R(F.col("start_s") + (F.col("end_s") - F.col("start_s")) * upto / F.sum("n").over(by), 6).alias("word_start"))


@query("N10_best_label", f"WITH {CALLS} SELECT call_id, CASE WHEN m >= p AND m >= q THEN 'a' WHEN p >= q THEN 'b' ELSE 'c' END AS label, round(greatest(m, p, q) / nullif(m + p + q, 0), 8) AS p FROM (SELECT call_id, mac_likelihood AS m, price_likelihood AS p, silence AS q FROM calls)")
def best_label(s: Source) -> DataFrame:
    """Probabilities renormalised over a subset of labels, and the best (first on ties)."""
    m = F.create_map(F.lit("a"), F.col("mac_likelihood"), F.lit("b"), F.col("price_likelihood"), F.lit("c"), F.col("silence"))
    total = F.nullif(F.col("mac_likelihood") + F.col("price_likelihood") + F.col("silence"), F.lit(0.0))
    best = F.array_max(F.transform(F.map_entries(m), lambda e: F.struct(e.value.alias("v"), (-F.ascii(e.key)).alias("o"))))
    return s.view("calls").select("call_id", F.chr(-best.o).alias("label"), R(best.v / total).alias("p"))


__all__ = ["REQUIRED_TOPICS", "names"]
