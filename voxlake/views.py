"""Domain views over the test tables: the call-centre entities, each as one SELECT that Spark and DuckDB both run.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

#: The expected order of topics in a call, and those that compliance requires.
SCRIPT_ORDER = ["SALUDO", "CONFIRMACION MONITOREO", "PERFILAMIENTO", "PRODUCTO", "CONFORMIDAD", "TRATAMIENTO DATOS", "MAC", "MAC REFUERZO", "PRECIO", "TERMINOS LEGALES", "LEY RETRACTO", "CONFIRMACION DATOS", "ATENCION", "DESPEDIDA"]
REQUIRED_TOPICS = ["TERMINOS LEGALES", "TRATAMIENTO DATOS", "LEY RETRACTO", "CONFIRMACION MONITOREO", "PRECIO", "CONFIRMACION DATOS"]

_TOPIC = "CASE {} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(SCRIPT_ORDER)) + " END"

VIEWS = {
    "calls": """SELECT o_orderkey AS call_id, o_custkey AS agent_id, CAST(o_custkey % 25 AS INT) AS campaign_id, o_orderdate AS call_ts,
        o_totalprice / 60000.0 AS score, 60.0 + o_orderkey % 600 AS tmo_s, (o_orderkey % 97) / 96.0 AS mac_likelihood, (o_orderkey % 89) / 88.0 AS price_likelihood,
        CAST(o_orderkey % 4 AS INT) AS mac_count, o_orderkey % 5 = 0 AS reinforced, (o_orderkey % 101) / 100.0 AS participation, (o_orderkey % 53) / 52.0 AS silence, (o_orderkey % 31) / 30.0 AS overlap,
        0.5 + (o_orderkey % 51) / 100.0 AS confidence, 80.0 + o_orderkey % 130 AS wpm, CAST(o_orderkey % 43 AS INT) AS turns, CAST(o_orderkey % 7 AS INT) AS questions, CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS is_empty,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 30.0 + o_orderkey % 400 END AS hangup_s, (o_orderkey % 17) * 1.0 AS overlap_s, (o_orderkey % 29) / 10.0 AS forbidden_rate, CAST(o_orderkey % 6 AS INT) AS strikes, o_orderstatus AS status, o_orderpriority AS priority
        FROM {orders}""",
    "call_topics": f"""SELECT l_orderkey AS call_id, {_TOPIC.format('CAST(l_partkey % 14 AS INT)')} AS label, CAST(l_partkey % 14 AS INT) AS ordinal, l_linenumber * 10.0 AS start_s, l_linenumber * 10.0 + l_quantity AS end_s,
        CAST(l_quantity AS INT) AS words, 1.0 - l_discount AS confidence, l_partkey AS part_id, l_suppkey AS supp_id, l_linenumber AS line, l_extendedprice AS price FROM {{lineitem}}""",
    "utterances": """SELECT call_id, turn, speaker, text, words, num_words, 0.4 * (upto - num_words) AS start_s, 0.4 * upto AS end_s FROM (
        SELECT call_id, turn, speaker, text, words, num_words, CAST(sum(num_words) OVER (PARTITION BY call_id ORDER BY turn) AS DOUBLE) AS upto FROM (
        SELECT conv_id AS call_id, turn, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 END AS speaker, text, WORDS(text) AS words, CAST(COUNT_OF(WORDS(text)) AS INT) AS num_words FROM {conversations}))""",
    "windows": """SELECT user_id AS file_id, event_id, ts, CAST(extract(hour FROM ts) * 3600 + extract(minute FROM ts) * 60 + floor(extract(second FROM ts)) AS INT) AS second_of_day, CAST(ts AS DATE) AS day, -value AS vol, value AS level, event_type AS state FROM {events}""",
    "agents": "SELECT c_custkey AS agent_id, c_name AS agent_name, c_nationkey AS campaign_id, c_acctbal AS balance, c_mktsegment AS segment FROM {customer}",
    "campaigns": "SELECT n_nationkey AS campaign_id, n_name AS campaign, n_regionkey AS sponsor_id, r_name AS sponsor FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    "dialer": "SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'VENTA' WHEN 'error' THEN 'AUD-1' WHEN 'signup' THEN 'v-OTHER' ELSE event_type END AS vici_status FROM {events}",
    "affected": "SELECT l_orderkey AS call_id, l_linenumber AS line, l_partkey AS part_id, l_suppkey AS supp_id, l_extendedprice AS price, CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN 'NO AUDITABLE' WHEN 1 THEN 'MAC INCORRECTO' WHEN 2 THEN 'PRECIO INCORRECTO' WHEN 3 THEN 'mac forzado, precio incorrecto' WHEN 4 THEN '' END AS summary_rejection FROM {lineitem}",
}


#: How each engine writes what the SELECTs call WORDS(x), a text's words, and COUNT_OF(x), an array's size.
_SPARK = [(r"WORDS\((\w+)\)", r"filter(split(coalesce(\1, ''), '[ \\n\\t\\r]+'), x -> x <> '')"), (r"COUNT_OF\(", "size(")]
_DUCK = [(r"WORDS\((\w+)\)", r"list_filter(regexp_split_to_array(coalesce(\1, ''), '[ \\n\\t\\r]+'), lambda x: x <> '')"), (r"COUNT_OF\(", "len(")]


def _in(text: str, dialect: list[tuple[str, str]]) -> str:
    text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.])", r"\1E0", text)  # doubles, not decimals
    for pattern, form in dialect:
        text = re.sub(pattern, form, text)
    return text


def duck(name: str) -> str:
    """The view's SELECT for DuckDB, with what it stands on written out."""
    return _in(re.sub(r"\{(\w+)\}", lambda m: f"({duck(m[1])})" if m[1] in VIEWS else m[1], VIEWS[name]), _DUCK)


def ctes(*names: str) -> str:
    """WITH items for these views."""
    return ", ".join(f"{n} AS ({duck(n)})" for n in names)


def spark_view(source, name: str) -> DataFrame:
    text = VIEWS[name]
    needs = set(re.findall(r"\{(\w+)\}", text))
    return source.sql(_in(text, _SPARK), **{n: spark_view(source, n) if n in VIEWS else source.table(n) for n in needs})
