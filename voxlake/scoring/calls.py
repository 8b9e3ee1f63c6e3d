"""A call's score in five dimensions, its sale flow, and the reasons to reject or warn. Column expressions over one row per call.

Calls have mac_count, mac_likelihood, price_likelihood, reinforced, participation, wpm, turns, questions, confidence, silence, overlap and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.views import REQUIRED_TOPICS, SCRIPT_ORDER

#: Weights of the dimensions.
WEIGHTS = {"d1": 0.40, "d2": 0.30, "d3": 0.15, "d4": 0.10, "d5": 0.05}


def mac_flow() -> Column:
    """struct<outcome, triggered, effective>."""
    none, sure, again = F.col("mac_count") == 0, (F.col("mac_likelihood") >= 0.88) & ~F.col("reinforced"), F.col("reinforced")
    outcome = F.when(none, "NO_MAC").when(sure, "VENTA_CONFIRMADA").when(again, "VENTA_REFUERZO").otherwise("NO_CONFIRMADA")
    triggered = ~none & ~sure & (again | (F.col("mac_likelihood") >= 0.80))
    return F.struct(outcome.alias("outcome"), triggered.alias("triggered"), (~none & again).alias("effective"))


def capped(x: Column) -> Column:
    return F.least(x, F.lit(10.0))


def sale_score() -> Column:
    outcome = mac_flow().outcome
    flow = F.when(outcome == "VENTA_CONFIRMADA", 3.0).when(outcome == "VENTA_REFUERZO", 2.0).when(outcome == "NO_CONFIRMADA", 0.5).otherwise(0.0)
    return capped(2 * (F.col("mac_count") > 0).cast("int") + 3 * F.coalesce("mac_likelihood", F.lit(0.0)) + flow + 2 * F.least(F.coalesce("price_likelihood", F.lit(0.0)), F.lit(1.0)))


def topic_flags(topics: DataFrame) -> DataFrame:
    """call_id and f0..f13: whether each topic of the script occurs."""
    return topics.groupBy("call_id").agg(*(F.bool_or(F.col("label") == t).alias(f"f{k}") for k, t in enumerate(SCRIPT_ORDER)))


def _flag(topic: str) -> Column:
    return F.coalesce(F.col(f"f{SCRIPT_ORDER.index(topic)}"), F.lit(False)).cast("int")


def required_count() -> Column:
    total = _flag(REQUIRED_TOPICS[0])
    for t in REQUIRED_TOPICS[1:]:
        total = total + _flag(t)
    return total


def compliance_score() -> Column:
    return capped(9 * required_count() / 6.0 + _flag("CONFIRMACION MONITOREO"))


def script_score(topics: DataFrame) -> DataFrame:
    """Topic flags with d3: completeness, and the share of topic pairs in the script's order of their first places. One grouping by call."""
    places = range(len(SCRIPT_ORDER))
    x = topics.groupBy("call_id").agg(*(F.bool_or(F.col("label") == t).alias(f"f{k}") for k, t in enumerate(SCRIPT_ORDER)), *(F.min(F.when(F.col("ordinal") == k, F.col("start_s"))).alias(f"__t{k}") for k in places))
    firsts = F.array(*(F.struct(F.col(f"__t{k}").alias("t"), F.lit(k).alias("ordinal")) for k in places))
    order = F.transform(F.array_sort(F.filter(firsts, lambda x: x.t.isNotNull())), lambda x: x.ordinal)
    x = x.withColumn("__o", order).drop(*(f"__t{k}" for k in places))
    n = F.size("__o")
    right = F.aggregate(F.transform("__o", lambda x, i: F.size(F.filter(F.slice("__o", i + 2, F.greatest(n, F.lit(1))), lambda y: y > x))), F.lit(0), lambda a, b: a + b)
    x = x.withColumn("tau", F.coalesce(F.try_divide(right, n * (n - 1) / 2), F.lit(0.0))).drop("__o")
    return x.withColumn("d3", 6 * required_count() / 6.0 + 4 * F.col("tau"))


def engagement_score() -> Column:
    p, w = F.col("participation"), F.col("wpm")
    share = F.when(p.between(0.55, 0.70), 4.0).when(p > 0.85, F.greatest(F.lit(0.0), 4 - 20 * (p - 0.85))).otherwise(4 * p / 0.55)
    speed = F.when(w.between(120, 160), 3.0).when(w > 160, F.greatest(F.lit(0.0), 3 - (w - 160) / 40)).otherwise(3 * w / 120)
    return capped(share + speed + F.least(F.col("turns") / 20, F.lit(1.0)) * 2 + F.least(F.col("questions") / 5, F.lit(1.0)))


def audio_score() -> Column:
    return capped(5 * F.col("confidence") + 3 * (1 - F.col("silence")) + 2 * (1 - F.col("overlap")))


def dimensions(calls: DataFrame, topics: DataFrame) -> DataFrame:
    """Calls with d1..d5; a call without topics has 0 for d2 and d3."""
    t = script_score(topics)
    t = t.select("call_id", compliance_score().alias("d2"), "d3")
    x = calls.join(t, "call_id", "left")
    return x.withColumns({"d1": sale_score(), "d2": F.coalesce("d2", F.lit(0.0)), "d3": F.coalesce("d3", F.lit(0.0)), "d4": engagement_score(), "d5": audio_score()})


def final_score() -> Column:
    total = F.lit(0.0)
    for d, w in WEIGHTS.items():
        total = total + w * F.col(d)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(10.0))


def available_score(parts: dict[str, Column]) -> Column:
    """The weighted mean of the dimensions that are not NULL."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for d, c in parts.items():
        total = total + F.when(c.isNotNull(), WEIGHTS[d] * c).otherwise(0.0)
        weight = weight + F.when(c.isNotNull(), WEIGHTS[d]).otherwise(0.0)
    return F.try_divide(total, weight)


def reasons(calls: DataFrame, *, mac_cut: float, price_cut: float, compat: bool = False) -> DataFrame:
    """Adds reject_reason, warning_reason and reject. References are means over all calls, one broadcast row. compat: forbidden words warn below their mean."""
    m = calls.agg(F.avg("score").alias("__s"), F.avg("tmo_s").alias("__t"), F.avg("forbidden_rate").alias("__f"))
    x = calls.crossJoin(F.broadcast(m))
    hangup = F.coalesce("hangup_s", "tmo_s")
    wrong = [(F.col("mac_likelihood") < mac_cut * 0.95, "MAC INCORRECTO"), (F.col("price_likelihood") < price_cut * 0.8, "PRECIO INCORRECTO"), (F.col("mac_count") > 2, "MAC FORZADO")]
    words = F.col("forbidden_rate") < 0.9 * F.col("__f") if compat else F.col("forbidden_rate") > 1.1 * F.col("__f")
    odd = [
        ((hangup < F.col("tmo_s") - 15) & (hangup > 20), "HANGUP ANTICIPADO"),
        (F.col("overlap_s") > 5, "OVERLAPPING"),
        (F.col("mac_likelihood") < mac_cut, "MAC INEXACTO"),
        (F.col("price_likelihood") < price_cut, "PRECIO INEXACTO"),
        (words, "PALABRAS PROHIBIDAS"),
        (F.col("tmo_s") < 0.8 * F.col("__t"), "TMO BAJO"),
        (F.col("score") < 0.8 * F.col("__s"), "PUNTAJE BAJO"),
        (F.col("participation") > 0.9, "BPC"),
    ]
    listed = lambda rules: F.concat_ws(", ", *(F.when(c, text) for c, text in rules))
    empty, closed = F.col("is_empty") == 1, F.col("strikes") > 3
    x = x.withColumn("reject_reason", F.when(empty, "LLAMADA VACÍA").when(closed, "NO AUDITABLE").otherwise(listed(wrong)))
    x = x.withColumn("warning_reason", F.when(empty | closed, "").otherwise(listed(odd)))
    return x.withColumn("reject", ~empty & ~closed & (F.col("reject_reason") != "")).drop("__s", "__t", "__f")


def conscious_sale() -> Column:
    part = F.least(F.col("participation") / 0.15, F.lit(1.0))
    share = F.when(F.col("questions") > 0, 0.5 * part + 0.5 * F.least(F.col("turns") / 40, F.lit(1.0))).otherwise(part)
    return 0.3 * share + 0.3 * F.least(F.col("questions") / 5, F.lit(1.0)) + 0.2 * F.col("mac_likelihood") + 0.2 * F.col("price_likelihood")
