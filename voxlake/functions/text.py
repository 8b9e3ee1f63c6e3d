"""Column functions over text: normalising, keywords, masking, extraction. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they are without their accents.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüýÿñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyync"
#: Connectors that carry no topic.
CONNECTORS = ["de", "la", "el", "los", "las", "y", "a", "en", "que", "the", "of", "and", "to", "in", "is", "le", "et", "der", "die", "das"]
URL = r"(?i)\b(?:https?://|www\.)[^\s]+"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d{1,3}[ \-]?\(?\d{2,4}\)?[ \-]?\d{3,4}[ \-]?\d{3,4}"
IPV4 = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
LONG_NUMBER = r"\b\d{6,}\b"
NUMBER = r"\d+(?:[.,]\d+)?"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_accents(x: Column | str, keep_enye: bool = False) -> Column:
    pairs = [(a, b) for a, b in zip(ACCENTED, PLAIN, strict=True) if not (keep_enye and a == "ñ")]
    return F.translate(_c(x), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def normalize(x: Column | str) -> Column:
    """Lower case, without punctuation, accents or digits."""
    return F.regexp_replace(strip_accents(F.regexp_replace(F.lower(_c(x)), r"[^\p{L}\p{N}_\s]", "")), r"\d+", "")


def words(x: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"[ \n\t\r]+"), lambda w: w != "")


def without(x: Column, dropped: Sequence[str]) -> Column:
    """Words not in a list; repeats stay."""
    return F.filter(x, lambda w: ~w.isin(*dropped))


def keyword_hits(x: Column, keywords: Sequence[str]) -> Column:
    """How many keywords the text contains."""
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(x, F.lit(k)).cast("int")
    return total


def presence(score: Column, ok: float = 0.88, warn: float = 0.80) -> Column:
    return F.when(score >= ok, "ok").when(score >= warn, "warn").otherwise("missing")


def mask_pii(x: Column | str) -> Column:
    """Addresses, mail, IP and long numbers become tags; a text without any of their signs is passed through."""
    c = _c(x)
    masked = c
    for pattern, tag in ((URL, "<URL>"), (EMAIL, "<EMAIL>"), (IPV4, "<IP>"), (LONG_NUMBER, "<NUM>")):
        masked = F.regexp_replace(masked, pattern, tag)
    return F.when(c.rlike(r"(?i)\d{4}|\.\d|@|https?:|www\."), masked).otherwise(c)


def found(x: Column | str, pattern: str) -> Column:
    """All distinct matches in the order of their first."""
    return F.array_distinct(F.regexp_extract_all(_c(x), F.lit(pattern), F.lit(0)))


def replace_all(x: Column | str, pairs: dict[str, str]) -> Column:
    out = _c(x)
    for a, b in pairs.items():
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def money(x: Column | str) -> tuple[Column, Column]:
    """(amount, currency) of text like "$ 1.234,50" or "2,5 millones"."""
    c = _c(x)
    number = F.regexp_extract(c, r"(\d[\d.,]*)", 1)
    comma_last = number.rlike(r",\d{1,2}$")
    dot_groups = number.rlike(r"^\d{1,3}(\.\d{3})+$")
    plain = F.when(comma_last, F.replace(F.replace(number, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(dot_groups, F.replace(number, F.lit("."), F.lit(""))).otherwise(F.replace(number, F.lit(","), F.lit("")))
    times = F.when(F.lower(c).contains("millon"), 1e6).when(F.lower(c).rlike(r"\bmil\b"), 1e3).otherwise(1.0)
    currency = F.when(c.contains("$"), "$").when(c.contains("€"), "EUR").when(F.upper(c).contains("USD"), "USD")
    return plain.try_cast("double") * times, currency


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing more. Parsers stop after a value, so it is looked at within an array and within an object: no text closes both early."""
    alone = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    return F.coalesce(alone & F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull(), F.lit(False))


def json_block(text: Column | str) -> Column:
    """The JSON in a reply: what a ```json fence holds, else the shortest stretch from the first { to a } where braces are balanced that parses, else the whole text if it does; NULL if none does.

    Only braces count, so the text is cut at them and folded: a depth, the length so far, and the first stretch that parses.
    """
    text = F.col(text) if isinstance(text, str) else text
    fence = F.nullif(F.regexp_extract(text, r"(?s)```json\s*(\{.*?\})\s*```", 1), F.lit(""))
    rest = F.substring(text, F.nullif(F.locate("{", text), F.lit(0)), F.length(text))
    begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        closes = piece.endswith("}")
        depth = state["depth"] + F.when(piece.endswith("{"), 1).when(closes, -1).otherwise(0)
        size = state["size"] + F.length(piece)
        whole = F.substring(rest, F.lit(1), size)
        # parsed only where a stretch is balanced, and none has been found
        found = F.when(state["found"].isNotNull(), state["found"]).when(closes & (depth == 0), F.when(is_json(whole), whole))
        return F.struct(depth.alias("depth"), size.alias("size"), found.alias("found"))

    balanced = F.when(rest.isNotNull(), F.aggregate(F.split(rest, r"(?<=[{}])"), begin, step, lambda state: state["found"]))
    return F.coalesce(F.when(is_json(fence), fence), balanced, F.when(is_json(text), text))
