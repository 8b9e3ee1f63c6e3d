"""Language identification by Bayesian evidence fusion.

Evidence on a page: its text, the language its markup declares, and the suffix of its address; the
prior is that of its host. Text likelihoods are of hashed byte trigrams, counted per language
over all labelled documents. How far a declaration or a suffix is to be believed is counted over all pages:
the languages that the texts alone suggest, summed for each declared code and suffix without the page's own share and
smoothed towards the overall shares. A host's prior is its pages' sum, smoothed towards its site's (the
last two labels of the host), smoothed towards the overall one; a page's own share is taken out of its
host's, site's and overall sums first. All sums are grouped aggregations with a partial sum in each task, so a
host with a third of all pages is no burden; the posterior is the normalised product.

What is broadcast: the trigram table (languages x 2**14 in single precision, at most ``LANGUAGES`` languages, 128 MiB; more are refused). Sums by host,
site, declared code and suffix are joined, all of them: broadcast if small, else a join whose skewed keys
are split. A suffix is any last label of a host name that is not part of an IP address.

Defined results: null or empty html has no text and no declaration; a null address is the host "" with
no suffix; ties go to the language first in the alphabet; documents with a null lang or text teach
nothing; without any taught language lang and probability are null; repeated rows count each; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C
from .html import BLOCKS, extract, host_of
from .markup import attributes, tags
from .tokens import batches_of_texts

BITS, LANGUAGES = 14, 2048
#: Overlapping trigrams are not independent: their log-likelihood counts for a third.
TEMPER = 1 / 3
HOST_WEIGHT, SITE_WEIGHT, EVIDENCE_WEIGHT = 5.0, 20.0, 10.0

_CODE = re.compile(r"\s*+([a-z]{2,3})(?![a-z])", re.I)


def declared(page: str) -> str:
    """The primary subtag that the markup declares, or "": that of the html element, else of a meta element in the head. Comments, scripts and the body declare nothing."""
    meta = ""
    for _, _, tag, closes, attrs in tags(page):
        if not tag:
            continue
        if tag in ("html", "meta") and not closes:
            own = dict(reversed([*attributes(attrs)]))  # of two of one name the first counts
            found = _CODE.match(next((own[c] for c in ("lang", "xml:lang") if _CODE.match(own.get(c, ""))), "") if tag == "html" else own.get("content", "") if own.get("http-equiv", "").strip().lower() == "content-language" else "")
            if found and tag == "html":
                return found[1].lower()
            meta = meta or (found[1].lower() if found else "")
        elif tag in BLOCKS and tag != "head" or closes and tag == "head":
            break
    return meta


def suffix_of(host: str) -> str:
    last = host.rpartition(".")[2]
    return "" if "." not in host or host.startswith("[") or re.fullmatch(r"[0-9]+|0x[0-9a-f]*", last) else last


def site_of(host: str) -> str:
    return ".".join(host.split(".")[-2:])


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The table columns of each text's trigrams (a space stands before and after), and their first (n + 1)."""
    n = np.diff(offsets)
    size = np.where(n > 0, n + 2, 0)
    first = np.concatenate([[0], np.cumsum(size)])
    padded = np.full(int(first[-1]), 32, np.uint8)
    padded[A.ragged(first[:-1] + 1, n)] = A.lower_ascii(data)
    padded[padded < 32] = 32
    x = padded.astype(np.uint32)
    h = x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16)) if len(x) > 2 else np.zeros(0, np.uint32)
    h = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    # a text of n bytes has n trigrams in its padded form
    starts = A.ragged(first[:-1], n)
    return h[starts], np.concatenate([[0], np.cumsum(n)])


def text_model(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order, and the log-probabilities of trigrams (languages x 2**BITS)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array([x or "" for x in batch.column(0).to_pylist()], object)
            data, offsets = A.utf8(batch.column(1))
            for lo, hi in A.slices(offsets, 4 << 20):
                h, first = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                names, own = np.unique(langs[lo:hi].astype(str), return_inverse=True)
                per = np.repeat(own, np.diff(first))
                both = np.bincount(per * (1 << BITS) + h, minlength=len(names) << BITS).reshape(len(names), -1)
                for k, name in enumerate(names.tolist()):
                    if name:
                        sums[name] = sums.get(name, 0) + both[k]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([C.pack(v.astype("<i8")) for v in sums.values()], pa.binary())], names=["lang", "counts"])

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in parts:
            for x in batch.column("counts").to_pylist():
                total += C.unpack(x, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([C.pack(total)], pa.binary())], names=["lang", "counts"])

    rows = docs.select(docs[lang_col].cast("string").alias("l"), docs[text_col].cast("string").alias("t")).where("l is not null and l <> '' and t is not null")
    found = rows.mapInArrow(partial, "lang string, counts binary").groupBy("lang").applyInArrow(add, "lang string, counts binary").limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found.sort(key=lambda r: r.lang)
    counts = np.array([C.unpack(r.counts, "<i8") for r in found]).reshape(len(found), 1 << BITS) + 0.5
    return [r.lang for r in found], np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def likelihoods(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Tempered log-likelihoods (texts x languages)."""
    out = np.zeros((len(texts), len(table)))
    data, offsets = A.utf8(pa.array(texts, pa.string()))
    for lo, hi in A.slices(offsets):
        h, first = trigrams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        full = np.diff(first) > 0
        if full.any():
            at = first[:-1][full]
            for k in range(0, len(table), 64):  # some languages at a time
                out[lo:hi][full, k : k + 64] = TEMPER * np.add.reduceat(table[k : k + 64, h].astype(np.float64), at, axis=1).T
    return out


def identify(pages: DataFrame, docs: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row per page: the id, lang, probability, text_lang, declared, suffix, host."""
    spark = pages.sparkSession
    id_type = pages.schema[id_col].dataType.simpleString()
    langs, table = text_model(docs, lang_col=lang_col, text_col=text_col)
    none = [F.lit(None).cast(t) for t in ("string", "double", "string")]
    if not langs:
        return pages.select(id_col, none[0].alias("lang"), none[1].alias("probability"), none[2].alias("text_lang"), none[0].alias("declared"), none[0].alias("suffix"), none[0].alias("host"))
    shared = spark.sparkContext.broadcast(table)
    count = len(langs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, at = batch.column(1).to_pylist(), 0
            for texts in batches_of_texts(batch.column(2)):
                hosts = [host_of(u) for u in urls[at : at + len(texts)]]
                like = likelihoods([extract(t) for t in texts], shared.value)
                rows = batch.slice(at, len(texts))
                at += len(texts)
                lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), count).cast(pa.list_(pa.float64())) for x in (like, softmax(like))]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(hosts), pa.array(list(map(site_of, hosts))), pa.array(list(map(suffix_of, hosts))), pa.array(list(map(declared, texts))), *lists], names=["id", "host", "site", "suffix", "declared", "like", "own"])

    seen = C.written(pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("u"), pages[html_col].cast("string").alias("h")).mapInArrow(read, f"id {id_type}, host string, site string, suffix string, declared string, like array<double>, own array<double>"))
    sums = lambda source: F.array(*(F.sum(F.col(source)[k]) for k in range(count)))
    hosts = C.written(seen.groupBy("host", "site").agg(sums("own").alias("host_sum")))
    sites = hosts.groupBy("site").agg(sums("host_sum").alias("site_sum"))
    overall = np.array(hosts.agg(sums("host_sum").alias("s")).first().s or [0.0] * count, float)

    def by(column: str) -> DataFrame:
        return C.written(seen.where(F.col(column) != "").groupBy(column).agg(sums("own").alias(f"{column}_sum")))

    shared_overall = spark.sparkContext.broadcast(overall)

    def weights(sums: pa.Array, own: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log P(value | language) from the other pages, up to what is the same for all languages; 0 without a value."""
        has = sums.is_valid().to_numpy(zero_copy_only=False)
        s = np.maximum(sums.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, count) - own[has], 0)
        out = np.zeros((len(sums), count))
        out[has] = np.log((s + EVIDENCE_WEIGHT * share[has]) / (s.sum(axis=1, keepdims=True) + EVIDENCE_WEIGHT)) - np.log(share[has])
        return out

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overall = shared_overall.value
        for batch in batches:
            if not len(batch):
                continue
            like, own, host, site = (batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, count) for c in ("like", "own", "host_sum", "site_sum"))
            rest = lambda x, own=own: np.maximum(x - own, 0)
            base = rest(overall[None, :]) + 1.0
            base /= base.sum(axis=1, keepdims=True)
            level = rest(site) + SITE_WEIGHT * base
            level /= level.sum(axis=1, keepdims=True)
            prior = rest(host) + HOST_WEIGHT * level
            prior /= prior.sum(axis=1, keepdims=True)
            total = like + np.log(prior) + weights(batch.column("declared_sum"), own, base) + weights(batch.column("suffix_sum"), own, base)
            p = softmax(total)
            best, text = p.argmax(axis=1), own.argmax(axis=1)
            has_text = like.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([langs[k] for k in best]), pa.array(p[np.arange(len(p)), best]), pa.array([langs[k] if t else None for k, t in zip(text, has_text, strict=True)], pa.string()), batch.column("declared"), batch.column("suffix"), batch.column("host")],
                names=[id_col, "lang", "probability", "text_lang", "declared", "suffix", "host"],
            )

    joined = seen.join(hosts.select("host", "host_sum"), "host").join(F.broadcast(sites) if _small(sites) else sites, "site")
    for column in ("declared", "suffix"):
        found = by(column)
        joined = joined.join(F.broadcast(found) if _small(found) else found, column, "left")
    return joined.select("id", "host", "suffix", "declared", "like", "own", "host_sum", "site_sum", "declared_sum", "suffix_sum").mapInArrow(fuse, f"`{id_col}` {id_type}, lang string, probability double, text_lang string, declared string, suffix string, host string")


def _small(df: DataFrame, rows: int = 20_000) -> bool:
    return df.limit(rows + 1).count() <= rows
