"""Language-model scores by deleted interpolation.

P(w | v) = a3(b) c(v, w) / c(v) + a2(b) c(w) / N + a1(b) / (V + 1), where v is the token before (or a
mark for the text's start), and b the bucket of c(v): 0, or one for each power of two. The weights of each
bucket are learned by expectation-maximisation on held-out counts: one part of the training documents
(``FOLD``) is kept out of the counts whose maximum-likelihood estimates it then weighs. All of that part's
tokens are gathered as counts over the exact c(v, w), c(v) and c(w), a table that is written once and grows
with the corpus; each round of expectation-maximisation is one grouped sum over it, of at most ``BUCKETS`` rows, with
the weights as literals. The final model takes its estimates from all training documents.

Counting moves keys, not texts: each chunk of documents sends its distinct unigrams and bigrams with
their counts, parts sum them, and each chunk gets the sums back in its own order. A frequent
word or a group of copies costs a chunk one entry.

Defined results: null and empty texts are one end token; a null id is in no fold that is kept out;
without training tokens all counts are 0; repeated rows count each; other columns are ignored. Keys have
63 bits: two words that share one would be counted as one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C

FOLDS, TEST, FOLD = 7, 2, 3
CHUNK_BYTES, PART_BYTES = 16 << 20, 32 << 20
BUCKETS, ROUNDS, TOLERANCE = 64, 40, 1e-4
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)

_TOKEN = np.ones(256, bool)
_TOKEN[[0x20, *range(0x09, 0x0E)]] = False


def folds(ids: np.ndarray, none: int = np.iinfo(np.int64).min) -> np.ndarray:
    return np.array([0 if i == none else zlib.crc32(str(i).encode()) % FOLDS for i in ids.tolist()], np.int64)


class Sequence:
    """A chunk's tokens: hashes with an end after each text, the place of each token's predecessor (-1 at a start), and first tokens."""

    def __init__(self, chunk: C.Chunk):
        hashes, counts = [], []
        for lo, hi in A.slices(chunk.offsets):
            a, b = chunk.offsets[lo], chunk.offsets[hi]
            low = A.lower_ascii(chunk.data[a:b])
            starts, ends, first = A.runs(_TOKEN[low], chunk.offsets[lo : hi + 1] - a)
            hashes.append(A.words_hash(low, A.prefix(A.BYTE_VALUES[low]), starts, ends))
            counts.append(np.diff(first))
        words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.size = count + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.h = np.full(int(self.first[-1]), END)
        self.h[A.ragged(self.first[:-1], count)] = words
        before = np.empty_like(self.h)
        before[1:] = self.h[:-1]
        before[self.first[:-1]] = START
        self.doc = np.repeat(np.arange(len(count)), self.size)
        one = np.uint64(1)
        self.keys: list[np.ndarray] = []
        self.place: list[np.ndarray] = []
        for x in (self.h & ~one, A.mix(before * np.uint64(0x9E3779B97F4A7C15) + self.h) | one):
            keys, place = np.unique(x, return_inverse=True)
            self.keys.append(keys)
            self.place.append(place)
        self.order = np.argsort(np.concatenate(self.keys), kind="stable")

    def counted(self, mask: np.ndarray) -> np.ndarray:
        """How often each key stands in the documents of mask, in the order sent."""
        at = mask[self.doc]
        return np.concatenate([np.bincount(p[at], minlength=len(k)) for p, k in zip(self.place, self.keys, strict=True)])[self.order]

    def sums(self, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """c(w), c(v, w) and c(v) of each token."""
        flat = np.concatenate([C.unpack(a, "<u8") for a in answers] or [np.zeros(0, np.uint64)])
        back = np.empty(len(self.order), np.int64)
        back[self.order] = flat
        one, two = back[: len(self.keys[0])], back[len(self.keys[0]) :]
        word = one[self.place[0]]
        context = np.empty_like(word)
        context[1:] = word[:-1]
        end = np.searchsorted(self.keys[0], END & ~np.uint64(1))
        context[self.first[:-1]] = one[end] if len(one) else 0
        return word, two[self.place[1]], context


CORE, ALL, TOTALS = 1, 2, 9


def add_up(rows: list[dict]) -> Iterator[dict]:
    """Sums for each key, and the part's totals: core tokens, core distinct, all tokens, all distinct."""
    keys, (core, fold), _, ends = C.asked_of(rows, ["<u4", "<u4"])
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]) != 0)
    word = (keys[order][first] & np.uint64(1)) == 0
    totals = []
    for kind, values in ((CORE, core.astype(np.int64)), (ALL, core.astype(np.int64) + fold)):
        total = np.add.reduceat(values[order], first)
        totals += [int(total[word].sum()), int((total[word] > 0).sum())]
        each = np.empty(len(keys), np.uint64)
        each[order] = np.repeat(total, np.diff(np.append(first, len(keys)))).astype(np.uint64)
        yield from C.answer(kind, rows, ends, each)
    yield {"kind": TOTALS, "part": rows[0]["part"], "chunk": -1, "answer": np.array(totals, "<i8").tobytes()}


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1))).astype(np.int64), 0)


def learn(held: DataFrame, tokens: int, vocabulary: int, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Weights (BUCKETS x 3) of bigram, unigram and uniform estimates by expectation-maximisation on held-out counts: bucket, pair, context, word, n.

    A bucket that no held-out token is in takes the weights that are best for all tokens together; bucket 0 has no bigram estimates.
    """
    estimates = F.array(F.try_divide(F.col("pair").cast("double"), F.col("context")), F.col("word") / F.lit(float(max(tokens, 1))), F.lit(1 / (vocabulary + 1)))
    rows = held.select("bucket", F.col("n").cast("double").alias("n"), F.transform(estimates, lambda p: F.coalesce(p, F.lit(0.0))).alias("p"))
    own, every = np.full((BUCKETS, 3), 1 / 3), np.full(3, 1 / 3)
    seen = np.zeros(BUCKETS)
    for _ in range(rounds):
        mine = [F.element_at(F.lit(own[:, k].tolist()), F.col("bucket") + 1) * F.col("p")[k] for k in range(3)]
        all_ = [F.lit(float(every[k])) * F.col("p")[k] for k in range(3)]
        share = lambda parts, k: F.sum(F.col("n") * parts[k] / (parts[0] + parts[1] + parts[2]))
        found = rows.groupBy("bucket").agg(F.sum("n").alias("n"), *(share(mine, k).alias(f"m{k}") for k in range(3)), *(share(all_, k).alias(f"a{k}") for k in range(3))).collect()
        if not found:
            break
        sums, total = np.zeros((BUCKETS, 3)), np.zeros(3)
        for r in found:
            seen[r.bucket], sums[r.bucket] = r.n, (r.m0, r.m1, r.m2)
            total += (r.a0, r.a1, r.a2)
        sums, total = sums + 1e-3, total + 1e-3
        new, whole = sums / sums.sum(axis=1, keepdims=True), total / total.sum()
        moved = max(np.abs(new - own)[seen > 0].max(initial=0), np.abs(whole - every).max())
        own, every = new, whole
        if moved < tolerance:
            break
    own[seen == 0] = every
    own[0] = [0, *(own[0, 1:] / own[0, 1:].sum())]
    return own


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: the id, held_out, n_tokens, n_known, train_tokens, vocabulary, base_score, score."""
    table, parts = C.chunked(docs, text_col=text_col, id_col=id_col, chunk_bytes=chunk_bytes, part_bytes=part_bytes)

    def ask(chunk: C.Chunk) -> Iterator[dict]:
        s, f = Sequence(chunk), folds(chunk.ids)
        keys = np.concatenate(s.keys)[s.order]
        yield from C.ask(keys, [s.counted((f != TEST) & (f != FOLD)).astype("<u4"), s.counted(f == FOLD).astype("<u4")], parts, chunk.number)

    answers = C.written(C.by_part(C.each_chunk(table, ask, C.ASKED, C.ASKED_ARROW), parts, add_up))
    totals = np.zeros(4, np.int64)
    for r in answers.where(F.col("kind") == TOTALS).toLocalIterator():
        totals += np.frombuffer(r.answer, "<i8")
    core_tokens, core_words, tokens, words = map(int, totals)

    def tally(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        s = Sequence(chunk)
        at = (folds(chunk.ids) == FOLD)[s.doc]
        word, pair, context = (x[at] for x in s.sums(got.get(CORE, [])))
        rows, n = np.unique(np.stack([pair, context, word]).astype(np.int64), axis=1, return_counts=True)
        return pa.table({"bucket": pa.array(bucket(rows[1]), pa.int32()), "pair": pa.array(rows[0]), "context": pa.array(rows[1]), "word": pa.array(rows[2]), "n": pa.array(n, pa.int64())})

    held = C.with_answers(table, answers.where(F.col("kind") == CORE), tally, "bucket int, pair long, context long, word long, n long")
    weights = learn(C.written(held.groupBy("bucket", "pair", "context", "word").agg(F.sum("n").alias("n"))), core_tokens, core_words)

    def rate(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        s = Sequence(chunk)
        word, pair, context = s.sums(got.get(ALL, []))
        w = weights[bucket(context)]
        p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (words + 1)
        total = lambda x: np.add.reduceat(x, s.first[:-1]) if len(s.size) else np.zeros(0)
        return pa.table(
            {
                "id": chunk.table.column("id"),
                "held_out": pa.array(folds(chunk.ids) == TEST),
                "n_tokens": pa.array(s.size, pa.int64()),
                "n_known": pa.array(total((word > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(len(s.size), tokens), pa.int64()),
                "vocabulary": pa.array(np.full(len(s.size), words), pa.int64()),
                "base_score": pa.array(total(np.log10((word + 1) / (tokens + words + 1))), pa.float64()),
                "score": pa.array(total(np.log10(p)), pa.float64()),
            }
        )

    out = C.with_answers(table, answers.where(F.col("kind") == ALL), rate, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, vocabulary long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
