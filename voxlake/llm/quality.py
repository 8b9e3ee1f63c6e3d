"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Word vectors: every token has a sparse ternary index vector drawn from its hash; its word
vector is its own index vector plus the normalised sum of its neighbours' index vectors over
the whole corpus. Tokens are runs of word bytes or of punctuation, lower-cased. Words share ``ROWS`` hashed rows, so
the vectors are one matrix of fixed size: each task sums its own, blocks of rows are summed
after a shuffle, and the sum (4 MB whatever the input) is broadcast.

A document's vector is the mean of its tokens' vectors, of tokens that repeat the one before only the first; the shares
of words in capitals, of such repetitions and of tokens that stood up to ``NEAR`` places before; and the log of its length. A numpy network with one hidden layer learns from at most ``SAMPLE`` labelled rows (the
least by hash of the id, a documented bound on rows as well as ids), in the order of that hash, so that
scores do not depend on how the table is laid out; it holds a fifth back, and divides its logits
by the temperature that fits those best.

Only rows outside the held-out fold (crc32 of the id as text, mod 3, is 1) give labels.

Defined results: null or empty text has the vector of no tokens and still gets a score; a null id is
in no held-out fold and gives no label; several labels of one id are averaged; without labelled
rows every score is 0.5; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A

ROWS, DIM, NONZERO, REACH = 1 << 14, 64, 4, 2
BLOCK_ROWS = 1 << 10
SAMPLE = 20_000
HIDDEN, NEAR, SHARES = 32, 6, 3

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(0x21), 0x7F]] = 0
_CLASS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The non-zero places and signs of each row's index vector."""
    rng = np.random.default_rng(7)
    return np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO].astype(np.int64), rng.choice([-1.0, 1.0], (ROWS, NONZERO))


def token_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix rows of all tokens, each document's first token (n + 1), and which tokens are words in capitals, which repeat the word before, and which one of the NEAR before."""
    kind = _CLASS[data]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(kind)]] = True
    bounds = np.flatnonzero(change)
    ends = np.append(bounds[1:], len(kind)) if len(bounds) else bounds
    solid = kind[bounds] != 0
    starts, ends = bounds[solid], ends[solid]
    low = A.lower_ascii(data)
    hashes = A.words_hash(low, A.prefix(A.BYTE_VALUES[low]), starts, ends)
    first = np.searchsorted(starts, offsets)
    rows = (hashes >> np.uint64(50)).astype(np.int64)
    capitals, again, near = (np.zeros(len(rows), bool) for _ in range(3))
    if len(starts):
        upper = (data >= 65) & (data <= 90)
        second = np.minimum(starts + 1, ends - 1)
        capitals = (ends - starts > 1) & upper[starts] & upper[second]
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        again[2:] |= (hashes[2:] == hashes[:-2]) & (doc[2:] == doc[:-2]) & (kind[starts[1:-1]] == 2)
        for lag in range(1, min(NEAR, len(rows) - 1) + 1):
            near[lag:] |= (hashes[lag:] == hashes[:-lag]) & (doc[lag:] == doc[:-lag])
    return rows, first, capitals, again, near


def contexts(data: np.ndarray, offsets: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """The sum of the neighbours' index vectors for each row."""
    total = np.zeros(ROWS * DIM)
    for lo, hi in A.slices(offsets, 4 << 20):
        a, b = offsets[lo], offsets[hi]
        rows, first, _, _, _ = token_rows(data[a:b], offsets[lo : hi + 1] - a)
        doc = np.repeat(np.arange(hi - lo), np.diff(first))
        for o in range(1, REACH + 1):
            same = doc[o:] == doc[:-o]
            left, right = rows[:-o][same], rows[o:][same]
            for mine, other in ((left, right), (right, left)):
                for j in range(NONZERO):
                    total += np.bincount(mine * DIM + places[other, j], signs[other, j], ROWS * DIM)
    return total.reshape(ROWS, DIM)


def word_vectors(docs: DataFrame, *, text_col: str = "text") -> np.ndarray:
    """The ROWS x DIM matrix of word vectors, from all documents."""
    places, signs = index_vectors()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((ROWS, DIM))
        for batch in batches:
            total += contexts(*A.utf8(batch.column(0)), places, signs)
        blocks = range(0, ROWS, BLOCK_ROWS)
        yield pa.RecordBatch.from_arrays([pa.array([k // BLOCK_ROWS for k in blocks], pa.int32()), pa.array([total[k : k + BLOCK_ROWS].astype("<f4").tobytes() for k in blocks], pa.binary())], names=["block", "sums"])
        A.trim()

    def add(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK_ROWS * DIM)
        for batch in parts:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer(), "<f4")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

    sums = docs.select(docs[text_col].cast("string").alias("t")).mapInArrow(partial, "block int, sums binary")
    out = np.zeros((ROWS, DIM))
    for r in sums.groupBy("block").applyInArrow(add, "block int, sums binary").collect():
        out[r.block * BLOCK_ROWS : (r.block + 1) * BLOCK_ROWS] = np.frombuffer(r.sums, "<f4").reshape(-1, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)
    np.add.at(out, (np.repeat(np.arange(ROWS), NONZERO), places.ravel()), signs.ravel() / np.sqrt(NONZERO))
    return out.astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Each document's vector: the mean over its tokens, the shares of capitals and of repetitions, and the log of the tokens' number."""
    out = np.zeros((len(offsets) - 1, DIM + SHARES + 1), np.float32)
    for lo, hi in A.slices(offsets):
        a, b = offsets[lo], offsets[hi]
        rows, first, capitals, again, near = token_rows(data[a:b], offsets[lo : hi + 1] - a)
        n = np.diff(first)
        full = n > 0
        if full.any():
            at, counted = first[:-1][full], (~again).astype(np.float32)
            if hi - lo == 1:  # one long document: by parts
                total = sum((vectors[rows[k : k + 100_000]] * counted[k : k + 100_000, None]).sum(axis=0, dtype=np.float64) for k in range(0, len(rows), 100_000))[None, :]
            else:
                total = np.add.reduceat(vectors[rows] * counted[:, None], at, axis=0)
            out[lo:hi][full, :DIM] = total / np.add.reduceat(counted, at)[:, None]  # a document's first token is counted
            for k, flags in enumerate((capitals, again, near)):
                out[lo:hi][full, DIM + k] = np.add.reduceat(flags.astype(np.int64), at) / n[full]
        out[lo:hi, DIM + SHARES] = np.log1p(n) / 8
    return out


class Network:
    """Two layers: tanh, then a logit; probabilities are of logit / temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, epochs: int = 60, rate: float = 0.01):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = (x - self.mean) / self.scale
        rng = np.random.default_rng(seed)
        held = rng.random(len(y)) < 0.2
        if not 0 < held.sum() < len(y):
            held = np.zeros(len(y), bool)
        fit, target = z[~held], y[~held]
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.array(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))]
        m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
        for _ in range(epochs):
            order = rng.permutation(len(target))
            for k in range(0, len(order), 256):
                i = order[k : k + 256]
                h = np.tanh(fit[i] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - target[i]) / len(i)
                back = np.outer(d, p[2]) * (1 - h * h)
                grads = [fit[i].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum()]
                t += 1
                for q in range(4):
                    m[q] = 0.9 * m[q] + 0.1 * grads[q]
                    v[q] = 0.999 * v[q] + 0.001 * grads[q] ** 2
                    p[q] = p[q] - rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(v[q] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature, self.seen = p, 1.0, len(y)
        at = held if held.any() else ~held
        logits, target = self.logits(x[at]), y[at]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        loss = [np.mean(np.logaddexp(0, logits / g) - target * logits / g) for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


class Constant:
    """For want of labels."""

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5)


def held_out(id_column: F.Column) -> F.Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> Network | Constant:
    """Learns from at most ``sample`` labelled documents outside the held-out fold."""
    known = labels.select(labels[label_id_col].alias("i"), labels[label_col].cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & F.col("i").isNotNull() & ~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.avg("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(*A.utf8(batch.column(0)), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["i", "y", "x"])

    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t")).join(F.broadcast(known), "i")
    vectors_of = rows.select("t", "i", "y").mapInArrow(run, f"i {rows.schema['i'].dataType.simpleString()}, y double, x binary")
    got = vectors_of.orderBy(F.xxhash64("i"), "i", "x").limit(sample).select("y", "x").collect()
    if not got:
        return Constant()
    x = np.frombuffer(b"".join(r.x for r in got), "<f4").reshape(-1, DIM + SHARES + 1).astype(np.float64)
    return Network(x, np.array([r.y for r in got]))


def score(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, any columns named in keep, held_out, score (0 to 1) and predicted (1 if score >= 0.5)."""
    vectors = word_vectors(docs, text_col=text_col)
    network = fit(docs, labels, vectors, id_col=id_col, text_col=text_col, label_id_col=label_id_col, label_col=label_col, sample=sample)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))
    names = [id_col, *(c for c in keep if c not in (id_col, "score"))]
    text_at = names.index(text_col) if text_col in names else len(names)
    extra = [docs[text_col].cast("string").alias("__text")] if text_at == len(names) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in batches:
            s = network.scores(pooled(*A.utf8(batch.column(text_at)), vectors))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(s, pa.float64())], names=[*names, "score"])
        A.trim()

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    out = docs.select(*(docs[c] for c in names), *extra).mapInArrow(run, f"{schema}, score double")
    return out.select(*names, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
