"""The best pairs of text windows and script phrases by edit distance, over all windows and all phrases.

A pair's score is 1 - distance / length of the longer, to six decimals. Distances are exact: the
bit-parallel algorithm of Myers, in blocks of 64 characters, over many pairs at once. A pair is left
out only when it cannot be among the best: one pass over a text says how near a phrase comes to any stretch that
ends at a place, which no window that ends there can undercut; what windows have to reach rises as pairs are compared.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LETTERS = np.frombuffer(b" abcdefghijklmnopqrstuvwxyz", np.uint8)
#: Characters of windows that are laid out at a time, and windows that are compared at a time.
LAID_OUT, AT_ONCE = 4 << 20, 4096
#: Windows that a phrase passes at a time, and pairs of windows and phrases of a batch of texts (see evidence).
STRETCH, PAIRS = 8192, 4 << 20
ONE, TOP = np.uint64(1), np.uint64(63)
#: Phrases of a script that are sent to every task at a time, and that windows meet at a time; windows that meet them at a time, and in one pass.
PHRASES, SCRIPT, WINDOWS, LANE = 100_000, 64, 16_384, 64
#: Of each document and cluster so many times ``top`` pairs are compared first.
LEADS = 4


def distances(masks: np.ndarray, lengths: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Edit distances of a phrase, as letter numbers, to windows of the same number of blocks; masks: letters x blocks x windows.

    What a column grows by from row to row is kept, and summed after the last letter only; all steps write into arrays that are there.
    """
    blocks, n = masks.shape[1:]
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    xv, xh, ph, mh, same, *carried = np.empty((9, n), np.uint64)
    more, less, above, below = carried
    one, top = np.array(ONE), np.array(TOP)
    or_, and_, xor, add, invert, shift = np.bitwise_or, np.bitwise_and, np.bitwise_xor, np.add, np.invert, np.right_shift
    for letter in phrase.tolist():
        for b in range(blocks):
            eq, pv, mv = masks[letter, b], up[b], down[b]
            or_(eq, mv, xv)
            if b:
                eq = or_(eq, less, same)
            and_(eq, pv, xh)
            add(xh, pv, xh)
            xor(xh, pv, xh)
            or_(xh, eq, xh)
            or_(xh, pv, ph)
            invert(ph, ph)
            or_(ph, mv, ph)
            and_(pv, xh, mh)
            if b < blocks - 1:
                shift(ph, top, above)
                shift(mh, top, below)
            add(ph, ph, ph)
            or_(ph, more if b else one, ph)  # the row above grows by one at each letter
            add(mh, mh, mh)
            if b:
                or_(mh, less, mh)
            or_(xv, ph, pv)
            invert(pv, pv)
            or_(pv, mh, pv)
            and_(ph, xv, mv)
            more, less, above, below = above, below, more, less
    total = np.full(n, len(phrase), np.int64)
    for b in range(blocks):
        some = np.clip(lengths - 64 * b, 0, 64).astype(np.uint64)
        own = np.where(some > 0, ~np.uint64(0) >> (np.uint64(64) - np.maximum(some, ONE)), np.uint64(0))
        total += np.bitwise_count(up[b] & own).astype(np.int64) - np.bitwise_count(down[b] & own)
    return total


def millionths(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """part / whole to six decimals, halves up."""
    return (2_000_000 * part + whole) // (2 * whole)


def windows(words: list[str], size: int, step: int, tail: bool) -> list[int]:
    """Starts of windows; a short text is one window; with tail also the last words."""
    last = max(len(words) - size, 0)
    starts = list(range(0, last + 1, step)) if words else []
    return starts + [last] if tail and starts and starts[-1] != last else starts


class Best:
    """The first ``top`` pairs of each document and cluster, by score, item and start."""

    def __init__(self, docs: int, clusters: int, top: int):
        self.top = top
        self.score, self.item, self.start = (np.full((docs, clusters, top), x, np.int64) for x in (-1, 0, 0))

    def add(self, cluster: int, item: np.ndarray, doc: np.ndarray, start: np.ndarray, score: np.ndarray) -> None:
        docs = np.unique(doc)
        own = np.repeat(docs, self.top)
        d, s, i, k = (np.concatenate(x) for x in ((own, doc), (self.score[docs, cluster].ravel(), score), (self.item[docs, cluster].ravel(), item), (self.start[docs, cluster].ravel(), start)))
        order = np.lexsort((k, i, -s, d))
        d, s, i, k = d[order], s[order], i[order], k[order]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        kept = rank < self.top
        for to, x in ((self.score, s), (self.item, i), (self.start, k)):
            to[d[kept], cluster, rank[kept]] = x[kept]


def laid_out(texts: list[list[str]], size: int, step: int, tail: bool) -> tuple[np.ndarray, ...] | None:
    """All windows of all texts: the letters, and for each window its text, first word, and begin and end among the letters; None without any."""
    joined, doc, start, lo, hi, at = [], [], [], [], [], 0
    for j, words in enumerate(texts):
        ends = np.cumsum([len(w) + 1 for w in words]) + at if words else np.zeros(0, np.int64)
        found = np.array(windows(words, size, step, tail), np.int64)
        if len(found):
            doc.append(np.full(len(found), j))
            start.append(found)
            lo.append(np.where(found > 0, ends[found - 1], at))
            hi.append(ends[np.minimum(found + size, len(words)) - 1] - 1)
            at = int(ends[-1])
            joined.append(" ".join(words))
    if not doc:
        return None
    return np.frombuffer((" ".join(joined) + " ").encode(), np.uint8), *map(np.concatenate, (doc, start, lo, hi))


def letter_numbers() -> np.ndarray:
    number = np.zeros(256, np.intp)
    number[LETTERS] = np.arange(len(LETTERS))
    return number


def masks_of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, blocks: int) -> np.ndarray:
    """Where each letter stands in windows of that many blocks: letters x blocks x windows."""
    place = np.minimum(lo[:, None] + np.arange(64 * blocks), len(data) - 1)
    shown = np.where(np.arange(64 * blocks) < (hi - lo)[:, None], data[place], 0)
    return np.stack([np.packbits(shown == c, axis=1, bitorder="little").view("<u8").T for c in LETTERS])


class Script:
    """Some phrases as patterns: bits of where each letter stands, by letter, block of 64 and phrase; and their letters."""

    def __init__(self, phrases: Sequence[tuple[int, int, str]]):
        number = letter_numbers()
        self.items, self.clusters = (np.array([p[k] for p in phrases], np.int64) for k in (0, 1))
        self.lengths = np.array([len(p[2]) for p in phrases], np.int64)
        self.letters = np.zeros((len(phrases), max(1, int(self.lengths.max(initial=0)))), np.intp)
        self.blocks = max(1, -(-int(self.lengths.max(initial=0)) // 64))
        self.masks = np.zeros((len(LETTERS), self.blocks, len(phrases)), np.uint64)
        for k, (_, _, text) in enumerate(phrases):
            own = number[np.frombuffer(text.encode(), np.uint8)]
            self.letters[k, : len(own)] = own
            at = np.arange(len(own))
            np.bitwise_or.at(self.masks, (own, at // 64, k), ONE << (at % 64).astype(np.uint64))


    def only(self, own: np.ndarray) -> Script:
        """The script of some of its phrases."""
        out = object.__new__(Script)
        out.items, out.clusters, out.lengths = self.items[own], self.clusters[own], self.lengths[own]
        most = max(1, int(out.lengths.max(initial=0)))
        out.blocks = -(-most // 64)
        out.letters, out.masks = self.letters[own, :most], np.ascontiguousarray(self.masks[:, : out.blocks, own])
        return out


def least_distances(data: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, script: Script) -> np.ndarray:
    """What each window is from each phrase at least (windows x phrases): the least distance of the phrase to any stretch that ends where the window does, and begins
    where it or one of the windows before it in its lane do. One pass over the letters of a lane of ``LANE`` windows serves all of them, and all phrases at once."""
    n, phrases = len(lo), len(script.items)
    out = np.zeros((n, phrases), np.int32)
    lane = np.zeros(n, np.int64)
    if not n or not phrases:
        return out
    place = np.arange(n) - np.searchsorted(doc, doc)
    first = place % LANE == 0
    lane = np.cumsum(first) - 1
    begin = lo[first]
    end = np.maximum.reduceat(hi, np.flatnonzero(first))
    order = np.argsort(begin - end, kind="stable")  # the longest lanes first, so that those at work are a prefix
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    begin, length = begin[order], (end - begin)[order]
    lane = rank[lane]
    offset = hi - begin[lane] - 1
    told = np.argsort(offset, kind="stable")
    step = np.searchsorted(offset[told], np.arange(int(length[0]) + 1))
    number = letter_numbers()
    up = np.full((script.blocks, len(order), phrases), ~np.uint64(0))
    down = np.zeros_like(up)
    total = np.tile(script.lengths.astype(np.int32), (len(order), 1))
    last = ((np.maximum(script.lengths, 1) - 1) % 64).astype(np.uint64)
    own_block = (np.maximum(script.lengths, 1) - 1) // 64
    live = len(order)
    for t in range(int(length[0])):
        while live and length[live - 1] <= t:
            live -= 1
        letter = number[data[begin[:live] + t]]
        more = less = np.zeros((live, phrases), np.uint64)  # a stretch may begin anywhere
        for b in range(script.blocks):
            eq, pv, mv = script.masks[letter, b], up[b, :live], down[b, :live]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            change = ((ph >> last) & ONE).astype(np.int32) - ((mh >> last) & ONE).astype(np.int32)
            total[:live] += change if script.blocks == 1 else np.where(own_block == b, change, 0)
            above, below = more, less
            more, less = ph >> TOP, mh >> TOP
            ph, mh = (ph << ONE) | above, (mh << ONE) | below
            up[b, :live], down[b, :live] = mh | ~(xv | ph), ph & xv
        some = told[step[t] : step[t + 1]]
        if len(some):
            out[some] = total[lane[some]]
    return out


def distances_of_pairs(masks: np.ndarray, lengths: np.ndarray, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """As distances, each window against a phrase of its own; letters: windows x letters, sizes: how many of them count."""
    blocks, n = masks.shape[1:]
    up, down = np.full((blocks, n), ~np.uint64(0)), np.zeros((blocks, n), np.uint64)
    total, last = lengths.astype(np.int64), ((lengths - 1) % 64).astype(np.uint64)
    out, lanes = total.copy(), np.arange(n)
    for t in range(int(sizes.max(initial=0))):
        more, less = np.ones(n, np.uint64), np.zeros(n, np.uint64)
        for b in range(blocks):
            eq, pv, mv = masks[letters[:, t], b, lanes], up[b], down[b]
            xv = eq | mv
            eq = eq | less
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            if b == blocks - 1:
                total = total + ((ph >> last) & ONE).astype(np.int64) - ((mh >> last) & ONE).astype(np.int64)
            above, below = more, less
            more, less = ph >> TOP, mh >> TOP
            ph, mh = (ph << ONE) | above, (mh << ONE) | below
            up[b], down[b] = mh | ~(xv | ph), ph & xv
        out = np.where(sizes > t, total, out)
    return out


def best_of(texts: list[list[str]], phrases: Sequence[tuple[int, int, str]], clusters: int, *, size: int, step: int, tail: bool, top: int) -> Best:
    """phrases: item, cluster number and text, letters and spaces only, as the words are. best.verified: how many pairs were compared in full."""
    best = Best(len(texts), clusters, top)
    best.verified = 0
    if (laid := laid_out(texts, size, step, tail)) is None:
        return best
    data, doc, start, lo, hi = laid
    phrases = sorted(phrases, key=lambda p: (len(p[2]), p[0]))
    for k in range(0, len(phrases), SCRIPT):
        script = Script(phrases[k : k + SCRIPT])
        for a in range(0, len(lo), WINDOWS):
            _improve(best, data, doc[a : a + WINDOWS], start[a : a + WINDOWS], lo[a : a + WINDOWS], hi[a : a + WINDOWS], script, top)
    return best


def _improve(best: Best, data: np.ndarray, doc: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, script: Script, top: int) -> None:
    """Compares the pairs of some windows and phrases that can be among the best: first the likeliest of each document and cluster, so that what the others have to reach rises."""
    length = hi - lo
    # what lengths alone rule out takes no part in the pass over the letters
    shorter, longer = (f(length[:, None], script.lengths[None, :]) for f in (np.minimum, np.maximum))
    can = millionths(shorter, longer) >= best.score[doc][:, script.clusters, top - 1]
    if not can.any():
        return
    if not (used := can.any(axis=0)).all():
        script = script.only(np.flatnonzero(used))
        longer = longer[:, used]
    least = np.maximum(least_distances(data, doc, lo, hi, script), np.abs(length[:, None] - script.lengths[None, :]))
    most = millionths(longer - least, longer)
    bound = lambda w, p: best.score[doc[w], script.clusters[p], top - 1]
    w, p = np.nonzero(most >= best.score[doc][:, script.clusters, top - 1])
    if not len(w):
        return
    score = most[w, p]
    order = np.lexsort((-score, script.clusters[p], doc[w]))
    group = doc[w[order]] * (int(script.clusters.max()) + 1) + script.clusters[p[order]]
    leads = np.arange(len(order)) - np.searchsorted(group, group) < LEADS * top
    likely, rest = order[leads], order[~leads]
    for own in (likely, rest[np.argsort(-score[rest], kind="stable")]):
        for some in np.split(own, range(AT_ONCE, len(own), AT_ONCE)):
            some = some[score[some] >= bound(w[some], p[some])]
            if not len(some):
                continue
            best.verified += len(some)
            a, b = w[some], p[some]
            far = np.empty(len(some), np.int64)
            blocks = (length[a] + 63) // 64
            for n in np.unique(blocks).tolist():
                same = np.flatnonzero(blocks == n)
                far[same] = distances_of_pairs(masks_of(data, lo[a[same]], hi[a[same]], n), length[a[same]], script.letters[b[same]], script.lengths[b[same]])
            found = millionths(longer[a, b] - far, longer[a, b])
            for c in np.unique(script.clusters[b]).tolist():
                good = (script.clusters[b] == c) & (found >= bound(a, b))
                if good.any():
                    best.add(c, script.items[b[good]], doc[a[good]], start[a[good]], found[good])


def in_blocks(phrases: DataFrame, whole_clusters: bool = False) -> Iterator[list[tuple[int, int, str]]]:
    """A script's phrases (item_id, cluster, phrase), ``PHRASES`` at a time: a query set against all rows, in blocks. A script without phrases is one empty block; with whole_clusters a cluster's phrases are in one block."""
    rows = phrases.select("item_id", "cluster", "phrase").orderBy("cluster", "item_id", "phrase")
    block: list[tuple[int, int, str]] = []
    any_ = False
    for r in rows.toLocalIterator():
        if len(block) >= PHRASES and not (whole_clusters and block[-1][1] == r.cluster):
            yield block
            block, any_ = [], True
        block.append((r.item_id, r.cluster, r.phrase))
    if block or not any_:
        yield block


def enough_tasks(docs: DataFrame) -> DataFrame:
    """Texts that come in fewer partitions than there are cores are dealt out, as comparing is slow; a large input stays where it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(4 * cores) if docs.rdd.getNumPartitions() < cores else docs


def best_pairs(docs: DataFrame, phrases: DataFrame, *, size: int, step: int, tail: bool, top: int) -> DataFrame:
    """docs: doc_id, w (words of a to z); phrases: item_id, cluster, phrase. The first ``top`` of each document and cluster: doc_id, cluster, item_id, k, score.

    A document without words has one row for itself, where the rest is null and the score 0. The script is read, and sent to every task, ``PHRASES`` phrases at a time;
    the best of several such blocks are the best of all.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, cluster long, item_id long, k long, score double"

    def of_block(rows: list[tuple[int, int, str]]) -> DataFrame:
        names = sorted({c for _, c, _ in rows})
        shared = spark.sparkContext.broadcast(([(i, names.index(c), p) for i, c, p in rows], names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded, names = shared.value
            for whole in batches:
                for lo in range(0, len(whole), 256):
                    batch = whole.slice(lo, 256)
                    texts = [x or [] for x in batch.column(1).to_pylist()]
                    best = best_of(texts, coded, len(names), size=size, step=step, tail=tail, top=top)
                    d, c, r = np.nonzero(best.score >= 0)
                    none = np.array([j for j, x in enumerate(texts) if not x or not names], np.int64)
                    gap = pa.nulls(len(none), pa.int64())
                    columns = [pa.concat_arrays([pa.array(x, pa.int64()), gap]) for x in (np.array(names, np.int64)[c] if names else c, best.item[d, c, r], best.start[d, c, r])]
                    score = np.concatenate([best.score[d, c, r] / 1e6, np.zeros(len(none))])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate([d, none]))), *columns, pa.array(score)], names=["doc_id", "cluster", "item_id", "k", "score"])

        return spread.mapInArrow(run, schema)

    spread = enough_tasks(docs.select("doc_id", "w"))
    parts = [of_block(rows) for rows in in_blocks(phrases)]
    found = reduce(DataFrame.unionByName, parts)
    if len(parts) == 1:
        return found
    rank = F.row_number().over(Window.partitionBy("doc_id", "cluster").orderBy(F.desc("score"), "item_id", "k"))
    # rows that say that a document has no words come once from each block
    return found.where("item_id is not null").withColumn("__r", rank).where(F.col("__r") <= top).drop("__r").unionByName(parts[0].where("item_id is null"))


#: What the edit score and the likeness of meaning count for.
FUZZY, SEMANTIC = 0.55, 0.45
DIMENSIONS = 1024


def meaning(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed letter trigrams, which stand for an embedding; stretches of under three letters have the zero vector."""
    n = np.maximum(hi - lo - 2, 0)
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first - lo, n)
    x = letter_numbers()[data].astype(np.uint32)
    code = (x[at] * np.uint32(729) + x[at + 1] * np.uint32(27) + x[at + 2]) * np.uint32(2654435761) >> np.uint32(22)
    out = np.bincount(np.repeat(np.arange(len(lo)), n) * DIMENSIONS + code, minlength=len(lo) * DIMENSIONS).reshape(len(lo), DIMENSIONS).astype(np.float64)
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-12)


def common_letters(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, script: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many letters each stretch of data and each of script share in any order (windows x phrases): what is beyond them in the longer takes an edit each."""
    a, b = letter_counts(data, lo, hi), letter_counts(script, begin, end)
    out = np.zeros((len(lo), len(begin)), np.int32)
    for x, y in zip(a, b, strict=True):
        out += np.minimum(x[:, None], y[None, :])
    return out.astype(np.int64)


def letter_counts(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each letter, how often it stands in each stretch: letters x stretches."""
    sums = [np.concatenate([[0], np.cumsum(data == c)]) for c in LETTERS]
    return np.stack([x[hi] - x[lo] for x in sums]).astype(np.int32)


def blended(fuzzy: np.ndarray, alike: np.ndarray) -> np.ndarray:
    return np.round(FUZZY * fuzzy + SEMANTIC * alike, 6)


def evidence_of(texts: list[list[str]], phrases: Sequence[tuple[int, int, str]], clusters: int, *, size: int, step: int, tail: bool, top: int, counted: list | None = None) -> list[tuple[int, int, int, int, float, float, float]]:
    """(text, cluster, item, first word, combined, edit and meaning score) of each text's and cluster's ``top`` windows, first those with the highest combined score, then the earlier.

    Within a cluster a window has the best edit score over its phrases, and as meaning the greater of the cosine to the cluster's mean and to its nearest phrase. It is
    named after the phrase that is nearest in meaning, or after that of the edit score if that score is higher.

    Meaning is known of all pairs. Each cluster's windows of the most likeness are compared first; then of the others the pairs whose length and letters allow a score that reaches
    the last of those. counted: gets how many pairs were compared, and how many there are.
    """
    if (laid := laid_out(texts, size, step, tail)) is None or not phrases:
        return []
    data, doc, start, lo, hi = laid
    phrases = sorted(phrases)
    number = letter_numbers()
    coded = [number[np.frombuffer(t.encode(), np.uint8)] for _, _, t in phrases]
    sizes = np.array([len(t) for _, _, t in phrases])
    ends = np.cumsum(sizes + 1) - 1
    script = np.frombuffer((" ".join(t for _, _, t in phrases) + " ").encode(), np.uint8)
    cluster_of = np.array([c for _, c, _ in phrases])
    members = {c: own for c in range(clusters) if len(own := np.flatnonzero(cluster_of == c))}

    refs = meaning(script, ends - sizes, ends)
    means = np.zeros((clusters, DIMENSIONS))
    for c, own in members.items():
        mean = refs[own].mean(axis=0)
        means[c] = mean / (np.sqrt((mean**2).sum()) + 1e-12)
    near, alike = np.empty((len(doc), len(phrases))), np.empty((len(doc), clusters))
    for some in np.split(np.arange(len(doc)), range(AT_ONCE, len(doc), AT_ONCE)):
        vectors = meaning(data, lo[some], hi[some])
        near[some], alike[some] = vectors @ refs.T, vectors @ means.T
    for c, own in members.items():
        alike[:, c] = np.round(np.maximum(near[:, own].max(axis=1), alike[:, c]), 6)

    length = hi - lo
    longer = np.maximum(length[:, None], sizes[None, :])
    most = blended(millionths(common_letters(data, lo, hi, script, ends - sizes, ends), longer) / 1e6, alike[:, cluster_of])
    edit = np.zeros((len(doc), len(phrases)))
    blocks = (length + 63) // 64

    def compare(need: np.ndarray) -> None:
        for b in np.unique(blocks).tolist():
            same = np.flatnonzero((blocks == b) & need.any(axis=1))
            for own in np.split(same, range(each := max(1, LAID_OUT // (64 * b)), len(same), each)):
                masks, asked = masks_of(data, lo[own], hi[own], b), need[own]
                for k, phrase in enumerate(coded):
                    for some in np.split(at := np.flatnonzero(asked[:, k]), range(STRETCH, len(at), STRETCH)):
                        if len(some):
                            far = distances(masks if len(some) == len(own) else masks[:, :, some], length[own[some]], phrase)
                            edit[own[some], k] = millionths(longer[own[some], k] - far, longer[own[some], k]) / 1e6

    first, least = np.zeros((len(doc), clusters), bool), np.full((int(doc.max()) + 1, clusters), -1.0)
    for c in members:
        order = np.lexsort((-alike[:, c], doc))
        first[order[np.arange(len(order)) - np.searchsorted(doc[order], doc[order]) < 2 * top], c] = True
    compare(leads := first[:, cluster_of])
    for c, own in members.items():
        known = np.flatnonzero(first[:, c])
        both = blended(edit[known][:, own].max(axis=1), alike[known, c])
        order = np.lexsort((-both, doc[known]))
        docs = doc[known[order]]
        last = np.arange(len(order)) - np.searchsorted(docs, docs) == top - 1
        least[docs[last], c] = both[order[last]]
    # what may be among the first, by the letters that a window and a phrase have in common; the rest counts as no likeness
    compare(rest := ~leads & (most >= least[doc][:, cluster_of]))
    if counted is not None:
        counted.append((int(leads.sum() + rest.sum()), edit.size))
    out = []
    for c, own in members.items():
        fuzzy, meant = edit[:, own].max(axis=1), alike[:, c]
        both = blended(fuzzy, meant)
        named = np.where(meant >= fuzzy, own[near[:, own].argmax(axis=1)], own[edit[:, own].argmax(axis=1)])
        order = np.lexsort((start, -both, doc))
        rank = np.arange(len(order)) - np.searchsorted(doc[order], doc[order])
        for k in order[rank < top].tolist():
            out.append((int(doc[k]), c, phrases[named[k]][0], int(start[k]), float(both[k]), float(fuzzy[k]), float(meant[k])))
    return out


def evidence(docs: DataFrame, phrases: DataFrame, *, size: int = 18, step: int = 6, tail: bool = True, top: int = 3) -> DataFrame:
    """doc_id, cluster, item_id, k, score, fuzzy, semantic: see evidence_of. docs: doc_id, w; phrases: item_id, cluster, phrase.

    The script is sent to every task in blocks of whole clusters, of some ``PHRASES`` phrases; clusters are judged by themselves, so blocks just add up.
    """
    spark = docs.sparkSession

    def of_block(rows: list[tuple[int, int, str]]) -> DataFrame:
        names = sorted({c for _, c, _ in rows})
        shared = spark.sparkContext.broadcast(([(i, names.index(c), p) for i, c, p in rows], names))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coded, names = shared.value
            for whole in batches:
                windows = pc.list_value_length(whole.column(1)).fill_null(0).to_numpy(zero_copy_only=False) // step + 2
                batch_of = np.cumsum(windows) // max(1, PAIRS // max(1, len(coded)))
                for at in np.split(np.arange(len(whole)), np.flatnonzero(np.diff(batch_of)) + 1):
                    batch = whole.slice(int(at[0]) if len(at) else 0, len(at))
                    found = evidence_of([x or [] for x in batch.column(1).to_pylist()], coded, len(names), size=size, step=step, tail=tail, top=top)
                    d, c, i, k, *scores = map(list, zip(*found, strict=True)) if found else ([] for _ in range(7))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d, pa.int64())), pa.array([names[x] for x in c], pa.int64()), pa.array(i, pa.int64()), pa.array(k, pa.int64()), *(pa.array(x, pa.float64()) for x in scores)], names=["doc_id", "cluster", "item_id", "k", "score", "fuzzy", "semantic"])

        return spread.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, cluster long, item_id long, k long, score double, fuzzy double, semantic double")

    spread = enough_tasks(docs.select("doc_id", "w"))
    return reduce(DataFrame.unionByName, [of_block(rows) for rows in in_blocks(phrases, whole_clusters=True)])


def words(column: str):
    """The words of a text in letters a to z; other characters go."""
    return F.filter(F.split(F.regexp_replace(F.lower(column), "[^a-z ]", ""), " "), lambda w: w != "")
