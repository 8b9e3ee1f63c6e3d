"""Collocations by growing contiguous phrases to the right from the occurrences of frequent prefixes.

1. Each chunk of documents asks the corpus how often its words stand in a language, and then its pairs of common words; a pair that is too rare ends a phrase.
2. The occurrences of each frequent word, with the up to four words that follow by common pairs in their piece, are projected to the
   task that the word is dealt to, equal ones of a chunk as one with their number. There the occurrences are pointers into a
   table: those of a prefix are parted by the next word, and each part that is large enough is extended in its turn, depth first.
3. A prefix with more than ``HOT`` occurrences isn't dealt to one task: the corpus is asked how often its extensions stand, and each is a
   prefix of its own, dealt or asked about further. Of the hot prefix itself a chunk sends its number only. So no task grows with
   a word, pair or line that a third of the rows share. The prefix of no words, which is a language, is always hot: its number is n.
4. Phrases' counts meet in Spark: those of a phrase's two parts for each cut (words are salted), and those of phrases one word longer, which
   are all that can be needed to see whether a longer phrase covers it, since a phrase in between stands no less often. The
   best of each language are found in shares first.

Texts don't move. Keys of 48 bits only say where a prefix goes and which pairs are too rare to follow (prefixes that share one are
taken for more frequent than they are, which prunes less); what is counted are the words themselves.

Defined results: a null or empty text has no words; a null lang is ``und``; repeated rows count each; an empty table gives no rows;
documents of null id count; other columns are ignored. Arithmetic is in decimals of 38 digits; a score that a long can't hold is an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C
from .pretokens import _same

WORDS, LEAST, SHARE, BEST = 5, 100, 100, 2000
HOT = 1 << 20
CHUNK_BYTES, PART_BYTES = 8 << 20, 16 << 20
SALTS = 16
#: Beside the depths 1 to WORDS - 1 that answers are of.
ANY_HOT = 99

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_BREAK
_WORD[[0x20, 0x09]] = False
#: What of a key is sent: it only has to tell the corpus's prefixes apart by and large.
KEY = np.uint64(0xFFFFFFFFFFFF0000)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def chained(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return A.mix(key * _STEP + word)


def _strings(lengths: bytes, body: bytes) -> list[bytes]:
    to, raw = np.cumsum(C.unpack(lengths, "<u4"), dtype=np.int64).tolist(), C.unpack(body, "u1").tobytes()
    return [raw[a:b] for a, b in zip([0, *to], to, strict=False)]


class Rows:
    """Projected occurrences: a key (where they go), the depth that they count from, a language and words by number (0: none), how many."""

    def __init__(self, keys: np.ndarray, depth: np.ndarray, words: np.ndarray, count: np.ndarray, langs: list[bytes], strings: list[bytes]):
        self.keys, self.depth, self.words, self.count, self.langs, self.strings = keys, depth, words, count, langs, strings  # words: (1 + WORDS) x rows, the language first

    def take(self, at: np.ndarray) -> Rows:
        return Rows(self.keys[at], self.depth[at], self.words[:, at], self.count[at], self.langs, self.strings)

    def parted(self, edges: np.ndarray) -> Iterator[tuple[int, Rows]]:
        """By the ranges of keys that begin at edges; rows with equal keys and next words beside each other."""
        rows = self.take(np.lexsort((self.words[2], self.keys)))
        first = np.append(np.searchsorted(rows.keys, edges), len(rows.keys))
        for p in np.flatnonzero(first[1:] > first[:-1]).tolist():
            yield p, rows.take(np.arange(first[p], first[p + 1]))

    def packed(self) -> bytes:
        """With only the words that are used, frequent ones first, and numbers byte plane by byte plane."""
        often = np.bincount(self.words[1:].ravel(), minlength=len(self.strings) + 1)[1:]
        used = np.flatnonzero(often)
        used = used[np.argsort(-often[used], kind="stable")]
        number = np.zeros(len(self.strings) + 1, np.int64)
        number[used + 1] = np.arange(1, len(used) + 1)
        words = np.ascontiguousarray(np.concatenate([self.words[:1], number[self.words[1:]]]), "<u4")
        own = [self.strings[k] for k in used.tolist()]
        lists = [x for strings in (self.langs, own) for x in (C.pack(np.array(list(map(len, strings)), "<u4")), C.pack(np.frombuffer(b"".join(strings), np.uint8)))]
        return C.joined([C.pack_keys(self.keys), C.pack(self.depth.astype(np.uint8)), C.pack(words.view(np.uint8).reshape(-1, 4).T), C.pack(np.ascontiguousarray(self.count, "<u8").view(np.uint8).reshape(-1, 8).T), *lists])

    @classmethod
    def unpacked(cls, blobs: list[bytes]) -> Rows:
        """All of several, with one numbering of languages and words."""
        langs: dict[bytes, int] = {}
        strings: dict[bytes, int] = {}
        out = []
        for blob in blobs:
            keys, depth, words, count, *lists = C.parted(blob)
            keys = C.unpack_keys(keys)
            words = np.ascontiguousarray(C.unpack(words, "u1").reshape(4, -1).T).view("<u4").reshape(1 + WORDS, -1)
            names, own = (_strings(n, body) for n, body in zip(lists[::2], lists[1::2], strict=True))
            lang = np.array([langs.setdefault(x, len(langs)) for x in names], np.uint32)
            number = np.array([0, *(strings.setdefault(x, len(strings) + 1) for x in own)], np.uint32)
            out.append((keys, C.unpack(depth, "u1"), np.concatenate([lang[words[:1]], number[words[1:]]]), np.ascontiguousarray(C.unpack(count, "u1").reshape(8, -1).T).view("<u8").ravel().astype(np.int64)))
        keys, depth, words, count = zip(*out, strict=True)
        return cls(np.concatenate(keys), np.concatenate(depth), np.concatenate(words, axis=1), np.concatenate(count), list(langs), list(strings))


def grow(rows: Rows, least: int) -> Iterator[tuple[int, list[int], int]]:
    """(language, words, number) of every frequent phrase that the rows tell the whole number of, depth first."""

    def extend(at: np.ndarray, depth: int, prefix: list[int]) -> Iterator[tuple[int, list[int], int]]:
        """at: the occurrences of prefix, which has depth - 1 words after its language."""
        word = rows.words[depth][at]
        order = np.argsort(word, kind="stable")
        at, word = at[order], word[order]
        first = np.flatnonzero(np.diff(word, prepend=np.uint32(0)) != 0) if depth else np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        if not len(first):
            return
        own, to = rows.depth[at] <= depth, np.append(first[1:], len(at))
        number = np.add.reduceat(np.where(own, rows.count[at], 0), first)
        deeper = np.logical_or.reduceat(~own, first)
        for k in np.flatnonzero((number >= (least if depth else 1)) | deeper).tolist():
            a, b = first[k], to[k]
            phrase = [*prefix, int(word[a])]
            if number[k] >= (least if depth else 1):
                yield phrase[0], phrase[1:], int(number[k])
            if depth < WORDS:
                yield from extend(at[a:b], depth + 1, phrase)

    if len(rows.keys):
        yield from extend(np.arange(len(rows.keys)), 0, [])


class Occurrences:
    """A chunk's words in order, each with its language; and, to the depth that the corpus has answered, which prefixes go where."""

    def __init__(self, chunk: C.Chunk, got: dict[int, list[bytes]], answered: int, least: int, hot: int):
        self.data, parts = A.lower_ascii(chunk.data), []
        langs = chunk.table.column("k0").to_pylist()
        names = {x: k for k, x in enumerate(sorted(set(langs)))}
        self.langs = [x.encode() for x in names]
        named = A.hash_rows(*A.utf8(pa.array(list(names), pa.string())))
        of_doc = np.array([names[x] for x in langs], np.int64)
        for lo, hi in A.slices(chunk.offsets):
            a, b = chunk.offsets[lo], chunk.offsets[hi]
            low = self.data[a:b]
            starts, ends, first = A.runs(_WORD[low], chunk.offsets[lo : hi + 1] - a)
            doc = np.repeat(np.arange(lo, hi), np.diff(first))
            piece = np.cumsum(_BREAK[low], dtype=np.int64)[starts]
            parts.append((starts + a, ends + a, A.words_hash(low, A.prefix(A.BYTE_VALUES[low]), starts, ends), doc, piece))
        self.starts, self.ends, plain, doc, piece = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 2
        n = len(self.starts)
        self.lang = of_doc[doc]
        self.hash = chained(named[self.lang], plain)
        #: Whether the next word follows in the same piece.
        self.joined = np.zeros(n, bool)
        self.joined[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        #: By depth: the distinct keys that are asked about, and which of them each occurrence asks about.
        self.asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        #: By depth: the occurrences (their first words' places) of prefixes that are dealt to tasks, and of hot ones, with their keys.
        self.dealt: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.hot: dict[int, tuple[np.ndarray, np.ndarray]] = {0: (np.arange(n), named[self.lang])}
        #: Whether a word is common, and whether it makes a common pair with the next.
        self.common = self.pair = np.zeros(n, bool)
        at, keys, split = np.arange(n), self.hash, np.ones(n, bool)
        for depth in range(1, WORDS):
            own, which = np.unique(keys & KEY, return_inverse=True)
            self.asked[depth] = own, which
            if depth > answered:
                return
            number = np.concatenate([C.unpack(x, "<u8") for x in got.get(depth, [])] or [np.zeros(0, "<u8")]).astype(np.int64)[which]
            common, many = number >= least, number > hot
            if depth < 3:
                seen = np.zeros(n, bool)
                seen[at[common]] = True
                self.common, self.pair = (seen, self.pair) if depth == 1 else (self.common, seen)
            self.dealt[depth] = at[split & common & ~many], keys[split & common & ~many]
            self.hot[depth] = at[split & many], keys[split & many]
            on = common if depth == 1 else split & many  # of all pairs it must be known whether they are common
            at, keys, split = at[on], keys[on], (split & many)[on]
            on = at + depth < n
            on[on] = (self.joined & np.append(self.common[1:], False))[at[on]] if depth == 1 else self.pair[at[on] + depth - 1]
            at, keys, split = at[on], keys[on], split[on]
            keys = chained(keys, self.hash[at + depth])
        self.dealt[WORDS] = at, keys

    def ask(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys of a depth and how often each stands here."""
        keys, which = self.asked[depth]
        return keys, np.bincount(which, minlength=len(keys)).astype("<u8")

    def project(self) -> Rows:
        """What the tasks are sent."""
        n = len(self.starts)
        _, lead, word = np.unique(self.hash, return_index=True, return_inverse=True)
        same = (self.lang == self.lang[lead[word]]).all() and _same(self.data, self.starts, self.ends, lead[word])
        raw = self.data.tobytes()
        if same:
            strings = [raw[a:b] for a, b in zip(self.starts[lead].tolist(), self.ends[lead].tolist(), strict=True)]
        else:
            seen: dict[bytes, int] = {}
            word = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True)], np.int64)
            strings = list(seen)
        word = (word + 1).astype(np.uint32)
        # the words that follow, as long as pairs are common
        follow = np.zeros((1 + WORDS, n), np.uint32)
        follow[0], follow[1] = self.lang, word
        whole, alive = self.hash.copy(), np.ones(n, bool)
        for j in range(1, WORDS):
            alive[-j:] = False
            alive[: n - j] &= self.pair[j - 1 : n - 1]
            follow[1 + j, : n - j] = np.where(alive[: n - j], word[j:], 0)
            whole[: n - j] = np.where(alive[: n - j], chained(whole[: n - j], self.hash[j:]), whole[: n - j])
        out = []
        for depth, (at, keys) in self.dealt.items():
            own = follow[:, at]
            _, lead, which = np.unique(whole[at], return_index=True, return_inverse=True)
            if not all((x == x[lead[which]]).all() for x in own):
                _, lead, which = np.unique(own, axis=1, return_index=True, return_inverse=True)
            out.append((keys[lead], np.full(len(lead), depth, np.uint8), own[:, lead], np.bincount(which.ravel(), minlength=len(lead))))
        for depth, (at, keys) in self.hot.items():
            own = follow[:, at]
            own[1 + depth :] = 0
            _, lead, which = np.unique(own, axis=1, return_index=True, return_inverse=True) if depth else np.unique(own[0], return_index=True, return_inverse=True)
            out.append((keys[lead], np.full(len(lead), depth, np.uint8), own[:, lead], np.bincount(which.ravel(), minlength=len(lead))))
        keys, depth, words, count = zip(*out, strict=True)
        return Rows(np.concatenate(keys), np.concatenate(depth), np.concatenate(words, axis=1), np.concatenate(count), self.langs, strings)


SENT = "part int, chunk long, rows binary"
SENT_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("rows", pa.binary())])


def _edges(first: int, count: int, total: int) -> np.ndarray:
    return np.array([((first + k) << 64) // total for k in range(count)], np.uint64)


def _sent(rows: Rows, number: int, first: int, count: int, total: int) -> pa.Table:
    sent = [{"part": first + p, "chunk": number, "rows": own.packed()} for p, own in rows.parted(_edges(first, count, total))]
    return pa.Table.from_pylist(sent, SENT_ARROW)


def by_task(sent: DataFrame, parts: C.Parts, least: int) -> DataFrame:
    """lang, phrase, words (how many) and f of every frequent phrase; n of each language as its phrase of no words."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = Rows.unpacked(table.column("rows").to_pylist())
        strings = ["", *(x.decode() for x in rows.strings)]
        found = [(rows.langs[lang].decode(), " ".join([strings[w] for w in words]), len(words), f) for lang, words, f in grow(rows, least)]
        A.trim()
        return pa.table([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "f"])

    def regroup(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Some chunks' rows of a group of parts, cut into the parts."""
        rows, group = Rows.unpacked(table.column("rows").to_pylist()), table.column("part")[0].as_py()
        out = _sent(rows, key[0].as_py() % parts.per, group * parts.per, parts.per, parts.total)
        A.trim()
        return out

    if parts.per > 1:
        slot = F.col("part") * parts.per + F.pmod(F.xxhash64("chunk"), F.lit(parts.per))
        sent = sent.withColumn("slot", slot.cast("int")).repartitionById(parts.total, "slot").groupBy("slot").applyInArrow(regroup, SENT)
    return sent.repartitionById(parts.total, "part").groupBy("part").applyInArrow(run, "lang string, phrase string, words int, f long")


def frequent(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, phrase, words, f: all phrases of 1 to WORDS words that stand at least ``least`` times in a language, and each language's n as its phrase of no words."""
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"))
    table, parts = C.chunked(plain, text_col="text", id_col="id", keep=("lang",), chunk_bytes=chunk_bytes, part_bytes=part_bytes)

    def add_up(depth: int):
        def run(rows: list[dict]) -> Iterator[dict]:
            keys, (count,), _, ends = C.asked_of(rows, ["<u8"])
            order = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
            total = np.add.reduceat(count[order].astype(np.int64), first)
            each = np.empty(len(keys), np.uint64)
            each[order] = np.repeat(np.where(total < least, 0, total), np.diff(np.append(first, len(keys)))).astype(np.uint64)
            yield from C.answer(depth, rows, ends, each)
            if (total > hot).any():
                yield {"kind": ANY_HOT, "part": rows[0]["part"], "chunk": -1, "answer": b""}

        return run

    def ask(chunk: C.Chunk, got: dict[int, list[bytes]], depth: int) -> Iterator[dict]:
        keys, count = Occurrences(chunk, got, depth - 1, least, hot).ask(depth)
        yield from C.ask(keys, [count], parts, chunk.number)

    answers = None
    for depth in range(1, WORDS):
        if answers is None:
            asked = C.each_chunk(table, lambda chunk: ask(chunk, {}, 1), C.ASKED, C.ASKED_ARROW)
        else:
            asked = C.with_answers(table, answers, lambda chunk, got, depth=depth: pa.Table.from_pylist(list(ask(chunk, got, depth)), C.ASKED_ARROW), C.ASKED)
        told = C.written(C.by_part(asked, parts, add_up(depth)))
        own = told.where("chunk >= 0")
        answers = own if answers is None else answers.unionByName(own)
        if depth > 1 and not told.where(F.col("kind") == ANY_HOT).limit(1).count():
            break

    def project(chunk: C.Chunk, got: dict[int, list[bytes]]) -> pa.Table:
        return _sent(Occurrences(chunk, got, depth, least, hot).project(), chunk.number, 0, parts.groups, parts.groups)

    return by_task(C.with_answers(table, answers, project, SENT), parts, least)


def collocations(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: int = LEAST, share: int = SHARE, best: int = BEST, hot: int = HOT, **more: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to WORDS words. share: percent of a phrase's occurrences that a longer one must have to cover it."""
    found = C.written(frequent(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, least=least, hot=hot, **more))
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    inside = F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1)))
    cover = phrases.where("words > 2").select("lang", inside.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    kept = phrases.join(cover, ["lang", "phrase"], "left").where(f"cover is null or 100 * cover < {int(share)} * a").drop("cover")

    # single words are parts of many phrases: they stand in SALTS copies, of which a phrase asks one
    copies = F.explode(F.when(F.col("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    numbers = found.where("words > 0").select("lang", "phrase", "f", copies.alias("salt"))
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    salt = lambda words: F.when(words == 1, F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"), salt(F.col("k")).alias("left_salt"), salt(F.col("words") - F.col("k")).alias("right_salt"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(numbers.select("lang", F.col("phrase").alias(side), F.col("f").alias(name), F.col("salt").alias(f"{side}_salt")), ["lang", side, f"{side}_salt"])
    total = found.where("words = 0").select("lang", F.col("f").alias("n"))
    scored = cuts.join(total, "lang").withColumn("above", exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("below", exact("l") * exact("r"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").alias("score"), "k", "l", "r")).alias("cut"))
    rows = lowest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))).where(F.col("rank") <= best)
    ranked = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
