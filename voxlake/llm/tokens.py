"""Token counts: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies.

1. Each chunk of documents is cut into pre-tokens (``pretokens``). For each document its distinct pre-tokens and
   how often they stand there are kept, as numbers into the chunk's list of distinct pre-tokens; the list
   is kept beside them, in the order of hashes. Both are written once to the shared folder, bucketed by chunk.
2. The lists are cut by hash into parts, as many as their size needs. A part sees a pre-token at most once from each
   chunk, however frequent it is, and has the library count its pieces once.
3. Each chunk gets its counts back in the order it sent the pre-tokens, and sums frequency times count for each
   document. Texts are not shuffled and the ids of a text are never made.

Special strings inside a text are one token each and end the pre-tokens before them, as the library has it.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows are counted
each; other columns are ignored. A file that is not byte-level BPE is refused.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import chunks as C
from . import pretokens

CACHE = 150_000
CHUNK_BYTES, SLICE_BYTES = 16 << 20, 4 << 20
#: Bytes of pre-tokens that a part is to have, and slices that a chunk's list is kept in, so that no row is large.
PART_BYTES, SLICES = 32 << 20, 16


class Known(dict):
    """A bounded table of what is known about strings: what is looked up stays, what is not ages out."""

    def __init__(self, most: int | None = None) -> None:
        self.older: dict = {}
        self.most = CACHE if most is None else most

    def missing(self, strings: list[bytes]) -> list[bytes]:
        """Those that must be worked out; the others are in the table after this."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        older, out = self.older, []
        for s in strings:
            if s not in self:
                if s in older:
                    self[s] = older[s]
                else:
                    out.append(s)
        return out


def read_file(path: str) -> tuple[bytes, list[bytes]]:
    """A byte-level file's contents and its special strings."""
    with open(path, "rb") as f:
        content = f.read()
    spec = json.loads(content)
    if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError(f"{path} is not a byte-level tokenizer")
    return content, [t["content"].encode() for t in spec["added_tokens"]]


@functools.lru_cache(1)
def library(content: bytes):
    """The file's tokenizer, without truncation and padding; kept by the process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def count_pieces(tokenizer, lists: list[tuple[bytes, bytes]]) -> list[np.ndarray]:
    """For (packed lengths, packed bytes) of pre-tokens, their numbers of pieces; each distinct pre-token is counted once."""
    seen: dict[bytes, int] = {}
    asked = []
    for lengths, body in lists:
        raw = C.unpack(body, "u1").tobytes()
        ends = np.cumsum(C.unpack(lengths, "<u4"), dtype=np.int64).tolist()
        asked.append(np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends], ends)], np.uint32))
    pieces, part = np.empty(len(seen), "<u4"), []
    at = 0
    for t in seen:
        part.append(t.decode())
        if len(part) == 5000 or at + len(part) == len(seen):
            pieces[at : at + len(part)] = [len(x) for x in tokenizer.encode_batch(part, add_special_tokens=False)]
            at, part = at + len(part), []
    return [pieces[x] for x in asked]


def matches(pattern: str, text: str) -> str:
    """The characters of text that match, by the library's regex engine."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    left = {c for part, _ in Split(Regex(pattern), "removed").pre_tokenize_str(text) for c in part}
    return "".join(c for c in text if c not in left)


def without_special(data: np.ndarray, offsets: np.ndarray, special: re.Pattern | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and offsets of the stretches between special strings, the row that each is of, and how many special strings a row has."""
    n = len(offsets) - 1
    count = np.zeros(n, np.int64)
    raw = data.tobytes() if special else b""
    if not special or not special.search(raw):
        return data, offsets, np.arange(n), count
    bounds, rows = [], []
    hit = {int(np.searchsorted(offsets, m.start(), "right")) - 1 for m in special.finditer(raw)}
    for row in range(n):
        at = int(offsets[row])
        if row in hit:
            for m in special.finditer(raw[at : offsets[row + 1]]):
                bounds.append((at, int(offsets[row]) + m.start()))
                rows.append(row)
                count[row] += 1
                at = int(offsets[row]) + m.end()
        bounds.append((at, int(offsets[row + 1])))
        rows.append(row)
    size = np.array([b - a for a, b in bounds], np.int64)
    place = A.ragged(np.array([a for a, _ in bounds], np.int64), size)
    return data[place], np.concatenate([[0], np.cumsum(size)]), np.array(rows, np.int64), count


def frequencies(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, special: re.Pattern | None) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The rows' distinct pre-tokens; each row's number of pairs, the pairs (number of the pre-token, frequency) row by row, and its special strings."""
    body, bounds, row, count = without_special(data, offsets, special)
    d = pretokens.Distinct(body, bounds, table)
    own = np.repeat(row, np.diff(d.first))
    pair, times = np.unique(own * max(1, len(d.tokens)) + d.which, return_counts=True)
    owner, which = np.divmod(pair, max(1, len(d.tokens)))
    return d.tokens, np.bincount(owner, minlength=len(offsets) - 1), which, times, count


def batches_of_texts(column: pa.Array, limit: int = 4 << 20) -> Iterator[list[str]]:
    """The column's texts, nulls as "", in lists of about limit bytes."""
    _, offsets = A.utf8(column)
    for lo, hi in A.slices(offsets, limit):
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def _blobs(values: np.ndarray, count: np.ndarray) -> pa.Array:
    """Runs of count values as binaries of little-endian uint32."""
    ends = np.concatenate([[0], 4 * np.cumsum(count)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(count), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(values.astype("<u4").tobytes())]).cast(pa.binary())


def _values(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """What _blobs() was given."""
    data, offsets = A.utf8(blobs)
    return np.frombuffer(data.tobytes(), "<u4").astype(np.int64), np.diff(offsets) // 4


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document: the id, n_bytes and n_tokens (both long)."""
    sc = docs.sparkSession.sparkContext
    content, strings = read_file(path)
    shared = sc.broadcast((content, pretokens.classes(matches), [re.escape(s) for s in sorted(strings, key=len, reverse=True)]))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["chunk", "slice", "id", "n_bytes", "special", "which", "times", "hashes", "lengths", "tokens", "n_list"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        _, packed, escaped = shared.value
        table = pretokens.read_classes(packed)
        special = re.compile(b"|".join(escaped)) if escaped else None
        chunk, size = TaskContext.get().partitionId() << 32, 0
        seen: dict[bytes, int] = {}  # the chunk's list, filled slice by slice
        held: list[tuple] = []

        def add(rows: pa.RecordBatch) -> None:
            data, offsets = A.utf8(rows.column(1))
            tokens, pairs, which, times, count = frequencies(data, offsets, table, special)
            number = np.array([seen.setdefault(t, len(seen)) for t in tokens], np.uint32)
            held.append((rows.column(0), np.diff(offsets), pairs, number[which], times.astype(np.uint32), count))

        def flush() -> Iterator[pa.RecordBatch]:
            """The documents' frequencies, and the chunk's list in slices of hashes."""
            ids = pa.concat_arrays([x[0] for x in held])
            sizes, pairs, which, times, count = (np.concatenate([x[k] for x in held]) for k in range(1, 6))
            tokens = list(seen)
            seen.clear()
            held.clear()
            hashes = _hashes(tokens)
            order = np.argsort(hashes, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            owner = np.repeat(np.arange(len(pairs)), pairs)
            near = np.lexsort((place[which], owner))
            which, times = place[which][near], times[near]
            first = np.cumsum(pairs) - pairs
            steps = np.diff(which, prepend=0)
            steps[first[pairs > 0]] = which[first[pairs > 0]]
            n = len(ids)
            full = lambda k, kind: pa.nulls(k, kind)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, -1, np.int32)), ids, pa.array(sizes), pa.array(count), _blobs(steps, pairs), _blobs(times, pairs), *(full(n, pa.binary()) for _ in range(3)), full(n, pa.int64())], names=names)
            lists = []
            hashes, sent = hashes[order], [tokens[k] for k in order.tolist()]
            edge = C.key_parts(hashes, SLICES)
            for k in range(SLICES):
                own = sent[edge[k] : edge[k + 1]]
                if own:
                    body = b"".join(own)
                    lists.append((k, C.pack_keys(hashes[edge[k] : edge[k + 1]]), C.pack(np.array(list(map(len, own)), "<u4")), C.pack(np.frombuffer(body, np.uint8)), len(body) + 4 * len(own)))
            n = len(lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array([x[0] for x in lists], pa.int32()), full(n, ids.type), full(n, pa.int64()), full(n, pa.int64()), full(n, pa.binary()), full(n, pa.binary()), *(pa.array([x[j] for x in lists], pa.binary()) for j in (1, 2, 3)), pa.array([x[4] for x in lists], pa.int64())], names=names)

        for batch in batches:
            _, offsets = A.utf8(batch.column(1))
            for lo, hi in A.slices(offsets + 16 * np.arange(len(offsets)), min(SLICE_BYTES, chunk_bytes)):
                n = int(offsets[hi] - offsets[lo]) + 16 * (hi - lo)
                if held and size + n > chunk_bytes:
                    yield from flush()
                    chunk, size = chunk + 1, 0
                add(batch.slice(lo, hi - lo))
                size += n
        if held:
            yield from flush()
        A.trim()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("__text"))
    chunks = C.bucketed(rows.mapInArrow(cut, f"chunk long, slice int, id {id_type}, n_bytes long, special long, which binary, times binary, hashes binary, lengths binary, tokens binary, n_list long"))
    lists = chunks.where("slice >= 0")
    total = lists.agg(F.sum("n_list")).first()[0] or 0
    wanted = max(C.partitions(docs.sparkSession), -(-total // part_bytes))
    parts = C.Parts.of(-(-wanted // SLICES) * SLICES)  # so that a part's keys of a chunk are in one slice

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                keys, lengths, tokens = C.unpack_keys(r["hashes"]), C.unpack(r["lengths"], "<u4"), C.unpack(r["tokens"], "u1")
                edge = C.key_parts(keys, parts.groups)
                at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
                out = []
                for p in np.flatnonzero(edge[1:] > edge[:-1]).tolist():
                    a, b = edge[p], edge[p + 1]
                    # the keys are only read where arrays are merged
                    out.append({"part": p, "chunk": r["chunk"], "keys": C.pack_keys(keys[a:b]) if parts.per > 1 else b"", "more": C.joined([C.pack(lengths[a:b]), C.pack(tokens[at[a] : at[b]])])})
                yield pa.RecordBatch.from_pydict({f.name: pa.array([x[f.name] for x in out], f.type) for f in C.ASKED_ARROW}, schema=C.ASKED_ARROW)

    def count(rows: list[dict]) -> Iterator[dict]:
        found = count_pieces(library(shared.value[0]), [C.parted(r["more"]) for r in rows])
        yield from C.answer(1, rows, np.cumsum(list(map(len, found))), np.concatenate(found))

    asked = lists.select("chunk", "hashes", "lengths", "tokens").mapInArrow(ask, C.ASKED)
    told = C.by_part(asked, parts, count, ragged=True)

    def add(key: tuple[pa.Scalar, ...], mine: pa.Table, theirs: pa.Table) -> pa.Table:
        pieces = np.concatenate([C.unpack(r["answer"], "<u4") for r in sorted(theirs.to_pylist(), key=lambda r: r["part"])] or [np.zeros(0, "<u4")]).astype(np.int64)
        steps, pairs = _values(mine.column("which"))
        times, _ = _values(mine.column("times"))
        upto = np.concatenate([[0], np.cumsum(steps)])
        to = np.cumsum(pairs)
        which = upto[1:] - np.repeat(upto[to - pairs], pairs)
        sums = np.concatenate([[0], np.cumsum(pieces[which] * times)])
        n = sums[to] - sums[to - pairs] + mine.column("special").to_numpy()
        return pa.table({id_col: mine.column("id"), "n_bytes": mine.column("n_bytes"), "n_tokens": pa.array(n, pa.int64())})

    kept = chunks.where("slice < 0").select("chunk", "id", "n_bytes", "special", "which", "times")
    return kept.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(add, f"`{id_col}` {id_type}, n_bytes long, n_tokens long")


def _hashes(tokens: list[bytes]) -> np.ndarray:
    offsets = np.zeros(len(tokens) + 1, np.int64)
    np.cumsum(list(map(len, tokens)), out=offsets[1:])
    return A.hash_rows(np.frombuffer(b"".join(tokens), np.uint8), offsets)


def digest(counted: DataFrame, limit: int = 1024) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
