import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from voxlake.llm import arrays as A
from voxlake.llm import bpe, pretokens, tokens

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "the cat's  hat\n\n  and 12 мир 日本語 naïve", "a" * 5000, "<|endoftext|>x <|endoftext|>", " \t\x1c\x1d   x", "՘ ႔0 é" * 5, "\U0001f600 smile", "x'S 'll 'Re don't", "ß" * 300 + "!" * 300 + " " * 300, "thhaerble ### onre%%% | THE!!\r\n"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(open(BPE, "rb").read())


def library_splits(library, text):
    return [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_pretokens_equal_the_library():
    """Random texts over all of Unicode, and over the characters that the pattern is about."""
    library = Tokenizer.from_file(JSON)
    rng = random.Random(5)
    near = [*" '\"\n\t\u00a0\u3000\x1c\x1d\x85sstremvldlaB\u00e91\u0663\u00bd,.!\u4e2d\u65e5\u3001\U0001f600\u200b\u0301\u0627\u1ebf", "'s", "'re", "'ll", "  "]
    far = lambda: chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 32, 39]))
    texts = ["".join(rng.choice(near) if k % 2 else far() for _ in range(rng.randint(0, 25))) for k in range(6000)]
    for m in (bpe.matches, tokens.matches):
        table = pretokens.read_classes(pretokens.classes(m))
        data, offsets = A.utf8(pa.array(texts, pa.string()))
        starts, ends = pretokens.cut(data, offsets, table)
        raw, first = data.tobytes(), np.searchsorted(starts, offsets)
        for i, t in enumerate(texts):
            assert [raw[a:b].decode() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)] == library_splits(library, t)


def test_random_unicode_equals_the_libraries(spark, ranks):
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0, 0x2FFF), rng.randint(0xE000, 0x10FFFF), 32])) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += [f"{t}<|endoftext|>{u} <|endoftext|" for t, u in zip(texts[:50], texts[50:100], strict=True)] + ["<|endoftext|><|endoftext|>", " <|endoftext|>  x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, two = Tokenizer.from_file(JSON), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counted = {r.doc_id: r.n_tokens for r in tokens.count_tokens(rows, JSON, chunk_bytes=2000, part_bytes=500).collect()}
    assert counted == {i: len(one.encode(t, add_special_tokens=False)) for i, t in enumerate(texts)}
    digests = {r.doc_id: (r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(rows, BPE).collect()}
    assert digests == {i: (hashlib.sha256(np.array(two.encode_ordinary(t), "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(texts)}


def test_very_long_runs(spark, ranks):
    """A million characters of one class, where the libraries' own regex engines may overflow."""
    texts = [" " * 1_000_000 + "\U0001f600", "a" * 300_000, "\u65e5" * 300_000 + " x", "!" * 1_000_000, "\n" * 1_000_000 + "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(rows, BPE).collect()}
    for i, t in enumerate(texts):
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() and 0 < got[i].n_tokens <= len(t.encode())
    assert got[0].n_tokens == len(bpe.merge(b" " * 999_999, ranks)) + len(bpe.merge(" \U0001f600".encode(), ranks))
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(rows, JSON).collect()}
    assert all(counted[i][0] == len(t.encode()) and 0 < counted[i][1] <= len(t.encode()) for i, t in enumerate(texts))


def test_words_with_one_polynomial_hash_are_told_apart(spark):
    """Thue-Morse words and their complements have equal hashes modulo 2**64 from some length on."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    data, offsets = A.utf8(pa.array([t, u]))
    assert len(set(A.hash_rows(data, offsets).tolist())) == 2
    d = pretokens.Distinct(*A.utf8(pa.array([t, u, t])), pretokens.read_classes(pretokens.classes(bpe.matches)))
    assert sorted(d.tokens) == sorted([t.encode(), u.encode()]) and d.which[0] == d.which[2] != d.which[1]


def test_pretokens_with_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(A, "words_hash", lambda data, sums, starts, ends: (ends - starts).astype(np.uint64))
    d = pretokens.Distinct(*A.utf8(pa.array(["ab cd ab", "ef"])), pretokens.read_classes(pretokens.classes(bpe.matches)))
    assert [d.tokens[k] for k in d.which] == [b"ab", b" cd", b" ab", b"ef"]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(JSON)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "again"), (0, "the")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.digest(tokens.count_tokens(rows, JSON)).collect() if r.doc_id not in (None, 0))
    for i, n_bytes, n, over in got:
        t = TEXTS[i] or ""
        assert (n_bytes, n, over) == (len(t.encode()), len(library.encode(t, add_special_tokens=False)), n > 1024)
    assert len(got) == len(TEXTS) - 1


def test_perfect_hash_is_minimal(ranks):
    keys = list(ranks)[:5000]
    h = bpe.PerfectHash(keys)
    slots = h.find(keys)
    assert sorted(slots) == list(range(len(keys)))
    assert h.find([b"no such key at all", b""]) == [-1, -1]


def test_merge_equals_the_library(ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(1)
    for _ in range(400):
        piece = "".join(rng.choice(list("thenrdaesio"), rng.integers(1, 40)))
        assert bpe.merge(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_round_trip_equals_the_library(spark, ranks):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in bpe.round_trip(rows, BPE).collect():
        t = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(t)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    out = bpe.decode(bpe.encode(rows, BPE), BPE)
    assert {r.doc_id: bytes(r.decoded).decode() for r in out.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_empty_table_and_clashing_columns(spark):
    rows = spark.createDataFrame([], "doc_id long, text string, n_tokens string, ids string")
    assert tokens.count_tokens(rows, JSON).count() == 0
    assert bpe.round_trip(rows, BPE).count() == 0
    assert bpe.encode(rows, BPE, keep=("doc_id", "n_tokens")).columns == ["doc_id", "n_tokens", "ids"]


def test_vocabulary_reader():
    assert bpe.read_ranks(base64.b64encode(b"ab") + b" 7\n") == {b"ab": 7}


def test_a_full_table_ages_and_changes_nothing(monkeypatch, ranks):
    monkeypatch.setattr(tokens, "CACHE", 3)
    known = tokens.Known()
    for k in range(50):
        for s in known.missing([f"w{k % 7}", f"x{k}"]):
            known[s] = len(s)
        assert known[f"w{k % 7}"] == 2 and known[f"x{k}"] == len(f"x{k}")
        assert len(known) <= 3 + 2 and len(known.older) <= 3 + 2
    codec = bpe.Codec(open(BPE, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["one two three four five six seven thhaer", "two thhaer one", "", "six five"] * 3
    assert [codec.encode(*A.utf8(pa.array([t])))[0].tolist() for t in texts] == [library.encode_ordinary(t) for t in texts]
