import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from voxlake.llm import arrays as A
from voxlake.llm import packing, queries, words

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(texts):
    coder = words.Words(words.read_file(PATH))
    ids, first = coder.encode(*A.utf8(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def test_ids_equal_the_library(library):
    rng = random.Random(1)
    near = [*" '\"\n\t\r\x0b\x0c\x1c\x85 　sStTmMdDlLrReEvVÉé×÷ßÅª²İıΣ̸̱́12<|>,.!中٣\U0001f600", "'s", "'re", "'LL", "n't", "  ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "H̱", "Å"]
    far = lambda: chr(rng.choice([rng.randint(0, 0x2FFF), rng.randint(0, 0x2FF), rng.randint(0xE000, 0x10FFFF), 32, 39]))
    texts = ["".join(rng.choice(near) if k % 2 else far() for _ in range(rng.randint(0, 25))) for k in range(6000)]
    texts += ["", "'", "''s", "don't 'tis 'something 12'3 a'b x'll's", "Àß×é", "a<", "|b", "é<|endoftext|>Éa", "A" * 5000, "日" * 3000]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoded(texts) == want


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        words.read_file(public_tokenizers.path("byte_bpe_50k.json"))


def slow_fit(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(left, k) for k, left in enumerate(bins) if left >= s]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append(capacity)
        out.append(capacity - bins[k])
        bins[k] -= s
    return out, bins


def test_best_fit_equals_a_slow_one():
    rng = random.Random(2)
    for _ in range(200):
        sizes = sorted((rng.randint(1, 50) for _ in range(rng.randint(0, 80))), reverse=True)
        bins, places, left = packing.best_fit(sizes, 50)
        _, want = slow_fit(sizes, 50)
        assert sorted(left) == sorted(want)  # which of two bins with as much left is taken changes nothing
        held = defaultdict(list)
        for s, b, p in zip(sizes, bins, places, strict=True):
            held[b].append((p, s))
        for b, parts in held.items():
            assert [p for p, _ in sorted(parts)] == np.cumsum([0, *(s for _, s in sorted(parts))])[:-1].tolist() and sum(s for _, s in parts) == 50 - left[b]


def check(rows, texts, library, capacity=packing.CAPACITY):
    """texts: (id, text); rows: of pack_documents. Returns the number of sequences."""
    want = []
    for i, t in texts:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want.append((i, k, a, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        at = 0
        for offset, length in parts:
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


def test_small_nodes_and_many_rounds(spark, library):
    rng = random.Random(3)
    texts = [(k, " ".join(rng.choice(["ab", "cd", "the", "x1"]) for _ in range(rng.choice([3, 10, 40, 90])))) for k in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = packing.pack_documents(df, PATH, capacity=100, node_pieces=20, fan=3, nearly=2, carried=5).collect()
    n = check(rows, texts, library, 100)
    alone = packing.pack_documents(df, PATH, capacity=100, node_pieces=20, fan=3, nearly=101, carried=5).collect()
    least = -(-sum(r.length for r in rows) // 100)
    assert least <= n <= 1.08 * least and n < check(alone, texts, library, 100)  # rounds save sequences


def test_odd_rows(spark, library):
    texts = [(1, None), (2, ""), (3, " \n\t"), (None, "null id"), (None, "null id"), (4, "same"), (4, "same"), (5, "word " * 10_000), (6, "x" * 50_000), (7, "日本 " * 3000), (8, "<|endoftext|> it's 12")] + [(k, "copy of a line") for k in range(100, 400)]
    df = spark.createDataFrame([(i, t, "a", 5) for i, t in texts], "doc_id long, text string, sequence_id string, length int")
    check(packing.pack_documents(df, PATH).collect(), texts, library)


def test_nothing(spark):
    rows = packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH)
    assert rows.collect() == [] and rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_query(spark, library):
    rows = queries.QUERIES["op12_packing"](spark, "/root/testdata/sf0.01").collect()
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    n = check(rows, texts, library)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 4096) + 1


def test_sequences_hold_the_documents(spark, library):
    texts = [(k, "the cat sat " * (k % 40)) for k in range(200)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = packing.sequences(df, PATH, capacity=100, node_pieces=50).collect()
    text = dict(texts)
    for r in found:
        assert len(r.ids) <= 100
    assert sorted(i for r in found for i in r.ids) == sorted(i for t in text.values() for i in [*library.encode(t, add_special_tokens=False).ids, 1])
    assert {d for r in found for d in r.doc_ids} == set(text)
    one = next(r for r in found if len(r.doc_ids) > 1 and all(len(text[d]) < 800 for d in r.doc_ids))
    assert one.ids == [i for d in one.doc_ids for i in [*library.encode(text[d], add_special_tokens=False).ids, 1]]
