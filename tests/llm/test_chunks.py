"""The exchange of keys in two steps gives what one step gives."""

import numpy as np
import public_tokenizers
import pytest

from voxlake.llm import chunks as C
from voxlake.llm import lm, near, repeats, tokens

WORDS = ["the", "of", "and", "house", "sea", "wind", "Été", "b"]


def corpus(n=90):
    rng = np.random.default_rng(11)
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(0, 60))))
        docs.append((i, text))
        if i % 4 == 0:
            docs.append((1000 + i, text + " more"))
    return docs + [(2000, None), (2001, ""), (None, docs[3][1]), (7, docs[5][1])]


def results(df):
    one = sorted(map(str, repeats.digest(repeats.remove_repeats(df, chunk_bytes=600)).collect()))
    two = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, r.vocabulary, round(r.base_score, 9), round(r.score, 9)) for r in lm.score(df, chunk_bytes=600).collect())
    three = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.is_first) for r in near.near_duplicates(df, chunk_bytes=600).collect())
    return one, two, three


def test_token_counts_by_two_steps(spark, monkeypatch):
    df = C.written(spark.createDataFrame([(i, t and t + f" own{i} \u65e5\u672c") for i, t in corpus()], "doc_id long, text string"))
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = sorted(map(str, tokens.count_tokens(df, path, chunk_bytes=900).collect()))
    monkeypatch.setattr(C, "GROUPS", 16)
    assert sorted(map(str, tokens.count_tokens(df, path, chunk_bytes=900, part_bytes=40).collect())) == plain


@pytest.mark.parametrize("groups", [3, 1])
def test_two_steps_equal_one(spark, monkeypatch, groups):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    df = C.written(df)
    plain = results(df)
    monkeypatch.setattr(C, "GROUPS", groups)
    assert C.Parts.of(8) == (groups, -(-8 // groups))
    assert results(df) == plain


def test_parts():
    assert C.Parts.of(8) == (8, 1) and C.Parts.of(C.GROUPS) == (C.GROUPS, 1)
    p = C.Parts.of(100_000)
    assert p.groups == C.GROUPS and p.total >= 100_000
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    fine, coarse = C.key_parts(keys, 12), C.key_parts(keys, 4)
    assert fine[::3].tolist() == coarse.tolist()


def test_packing():
    keys = np.sort(np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64))
    assert (C.unpack_keys(C.pack_keys(keys)) == keys).all() and len(C.unpack_keys(C.pack_keys(keys[:0]))) == 0
    assert C.parted(C.joined([b"", b"abc", b"\x00" * 300])) == [b"", b"abc", b"\x00" * 300]
    chunks = np.array([5, 5, 9, 1 << 60])
    assert C._sources({"sources": C._pack_sources(chunks), "chunk": 0}, 0).tolist() == chunks.tolist() and C._sources({"sources": None, "chunk": 4}, 3).tolist() == [4, 4, 4]


def test_buckets_grow_with_the_files(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    size = C.read_bytes(docs)
    assert size > 500_000 and C.read_bytes(docs.select("doc_id").where("doc_id > 5").mapInArrow(lambda x: x, "doc_id long")) == size
    assert C.read_bytes(spark.range(5)) < 1000
    assert C.read_bytes(spark.sparkContext.parallelize([(1, "a")]).toDF(["doc_id", "text"])) < 1 << 60
    monkeypatch.setattr(C, "BUCKET_BYTES", size // 40)
    table, _ = C.chunked(docs, text_col="text", id_col="doc_id", chunk_bytes=20_000, part_bytes=1 << 20)
    assert table.groupBy("chunk").count().rdd.getNumPartitions() >= 40 and table.count() == docs.count()
