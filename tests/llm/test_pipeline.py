import tiktoken
import public_tokenizers

import corpus_pipeline as P
from voxlake.llm import bpe, decontaminate, near, quality, repeats

SF = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        after = {r.doc_id: r.text for r in out.collect()}
        if k == 0:
            good = {r.doc_id for r in quality.score(docs, labels).where("score >= 0.5").collect()}
            assert set(after) == good and all(before[i] == t for i, t in after.items())
        elif k == 1:
            assert set(after) == {c for _, c, _ in near.brute_force(list(before.items()))}
        elif k == 2:
            want = {i: (n, h) for i, n, _, _, h in repeats.brute_force(list(before.items()))}
            assert set(after) == set(want)
            for i, t in after.items():
                assert before[i] == t or len(t) < len(before[i])
        else:
            clean = {r[0] for r in decontaminate.brute_force(list(before.items()), items) if not r[-1]}
            assert set(after) == clean
        docs = spark.createDataFrame(out.collect(), out.schema)
        before = after
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id: r.ids for r in last} == {i: library.encode_ordinary(t) for i, t in before.items()}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in last)


def test_run_applies_the_stages(spark):
    rows = P.run(spark, SF).collect()
    assert 0 < len(rows) < spark.read.parquet(f"{SF}/documents.parquet").count()
