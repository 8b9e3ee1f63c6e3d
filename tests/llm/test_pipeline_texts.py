import corpus_pipeline as P


def kept_bytes(docs, length=100):
    """Each text's bytes outside strings of ``length`` bytes that stand earlier, in the order of ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        t, upto, gone = text.encode(), 0, set()
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                gone.update(range(max(s, upto), s + length))
                upto = s + length
            seen.add(t[s : s + length])
        out[i] = bytes(b for k, b in enumerate(t) if k not in gone)
    return out


def test_pipeline_repeat_stage_keeps_just_the_brute_force_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    want = kept_bytes([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: (r.text, r.n_chars) for r in dict(P.STAGES)["suffix-array dedup"](spark, docs, sf).collect()}
    texts = {i: b.decode(errors="ignore") for i, b in want.items()}
    assert got == {i: (t, len(t)) for i, t in texts.items()}
    assert any(len(texts[r.doc_id]) < len(r.text) for r in docs.collect())
