"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing column names and empty tables."""

import corpus_pipeline as P
import pytest

from voxlake.llm import near

NAMES = "score class_id chunk seq id size kept_text spans hits items ids n_words held_out predicted n_links is_first lead __text own k0 text_1 f0 __rest".split()
LONG = " ".join(f"word{k}" for k in range(30_000))
STORY = "Once there was a house by the sea where the wind told of ships and of people who had gone away and come back again with stories."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edges"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, None), (None, "a null item of words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def table(spark, rows):
    extra = {n: f"x{k}" for k, n in enumerate(NAMES)}
    schema = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", None, len(t) if t else None, *extra.values()) for i, t in rows], schema)


ROWS = [(1, STORY), (1, STORY), (2, None), (None, None), (3, ""), (4, LONG), (5, "x one two three four five six seven eight nine ten y"), (None, "with a null id"), (6, STORY + " And " + STORY), (6, "same id, other text")]


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_columns_and_rows(spark, folder, stage):
    docs = table(spark, ROWS)
    out = stage(spark, docs, folder)
    rows = out.collect()
    assert out.dtypes == docs.dtypes and all(r[n] == f"x{k}" for r in rows for k, n in enumerate(NAMES))
    assert {r.doc_id for r in rows} <= {i for i, _ in ROWS}
    got = sorted(((r.doc_id, r.text, r.n_chars) for r in rows), key=str)
    if stage is P.keep_one_of_each_group:
        alone = sorted((i for i, t in ROWS if t not in (STORY, ROWS[8][1])), key=str)
        assert sorted((x[0] for x in got), key=str) == sorted([1, *alone], key=str) and {c for _, c, _ in near.brute_force(ROWS)} == {x[0] for x in got}
    elif stage is P.reject_contaminated:
        assert sorted((x[:2] for x in got), key=str) == sorted((x for x in ROWS if x[0] != 5), key=str)
    elif stage is P.remove_repeated_passages:
        assert len(got) == len(ROWS) and all((n or 0) == len(t or "") for _, t, n in got)
        assert sorted(t for i, t, _ in got if i == 1) == ["", STORY] and (4, LONG, len(LONG)) in got


def test_the_last_stage(spark, folder):
    rows = P.encode(spark, table(spark, ROWS), folder).collect()
    assert len(rows) == len(ROWS) and all(r.exact and r.n_tokens == len(r.ids) for r in rows)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES])
def test_empty_tables(spark, folder, stage):
    assert stage(spark, table(spark, ROWS).limit(0), folder).count() == 0
