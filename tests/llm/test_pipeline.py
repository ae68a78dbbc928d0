import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rubricon.llm import quality

from .test_exact import brute_force as equal_groups
from .test_jaccard import true_groups
from .test_packing import check as check_packing
from .test_substrings import brute_force as kept_words

FOLDER = "/root/testdata/sf0.001"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    return out


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_filter", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    for df in stages[1:-1]:
        assert df.dtypes == stages[0].dtypes


def test_every_stage_equals_brute_force(spark, stages):
    docs, good, exact, near, cut, packed = stages
    model = quality.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    keep = lambda t: model.score(quality.figures(t or "")[None, :].astype(float))[0] >= 0.7
    assert sorted(pairs(good)) == sorted((i, t) for i, t in pairs(docs) if keep(t))
    kept = {i for i, _, _, k in equal_groups(pairs(good)) if k}
    assert sorted(pairs(exact)) == sorted((i, t) for i, t in pairs(good) if i in kept)
    kept = {i for i, c in true_groups(pairs(exact)) if i == c}
    assert sorted(pairs(near)) == sorted((i, t) for i, t in pairs(exact) if i in kept)
    given = dict(pairs(near))
    want = {i: kept if n else given[i] for i, _, n, kept in kept_words(list(given.items()), 20)}
    assert dict(pairs(cut)) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    check_packing(pairs(cut), packed.collect())


def test_run(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(stages[-1])


@pytest.fixture(scope="module")
def odd(documents, odd_rows):
    """Odd rows, near copies and a passage of many texts, with columns that stages might use themselves."""
    near = "the quick brown fox jumps over the lazy dog and runs far away from here now " * 4
    rows = odd_rows + [(30, near), (31, near + "again"), (32, near + "once more"), (32, near + "once more")]
    extra = {c: F.lit("x") for c in ("_gone", "row", "lang", "source", "leaf", "kept", "predicted", "component_id")}
    return documents(rows).withColumns(extra).withColumn("n_chars", F.length("text").cast("long"))


def test_odd_rows_through_quality_filter(spark, odd):
    out = corpus_pipeline.quality_filter(spark, odd, FOLDER)
    assert out.dtypes == odd.dtypes
    model = quality.train(odd, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    keep = lambda t: model.score(quality.figures(t or "")[None, :].astype(float))[0] >= 0.7
    assert sorted(pairs(out), key=str) == sorted(((i, t) for i, t in pairs(odd) if keep(t)), key=str)


def test_odd_rows_through_exact_dedup(spark, odd):
    out = corpus_pipeline.exact_dedup(spark, odd, FOLDER)
    assert out.dtypes == odd.dtypes
    kept = {i for i, _, _, k in equal_groups(pairs(odd)) if k}
    assert sorted(pairs(out), key=str) == sorted(((i, t) for i, t in pairs(odd) if i in kept), key=str)


def test_odd_rows_through_near_dedup(spark, odd):
    out = corpus_pipeline.near_dedup(spark, odd, FOLDER)
    assert out.dtypes == odd.dtypes
    kept = {i for i, c in true_groups(pairs(odd)) if i == c}
    assert sorted(pairs(out), key=str) == sorted(((i, t) for i, t in pairs(odd) if i in kept), key=str)
    assert 30 in kept and 31 not in kept and 32 not in kept


def test_odd_rows_through_substring_dedup(spark, odd):
    out = corpus_pipeline.substring_dedup(spark, odd, FOLDER)
    assert out.dtypes == odd.dtypes
    given = dict(pairs(odd))  # rows that share an id share the text
    want = [(i, kept if n else given[i]) for i, _, n, kept in kept_words(pairs(odd), 20)]
    assert sorted(pairs(out), key=str) == sorted(want, key=str)


def test_odd_rows_through_packing(spark, odd):
    check_packing(pairs(odd), corpus_pipeline.pack(spark, odd, FOLDER).collect())


def test_empty_table(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.collect() == []
