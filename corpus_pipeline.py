"""A corpus pipeline of five stages over ``documents``.

Each stage is (name, function of (spark, docs, sf_dir)); it works on all that the one before it kept
and its decisions take effect. All but the last return the columns of ``documents``, whose ``doc_id``
tells documents apart: rows that repeat an id share their fate. ``run`` writes every stage as Parquet
and reads it again for the next. An empty table passes through as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import exact, jaccard, packing, quality, substrings
from rubricon.llm.queries import vocabulary_file
from rubricon.session import stored


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.scored(docs, quality.train(docs, labels), threshold=0.7, carry=True)
    return scored.where("predicted = 1").select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest as written, then the smallest id."""
    groups = exact.exact_groups(docs)
    return _without(docs, groups.where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id.

    Texts are linked when the sets of their five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    groups = jaccard.near_groups(docs, words=5, num=4, den=5)
    return _without(docs, groups.where("not doc_id <=> component_id"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that occur earlier; texts that lose none stay as written."""
    kept = substrings.kept_words(docs, width=20, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    changed = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return kept.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents in sequences of 2048 tokens."""
    return packing.best_fit(docs, vocabulary_file("word_bpe_49k.json"), size=2048)


STAGES = [
    ("quality_filter", quality_filter),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", pack),
]

#: The classifier and the tokenizer are beyond SQL; a test compares with a brute-force version.
ORACLE_SQL = None


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select(F.col("doc_id").alias("_gone"))
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_gone"]), "left_anti")


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
