"""The registered queries of this subpackage and, where SQL can say it, their equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import bpe, dialogs, dialogs_sql, exact, fingerprints, htmltext, langid, mixing, packing, periodic, quality, sharding, simhash, substrings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_file(name: str) -> str:
    """Where an installed public tokenizer's file lies, on the driver and on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stay when repeated passages of 20 words go."""
    kept = substrings.kept_words(table(spark, sf_dir, "documents"), width=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = htmltext.extracted(pages, htmltext.trained(), keep=["page_id", "url"])
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return langid.predicted(docs, langid.train(docs))


@query(
    r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document of equal texts stays."""
    return exact.exact_groups(table(spark, sf_dir, "documents"))


@query()
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = vocabulary_file("byte_bpe_50k.json")
    ids = bpe.encoded(table(spark, sf_dir, "documents"), path)
    return bpe.decoded(ids, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query()
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), max_bits=4, words=4)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.train(docs, table(spark, sf_dir, "labels")), threshold=0.7)


@query()
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of nearly equal bytes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    return placed.select(
        "doc_id",
        "size",
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query()
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    path = vocabulary_file("word_bpe_49k.json")
    return packing.best_fit(table(spark, sf_dir, "documents"), path, size=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query(dialogs_sql.SQL)
def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    found = dialogs.repaired(dialogs.damaged(table(spark, sf_dir, "conversations")))
    return found.withColumnRenamed("digest", "repaired_sha256")


@query()
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of the sources by 5, 2, 1 and so on takes from every document."""
    held = mixing.mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)
    return held.select("doc_id", "size", "source_size", "target", "taken")


@query()
def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of which is made to repeat itself, and digests of the
    runs and of the text without the repetitions."""
    found = periodic.detected(periodic.stuttering(table(spark, sf_dir, "documents")))
    # Runs come by start, then period, so that the first of equal exponents wins.
    higher = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, run: F.when(higher(best, run), run).otherwise(best))
    line = lambda run: F.concat_ws(",", run["start"], run["length"], run["period"])
    listed = F.concat_ws("", F.transform("runs", lambda run: F.concat(line(run), F.lit("\n"))))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
