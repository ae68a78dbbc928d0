"""Keyed documents and prompts that refer to them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import slice_text
from rubricon.operators.grouping import exploded

# Fixed value: reference form.
KEY_PATTERN = r"\{\{([^{}]+)\}\}"


def keyed_store(saves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last saved text per key, and whether it replaced an earlier one."""
    return (
        saves.where(F.coalesce(F.col("text"), F.lit("")) != "")
        .groupBy(*keys)
        .agg(F.max_by("text", "seq").alias("text"), (F.count(F.lit(1)) > 1).alias("overwritten"))
    )


def plain_key(key: Column) -> Column:
    folded = F.regexp_replace(F.replace(key, F.lit(" "), F.lit("_")), "_+", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def references(prompts: DataFrame) -> DataFrame:
    """One row per reference: ``prompt_id, ref_pos, ref``."""
    found = F.regexp_extract_all(F.col("prompt"), F.lit(KEY_PATTERN), F.lit(1))
    return exploded(prompts, ["prompt_id"], found, "ref_pos", "ref")


def resolve_keys(prompts: DataFrame, store: DataFrame) -> DataFrame:
    """Document key of every reference: exact, else by folded spelling (the smallest such
    key). A prompt without reference means the only document when there is just one.
    ``error`` is set where no key is found."""
    exact = store.select(F.col("key").alias("ref"), F.col("key").alias("_exact"))
    folded = (
        store.groupBy(F.regexp_replace("key", "_+", "_").alias("_plain")).agg(F.min("key").alias("_folded"))
    )
    rows = (
        references(prompts)
        .withColumn("_plain", plain_key(F.col("ref")))
        .join(exact, "ref", "left")
        .join(folded, "_plain", "left")
        .select("prompt_id", "ref_pos", "ref", F.coalesce("_exact", "_folded").alias("key"))
    )
    only = store.agg(F.when(F.count(F.lit(1)) == 1, F.min("key"))).scalar()
    bare = prompts.where(~F.col("prompt").rlike(KEY_PATTERN)).select(
        "prompt_id", F.lit(0).alias("ref_pos"), F.lit(None).cast("string").alias("ref"), only.alias("key")
    )
    return rows.unionByName(bare).withColumn(
        "error", F.when(F.col("key").isNull(), F.coalesce(F.concat(F.lit("unknown key "), "ref"), F.lit("no key")))
    )


def fill_prompts(prompts: DataFrame, store: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Replace every reference by its document, or by the half-open character range asked for.

    The prompt is cut once into literals and references, so inserted text is never read
    again. ``ranges(prompt_id, key, start, end)``. A prompt with an unknown key, no
    reference, or a range for a key it does not mention has an error and no text.
    """
    literals = F.split("prompt", KEY_PATTERN)
    refs = F.regexp_extract_all(F.col("prompt"), F.lit(KEY_PATTERN), F.lit(1))
    zipped = F.arrays_zip(literals.alias("lit"), refs.alias("key"))
    parts = exploded(prompts, ["prompt_id", F.size(refs).alias("n_refs")], zipped, "pos", "_p").select("prompt_id", "n_refs", "pos", F.col("_p.lit").alias("lit"), F.col("_p.key").alias("key"))
    docs = parts.join(store.select("key", F.col("text").alias("doc")), "key", "left")
    unused = None
    if ranges is not None:
        docs = docs.join(ranges, ["prompt_id", "key"], "left").withColumn(
            "cut", F.when(F.col("start").isNull(), F.col("doc")).otherwise(slice_text(F.col("doc"), F.col("start"), F.col("end")))
        )
        unused = (
            ranges.join(parts.select("prompt_id", "key").distinct(), ["prompt_id", "key"], "left_anti")
            .groupBy("prompt_id")
            .agg(F.count(F.lit(1)).alias("_unused"))
        )
    else:
        docs = docs.withColumn("cut", F.col("doc"))
    piece = F.concat(F.coalesce("lit", F.lit("")), F.coalesce("cut", F.lit("")))
    out = docs.groupBy("prompt_id").agg(
        F.count_if(F.col("key").isNotNull() & F.col("doc").isNull()).alias("_unknown"),
        F.max("n_refs").alias("_refs"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("t")))), lambda s: s["t"]), "").alias("_text"),
    )
    error = F.when(F.col("_refs") == 0, "no reference").when(F.col("_unknown") > 0, "unknown key")
    if unused is not None:
        out = out.join(unused, "prompt_id", "left")
        error = error.when(F.col("_unused") > 0, "range for a key that is not referenced")
    return out.select("prompt_id", F.when(error.isNull(), F.col("_text")).alias("text"), error.alias("error"))


def context_or_text(requests: DataFrame, contexts: DataFrame, store: DataFrame, chars: int | None = None) -> DataFrame:
    """Retrieved context, else the document's flat text, cut to ``chars`` characters if asked for."""
    flat = F.col("text") if chars is None else F.left("text", F.lit(chars))
    return (
        requests.join(contexts.select("query_id", "context"), "query_id", "left")
        .join(store.select("key", "text"), "key", "left")
        .select(*requests.columns, F.coalesce("context", flat).alias("context"))
    )


def first_by_position(df: DataFrame, order: Sequence[Column], n: int = 3) -> DataFrame:
    """Head slice in a total order."""
    return df.orderBy(*order).limit(n)
