"""Finding and reading JSON inside free text, as VARIANT values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubricon.functions.text import SPACE, trim_space

# How a text that may be JSON begins; a letter begins nothing but these words.
JSON_START = r"\A(?:[^A-Za-z]|true|false|null|NaN|Inf)"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value, which is evaluated once however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def unfenced(text: Column) -> Column:
    """Text without a surrounding code fence."""

    def inner(t: Column) -> Column:
        return trim_space(F.replace(F.regexp_replace(t, r"\A```(?:json)?", ""), F.lit("```")))

    def trimmed(t: Column) -> Column:
        # Most texts have no space at their ends, which two characters tell.
        spaced = F.left(t, F.lit(1)).rlike(SPACE) | F.right(t, F.lit(1)).rlike(SPACE)
        return F.when(spaced, trim_space(t)).otherwise(t)

    trim = _once(text, trimmed)
    return _once(trim, lambda t: F.when(t.startswith("```"), inner(t)).otherwise(t))


def strict_json(text: Column) -> Column:
    """VARIANT of the whole text, or NULL. Wrapping in brackets makes trailing text an
    error instead of being skipped."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    return _once(items, lambda i: F.when(F.size(i) == 1, F.element_at(i, 1)))


def find_json(text: Column, arrays: bool = True) -> Column:
    """JSON value in a reply: the whole text, else first ``[`` to last ``]`` (only with
    ``arrays``), else first ``{`` to last ``}``, else NULL."""
    parts = [r"(?s)\[.*\]", r"(?s)\{.*\}"] if arrays else [r"(?s)\{.*\}"]

    def found(clean: Column) -> Column:
        # A text that cannot be JSON is not parsed: an error costs far more than a look at its beginning.
        whole = F.when(clean.rlike(JSON_START), strict_json(clean))
        return F.coalesce(whole, *[strict_json(F.regexp_extract(clean, p, 0)) for p in parts])

    return _once(unfenced(text), found)


def json_kind(value: Column) -> Column:
    """array, object, scalar or none."""
    schema = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), "none")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("scalar")
    )


def json_field(value: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(value, path, kind)


def verdict(reply: Column) -> Column:
    """``struct<met, reason>`` of a judge reply; anything but MET is unmet. NULL when the
    reply holds no JSON object."""
    parsed = find_json(reply, arrays=False)
    met = json_field(parsed, "$.verdict", "string") == "MET"
    reason = F.coalesce(json_field(parsed, "$.reason", "string"), F.lit(""))
    return F.when(parsed.isNotNull(), F.struct(F.coalesce(met, F.lit(False)).alias("met"), reason.alias("reason")))


def hallucination(reply: Column) -> Column:
    parsed = find_json(reply, arrays=False)
    return F.coalesce(json_field(parsed, "$.hallucination", "boolean"), F.lit(False))


QUALITY_SCORES = ("specificity", "atomicity", "tier_correctness", "coverage")


def quality_reply(reply: Column) -> Column:
    """Struct of the four scores, overall, issues and suggestions of a quality check; missing scores are
    NULL and missing lists empty. NULL when the reply holds no JSON object."""
    parsed = find_json(reply, arrays=False)
    listed = lambda name: F.coalesce(json_field(parsed, f"$.{name}", "array<string>"), F.array().cast("array<string>"))
    fields = [json_field(parsed, f"$.scores.{c}", "double").alias(c) for c in QUALITY_SCORES]
    fields += [json_field(parsed, "$.overall", "double").alias("overall")]
    fields += [listed(c).alias(c) for c in ("issues", "suggestions")]
    return F.when(parsed.isNotNull(), F.struct(*fields))


def category_reply(reply: Column, known: list[str]) -> Column:
    """``struct<category, error>`` of a classification: a category that is not ``known`` is an error."""
    name = json_field(find_json(reply), "$.category", "string")
    valid = F.coalesce(name.isin(known), F.lit(False))
    error = F.when(name.isNull(), "no category").when(~valid, F.concat(F.lit("unknown category "), name))
    return F.struct(F.when(valid, name).alias("category"), error.alias("error"))


def extracted_facts(reply: Column) -> Column:
    """Array under ``extracted_facts``; an unreadable reply gives an empty array."""
    found = json_field(find_json(reply), "$.extracted_facts", "array<string>")
    return F.coalesce(found, F.array().cast("array<string>"))


def context_list(reply: Column) -> Column:
    """Array under ``contexts`` with items stripped; empty when unreadable."""
    found = json_field(find_json(reply, arrays=False), "$.contexts", "array<string>")
    return F.transform(
        F.coalesce(found, F.array().cast("array<string>")), lambda c: trim_space(F.coalesce(c, F.lit("")))
    )


def tiered_facts(value: Column) -> Column:
    """Parsed rubric reply as ``array<struct<tier, fact>>``, or NULL when the shape is unknown.
    Pass a column that holds the VARIANT, not its expression: it is read several times.

    Accepts an object of tier arrays, a list of ``{tier, facts}`` and a list of
    ``{fact, tier}``; the two list shapes cannot be mixed. Unknown tiers are dropped.
    """
    pair = lambda tier, fact: F.struct(tier.alias("tier"), fact.alias("fact"))
    no_facts = F.array().cast("array<string>")

    def of_tier(t: str) -> Column:
        listed = F.coalesce(json_field(value, f"$.{t}", "array<string>"), no_facts)
        return F.transform(listed, lambda f: pair(F.lit(t), f))

    by_tier = F.flatten(F.array(*[of_tier(t) for t in ("critical", "important", "optional")]))
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"),
        lambda i: F.struct(
            F.lower(json_field(i, "$.tier", "string")).alias("tier"),
            json_field(i, "$.facts", "array<string>").alias("many"),
            json_field(i, "$.fact", "string").alias("one"),
        ),
    )
    known = lambda p: p["tier"].isin("critical", "important", "optional")
    grouped = lambda i: F.flatten(F.transform(i, lambda x: F.transform(x["many"], lambda f: pair(x["tier"], f))))
    single = lambda i: F.transform(i, lambda x: pair(x["tier"], x["one"]))
    return _once(
        items,
        lambda i: F.when(i.isNull() & (json_kind(value) == "object"), by_tier)
        .when(F.forall(i, lambda x: x["tier"].isNotNull() & x["many"].isNotNull()), F.filter(grouped(i), known))
        .when(F.forall(i, lambda x: x["tier"].isNotNull() & x["one"].isNotNull()), F.filter(single(i), known)),
    )
