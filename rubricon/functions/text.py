"""Text expressions: tokens, normalisation, numbers, identifiers, filing headers."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a Unicode-aware whitespace split breaks on.
SPACE = (
    r"[\t-\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# A word character as letter, number or underscore of any script.
WORD = r"[\p{L}\p{N}_]"

# Capitalised words that do not count as identifiers.
PLAIN_CAPITALISED = [
    "The", "What", "When", "Where", "How", "Did", "Does",
    "Was", "Were", "Has", "Have", "Which", "Who", "Why",
    "And", "But", "For", "With", "That", "This", "From",
]

# Lines that open a section of a filing.
SECTION_LINES = [
    r"ITEM\s+\d+[A-Z]?\.?\s+",
    "RISK FACTORS",
    "BUSINESS",
    r"MANAGEMENT[\s\S]{0,10}DISCUSSION",
    "MD&A",
    "USE OF PROCEEDS",
    "FORWARD[- ]LOOKING",
    "PROSPECTUS SUMMARY",
    "SELECTED FINANCIAL DATA",
    "QUANTITATIVE AND QUALITATIVE",
    "LEGAL PROCEEDINGS",
    "PRINCIPAL STOCKHOLDERS",
    "DILUTION",
    "DESCRIPTION OF CAPITAL STOCK",
    "UNDERWRITING",
    "FINANCIAL STATEMENTS",
]
SECTION_PATTERN = r"(?im)\A[ \t]*(?:" + "|".join(SECTION_LINES) + r")[ \t]*$"

# Filing type labels by form, first match wins.
FILING_TYPES = [
    ("10-K", "Form 10-K (Annual Report)"),
    ("10-Q", "Form 10-Q (Quarterly Report)"),
    ("8-K", "Form 8-K (Current Disclosure)"),
    ("S-1", "Form S-1 (Registration Statement)"),
]
FILING_TYPE_DEFAULT = "SEC Filing"
PERIOD_DEFAULT = "Unknown Period"
PERIOD_PATTERN = (
    r"(?i)For\s+the\s+(?:fiscal\s+year|quarterly\s+period)\s+ended\s+([A-Za-z]+\s+\d{1,2},\s+\d{4})"
)

# Numeric tokens for question matching, and figures inside facts.
NUMBER_PATTERN = r"\d+(?:\.\d+)?"
SIGNAL_PATTERN = r"\$?\d[\d,]*\.?\d*%?"

# Typographic variants and their plain forms.
PLAIN_FORMS = [
    ("€", "EUR"), ("£", "GBP"), ("–", "-"), ("—", "-"),
    ("’", "'"), ("‘", "'"), ("“", '"'), ("”", '"'), ("\u00a0", " "),
]

# Sizes of the document sample.
SAMPLE_WHOLE, SAMPLE_PART = 12_000, 4_000
SAMPLE_MIDDLE, SAMPLE_TAIL = "\n\n[... Middle Section ...]\n\n", "\n\n[... Tail Section ...]\n\n"


def trim_space(text: Column) -> Column:
    """Strip Unicode whitespace at both ends."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def fold_space(text: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens, in order."""
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Whitespace tokens as written."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda t: t != "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


@F.udf(T.StringType(), useArrow=False)
def _nfkc(text):
    """Row by row: an Arrow batch of long texts would be held whole, before and after."""
    return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)


def normalise_question(text: Column) -> Column:
    """Canonical text for question matching: NFKC, plain punctuation, single spaces.

    Spark has no NFKC function, so that one step runs in Python.
    """
    plain = _nfkc(text)
    for variant, form in PLAIN_FORMS:
        plain = F.replace(plain, F.lit(variant), F.lit(form))
    return fold_space(plain)


def number_tokens(text: Column) -> Column:
    """Ordered numeric tokens."""
    return F.regexp_extract_all(text, F.lit("(?U)" + NUMBER_PATTERN), F.lit(0))


def signals(text: Column) -> Column:
    """Distinct figures (amounts, counts, percentages) without trailing punctuation."""
    found = F.regexp_extract_all(text, F.lit(SIGNAL_PATTERN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda s: F.regexp_replace(s, "[,.]+$", "")))


def make_similarity(autojunk: bool = True):
    """Sequence-matcher ratio as a batch function. ``autojunk`` changes results for
    texts of 200 characters and more and is on by default."""

    @F.pandas_udf(T.DoubleType())
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [
                None if x is None or y is None
                else SequenceMatcher(None, x, y, autojunk=autojunk).ratio()
                for x, y in zip(a, b)
            ],
            dtype="float64",
        )

    return similarity


def exact_terms(query: Column) -> Column:
    """Terms of a query worth finding verbatim: quoted phrases, and tokens that hold a
    digit or hyphen or look like a name. Duplicates are removed before lower-casing,
    so case variants of one term count separately; terms of one or two characters
    are dropped."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    token = F.regexp_extract_all(
        query, F.lit(rf"{WORD}(?:[\p{{L}}\p{{N}}_\-]*{WORD})?"), F.lit(0)
    )

    def identifier(t: Column) -> Column:
        lower_case = (t == F.lower(t)) & (t != F.upper(t))
        name = (F.length(t) > 3) & ~lower_case & ~t.isin(PLAIN_CAPITALISED)
        return t.rlike(r"\p{Nd}") | t.contains("-") | name

    kept = F.array_distinct(F.concat(quoted, F.filter(token, identifier)))
    return F.transform(F.filter(kept, lambda t: F.length(t) > 2), lambda t: F.lower(t))


def is_section_line(text: Column) -> Column:
    return trim_space(text).rlike(SECTION_PATTERN)


def section_name(text: Column) -> Column:
    return F.upper(trim_space(text))


def filing_type(text: Column) -> Column:
    out = F.lit(FILING_TYPE_DEFAULT)
    for form, label in reversed(FILING_TYPES):
        out = F.when(text.rlike(rf"(?i)FORM\s+{form}"), F.lit(label)).otherwise(out)
    return out


def filing_period(text: Column) -> Column:
    found = F.regexp_extract(text, PERIOD_PATTERN, 1)
    return F.when(found != "", found).otherwise(F.lit(PERIOD_DEFAULT))


def strip_thinking(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def document_sample(text: Column) -> Column:
    """Whole text when short, else head, middle and tail joined by markers."""
    n = F.length(text)
    mid = F.greatest(F.lit(0), F.floor(n / 2).cast("int") - SAMPLE_PART // 2)
    return F.when(n <= SAMPLE_WHOLE, text).otherwise(
        F.concat(
            F.left(text, F.lit(SAMPLE_PART)),
            F.lit(SAMPLE_MIDDLE),
            F.substring(text, mid + 1, F.lit(SAMPLE_PART)),
            F.lit(SAMPLE_TAIL),
            F.right(text, F.lit(SAMPLE_PART)),
        )
    )


def url_key(url: Column) -> Column:
    return F.left(F.md5(url), F.lit(12))


def truncated(text: Column, max_chars: int | None) -> Column:
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Half-open character range; negative bounds count from the end."""
    n = F.length(text)
    at = lambda b: F.when(b < 0, F.greatest(n + b, F.lit(0))).otherwise(F.least(b, n))
    lo, hi = at(start), at(end)
    return F.when(hi > lo, F.substring(text, (lo + 1).cast("int"), (hi - lo).cast("int"))).otherwise(
        F.lit("")
    )
