"""Date handling and searches over tables of filings and web results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Last permitted day, date form, page size.
MAX_END_DATE = "2026-03-01"
DATE_PATTERN = r"\A\d{4}-\d{2}-\d{2}\z"
PAGE_ROWS = 100

_EDGE_BEFORE, _EDGE_AFTER = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def clamped_range(start: Column, end: Column) -> list[Column]:
    """``start_date``, ``end_date`` and ``error`` of a requested range. Both ends are capped
    at the last permitted day, so a range wholly after it becomes that day."""
    valid = F.coalesce(start.rlike(DATE_PATTERN) & end.rlike(DATE_PATTERN), F.lit(False))
    lo, hi = F.least(start, F.lit(MAX_END_DATE)), F.least(end, F.lit(MAX_END_DATE))
    error = F.when(~valid, "invalid date format").when(lo > hi, "start is later than end")
    good = error.isNull()
    return [
        F.when(good, lo).alias("start_date"),
        F.when(good, hi).alias("end_date"),
        error.alias("error"),
    ]


def checked_range(start: str, end: str) -> tuple[str, str]:
    for value in (start, end):
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", value):
            raise ValueError(f"invalid date {value!r}, expected YYYY-MM-DD")
    lo, hi = min(start, MAX_END_DATE), min(end, MAX_END_DATE)
    if lo > hi:
        raise ValueError(f"start {lo} is later than end {hi}")
    return lo, hi


def asset_route(asset_class: Column) -> Column:
    """equity, crypto or fx; NULL for anything else."""
    a = F.lower(F.trim(asset_class))
    return F.when(a.isin("equity", "etf"), "equity").when(a.isin("crypto", "fx"), a)


def bare_cik(cik: Column) -> Column:
    return F.regexp_replace(cik, "^0+", "")


def _term(text: str, prefix: bool = False) -> str:
    body = r"\s+".join(re.escape(w) for w in text.lower().split())
    return _EDGE_BEFORE + body + ("" if prefix else _EDGE_AFTER)


def text_matches(
    text: Column,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    phrases: Sequence[str] = (),
    prefixes: Sequence[str] = (),
) -> Column:
    """Word search, ignoring case: every term, at least one term, no term, exact phrases, and
    words that start with a prefix."""
    low = F.lower(text)
    has = lambda t, prefix=False: low.rlike(_term(t, prefix))
    out = F.lit(True)
    for t in [*all_of, *phrases]:
        out = out & has(t)
    for t in prefixes:
        out = out & has(t, True)
    for t in none_of:
        out = out & ~has(t)
    if any_of:
        some = F.lit(False)
        for t in any_of:
            some = some | has(t)
        out = out & some
    return out


def filings(
    table: DataFrame,
    start: str = "1900-01-01",
    end: str = MAX_END_DATE,
    form_types: Sequence[str] | None = None,
    ciks: Sequence[str] | None = None,
    **terms: Sequence[str],
) -> DataFrame:
    """Filings in a date range, of given forms and filers (leading zeros optional), whose text
    matches. Column filters come before the text search and reach the scan."""
    lo, hi = checked_range(start, end)
    out = table.where(F.col("filed_at").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    if form_types:
        out = out.where(F.col("form_type").isin(list(form_types)))
    if ciks:
        out = out.where(bare_cik(F.col("cik")).isin([c.lstrip("0") for c in ciks]))
    return out.where(text_matches(F.col("text"), **terms)) if terms else out


def web_results(table: DataFrame, start: str | None = None, end: str = MAX_END_DATE, **terms) -> DataFrame:
    """Published pages in a date range; unlike a remote search the start date filters."""
    lo, hi = checked_range(start or "1900-01-01", end)
    out = table.where(F.col("published").between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return out.where(text_matches(F.col("text"), **terms)) if terms else out


def result_page(
    results: DataFrame, order: Sequence[Column], page: int = 1, top_n: int = PAGE_ROWS, rows: int = PAGE_ROWS
) -> DataFrame:
    """First ``top_n`` rows of one page of results in a total order."""
    return results.orderBy(*order).offset((page - 1) * rows).limit(min(top_n, rows))
