"""HTML pages to text blocks, one page per row.

Spark has no HTML reader; a page is parsed once with the standard library, row by row,
and everything after that (sections, repeats, filters) is DataFrame work.
"""

from __future__ import annotations

import re
from functools import cache
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.text import trim_space

# Elements read as blocks, wrappers, and elements without end tag.
BLOCKS = {"table", "p", "div", "h1", "h2", "h3", "h4", "span"}
WRAPPERS, WRAPPED = {"div", "span"}, {"table", "p", "div"}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}

PAGE = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField(
            "blocks",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("tag", T.StringType()),
                        T.StructField("text", T.StringType()),
                        T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType()))),
                    ]
                )
            ),
        ),
    ]
)


@cache
def _page_reader():
    class Reader(HTMLParser):
        """Collects text per open element; element order is start-tag order."""

        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.stack, self.blocks, self.page, self.pending = [], [], [], []

        def flush(self):
            text = "".join(self.pending)
            self.pending = []
            if not text:
                return
            if not text.strip():
                text = "\n" if "\n" in text else " "
            if any(e["tag"] in ("script", "style") for e in self.stack):
                return
            self.page.append(text)
            for e in self.stack:
                if e["texts"] is not None:
                    e["texts"].append(text)

        def handle_starttag(self, tag, attrs):
            self.flush()
            if tag in VOID:
                return
            held = tag in BLOCKS or tag in ("td", "th")
            e = {"tag": tag, "texts": [] if held else None, "wraps": False, "rows": []}
            for parent in self.stack:
                if tag in WRAPPED:
                    parent["wraps"] = True
                if tag == "tr" and parent["tag"] == "table":
                    parent["rows"].append(e)
                if tag in ("td", "th") and parent["tag"] == "tr":
                    parent["rows"].append(e)
            if tag in BLOCKS:
                self.blocks.append(e)
            self.stack.append(e)

        def handle_startendtag(self, tag, attrs):
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

        def handle_endtag(self, tag):
            self.flush()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i]["tag"] == tag:
                    del self.stack[i:]
                    return

        def handle_data(self, data):
            self.pending.append(data)

        def handle_comment(self, data):
            self.flush()

    def read(html):
        reader = Reader()
        reader.feed(html)
        reader.close()
        reader.flush()
        blocks = []
        for e in reader.blocks:
            if e["tag"] in WRAPPERS and e["wraps"]:
                continue
            cells = None
            if e["tag"] == "table":
                cells = [
                    [re.sub(r"\s+", " ", "".join(c["texts"]).strip()) for c in row["rows"]]
                    for row in e["rows"]
                ]
            blocks.append({"tag": e["tag"], "text": " ".join(e["texts"]).strip(), "cells": cells})
        return {"text": "".join(reader.page), "blocks": blocks}

    return read


@F.udf(PAGE, useArrow=False)
def parse_page(html):
    """Row by row: a parsed page is many times its html, as a text is held by each element around it,
    so an Arrow batch of pages would be held whole in every form."""
    return _page_reader()(html or "")


def table_markdown(cells: Column) -> Column:
    """Markdown of a cell grid. Rows with only empty cells are left out; the separator
    follows the first grid row and is lost when that row is empty."""
    filled = lambda row: F.exists(row, lambda c: c != "")
    line = lambda row: F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |"))
    rule = lambda row: line(F.transform(row, lambda c: F.lit("---")))
    rows = F.transform(
        cells,
        lambda row, i: F.when(
            filled(row), F.when(i == 0, F.concat(line(row), F.lit("\n"), rule(row))).otherwise(line(row))
        ),
    )
    return F.array_join(F.filter(rows, lambda r: r.isNotNull()), "\n")


def plain_page_text(text: Column) -> Column:
    """Page text with lines stripped, split on double spaces and blanks removed."""
    phrases = F.flatten(
        F.transform(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"), lambda s: F.split(trim_space(s), "  "))
    )
    return F.array_join(
        F.filter(F.transform(phrases, lambda p: trim_space(p)), lambda p: p != ""), "\n"
    )
