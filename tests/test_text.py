import re
import unicodedata
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rubricon.functions import facts, jsontext, splitting, text
from rubricon.functions.html import parse_page, plain_page_text, table_markdown


def column(spark, values, fn):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", fn(F.col("s")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def test_question_normalisation(spark):
    raw = [
        "Q1 2026 – what’s  the €5 “ARPU”?", "ＡＢ ﬁn", "  a b\n", "£7 — x", "plain",
    ]
    got = column(spark, raw, text.normalise_question)
    assert got == ["Q1 2026 - what's the EUR5 \"ARPU\"?", "AB fin", "a b", "GBP7 - x", "plain"]
    assert all(unicodedata.is_normalized("NFKC", g) for g in got)


def test_tokens_split_on_unicode_space(spark):
    raw = ["A b C", " \t x\x1fy ", "", "　"]
    assert column(spark, raw, text.tokens) == [s.lower().split() for s in raw]


def test_number_tokens_and_signals(spark):
    raw = ["from 3.5 to 10, in Q1 2026", "cost $1,234.50, up 5%.", "none"]
    assert column(spark, raw, text.number_tokens) == [["3.5", "10", "1", "2026"], ["1", "234.50", "5"], []]
    assert column(spark, raw, text.signals) == [["3.5", "10", "1", "2026"], ["$1,234.50", "5%"], []]


def test_exact_terms(spark):
    raw = ['What is "Adjusted EBITDA" at Étoile-Nord in Q3 2024?', "V3 or 10-K and S-1", "lower case only", "The When NASDAQ _x Ab"]
    got = [sorted(x) for x in column(spark, raw, text.exact_terms)]
    assert got == [
        sorted(["adjusted ebitda", "adjusted", "ebitda", "étoile-nord", "2024"]), ["10-k", "s-1"], [], ["nasdaq"],
    ]


@pytest.mark.parametrize("autojunk", [True, False])
def test_similarity_ratio(spark, autojunk):
    pairs = [("abcd", "bcde"), ("", ""), ("x" * 250 + "y", "y" + "x" * 250), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(text.make_similarity(autojunk)("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a, b, autojunk=autojunk).ratio() for a, b in pairs]


def test_sections_filings_and_samples(spark):
    raw = ["  Risk Factors  \nmore", "ITEM 1A. \n\nx", "MD&A", "about risk factors", "Management’s Discussion"]
    assert column(spark, raw, text.is_section_line) == [True, True, True, False, True]
    docs = ["Form  10-K For the Fiscal Year ended May 3, 2024", "FORM S-1", ""]
    assert column(spark, docs, text.filing_type) == ["Form 10-K (Annual Report)", "Form S-1 (Registration Statement)", "SEC Filing"]
    assert column(spark, docs, text.filing_period) == ["May 3, 2024", "Unknown Period", "Unknown Period"]
    long = "".join(chr(97 + i % 26) for i in range(13_001))
    whole, cut = column(spark, ["short", long], text.document_sample)
    mid = len(long) // 2 - 2000
    assert whole == "short"
    assert cut == long[:4000] + "\n\n[... Middle Section ...]\n\n" + long[mid : mid + 4000] + "\n\n[... Tail Section ...]\n\n" + long[-4000:]


def test_character_ranges(spark):
    s = "Annual Report 2023"
    bounds = [(1, 6), (-4, 100), (0, -4), (5, 2), (-100, 3), (30, 40)]
    df = spark.createDataFrame([(s, a, b) for a, b in bounds], "s string, a int, b int")
    got = [r[0] for r in df.select(text.slice_text(F.col("s"), F.col("a"), F.col("b"))).collect()]
    assert got == [s[a:b] for a, b in bounds]


def test_amounts_periods_buckets(spark):
    raw = ["$8.2B in FY2025", "FY2025 revenue was $8,241M", "10 basis points", "about 500K users in Q3 2024", "7.5 % of x", "no number"]
    amounts = column(spark, raw, facts.amount_in_millions)
    assert amounts == [8200.0, 2025.0, 10000.0, 0.5, 7.5, None]
    assert column(spark, raw, facts.period) == ["FY2025", "FY2025", "UNKNOWN", "Q32024", "UNKNOWN", "UNKNOWN"]
    assert column(spark, raw, lambda c: facts.amount_bucket(facts.amount_in_millions(c))) == [8200, 2025, 10000, 0, 10, None]
    assert column(spark, ["7.45", "0.35"], lambda c: facts.amount_in_millions(c, True)) == [round(7.45, 1), round(0.35, 1)]


def test_json_in_text(spark):
    raw = [
        '```json\n{"a": 1}\n```', 'x [1, 2] y', '{"a": [1, 2]} junk', '["a"], "important": ["b"]', "{bad", '{"a": 1,}', '{"a": 1} tail {"b": 2}',
    ]
    kinds = column(spark, raw, lambda c: jsontext.json_kind(jsontext.find_json(c)))
    assert kinds == ["object", "array", "array", "none", "none", "none", "none"]
    only = column(spark, raw, lambda c: jsontext.json_kind(jsontext.find_json(c, arrays=False)))
    assert only == ["object", "none", "object", "none", "none", "none", "none"]


def test_tiered_facts_shapes(spark):
    raw = [
        '{"critical": ["a"], "optional": ["b", "c"]}',
        '[{"tier": "Critical", "facts": ["a", "b"]}, {"tier": "other", "facts": ["z"]}]',
        '[{"fact": "a", "tier": "important"}]',
        '[{"fact": "a"}]',
        "nothing",
    ]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string").withColumn("v", jsontext.find_json(F.col("s")))
    got = [r["t"] for r in df.select("i", jsontext.tiered_facts(F.col("v")).alias("t")).orderBy("i").collect()]
    pairs = [None if g is None else [(x["tier"], x["fact"]) for x in g] for g in got]
    assert pairs == [
        [("critical", "a"), ("optional", "b"), ("optional", "c")],
        [("critical", "a"), ("critical", "b")],
        [("important", "a")],
        None,
        None,
    ]


HTML = """<html><head><title>T</title><style>p{}</style></head><body>
<div><p>First <b>bold</b> &amp; more</p><script>var t='<p>no</p>';</script></div>
<div>plain <br>div</div><table><tr><th>Name</th><th> A  B </th></tr><tr><td></td><td> </td></tr>
<tr><td>x</td><td>1</td></tr></table><span><p>in span</p></span><h2>Head</h2></body></html>"""


def test_page_blocks(spark):
    df = spark.createDataFrame([(HTML,), ("",), ("<table><tr><td></td></tr><tr><td>v</td></tr></table>",)], "html string")
    rows = df.select(parse_page("html").alias("p")).collect()
    blocks = [(b["tag"], re.sub(r"\s+", " ", b["text"])) for b in rows[0]["p"]["blocks"] if b["tag"] != "table"]
    assert blocks == [("p", "First bold & more"), ("div", "plain div"), ("p", "in span"), ("h2", "Head")]
    assert rows[1]["p"]["blocks"] == []
    md = df.select(F.transform(parse_page("html")["blocks"], lambda b: table_markdown(b["cells"])).alias("m")).collect()
    tables = [m for r in md for m in r["m"] if m]
    assert tables == ["| Name | A B |\n| --- | --- |\n| x | 1 |", "| v |"]
    text_out = df.select(plain_page_text(parse_page("html")["text"])).first()[0]
    assert "var t" not in text_out and text_out.startswith("T\nFirst bold & more\nplain divName A\nB\n")


def test_splitter_sizes_and_coverage(spark):
    body = "\n\n".join(" ".join(f"w{i}x{j}" for j in range(i % 90)) + "\nline" for i in range(120)) + "".join(f"{i:05d}" for i in range(1000))
    split = splitting.make_splitter(200, 30)
    chunks = spark.createDataFrame([(body,)], "t string").select(split("t")).first()[0]
    assert all(0 < len(c) <= 200 for c in chunks)
    at = 0
    for c in chunks:
        found = body.find(c, max(0, at - 200))
        assert found >= 0
        assert body[at:found].strip() == "" or found <= at
        at = max(at, found + len(c))
    assert body[at:].strip() == ""
    assert spark.createDataFrame([("ab cd",)], "t string").select(split("t")).first()[0] == ["ab cd"]


def test_splitter_packs_levels_apart(spark):
    split = splitting.make_splitter(10, 3)
    got = lambda t: spark.createDataFrame([(t,)], "t string").select(split("t")).first()[0]
    assert got("aa\n\nbb cc dd ee ff\n\ngg") == ["aa", "bb cc dd", "dd ee ff", "gg"]
    assert got("abcdefghijkl m") == ["abcdefghij", "ijkl", "m"] or got("abcdefghijkl m")[-1] == "m"


def test_long_texts_reach_python_row_by_row(spark):
    """An Arrow batch of pages or documents would be held whole by a worker, with all that is made of it."""
    df = spark.createDataFrame([("<p>a b</p>",)], "t string")
    for made in (parse_page("t"), splitting.make_splitter(200, 30)("t"), text.normalise_question(F.col("t"))):
        plan = df.select(made.alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_a_reply_is_parsed_once_a_try(spark):
    df = spark.createDataFrame([("x",)], "s string")
    plan = df.select(jsontext.find_json(F.col("s")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 3


def test_json_that_begins_with_a_letter_or_follows_text(spark):
    raw = ["true", "nullx", "null", " false ", "Sure: [1] done", "t [2] x", "NaN", "] [1", "", "x {\"a\": [3]} y", "```json\ntrue\n```", "no", None]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, s string")
    got = [r["v"] for r in df.select("i", F.to_json(jsontext.find_json(F.col("s"))).alias("v")).orderBy("i").collect()]
    assert got == ["true", None, "null", "false", "[1]", "[2]", None, None, None, "[3]", "true", None, None]
