import json

import pytest
from pyspark.sql import functions as F

from rubricon.operators import index, prices, search, telemetry
from rubricon.plans.build_index import build_index
from rubricon.sources import readers, writers
from rubricon.streaming.ingest import ingest, waiting_pages


def dump(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False), encoding="utf-8")


def test_answers_and_facts(spark, tmp_path):
    dump(tmp_path / "a" / "m1.json", [{"question": "q", "success": True, "answer": "x", "error": None}])
    dump(tmp_path / "a" / "m2.v2.json", [{"question": "q", "success": False, "answer": None, "error": {"type": "T", "message": "late"}}])
    got = {r["model"]: (r["success"], r["answer"], r["error"] and r["error"]["message"]) for r in readers.answers(spark, str(tmp_path / "a")).collect()}
    assert got == {"m1": (True, "x", None), "m2.v2": (False, None, "late")}
    fact = lambda m, q: {"question": q, "category": "forensic", "model": m, "facts": ["f"], "answer_file": "x", "answer_index": 0}
    dump(tmp_path / "f" / "1.json", [fact("m1", "q1"), fact("m1", "q2")])
    dump(tmp_path / "f" / "2.json", [fact("m2", "q1"), fact("m2", "q2")])
    assert readers.facts(spark, str(tmp_path / "f")).count() == 4
    dump(tmp_path / "f" / "2.json", [fact("m2", "q1")])
    with pytest.raises(ValueError, match="between 1 and 2"):
        readers.facts(spark, str(tmp_path / "f"))


def test_rubrics_one_or_many_and_grades(spark, tmp_path):
    rub = {"question": "q", "category": "forensic", "rubric": {"critical": ["a"], "important": [], "optional": []}}
    dump(tmp_path / "r" / "one.json", rub)
    dump(tmp_path / "r" / "many.json", [rub, rub])
    assert readers.rubrics(spark, str(tmp_path / "r")).count() == 3
    grade = {"model": "raw", "summary": {"count": 1}, "results": [{"question": "q1", "score": 0.5}, {"question": "q2", "score": 0.25}]}
    dump(tmp_path / "g" / "k26_grades.json", grade)
    got = readers.grades(spark, str(tmp_path / "g"), {"k26_grades": "Model K"}).collect()
    assert [(r["model"], r["pos"], r["question"], r["score"]) for r in got] == [("Model K", 0, "q1", 0.5), ("Model K", 1, "q2", 0.25)]


def test_taxonomy_questions_and_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text('question,proposed_domain,proposed_workflow\n"a, ""b""",d,w\n', encoding="utf-8")
    assert readers.taxonomy(spark, str(tmp_path / "t.csv")).first()["question"] == 'a, "b"'
    (tmp_path / "u.csv").write_text("question,proposed_domain\nq,d\n", encoding="utf-8")
    with pytest.raises(ValueError, match="proposed_workflow"):
        readers.taxonomy(spark, str(tmp_path / "u.csv"))
    (tmp_path / "q.txt").write_text(" one \n\n two\n   \n", encoding="utf-8")
    assert [r[0] for r in readers.questions(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    assert readers.plain_answers(spark, str(tmp_path / "q.txt"), "q").first()["answer"].startswith(" one")


def test_turn_logs(spark, tmp_path):
    turn = {
        "duration_seconds": 2.5, "retry_overhead_seconds": 0.5,
        "query_result": {"metadata": {"cost": {"total": 0.25}, "in_tokens": 10, "out_tokens": 4, "cache_read_tokens": 1}},
        "tool_call_records": [{"tool_call": {"name": "search", "args": "{}"}, "duration_seconds": 1.0, "success": True}],
    }
    for n in (1, 2):
        dump(tmp_path / "m" / "run" / "q001" / "turns" / f"turn_00{n}" / "result.json", turn)
    logs = readers.turn_logs(spark, str(tmp_path / "m" / "run" / "q001" / "turns" / "*" / "result.json"))
    flat = telemetry.flat_turns(logs)
    r = telemetry.turn_totals(flat, ["model", "run", "question"]).first()
    assert (r["model"], r["run"], r["question"], r["turns"], r["duration_seconds"], r["in_tokens"], r["cost_total"]) == ("m", "run", "q001", 2, 5.0, 20, 0.5)
    t = telemetry.tool_totals(flat, ["model"]).first()
    assert (t["name"], t["calls"], t["failures"], t["tool_seconds"]) == ("search", 2, 0, 2.0)


def test_turn_log_tree_with_colons(spark, tmp_path):
    turn = {"duration_seconds": 1.5, "query_result": {"metadata": {"in_tokens": 7}}}
    for model in ("a:free", "b", "ü: x"):
        for q in ("q001", "q:2"):
            dump(tmp_path / "logs" / model / "2026-06-09_15-40-04" / q / "turns" / "turn_001" / "result.json", turn)
    (tmp_path / "logs" / "b" / "2026-06-09_15-40-04" / "q001" / "turns" / "turn_001" / "other.json").write_text("[]")
    bad = tmp_path / "logs" / "b" / "r" / "q" / "turns" / "t"
    bad.mkdir(parents=True)
    (bad / "result.json").write_text("{not json")
    logs = readers.turn_log_tree(spark, str(tmp_path / "logs"))
    rows = {(r["model"], r["run"], r["question"], r["turn"], r["duration_seconds"]) for r in logs.collect()}
    good = {(m, "2026-06-09_15-40-04", q, "turn_001", 1.5) for m in ("a:free", "b", "ü: x") for q in ("q001", "q:2")}
    assert rows == good | {("b", "r", "q", "t", None)}
    files = spark.read.format("folder_tree").option("files", 2).load(str(tmp_path / "logs"))
    assert files.rdd.getNumPartitions() == 4 and files.count() == 8
    with pytest.raises(Exception, match="no folder"):
        readers.turn_log_tree(spark, str(tmp_path / "none")).count()


def test_dead_letters(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad")], "id int, error string")
    writers.with_dead_letters(df, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).columns == ["id"]
    assert spark.read.json(str(tmp_path / "bad")).first()["error"] == "bad"


def test_dates_and_routes(spark):
    rows = [("2026-03-25", "2026-03-31"), ("2026-1-1", "2026-02-02"), ("2025-05-05", "2025-05-04"), ("2024-01-01", "2027-01-01"), (None, "2024-01-01")]
    df = spark.createDataFrame(rows, "s string, e string").select(*search.clamped_range(F.col("s"), F.col("e")))
    assert [tuple(r) for r in df.collect()] == [
        ("2026-03-01", "2026-03-01", None), (None, None, "invalid date format"), (None, None, "start is later than end"),
        ("2024-01-01", "2026-03-01", None), (None, None, "invalid date format"),
    ]
    with pytest.raises(ValueError):
        search.checked_range("2025-05-05", "2025-05-04")


def test_text_search_is_by_whole_word(spark):
    df = spark.createDataFrame([("Launch of Lander-2, net loss",), ("landers lost",), ("the NET  loss",)], "t string")
    hit = lambda **k: [r[0] for r in df.select(search.text_matches(F.col("t"), **k)).collect()]
    assert hit(all_of=["lander"]) == [True, False, False]
    assert hit(prefixes=["lander"]) == [True, True, False]
    assert hit(phrases=["net loss"]) == [True, False, True]
    assert hit(none_of=["lost"], any_of=["landers", "the"]) == [False, False, True]


def test_bars_as_text(spark):
    df = spark.createDataFrame([("s", "2024-01-02T00:00:00Z", 1.5, None, None), ("s", "2024-01-03", 2.0, 7.0, None)], "symbol string, date string, open double, volume double, divCash double")
    out = prices.as_text(df)
    assert out.columns == ["date", "open", "volume"]
    assert sorted(tuple(r) for r in out.collect()) == [("2024-01-02", "1.5", "N/A"), ("2024-01-03", "2.0", "7.0")]


def test_proportional_sample(spark):
    for n, cap in ((10, 3), (7, 7), (100, 33), (2001, 2000), (5, 9)):
        df = spark.range(n).select(F.lit("d").alias("k"), F.col("id").cast("int").alias("chunk_idx"))
        got = sorted(r["chunk_idx"] for r in index.proportional_sample(df, "k", cap).collect())
        step = n / cap
        assert got == (list(range(n)) if n <= cap else [int(i * step) for i in range(cap)])


def test_sections_carry_over_buckets(spark):
    rows = [("d", i, "BUSINESS\nx" if i in (5, 4100, 9000) else ("Dilution" if i == 4095 else f"t{i}")) for i in range(9010)]
    df = spark.createDataFrame(rows, "k string, block_idx int, text string")
    got = {r["block_idx"]: r["section"] for r in index.sectioned(df, "k").collect()}
    section, want = "PREAMBLE", {}
    for _, i, t in rows:
        if t.startswith("BUSINESS") or t == "Dilution":
            section = t.upper()
        else:
            want[i] = section
    assert got == want


PARA = "<p>" + "word " * 30 + "{}</p>"


def page(n, head="RISK FACTORS AND OTHER LONG HEADINGS OF THE FILING"):
    body = "".join(PARA.format(i) for i in range(n))
    return f"<html><body><h1>FORM 10-K</h1><h2>{head}</h2>{body}</body></html>"


def test_index_of_pages(spark):
    rows = [(1, "http://a", page(3)), (2, "http://a", page(9)), (3, "http://b", page(900)), (4, "http://c", page(1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    done = pages.where("page_id = 4").select(index.url_key(F.col("url")).alias("url_key"))
    contexts = lambda c: c.select("url_key", "chunk_idx", F.when(F.col("chunk_idx") < 40, "about it").alias("prefix"))
    out = build_index(pages, done, contexts)
    by_url = {r["url"]: r["url_key"] for r in out["texts"].collect()}
    assert set(by_url) == {"http://a", "http://b"}
    chunks = out["chunks"].collect()
    big = [c for c in chunks if c["url_key"] == by_url["http://b"]]
    assert len(big) >= 50 and all("[SECTION: PREAMBLE]" in c["text"] or "word" in c["text"] for c in big)
    assert all(c["filing_type"].startswith("Form 10-K") for c in chunks)
    small = [c for c in chunks if c["url_key"] == by_url["http://a"]]
    assert small and any("[SECTION" in c["text"] for c in small)
    publish = {r["url_key"]: r["publish"] for r in out["publish"].collect()}
    assert publish[by_url["http://a"]] and publish[by_url["http://b"]] == (len(big) <= 80)


def test_incremental_ingest(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    put = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(landing)
    put([(1, "http://a", page(2)), (2, "http://b", page(2))])
    ingest(spark, landing, out, ckpt).awaitTermination()
    put([(3, "http://b", page(5)), (4, "http://c", page(2))])
    ingest(spark, landing, out, ckpt).awaitTermination()
    texts = spark.read.parquet(out + "/texts")
    assert sorted(r["url"] for r in texts.collect()) == ["http://a", "http://b", "http://c"]
    assert {r["batch"] for r in texts.select("batch").distinct().collect()} == {0, 1}
    assert spark.read.parquet(out + "/chunks").select("url_key").distinct().count() == 3
    strict = str(tmp_path / "strict")
    none = lambda c: c.select("url_key", "chunk_idx", F.lit("").alias("prefix"))
    ingest(spark, landing, strict, str(tmp_path / "ckpt2"), none).awaitTermination()
    assert spark.read.parquet(strict + "/quarantine").count() > 0
    assert spark.read.parquet(strict + "/texts").count() == 0
    # Pages that were held back are taken up again, whether they land again or not.
    put([(5, "http://a", page(2))])
    every = lambda c: c.select("url_key", "chunk_idx", F.lit("about it").alias("prefix"))
    ingest(spark, landing, strict, str(tmp_path / "ckpt2"), every).awaitTermination()
    assert sorted(r["url"] for r in spark.read.parquet(strict + "/texts").collect()) == ["http://a", "http://b", "http://c"]
    assert spark.read.parquet(strict + "/postings").count() > 0


def test_waiting_pages_are_published_without_landing_again(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / d) for d in ("in", "out", "ckpt"))
    put = lambda rows: spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.mode("append").parquet(landing)
    texts = lambda: sorted((r["url"], r["batch"]) for r in spark.read.parquet(out + "/texts").collect())
    none = lambda c: c.select("url_key", "chunk_idx", F.lit("").alias("prefix"))
    only = lambda *urls: lambda c: c.join(spark.createDataFrame([(u,) for u in urls], "u string").select(index.url_key(F.col("u")).alias("url_key")), "url_key", "left_semi").select(
        "url_key", "chunk_idx", F.lit("about it").alias("prefix")
    )
    put([(1, "http://a", page(2)), (2, "http://b", page(2))])
    ingest(spark, landing, out, ckpt, none).awaitTermination()
    assert texts() == [] and waiting_pages(spark, out).count() == 2
    # A run without new files publishes the page whose prefixes suffice now.
    ingest(spark, landing, out, ckpt, only("http://a")).awaitTermination()
    assert texts() == [("http://a", -1)]
    # A waiting page that lands again counts as it landed last, and once.
    put([(3, "http://b", page(5)), (4, "http://c", page(2))])
    ingest(spark, landing, out, ckpt, only("http://c")).awaitTermination()
    assert texts() == [("http://a", -1), ("http://c", 1)]
    assert [r["page_id"] for r in waiting_pages(spark, out).collect()] == [3]
    ingest(spark, landing, out, ckpt, only("http://b", "http://c")).awaitTermination()
    assert texts() == [("http://a", -1), ("http://b", -2), ("http://c", 1)]
    assert waiting_pages(spark, out).count() == 0
    ingest(spark, landing, out, ckpt, only("http://b")).awaitTermination()
    assert len(texts()) == 3
    assert spark.read.parquet(out + "/chunks").select("url_key").distinct().count() == 3


def test_the_context_step_is_asked_once(spark):
    pages = spark.createDataFrame([(1, "http://a", page(400))], "page_id long, url string, html string")
    wavering = lambda c: c.select("url_key", "chunk_idx", F.when(F.rand() < 0.5, "about it").alias("prefix"))
    out = build_index(pages, contexts=wavering)
    counts = {out["chunks"].where("prefix <> ''").count() for _ in range(2)} | {out["publish"].first()["prefixed"]}
    assert len(counts) == 1


def test_long_pages_keep_all_chunks(spark):
    pages = spark.createDataFrame([(1, "http://a", page(30_000))], "page_id long, url string, html string")
    out = build_index(pages)["chunks"].agg(F.count("*").alias("n"), F.max("text").alias("t")).first()
    assert out["n"] > 2000
    text = build_index(pages)["chunks"].where(F.col("text").contains("29999")).count()
    assert text > 0


def test_answers_of_any_form(spark, tmp_path):
    dump(tmp_path / "list.json", [{"question": "a", "success": True, "answer": "x"}, {"question": "b", "success": True, "answer": "y"}])
    (tmp_path / "one.txt").write_text("\nfree text\nanswer", encoding="utf-8")
    rows = lambda *a, **k: [tuple(r) for r in readers.any_answers(spark, *a, **k).collect()]
    assert sorted(rows(str(tmp_path / "list.json"), "q")) == [("a", "x"), ("b", "y")]
    assert rows(str(tmp_path / "one.txt"), "q") == [("q", "\nfree text\nanswer")]
    assert rows("inline", "q", is_path=False) == [("q", "inline")]


def test_labels_inside_the_row_equal_the_block_table(spark):
    import random

    rnd = random.Random(11)
    long = ["".join(rnd.choices("abcdef ", k=600)) + str(i) for i in range(4)]

    def block():
        kind = rnd.random()
        if kind < 0.15:
            return rnd.choice(["risk factors\n", "MD&A\n", "Dilution\n"]) + "x" * 40
        if kind < 0.5:
            return rnd.choice(long)
        return "short " * rnd.randrange(1, 12)

    pages = [(n, [("p", block()) for _ in range(rnd.randrange(0, 40))]) for n in range(60)]
    parsed = spark.createDataFrame(pages, "page_id long, blocks array<struct<tag string, text string>>")
    rows = index.long_enough(index.block_rows(parsed, "page_id"))
    clean = index.without_repeats(index.sectioned(rows, "page_id"), "page_id").collect()
    want = {n: "" for n, _ in pages}
    for r in sorted(clean, key=lambda r: (r["page_id"], r["block_idx"])):
        label = f"[SECTION: {r['section']}]\n{r['text']}"
        want[r["page_id"]] += ("\n\n" if want[r["page_id"]] else "") + label
    got = {r["page_id"]: r["text"] for r in index.labelled_text(parsed).select("page_id", "text").collect()}
    assert got == want


def test_keyed_rubrics(spark, tmp_path):
    dump(tmp_path / "r.json", {"a": {"question": "q1", "rubric": {"critical": ["x"]}}, "b": {"question": "q2"}})
    rows = {r["question"]: r for r in readers.keyed_rubrics(spark, str(tmp_path / "r.json")).collect()}
    assert set(rows) == {"q1", "q2"} and rows["q1"]["rubric"]["critical"] == ["x"] and rows["q2"]["rubric"] is None
    (tmp_path / "bad.json").write_text("not json")
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.keyed_rubrics(spark, str(tmp_path / "bad.json")).collect()


def test_question_lists_drop_all_white_space(spark, tmp_path):
    (tmp_path / "q.txt").write_text("\tone \n \t\n\ntwo\n")
    assert [r["question"] for r in readers.questions(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]


def test_adjacent_repeats_move_the_blocks_once(spark):
    """Positions over a bucket's edge, missing and repeated ones, and documents without a key."""
    rows = [(1, i, "ab"[i // 2 % 2]) for i in range(4090, 4102)] + [(2, 0, "x"), (2, 0, "y"), (2, 1, "x"), (2, 3, "x"), (None, 0, "x"), (None, 1, "x"), (3, 0, None), (3, 1, None), (3, 2, "x"), (3, 3, None)]
    blocks = spark.createDataFrame(rows, "doc long, block_idx int, text string")
    out = index.without_adjacent_repeats(blocks, "doc")
    want = []
    for d, i, t in rows:
        before = [b for e, j, b in rows if d is not None and e == d and j == i - 1]
        want += [(d, i, t)] * (sum(b is None or (t is not None and b != t) for b in before) if before else 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_the_page_index_takes_every_step(spark, tmp_path, monkeypatch):
    """Pages with few chunks are split from their plain text; chunks carry the sample and the gate."""
    from rubricon.catalog import QUERIES

    bare = "<html><body>only " + "loose words " * 30 + "</body></html>"
    rows = [(1, "http://a", page(3)), (2, "http://b", page(900)), (3, "http://c", bare)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    monkeypatch.setattr(index, "CHUNK_CAP", 7)
    key = dict(spark.createDataFrame(rows, "page_id long, url string, html string").select("url", index.url_key(F.col("url"))).collect())
    chunks = QUERIES["page_index"](spark, str(tmp_path)).collect()
    of = {url: sorted((c for c in chunks if c["url_key"] == k), key=lambda c: c["chunk_idx"]) for url, k in key.items()}
    # The heading is too short for a block, the loose words are in none.
    assert len(of["http://a"]) == 1 and "FORM 10-K" in of["http://a"][0]["text"] and "[SECTION" not in of["http://a"][0]["text"]
    assert [c["text"].split()[:2] for c in of["http://c"]] == [["only", "loose"]]
    big = of["http://b"]
    assert len(big) >= 50 and big[0]["text"].startswith("[SECTION")
    assert [c["chunk_idx"] for c in big if c["sampled"]] == [int(i * (len(big) / 7)) for i in range(7)]
    assert of["http://a"][0]["sampled"] and not any(c["publish"] for c in chunks)
    prefixed = build_index(spark.read.parquet(str(tmp_path / "pages.parquet")), contexts=lambda c: c.where("chunk_idx < 1").selectExpr("url_key", "chunk_idx", "'p' AS prefix"))
    assert {r["url_key"] for r in prefixed["chunks"].where("publish").collect()} == {key["http://a"]}
