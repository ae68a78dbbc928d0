import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rubricon.operators import grouping, retrieval

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus(rnd, n, scopes):
    return [(rnd.choice(scopes), i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 12)))) for i in range(n)]


def bm25(docs, query):
    """Scores of ``query`` over one corpus of token lists."""
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    weight = {t: (0.25 * mean if v < 0 else v) for t, v in idf.items()}
    return [
        sum(
            weight.get(t, 0.0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
            for t in query
        )
        for d in docs
    ]


def test_lexical_channel_equals_brute_force(spark):
    rnd = random.Random(5)
    docs = corpus(rnd, 120, ["a", "b", "c"])
    queries = [(rnd.choice(["a", "b"]), q, " ".join(rnd.choices(WORDS + ["Unknown"], k=4))) for q in range(12)]
    queries.append(("a", 99, "nothing matches"))
    c = spark.createDataFrame(docs, "scope string, chunk_id long, text string")
    q = spark.createDataFrame(queries, "scope string, query_id long, text string")
    for k in (10, 60):
        got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.lexical_channel(c, q, "scope", k).collect()}
        want = {}
        for scope, qid, text in queries:
            mine = [d for d in docs if d[0] == scope]
            scores = bm25([d[2].split() for d in mine], text.lower().split())
            top = sorted(zip(scores, mine), key=lambda x: (-round(x[0], 9), -x[1][1]))[:k]
            for rank, (s, d) in enumerate(top):
                want[(qid, rank)] = (d[1], s)
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(abs(got[k][1] - want[k][1]) < 1e-8 for k in want)


def test_tables_of_an_index_give_the_same_ranks(spark):
    rnd = random.Random(12)
    c = spark.createDataFrame(corpus(rnd, 60, ["a", "b"]), "scope string, chunk_id long, text string")
    q = spark.createDataFrame([("a", 1, "alpha beta beta"), ("b", 2, "iota")], "scope string, query_id long, text string")
    tables = retrieval.lexical_tables(c, "scope")
    rows = lambda c, **k: sorted(map(tuple, retrieval.lexical_channel(c, q, "scope", 9, **k).collect()))
    # With tables, only the ids of the chunks are read.
    assert rows(c.withColumn("text", F.lit("")), tables=tables) == rows(c)


def common_corpus(rnd, n):
    """One scope in which a third of the chunks has a stop word, and some chunks rare words."""
    rare = [f"rare{i}" for i in range(n // 20)]
    return [("hot", i, " ".join(rnd.choices(WORDS, k=rnd.randrange(1, 12)) + ["the"] * (i % 3 == 0) + rnd.choices(rare, k=2))) for i in range(n)]


def test_bounds_leave_the_ranks_as_they_are(spark, monkeypatch):
    """With small blocks and few rare terms, every way of skipping is taken."""
    monkeypatch.setattr(retrieval, "BLOCK_IDS", 4)
    monkeypatch.setattr(retrieval, "RARE_CHUNKS", 60)
    rnd = random.Random(15)
    docs = common_corpus(rnd, 900)
    queries = [("hot", q, " ".join(rnd.choices(WORDS + ["the"], k=rnd.randrange(1, 4)) + [f"rare{rnd.randrange(50)}" for _ in range(rnd.randrange(4))])) for q in range(25)]
    c = spark.createDataFrame(docs, "scope string, chunk_id long, text string")
    q = spark.createDataFrame(queries, "scope string, query_id long, text string")
    got = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in retrieval.lexical_channel(c, q, "scope", 12).collect()}
    split = [d[2].split() for d in docs]
    for _, qid, text in queries:
        top = sorted(((round(s, 9), i) for i, s in enumerate(bm25(split, text.split()))), reverse=True)[:12]
        assert [got[qid, r][0] for r in range(12)] == [i for _, i in top]
        assert all(abs(got[qid, r][1] - s) < 1e-8 for r, (s, _) in enumerate(top))


def test_a_stop_word_is_not_read_whole(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "RARE_CHUNKS", 200)
    monkeypatch.setattr(retrieval, "BLOCK_IDS", 128)
    rnd = random.Random(16)
    c = spark.createDataFrame(common_corpus(rnd, 6000), "scope string, chunk_id long, text string")
    q = spark.createDataFrame([("hot", 1, "the rare7 rare8")], "scope string, query_id long, text string")
    tables = retrieval.lexical_tables(c, "scope")
    assert tables["terms"].where("term = 'the'").first()["df"] == 2000
    read, parts = [], retrieval._parts
    monkeypatch.setattr(retrieval, "_parts", lambda *a: read.append(parts(*a)) or read[-1])
    retrieval.lexical_channel(c, q, "scope", 10, tables).collect()
    rare = tables["terms"].where("term in ('rare7', 'rare8')").groupBy().sum("df").first()[0]
    # Twice the rare terms, and the head blocks of the stop word.
    heads = retrieval.HEAD_BLOCKS * retrieval.BLOCK_IDS // 2
    assert sum(r.count() for r in read) <= 2 * rare + heads < 1000


def test_lexical_channel_runs_in_the_jvm(spark):
    c = spark.createDataFrame([("a", 1, "alpha beta")], "scope string, chunk_id long, text string")
    q = spark.createDataFrame([("a", 1, "alpha")], "scope string, query_id long, text string")
    plan = retrieval.lexical_channel(c, q, "scope")._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_dense_channel_keeps_to_the_scope(spark):
    v = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 0, [9.0, 0.0]), ("b", 1, [1.0, 1.0])], "doc string, chunk_id long, vector array<float>")
    q = spark.createDataFrame([("a", 7, [1.0, 0.0]), ("b", 8, [0.0, 1.0]), ("c", 9, [1.0, 1.0])], "doc string, query_id long, vector array<double>")
    got = {(r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in retrieval.dense_channel(v, q, scope="doc").collect()}
    assert got == {(7, 0, 0, 1.0), (8, 0, 1, 1.0), (8, 1, 0, 0.0)}


def test_dense_channel_equals_brute_force(spark, monkeypatch):
    rnd = np.random.default_rng(6)
    v = rnd.normal(size=(200, 8)).astype(np.float32)
    v[50] = v[10]
    q = rnd.normal(size=(9, 8))
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<float>").repartition(5)
    qs = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    for sizes in ((65_536, 512, 4_096), (64, 2, 5)):
        for name, size in zip(("BLOCK_VECTORS", "BLOCK_QUERIES", "PRODUCT_ROWS"), sizes):
            monkeypatch.setattr(retrieval, name, size)
        got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.dense_channel(vec, qs, 15).collect()}
        want = {}
        for i, x in enumerate(q):
            s = np.round(v.astype(np.float64) @ x, 9)
            for rank, c in enumerate(sorted(range(200), key=lambda c: (-s[c], -c))[:15]):
                want[(i, rank)] = c
        assert got == want


def test_dense_channel_is_dealt_to_blocks(spark, monkeypatch):
    """One scope holds nearly all vectors and queries; no task gets all of either."""
    monkeypatch.setattr(retrieval, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(retrieval, "BLOCK_QUERIES", 10)
    vec = spark.range(1000).selectExpr("'hot' AS s", "id AS chunk_id", "array(cast(id AS float), 1.0f) AS vector")
    qs = spark.range(40).selectExpr("'hot' AS s", "id AS query_id", "array(cast(id % 3 - 1 AS double), 1.0D) AS vector")
    offered = []
    monkeypatch.setattr(retrieval, "_ranked", lambda found, k: offered.append(found) or found)
    retrieval.dense_channel(vec, qs, 5, "s")
    cells = offered[0].groupBy("query_id").count().collect()
    # Each of 20 row blocks answers each query with its five best.
    assert len(cells) == 40 and all(60 <= r["count"] <= 100 for r in cells)


def test_small_norms_are_skipped_and_nothing_is_lost(spark):
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(900, 4)) * np.geomspace(1, 1e-6, 900)[:, None]
    block = retrieval._Block([pa.record_batch([pa.nulls(2)] * 3 + [pa.array([0, 1]), pa.nulls(2), pa.array([[1.0, 0, 0, 0], [0, 1.0, 1, 0]])], list("abcdef"))], 7)
    products = []
    keep = block._keep
    block._keep = lambda q, s, i: products.append(len(q)) or keep(q, s, i)
    for at in range(0, 900, 100):
        ids = pa.array(np.arange(at, at + 100))
        block.offer(pa.record_batch([pa.nulls(100)] * 4 + [ids, pa.array(v[at : at + 100].tolist())], list("abcdef")))
    assert sum(products) < 18
    want = np.round(v @ np.array([[1.0, 0, 0, 0], [0, 1.0, 1, 0]]).T, 9)
    for q in range(2):
        best = sorted(range(900), key=lambda i: (-want[i, q], -i))[:7]
        assert block.found[block.place == q].tolist() == best


def test_verbatim_hits_equal_brute_force(spark):
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abAB-1é") for _ in range(rnd.randrange(1, 9)))
    text = lambda n: "".join(word() + rnd.choice([" ", " ", "  ", "\n", "\t", "\u2003"]) for _ in range(n))
    docs = [(rnd.choice("xyz"), i, text(rnd.randrange(25))) for i in range(150)]
    queries = [(rnd.choice("xyw"), q, text(5) + '"' + rnd.choice([docs[q][2][3:15], "  ", "   ", " a ", "\n\t "]) + '" ' + docs[q][2][:30]) for q in range(60)]
    c = spark.createDataFrame(docs, "scope string, chunk_id long, text string")
    q = spark.createDataFrame(queries, "scope string, query_id long, text string")
    terms = {r[0]: r[1] for r in q.select("query_id", retrieval.exact_terms(F.col("text"))).collect()}
    want = {}
    for scope, query, _ in queries:
        for s, chunk, t in docs:
            n = sum(term in t.lower() for term in terms[query]) if s == scope else 0
            if n:
                want[query, chunk] = n
    hits = retrieval.verbatim_hits(c, q, "scope")
    assert {(r["query_id"], r["chunk_id"]): r["hits"] for r in hits.collect()} == want
    assert any(" " in t or not t.strip() for ts in terms.values() for t in ts)
    plan = hits._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "Arrow" not in plan


def test_verbatim_hits_count_case_variants_twice(spark):
    c = spark.createDataFrame([("d", 0, "the Q3-2024 note on EBITDA"), ("d", 1, "ebitda only"), ("x", 2, "EBITDA")], "scope string, chunk_id long, text string")
    q = spark.createDataFrame([("d", 7, 'EBITDA Ebitda Q3-2024 "note on"')], "scope string, query_id long, text string")
    got = {(r["chunk_id"]): (r["hits"], r["rank"]) for r in retrieval.verbatim_channel(c, q, "scope").collect()}
    assert got == {0: (4, 0), 1: (2, 1)}


def test_passages_of_hand_made_lists(spark):
    lists = {
        1: ([6, 5, 7], {0: [6, 7], 1: [5, 6, 7]}, {5: [5, 6, 7]}),
        2: ([3, 9, 4, 1], {0: [3, 4], 1: [9], 3: [1]}, {1: [1], 3: [3, 4], 9: [9]}),
        3: ([2], {0: [2]}, {2: [2]}),
    }
    rows = [(q, c, r) for q, (order, _, _) in lists.items() for r, c in enumerate(order)]
    top = spark.createDataFrame(rows, "query_id long, chunk_idx long, rerank_rank int")
    for document_order in (False, True):
        got = {}
        for r in retrieval.passages(top, document_order).collect():
            got.setdefault(r["query_id"], {}).setdefault(r["passage_rank"], []).append(r["chunk_idx"])
        for q, (_, by_rank, by_place) in lists.items():
            assert {k: sorted(v) for k, v in got[q].items()} == (by_place if document_order else by_rank)


def test_passages_are_maximal_runs_from_uncovered_chunks(spark):
    rnd = random.Random(7)
    lists = {q: rnd.sample(range(14), rnd.randrange(1, 12)) for q in range(150)}
    rows = [(q, c, r) for q, order in lists.items() for r, c in enumerate(order)]
    top = spark.createDataFrame(rows, "query_id long, chunk_idx long, rerank_rank int")
    found = {}
    for r in retrieval.passages(top).collect():
        found.setdefault((r["query_id"], r["passage_rank"]), set()).add(r["chunk_idx"])
    for q, order in lists.items():
        ranks = sorted(r for p, r in found if p == q)
        assert set().union(*(found[q, r] for r in ranks)) == set(order)
        for rank in ranks:
            run = found[q, rank]
            # It starts at the chunk of its rank, has no gap, and cannot go on.
            assert min(run) == order[rank] and len(run) == max(run) - min(run) + 1 and max(run) + 1 not in order
            assert all(order[rank] not in found[q, r] for r in ranks if r < rank)


def test_from_pages_to_context(spark):
    from rubricon.plans.build_index import build_index
    from rubricon.plans.retrieve import retrieve_from_index

    para = "<p>" + "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 3 + "{}</p>"
    page = lambda word, n: "<html><body>" + "".join(para.format(f"{word} item {i}") for i in range(n)) + "</body></html>"
    pages = spark.createDataFrame([(1, "http://a", page("ants", 30)), (2, "http://b", page("bees", 30))], "page_id long, url string, html string")
    built = build_index(pages)
    keys = {r["url"]: r["url_key"] for r in built["texts"].collect()}
    vectors = built["chunks"].select("url_key", "chunk_idx", F.array(F.lit(1.0), F.col("chunk_idx").cast("double")).alias("vector"))
    queries = spark.createDataFrame([(keys["http://a"], 1, "ants 7"), (keys["http://b"], 2, "Bees-like 9")], "url_key string, query_id long, text string")
    query_vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "query_id long, vector array<double>")
    score = lambda c: c.select("query_id", "chunk_id", (-F.col("fused_rank")).cast("double").alias("rerank_score"))
    out = {r["query_id"]: r["context"] for r in retrieve_from_index(built, queries, vectors, query_vectors, score).collect()}
    assert "ants item 7" in out[1] and "bees" not in out[1]
    assert "bees item 9" in out[2] and "ants" not in out[2]


def test_fusion_adds_channels_and_breaks_ties_by_channel(spark):
    one = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "query_id long, chunk_id long, rank int")
    two = spark.createDataFrame([(1, 12, 0), (1, 11, 1)], "query_id long, chunk_id long, rank int")
    got = [(r["chunk_id"], round(r["rrf"], 9)) for r in retrieval.fuse([one, two]).orderBy("fused_rank").collect()]
    assert got == [(11, round(2 / 61, 9)), (10, round(1 / 60, 9)), (12, round(1 / 60, 9))]


def test_context_text(spark):
    p = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (1, 3, 1)], "query_id long, passage_rank int, chunk_idx long")
    c = spark.createDataFrame([(1, "one"), (5, "five"), (6, "six")], "chunk_idx long, text string")
    got = retrieval.context_text(p, c, ["chunk_idx"]).first()["context"]
    assert got == "five\n[Contiguous Block Extension]\nsix\n\n[... Structural Fragment Break ...]\n\none"


def test_jvm_dot_product(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "vector array<float>, query_vector array<double>")
    assert retrieval.dense_scores(df).select(F.col("score")).first()[0] == 11.0


def test_terms_are_counted_where_the_texts_are_read(spark):
    rows = [("a", 1, "x y X  z"), ("a", 2, None), ("a", 3, " "), ("b", 1, "y"), ("b", 4, "q Q q")]
    table = lambda r: spark.createDataFrame(r, "scope string, chunk_id long, text string")
    keys = ["scope", "chunk_id"]
    got = retrieval._counts(table(rows), keys)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    known = lambda df: sorted((tuple(r) for r in df.select(*keys, "term", "tf").collect()), key=str)
    for more in ([], [("b", 4, "q r"), ("b", 4, "q"), (None, 7, "n n"), (None, 7, "n"), ("b", None, "o"), ("b", None, "o")]):
        assert known(retrieval._counts(table(rows + more), keys)) == known(retrieval.postings(table(rows + more), keys))
    lens = {r["len"] for r in retrieval._counts(table(rows), keys).where("chunk_id = 1 and scope = 'a'").collect()}
    assert lens == {4}


def test_few_query_terms_go_to_the_postings(spark, monkeypatch):
    """Whatever Spark believes of table sizes, no posting is moved to meet the terms."""
    monkeypatch.setattr(retrieval, "RARE_CHUNKS", 30)
    monkeypatch.setattr(retrieval, "BLOCK_IDS", 64)
    rnd = random.Random(21)
    c = spark.createDataFrame(common_corpus(rnd, 600), "scope string, chunk_id long, text string")
    q = spark.createDataFrame([("hot", 1, "the rare7 rare8"), ("hot", 2, "alpha the")], "scope string, query_id long, text string")
    read, parts = [], retrieval._parts
    monkeypatch.setattr(retrieval, "_parts", lambda *a: read.append(parts(*a)) or read[-1])
    ranks = lambda: sorted(map(tuple, retrieval.lexical_channel(c, q, "scope", 10).collect()))
    want = ranks()
    read.clear()
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        assert ranks() == want and read
        for df in read:
            assert "SortMergeJoin [scope" not in df._jdf.queryExecution().toString()
        # More terms than a lookup may have meet the postings in a join that moves both.
        monkeypatch.setattr(grouping, "LOOKUP_ROWS", 0)
        monkeypatch.setattr(retrieval, "LOOKUP_ROWS", 0)
        assert ranks() == want
    finally:
        spark.conf.set(key, before)


def test_a_filter_of_terms_loses_none(spark, monkeypatch):
    rows = spark.createDataFrame([(f"t{i}", i) for i in range(3000)] + [(None, -1)], "term string, n long")
    wanted = spark.createDataFrame([(f"t{i}",) for i in range(0, 3000, 100)] * 2 + [(None,)], "term string")
    for bits, most in ((1 << 24, 40), (64, 3000)):
        monkeypatch.setattr(grouping, "FILTER_BITS", bits)
        got = grouping.maybe_in(rows, "term", wanted).where("term is not null")
        found = sorted(r["n"] for r in got.collect())
        assert set(range(0, 3000, 100)) <= set(found) and len(found) == len(set(found)) <= most
        assert got.columns == rows.columns


def test_candidates_are_made_once_before_they_are_reranked(spark, tmp_path):
    from rubricon.catalog import QUERIES

    rnd = random.Random(22)
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    texts = [" ".join(rnd.choices(WORDS, k=8)) for _ in range(30)]
    put("documents", [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    put("benchmark", [(i, f"{t} Alpha") for i, t in enumerate(texts[:3])], "item_id long, text string")
    put("embeddings", [(i, [rnd.random() for _ in range(4)], 0) for i in range(30)], "vec_id long, embedding array<float>, label int")
    out = QUERIES["reranked_chunks"](spark, str(tmp_path))
    # The channels are not part of what ranks the candidates.
    assert "MapInArrow" not in out._jdf.queryExecution().toString()
    got = {q: [r["chunk_id"] for r in out.where(f"query_id = {q}").orderBy("rerank_rank").collect()] for q in range(3)}
    assert all(len(g) == retrieval.RERANK_K for g in got.values())
    sizes = [[round(1000.0 / len(texts[i]), 6) for i in g] for g in got.values()]
    assert all(s == sorted(s, reverse=True) for s in sizes)


def test_missing_vectors_come_last(spark):
    v = [(0, [1.0, 2.0]), (1, None), (2, [None, 3.0]), (3, []), (4, [5.0]), (5, [1.0, 1.0, 9.0])]
    q = [(7, [1.0, 1.0]), (8, None), (9, []), (None, [0.0, 1.0])]
    vectors = spark.createDataFrame(v, "chunk_id long, vector array<float>")
    queries = spark.createDataFrame(q, "query_id long, vector array<float>")
    got = {}
    for r in retrieval.dense_channel(vectors, queries, 10).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    gone, rest = [(3, None), (1, None)], [(5, None), (4, None), (2, None), (0, None)]
    assert got == {7: [(4, 5.0), (2, 3.0), (0, 3.0), (5, 2.0), *gone], 8: rest, 9: rest, None: [(2, 3.0), (0, 2.0), (5, 1.0), (4, 0.0), *gone]}
