import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from rubricon.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    return langid.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def test_held_out_accuracy(spark, trained):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = langid.predicted(docs, trained).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98


def test_repeated_rows_stay_within_the_bound(spark, monkeypatch):
    rows = [(i, f"text number {i} of many", "en" if i % 2 else "de") for i in range(60)] + [(7, "the same text", "en")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    given = []
    monkeypatch.setattr(langid, "fit", lambda rows, languages, idf: given.append((rows, languages)))
    langid.train(docs, rows_per_language=12)
    (rows, languages), = given
    assert languages == ["de", "en"]
    assert [sum(r[0] == k for r in rows) for k in (0, 1)] == [12, 12]
    assert len({(r[1].tobytes(), r[2].tobytes()) for r in rows}) == 24


def naive_ftrl(rows, k, idf, alpha=0.5, beta=1.0, l1=0.02, l2=0.01, epochs=3):
    """One weight at a time in dictionaries, from the algorithm's definition."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= l1:
            return 0.0
        return (math.copysign(l1, z[key]) - z[key]) / ((beta + math.sqrt(n[key])) / alpha + l2)

    learnt = [r for i, r in enumerate(rows) if i % 5]
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(learnt)):
            y, at, count = learnt[i]
            tfidf = {int(f): (1 + math.log(c)) * idf[f] for f, c in zip(at, count)}
            norm = math.sqrt(sum(v * v for v in tfidf.values()))
            x = {f: v / norm for f, v in tfidf.items()} | {"bias": 1.0}
            w = {(f, c): weight((f, c)) for f in x for c in range(k)}
            score = [sum(v * w[f, c] for f, v in x.items()) for c in range(k)]
            total = sum(math.exp(s) for s in score)
            for f, v in x.items():
                for c in range(k):
                    g = v * (math.exp(score[c]) / total - (c == y))
                    z[f, c] += g - (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / alpha * w[f, c]
                    n[f, c] += g * g
    return {key: weight(key) for key in list(z)}


def test_weights_equal_the_naive_algorithm():
    texts = [("ein kleiner hund", 0), ("a little dog", 1), ("un chien petit", 2)] * 9
    rows = [(y, *langid.ngram_counts(t + " " + "xyz"[i % 3] * (i % 4))) for i, (t, y) in enumerate(texts)]
    df = np.bincount(np.concatenate([r[1] for r in rows]), minlength=langid.FEATURES)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    model = langid.fit(rows, ["de", "en", "fr"], idf)
    want = naive_ftrl(rows, 3, idf)
    assert len(want) > 100
    for (f, c), w in want.items():
        assert (model.bias[c] if f == "bias" else model.weights[f, c]) == pytest.approx(w, abs=1e-9)


def test_weights_are_sparse(trained):
    assert (trained.weights == 0).mean() > 0.3


def test_slices_count_the_same(monkeypatch):
    text = "Straße und Mädchen, ñandú! " * 50
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "_SLICE", 37)
    assert all((a == b).all() for a, b in zip(whole, langid.ngram_counts(text)))


def test_odd_rows(documents, odd_rows, trained):
    rows = langid.predicted(documents(odd_rows), trained).collect()
    assert len(rows) == len(odd_rows)
    unknown = {r.doc_id for r in rows if r.lang_pred == langid.UNKNOWN}
    assert unknown == {1, 2, 3, 14}


def test_nothing_to_learn_from(spark, documents):
    none = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert langid.train(none) is None
    assert [r.lang_pred for r in langid.predicted(documents([(1, "text")]), None).collect()] == ["und"]
    assert langid.predicted(documents([]), None).collect() == []
