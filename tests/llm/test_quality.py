import math
from zlib import crc32

import numpy as np
import pytest

from rubricon.llm import quality

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def trained(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    return quality.train(read("documents"), read("labels"))


def test_held_out_accuracy(spark, trained):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = quality.scored(spark.read.parquet(f"{FOLDER}/documents.parquet"), trained).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_learns_without_negatives():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal([3, 0, 0], 1, (1200, 3))
    model = quality.fit(good[:1500], np.concatenate([good[1500:], bad]), prior=2500 / 3700)
    raw = lambda x: model.raw(model.bins(x))
    assert np.mean(raw(good)) > np.mean(raw(bad)) + 1
    assert (raw(good)[:, None][:500] > raw(bad)[None, :500]).mean() > 0.9


def naive_risk(weights, bias, p, u, w, prior):
    """The two parts text by text, from the formula."""
    loss = lambda z: math.log1p(math.exp(-z))
    z = lambda bins: sum(weights[b] for b in bins) + bias
    seen = prior * sum(loss(z(t)) for t in p) / len(p)
    unseen = sum(n * loss(-z(t)) for t, n in zip(u, w)) / sum(w) - prior * sum(loss(-z(t)) for t in p) / len(p)
    return seen, unseen


@pytest.mark.parametrize("falls_below", [False, True])
def test_risk_and_gradient(falls_below):
    """Against the formula and its differences. Where the part for negatives is below zero, the step is
    to make it larger again."""
    rng = np.random.default_rng(4)
    p, u, w = rng.integers(0, 12, (9, 3)), rng.integers(0, 12, (14, 3)), rng.integers(1, 4, 14).astype(float)
    model = quality.Model(np.zeros((3, 3)), rng.normal(0, 1, 12), 0.3, 1.0, 0.0)
    if falls_below:
        u, w = p[np.argsort(model.raw(p))[:3]], np.ones(3)
    seen, unseen = naive_risk(model.weights, model.bias, p, u, w, 0.97)
    assert quality.risk(model, p, u, w, 0.97) == pytest.approx((seen, unseen))
    assert (unseen < 0) == falls_below
    value = lambda v: (lambda s, n: -n if falls_below else s + n)(*naive_risk(v[:-1], v[-1], p, u, w, 0.97))
    at, step = np.append(model.weights, model.bias), 1e-6
    slopes = [(value(at + step * e) - value(at - step * e)) / (2 * step) for e in np.eye(13)]
    assert quality.gradient(model, p, u, w, 0.97) == pytest.approx(slopes, abs=1e-6)


@pytest.mark.parametrize("prior", [0.3, 0.6, 0.85])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(1, 1, 20_000), rng.normal(-2, 1, 20_000)
    n = round(prior * 16_000)
    found = quality.estimated_prior(good[16_000:], np.concatenate([good[:n], bad[: 16_000 - n]]), np.ones(16_000))
    assert abs(found - prior) < 0.05


def test_prior_of_documents(spark):
    """It comes near the share among labels, which it does not see."""
    model = {}
    averaged = quality._averaged
    try:
        quality._averaged = lambda *a, **k: model.setdefault(len(model), averaged(*a, **k))
        quality.train(*(spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")))
    finally:
        quality._averaged = averaged
    assert abs(model[0][1] - 0.857) < 0.08


def test_repeated_rows_stay_within_the_bound(spark, documents, monkeypatch):
    """Copies of one document are one row that counts often, in one shard's fit too."""
    docs = documents([(i, f"Some text of {i}, plain and clear.") for i in range(40)] + [(4, "the same text again.")] * 5000)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 50, "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "calibrate", lambda model, x, y: seen.append(len(y)))
    averaged = quality._averaged
    monkeypatch.setattr(quality, "_averaged", lambda rows, *a, **k: seen.append((rows.count(), rows.groupBy().sum("w").first()[0])) or averaged(rows, *a, **k))
    learnt = [i for i in range(40) if crc32(str(i).encode()) % 4 != 2]
    quality.train(docs, labels, labelled_rows=10)
    copies = 4 in learnt
    assert seen[:-1] == [(len(learnt) + copies, len(learnt) + 5000 * copies)] * 2
    assert seen[-1] <= 10


def test_several_shards(spark):
    read = lambda t: spark.read.parquet(f"{FOLDER}/{t}.parquet")
    labels = {r.doc_id: r.quality for r in read("labels").collect()}
    rows = quality.scored(read("documents"), quality.train(read("documents"), read("labels"), shard_rows=200)).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93


def test_odd_rows(documents, odd_rows, trained):
    rows = quality.scored(documents(odd_rows), trained).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in odd_rows)
    assert all(np.isfinite(r.score) for r in rows)
    kept = quality.scored(documents(odd_rows), trained, carry=True).select("row.*")
    assert kept.columns == documents(odd_rows).columns and kept.count() == len(odd_rows)


def test_no_labels(spark, documents):
    labels = spark.createDataFrame([(1, None)], "doc_id long, quality int")
    assert quality.train(documents([(1, "a"), (2, "b")]), labels) is None
    assert [r.predicted for r in quality.scored(documents([(1, "a")]), None).collect()] == [1]
    assert quality.scored(documents([]), None).collect() == []
