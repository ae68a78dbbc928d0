"""Language identification by sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed character n-grams; document frequencies are counted over all
texts of the learning folds. Weights are learnt one text at a time by follow-the-regularised-leader
with elastic-net penalties, which leaves most of them exactly zero, on a bounded number of texts of
each language. A temperature fitted on texts kept out of that makes the probabilities honest.
Prediction is one pass without a shuffle; texts are read whole, in slices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon.llm.common import HASHES, fold, hash_share, id_of, shown_id, text_of

UNKNOWN = "und"
FEATURES = 1 << 14
ORDERS = (1, 2, 3)
_SLICE = 1 << 20


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text in lower case, and how often each occurs."""
    total = np.zeros(FEATURES, np.int64)
    for at in range(0, len(text), _SLICE):
        # A slice starts with the end of the one before, for the n-grams that reach across.
        lead = min(at, max(ORDERS) - 1)
        codes = np.frombuffer(text[at - lead : at + _SLICE].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in ORDERS:
            if len(codes) >= n:
                skip = max(0, lead - (n - 1))
                h = np.full(len(codes) - n + 1, n, np.uint32)
                for k in range(n):
                    h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x01000193 + 2 * k * 0x9E37)
                    h ^= h >> np.uint32(15)
                total += np.bincount(h[skip:] % np.uint32(FEATURES), minlength=FEATURES)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        v = (1 + np.log(count)) * self.idf[at]
        return v / max(1e-12, np.sqrt((v * v).sum()))

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.vector(at, count) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*ngram_counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(
    rows: list[tuple[int, np.ndarray, np.ndarray]],
    languages: list[str],
    idf: np.ndarray,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
    epochs: int = 3,
) -> Model:
    """Learn from (language, features, counts) rows; every fifth only sets the temperature."""
    k = len(languages)
    model = Model(languages, idf, np.zeros((FEATURES, k)), np.zeros(k))
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))
    leader = lambda z, n: np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    learnt = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10]
    random = np.random.default_rng(7)
    for _ in range(epochs):
        for i in random.permutation(len(learnt)):
            y, at, count = learnt[i]
            at, v = np.append(at, FEATURES), np.append(model.vector(at, count), 1.0)
            w = leader(z[at], n[at])
            p = softmax(v @ w)
            p[y] -= 1
            g = np.outer(v, p)
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    w = leader(z, n)
    model.weights, model.bias = w[:-1], w[-1]
    kept = rows[::5] if len(rows) >= 10 else rows
    logits = np.array([model.logits(at, count) for _, at, count in kept])
    truth = np.array([y for y, _, _ in kept])

    def loss(t: float) -> float:
        s = logits / t
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(s)), truth]).mean())

    model.temperature = float(min(np.geomspace(0.02, 5, 120), key=loss))
    return model


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of the task's texts have each feature; feature -1 counts the texts."""
    df, texts = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            at, _ = ngram_counts(t.as_py())
            df[at] += 1
            texts += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], texts), pa.int64())], names=["feature", "n"]
    )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngram_counts(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int64()))],
            names=["lang", "at", "count"],
        )


def train(
    docs: DataFrame,
    rows_per_language: int = 800,
    held_out_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model | None:
    """Fit on the folds that are not held out, or None if no text there has a language.

    Document frequencies cover every text of those folds. The weights see at most
    ``rows_per_language`` texts of each language, chosen by a hash of id and text; rows that repeat
    both are one of them.
    """
    learnt = docs.where(fold(id_col) != held_out_fold).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    )
    learnt = learnt.where("text is not null")
    counted = learnt.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    frequency = {r["feature"]: r["n"] for r in counted.collect()}  # at most FEATURES + 1 rows
    texts = frequency.pop(-1, 0)
    # Equal texts of an id are one row, found by their hash before any text moves.
    key = F.pmod(F.xxhash64("id", "text"), F.lit(HASHES))
    named = learnt.where("lang is not null").select("lang", key.alias("key"), "text")
    sizes = named.select("lang", "key").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    bounds = sizes.select("lang", hash_share(F.col("n"), rows_per_language).alias("bound"))
    near = named.join(bounds, "lang").where("key < bound").dropDuplicates(["lang", "key"])
    order = Window.partitionBy("lang").orderBy("key")
    sample = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= rows_per_language).select("lang", "text")
    rows = sample.mapInArrow(_vectors, "lang string, at array<int>, count array<long>").toArrow()
    if not rows.num_rows:
        return None
    idf = np.log((1 + texts) / (1 + np.bincount(list(frequency), list(frequency.values()), FEATURES))) + 1
    named = rows.column("lang").to_pylist()
    languages = sorted(set(named))
    vectors = [
        (languages.index(lang), np.asarray(at.values), np.asarray(count.values))
        for lang, at, count in zip(named, rows.column("at"), rows.column("count"))
    ]
    # An order that does not depend on how the rows arrived.
    vectors.sort(key=lambda r: (len(r[1]), int(r[2].sum()), r[0], r[1].tobytes(), r[2].tobytes()))
    return fit([vectors[i] for i in np.random.default_rng(3).permutation(len(vectors))], languages, idf)


def predicted(
    docs: DataFrame, model: Model | None, held_out_fold: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs``.

    A text that is null or has no letter is ``und`` with score 0, as is every text where no language
    could be learnt. Rows that repeat an id have rows of their own; a null id is never held out.
    Other columns of ``docs`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t.as_py()) if model else (UNKNOWN, 0.0) for t in batch.column(2)]
            lang, score = pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], lang, score], names=["id", "held_out", "lang_pred", "score"])

    rows = docs.select(id_of(id_col).alias("id"), (fold(id_col) == held_out_fold).alias("held_out"), text_of(text_col))
    out = rows.mapInArrow(run, "id long, held_out boolean, lang_pred string, score double")
    return out.select(shown_id("id").alias("doc_id"), "held_out", "lang_pred", "score")
