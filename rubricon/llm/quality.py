"""Quality scores from positive and unlabelled texts.

A text becomes a few figures of its letters, marks, words and lines, and each figure one of a few
bins, so that the linear score can bend. Training sees trusted positives and unlabelled web text and
minimises the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss: where the part for the unseen negatives falls below zero, its gradient is
reversed as the estimator demands. All web text takes part: it is dealt by hash to shards of some
``shard_rows``, each shard fits the risk against the same positives, and the weights are averaged.

The prior, the share of positives in web text, is estimated without negatives: where texts score so
high that only positives do, the share of web text that does is the prior times the share of positives
that does. So the least ratio of the two, with an allowance for small counts, bounds it (a first fit
gives the scores). Labelled texts then set slope and offset of the final sigmoid, so that a score can
be read as a probability. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.common import bounded_sample, fold, id_of, shown_id, text_of
from rubricon.session import bounded_batches, stored

FIGURES = (
    "upper", "digit", "high", "bang", "hash", "star", "dollar", "amp", "percent", "bar", "stop", "comma", "line",
    "other", "word_length", "short_words", "marked_words", "mark_runs", "repeats", "distinct", "top_word", "stops_per_word", "size",
)

_UPPER, _DIGIT, _HIGH, _SPACE, _MARK = 1, 2, 3, 4, 5
_KIND = np.zeros(256, np.uint8)
_KIND[65:91], _KIND[48:58], _KIND[128:], _KIND[[9, 10, 11, 12, 13, 32]] = _UPPER, _DIGIT, _HIGH, _SPACE
for _b in range(33, 127):
    if not chr(_b).isalnum():
        _KIND[_b] = _MARK


def figures(text: str) -> np.ndarray:
    """The figures of one whole text; an empty text has zeros.

    Shares are taken as if a few ordinary words came along, so that a short text is not odd by chance.
    """
    raw = text.encode()
    if not raw:
        return np.zeros(len(FIGURES), np.float32)
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    n = len(data) + 60
    kind = _KIND[data]
    marks = kind == _MARK
    words = raw.split()
    lengths = np.array([len(w) for w in words], np.int64)
    n_words = len(words) + 8
    tally: dict[bytes, int] = {}
    repeats, last = 0, b""
    for w in words:
        tally[w] = tally.get(w, 0) + 1
        repeats += w == last
        last = w
    upper = int(counts[65:91].sum())
    letters = upper + int(counts[97:123].sum())
    named = [counts[ord(c)] / n for c in "!#*$&%|.,\n"]
    mark_ends = np.flatnonzero(marks[:-1] & (kind[1:] == _SPACE)) if len(data) > 1 else np.zeros(0)
    return np.array(
        [
            upper / (letters + 20),
            counts[48:58].sum() / n,
            counts[128:].sum() / n,
            *named,
            (marks.sum() - sum(counts[ord(c)] for c in "!#*$&%|.,")) / n,
            (lengths.sum() + 40) / n_words,
            ((lengths <= 3).sum() + 4) / n_words,
            len(mark_ends) / n_words,
            (marks[:-1] & marks[1:]).sum() / n_words,
            repeats / n_words,
            (len(tally) + 6) / n_words,
            max(tally.values()) / n_words if tally else 0,
            (counts[ord(".")] + 0.8) / n_words,
            np.log1p(len(words)),
        ],
        np.float32,
    )


@dataclass
class Model:
    """Bin edges (figures x edges), weights per bin, and the sigmoid's slope and offset."""

    edges: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)
        return at + np.arange(len(self.edges)) * (self.edges.shape[1] + 1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(self.bins(x)) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


# Few texts are odd in any one figure, so the edges are dense at both ends of the range.
_ENDS = [0.002, 0.01, 0.03, 0.06]
QUANTILES = [*_ENDS, *np.linspace(0.1, 0.9, 6).tolist(), *[1 - q for q in _ENDS[::-1]]]


def risk(model: Model, p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, float]:
    """The parts of the risk for positives and for unseen negatives; ``p`` and ``u`` are bins of positive
    and unlabelled texts, ``w`` says how often each of the latter occurs."""
    zp, zu = model.raw(p), model.raw(u)
    unseen = np.logaddexp(0, zu) @ w / w.sum() - prior * np.logaddexp(0, zp).mean()
    return prior * np.logaddexp(0, -zp).mean(), unseen


def gradient(model: Model, p: np.ndarray, u: np.ndarray, w: np.ndarray, prior: float) -> np.ndarray:
    """Of the risk in the weights and the bias; of the part for unseen negatives alone and reversed,
    where that is below zero."""
    width = len(model.weights)
    of = lambda bins, g: np.append(np.bincount(bins.ravel(), np.repeat(g, bins.shape[1]), width), g.sum())
    zp, zu = model.raw(p), model.raw(u)
    unseen = of(u, _sigmoid(zu) * w / w.sum()) - prior * of(p, _sigmoid(zp) / len(zp))
    if risk(model, p, u, w, prior)[1] < 0:
        return -unseen
    return prior * of(p, -_sigmoid(-zp) / len(zp)) + unseen


def fit(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.05,
    edges: np.ndarray | None = None, w: np.ndarray | None = None,
) -> Model:
    """Minimise the non-negative risk by full-batch Adam steps."""
    if edges is None:
        edges = np.quantile(np.concatenate([positive, unlabelled]), QUANTILES, axis=0).T.copy()
    w = np.ones(len(unlabelled)) if w is None else w
    width = edges.shape[0] * (edges.shape[1] + 1)
    model = Model(edges, np.zeros(width), 0.0, 1.0, 0.0)
    p, u = model.bins(positive), model.bins(unlabelled)
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        g = gradient(model, p, u, w, prior) + 1e-3 * np.append(model.weights, 0)
        moment = 0.9 * moment + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        change = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        model.weights -= change[:-1]
        model.bias -= change[-1]
    return model


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, w: np.ndarray) -> float:
    """The share of positives among unlabelled texts from the raw scores of both."""
    cuts = np.unique(np.quantile(positive, np.linspace(0, 0.99, 100)))
    above = lambda z, w: np.array([w[z >= c].sum() for c in cuts]) / w.sum()
    share_p, share_u = above(positive, np.ones(len(positive))), above(unlabelled, w)
    # The allowance is that of the best-bin estimate, at a confidence of nine in ten.
    room = np.sqrt(np.log(40) / 2) * (len(positive) ** -0.5 + len(unlabelled) ** -0.5)
    best = int(np.argmin((share_u + room) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.02, 0.98))


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, steps: int = 50) -> None:
    """Slope and offset by Newton steps on the log loss, with the usual softened targets."""
    z = model.raw(model.bins(x))
    spread = z.std() or 1.0
    z = (z - z.mean()) / spread
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = _sigmoid(a * z + b)
        w = q * (1 - q) + 1e-9
        g = np.array([((q - target) * z).sum() + 1e-3 * a, (q - target).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
    mean = model.raw(model.bins(x)).mean()
    model.slope, model.offset = max(a, 0.0) / spread, b - max(a, 0.0) * mean / spread


def _figures_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = [figures(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float32()))], names=["id", "key", "x"])


def _matrix(lists) -> np.ndarray:
    return np.array(list(lists), np.float64).reshape(-1, len(FIGURES))


def _averaged(rows: DataFrame, shards: int, positive: np.ndarray, edges: np.ndarray, prior: float | None, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias, and the prior, as averages over the fits of all shards. Without a prior the
    shards fit with an even one and estimate it."""
    shared = rows.sparkSession.sparkContext.broadcast((positive, edges))  # of bounded size

    def run(part: pd.DataFrame) -> pd.DataFrame:
        positive, edges = shared.value
        x, w = _matrix(part["x"]), part["w"].to_numpy(np.float64)
        if prior is None and len(x) > 1 and len(positive) > 1:
            # Half of the texts are scored by a fit to the other half, which would flatter its own.
            model = fit(positive[::2], x[::2], 0.5, steps, edges=edges, w=w[::2])
            raw = lambda x: model.raw(model.bins(x))
            found = estimated_prior(raw(positive[1::2]), raw(x[1::2]), w[1::2])
        else:
            found = prior or 0.5
            model = fit(positive, x, found, steps, edges=edges, w=w)
        values = np.append(model.weights, [model.bias, found])
        return pd.DataFrame({"at": np.arange(len(values)), "value": values, "w": w.sum()})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key", "id"), F.lit(shards)))
    fitted = dealt.select("shard", "x", "w").groupBy("shard").applyInPandas(run, "at long, value double, w double")
    # Decimals add up to the same whatever order the shards come in.
    exact = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    sums = fitted.groupBy("at").agg((exact(F.col("value") * F.col("w")) / exact(F.col("w"))).alias("value"))
    values = {r["at"]: r["value"] for r in sums.collect()}  # a row per weight
    values = np.array([values[i] for i in range(len(values))])
    return values[:-1], float(values[-1])


def train(
    docs: DataFrame,
    labels: DataFrame,
    labelled_rows: int = 20_000,
    shard_rows: int = 20_000,
    prior: float | None = None,
    held_out_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model | None:
    """Fit on the rows outside the held-out fold, or None without a positive among them.

    At most ``labelled_rows`` labelled texts, chosen by a hash of their ids, are the positives and set
    the sigmoid. Bin edges, ``prior`` (by default estimated) and risk cover all texts. Rows that repeat
    id and text are one row that counts as often; a null id is not learnt from.
    """
    bounded_batches(docs.sparkSession)
    learnt = F.col(id_col).isNotNull() & (fold(id_col) != held_out_fold)
    known = labels.where(learnt & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    known = bounded_sample(known, id_col, labelled_rows).select(id_of(id_col).alias("id"), "y")
    texts = docs.where(learnt).select(id_of(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("key"), text_of(text_col).alias("text"))
    rows = texts.mapInArrow(_figures_of, "id long, key long, x array<float>")
    rows = stored(rows.groupBy("id", "key").agg(F.first("x").alias("x"), F.count(F.lit(1)).alias("w")), "figures")
    told = bounded_sample(rows.join(F.broadcast(known), "id"), "key", labelled_rows).select("id", "key", "y", "x").toArrow()
    order = np.lexsort((told.column("key").to_numpy(), told.column("id").to_numpy()))
    y, x = told.column("y").to_numpy()[order], _matrix(told.column("x").to_pylist())[order]
    if not (y == 1).any():
        return None
    quantiles = [F.percentile_approx(F.col("x")[j], QUANTILES, 10_000).alias(str(j)) for j in range(len(FIGURES))]
    n, *edges = rows.agg(F.count(F.lit(1)), *quantiles).first()
    edges, shards = np.array(edges, np.float64), -(-n // shard_rows)
    if prior is None:
        prior = _averaged(rows, shards, x[y == 1], edges, None, steps=150)[1]
    weights, _ = _averaged(rows, shards, x[y == 1], edges, prior, steps=600)
    model = Model(edges, weights[:-1], float(weights[-1]), 1.0, 0.0)
    calibrate(model, x, y)
    return model


def scored(
    docs: DataFrame,
    model: Model | None,
    threshold: float = 0.7,
    held_out_fold: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: bool = False,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, and with ``carry`` the row itself
    as the struct ``row``.

    Null and empty texts are scored like any other, by figures of zero. Without a model, as when no
    label could be learnt from, every score is 1: nothing is rejected unseen. Rows that repeat an id
    have rows of their own; a null id is never held out. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([figures(t.as_py()) for t in batch.column(2)], np.float64).reshape(-1, len(FIGURES))
            score = model.score(x) if model else np.ones(len(x))
            columns = [*batch.columns[:2], pa.array(score), *batch.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "score", "row"][: len(columns)])

    rows = docs.select(
        id_of(id_col).alias("id"),
        (fold(id_col) == held_out_fold).alias("held_out"),
        text_of(text_col),
        *([F.struct("*").alias("row")] if carry else []),
    )
    schema = "id long, held_out boolean, score double"
    schema += f", row {rows.schema['row'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, schema).select(
        shown_id("id").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        *(["row"] if carry else []),
    )
