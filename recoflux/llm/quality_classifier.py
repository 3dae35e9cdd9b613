"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled text train a linear scorer that minimises the non-negative unbiased risk
    prior * R+(1) + max(0, Ru(0) - prior * R+(0)),
where the class prior is estimated from the data. Features are counts over whole texts; no label, language, source or id is one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .textstats import BANG, DIGIT, STOP, Stats

TRAIN_ROWS = 8_000  # the bound on positives, and on unlabelled rows, that a fit collects features of
KNOTS = 8


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = Stats(raw, offsets)
    n = np.maximum(s.n_words, 1)
    lines, dup = s.lines()
    words = s.n_words
    cols = [np.log1p(words), s.word_chars() / n, s.n_symbols() / n, s.caps_words() / n, s.count(BANG) / n, s.count(DIGIT) / n, s.count(STOP) / n, s.capitalised() / n, s.distinct_words() / n * np.log1p(words), s.same_as_before() / n, s.repeat_words() / n, dup / np.maximum(lines, 1), np.log1p(words / np.maximum(lines, 1))]
    return np.stack(cols, axis=1).astype(np.float64)


@dataclass(frozen=True)
class Model:
    """Piecewise-linear additive score: each feature by its value and its excess over quantile knots."""

    mean: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    bias: float

    def expand(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        parts = [z] + [np.maximum(z - k, 0) for k in self.knots]
        return np.concatenate(parts, axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.expand(x) @ self.weights + self.bias, -30, 30)))


def _adam(grad, size: int, steps: int = 800, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(held_positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives in the mixture, from scores of a non-traditional classifier (positive against unlabelled), of positives that it has not seen.

    Above a high threshold almost only positives lie, so there the mixture's tail is the share times the positives' tail; the median of that
    ratio over the thresholds that leave 30 to 90 of 100 positives is taken, since each alone is noisy.
    """
    ratios = []
    for q in np.linspace(0.1, 0.7, 31):
        cut = np.quantile(held_positive, q)
        ratios.append((unlabelled >= cut).mean() / max((held_positive >= cut).mean(), 1e-9))
    return float(np.clip(np.median(ratios), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, ridge: float = 1e-4) -> tuple[Model, float]:
    """Model and class prior. positive, unlabelled: rows of features."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-9
    z = (both - mean) / scale
    knots = np.quantile(z, np.linspace(0.05, 0.98, KNOTS), axis=0)
    base = Model(mean, scale, knots, np.zeros(z.shape[1] * (KNOTS + 1)), 0.0)
    p, u = (np.column_stack([base.expand(x), np.ones(len(x))]) for x in (positive, unlabelled))
    sig = lambda a: 1 / (1 + np.exp(-np.clip(a, -30, 30)))
    size = p.shape[1]
    if prior is None:
        a, b = p[::2], p[1::2]

        def plain(w):
            return a.T @ (sig(a @ w) - 1) / len(a) + u.T @ sig(u @ w) / len(u) + ridge * w

        w = _adam(plain, size, 300)
        prior = estimate_prior(b @ w, u @ w)

    def risk(w):
        sp, su = sig(p @ w), sig(u @ w)
        soft = lambda s: -np.log(np.maximum(1 - s, 1e-12)).mean()  # noqa: E731  the loss of calling it negative
        negative = soft(su) - prior * soft(sp)
        g_pos = prior * p.T @ (sp - 1) / len(p)
        g_neg = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        return (g_pos + g_neg if negative >= 0 else -g_neg) + ridge * w

    w = _adam(risk, size)
    return Model(mean, scale, knots, w[:-1], float(w[-1])), prior


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, offsets in C.pieces(batch.column(1)):
            x = features(raw, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in (0, 2, 3)), pa.array(list(x), pa.list_(pa.float64()))], names=["positive", "h", "unlabelled", "x"])


def held_out(doc_id):
    """crc32 of doc_id as text, modulo 5, is 0; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[Model, float]:
    """Fits on at most `rows` trusted positives and `rows` unlabelled texts, chosen by a hash of doc_id, none of them held out.

    The class prior is estimated from scores; labelled negatives serve for nothing.
    labels: doc_id, quality. Rows that contradict each other (both marks for one doc_id) count as unlabelled.
    """
    marks = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("mark"))
    pool = docs.select("doc_id", "text").filter(~held_out(F.col("doc_id")))
    dealt = F.xxhash64(F.lit(17), "doc_id")
    share = min(1.0, 2.0 * rows / max(1, pool.count()))
    sampled = F.shiftrightunsigned(dealt, 1) <= F.lit(min(2**63 - 1, int(2**63 * share)))
    # ids alone are joined and sorted; at most `rows` of them are broadcast to the texts
    trusted = marks.filter("mark = 1").join(pool.select("doc_id"), "doc_id", "left_semi").orderBy(dealt, "doc_id").limit(rows).select("doc_id", F.lit(True).alias("positive"))
    some = pool.join(F.broadcast(trusted), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    # unlabelled: a plain sample of the pool, whatever its labels, so that it follows the whole corpus
    some = some.select("positive", "text", dealt.alias("h"), sampled.alias("unlabelled")).filter("positive or unlabelled")
    made = C.checkpointed(some.mapInArrow(_features_of, "positive boolean, h long, unlabelled boolean, x array<double>"))
    p, u = ([r.x for r in made.filter(k).orderBy("h", "x").select("x").limit(rows).collect()] for k in ("positive", "unlabelled"))
    p, u = np.array(p), np.array(u)
    if not len(p) or not len(u):
        width = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros((KNOTS, width)), np.zeros(width * (KNOTS + 1)), 0.0), 0.5
    return fit(p, u)


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold) for each row of docs; empty and null texts too.

    Without positives or text to learn from, every score is 0.5. Only doc_id and text are read of docs; a null doc_id stays (held out).
    """
    model, _ = train(docs, labels, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in C.pieces(batch.column(2)):
                s = model.score(features(raw, offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
