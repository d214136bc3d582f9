"""A quality classifier learned from positive and unlabelled text.

Trusted positives are labelled 1 in the training folds; the rest of the training texts counts
as unlabelled whatever its label. A linear model over document features minimises the
non-negative unbiased risk  pi R_p(+1) + max(0, R_u(-1) - pi R_p(-1))  with logistic loss;
the class prior pi is estimated from the positives and the unlabelled texts alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import slices, utf8, word_hashes, words

BINS = 512
STATS = 15


def features(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A row of features for each text: shares of kinds of bytes, repetition, hashed byte trigrams."""
    n = len(offsets) - 1
    out = np.zeros((n, STATS + BINS), np.float32)
    size = np.diff(offsets).astype(np.float64)
    safe = np.maximum(size, 1)
    row = np.repeat(np.arange(n), np.diff(offsets))

    def share(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / safe

    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    lower, wide = (data >= 97) & (data <= 122), data >= 128
    white = (data == 32) | ((data >= 9) & (data <= 13))
    symbol = ~(upper | digit | lower | wide | white)
    start, end, of = words(offsets, data)
    hashes = word_hashes(data, start, end)
    count = np.bincount(of, minlength=n).astype(np.float64)
    some = np.maximum(count, 1)
    same = np.zeros(len(of))
    if len(of) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((hashes, of))
    fresh = np.ones(len(of))
    if len(of) > 1:
        a, b = order[1:], order[:-1]
        fresh[1:] = (hashes[a] != hashes[b]) | (of[a] != of[b])
    distinct = np.bincount(of[order], fresh, minlength=n) if len(of) else np.zeros(n)
    alone = np.bincount(of, symbol[start] & (end - start == 1), minlength=n) if len(of) else np.zeros(n)
    ends = np.bincount(of, symbol[end - 1] & symbol[np.maximum(end - 2, 0)] & (end - start > 2), minlength=n) if len(of) else np.zeros(n)
    loud = np.bincount(of, upper[start] & upper[np.minimum(start + 1, len(data) - 1)] & (end - start > 1), minlength=n) if len(of) else np.zeros(n)
    stats = [
        np.log1p(count), np.log1p(size), share(upper), share(digit), share(symbol), share(white), share(wide), share(data == 10),
        size / some, distinct / some, np.bincount(of, same, minlength=n) / some if len(of) else np.zeros(n), alone / some, ends / some, loud / some, (count == 0).astype(float),
    ]
    out[:, :STATS] = np.stack(stats, 1)
    if len(data) > 2:
        wide_data = data.astype(np.uint32)
        code = (wide_data[:-2] << 16 | wide_data[1:-1] << 8 | wide_data[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - 9)
        inside = row[:-2] == row[2:]
        grams = np.bincount(row[:-2][inside] * BINS + code[inside], minlength=n * BINS).reshape(n, BINS)
        out[:, STATS:] = np.sqrt(grams / np.maximum(size - 2, 1)[:, None])
    return out


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return ((rows - self.mean) / self.scale) @ self.weight + self.bias

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        z = self.logits(features(offsets, data))
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Minimises the non-negative risk; where its negative part dips below 0 the step goes against that part.

    Without positives or unlabelled rows the model knows the prior alone.
    """
    width = STATS + BINS
    if not len(positive) or not len(unlabelled):
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(width), float(np.log(p / (1 - p))), np.zeros(width), np.ones(width))
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = np.clip((positive - mean) / scale, -8, 8), np.clip((unlabelled - mean) / scale, -8, 8)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, steps + 1):
        zp, zu = p @ w + b, u @ w + b
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_p, down_u, up_p = sig(zp) / len(p), sig(zu) / len(u), -sig(-zp) / len(p)
        part = np.concatenate([down_u @ u - prior * (down_p @ p), [down_u.sum() - prior * down_p.sum()]])
        gain = np.concatenate([prior * (up_p @ p), [prior * up_p.sum()]])
        g = gain + part if negative >= 0 else -part
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model(w.astype(np.float32), float(b), mean, scale)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled rows.

    Above any threshold of any score, the unlabelled rows hold at least the prior times the share of
    positives that lie there, and no more if no other row does: the least ratio of the two shares
    is the prior's best bound. Models learned on four fifths of the rows rank the others: a linear
    discriminant first, then the classifier itself under the bound so found. Of the thresholds,
    those that leave at least half of the positives count, for shares of few rows vary.
    """
    if len(positive) < 10 or len(unlabelled) < 10:
        return 0.5
    part = lambda x, held: x[(np.arange(len(x)) % 5 == 4) == held]
    p, u = part(positive, False), part(unlabelled, False)

    def bound(p_score: np.ndarray, u_score: np.ndarray) -> float:
        p_score, u_score = np.sort(p_score), np.sort(u_score)
        above = lambda x, t: 1 - np.searchsorted(x, t) / len(x)
        at = np.quantile(p_score, np.linspace(0.02, 0.5, 25))
        return float(np.clip((above(u_score, at) / above(p_score, at)).min(), 0.01, 0.99))

    scale = unlabelled.std(0) + 1e-3
    spread = (np.cov(p / scale, rowvar=False) * len(p) + np.cov(u / scale, rowvar=False) * len(u)) / (len(p) + len(u)) + 0.1 * np.eye(len(scale))
    weight = np.linalg.solve(spread, (p.mean(0) - u.mean(0)) / scale) / scale
    first = bound(part(positive, True) @ weight, part(unlabelled, True) @ weight)
    model = fit(p, u, first, steps=150)
    return min(first, bound(model.logits(part(positive, True)), model.logits(part(unlabelled, True))))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, positives: int = 3_000, unlabelled: int = 6_000) -> Model:
    """Learns from at most ``positives`` labelled rows and ``unlabelled`` texts outside the held-out fold.

    These two bounds are all that is sampled; rows come first by a hash of their id, so reruns agree.
    """
    known = samples.one_label(labels.where(samples.remainder(id_col, folds) != held_fold), id_col, label_col)
    trusted = samples.first_by_hash(known.where("label = 1").select("id", F.lit(1).alias("kind")), positives)
    free = samples.first_by_hash(docs.where(samples.remainder(id_col, folds) != held_fold).select(F.col(id_col).alias("id"), F.lit(0).alias("kind")).dropna(), unlabelled)

    @F.arrow_udf("binary")
    def extract(text: pa.Array) -> pa.Array:
        offsets, data = utf8(text)
        return pa.array([x.tobytes() for lo, hi in slices(offsets) for x in features(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]])], pa.binary())

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((k, x) for batch in batches for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True))  # so that sums do not depend on the order of arrival
        take = lambda kind: np.array([np.frombuffer(x, np.float32) for k, x in rows if k == kind], np.float64).reshape(-1, STATS + BINS)
        positive, free_rows = take(1), take(0)
        rows.clear()
        yield pa.record_batch([pa.array([pickle.dumps(fit(positive, free_rows, estimate_prior(positive, free_rows)))], pa.binary())], names=["model"])

    # learned by one task, so that the driver holds the model alone and none of the sample
    rows = samples.texts(docs, trusted.unionByName(free), id_col, text_col).select("kind", extract("text").alias("x"))
    found = rows.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(nothing := np.zeros((0, STATS + BINS)), nothing, estimate_prior(nothing, nothing))


def scorer(model: Model):
    """A column function: text to score."""

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        offsets, data = utf8(text)
        parts = [model.score(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]) for lo, hi in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_fold: int = 0, threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Null and empty texts are scored as the text without words; null ids are in the fold of the
    empty text; repeated rows and ids are scored one by one; an empty table gives none. Without
    usable labels every score is the prior, 0.5. Only id and text of ``docs`` are read.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_fold=held_fold)
    scored = docs.select(F.col(id_col), (samples.remainder(id_col, folds) == held_fold).alias("held_out"), scorer(model)(F.col(text_col)).alias("score"))
    return scored.select(id_col, "held_out", "score", decide(F.col("score"), threshold).alias("predicted"))


def decide(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")
