"""Toxicity from bags of subwords.

Words are bags of byte n-grams, so a misspelling nobody labelled shares most vectors with the
word it comes from. The vectors of a passage are averaged and a linear softmax tells its two
classes apart; vectors and softmax are trained jointly in numpy. A document's logit is the
smooth maximum over its passages, so a few words weigh the same in a short and a long text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import samples
from .common import mix64, slices, utf8, word_hashes, words

BUCKET_BITS, DIM, GRAMS, PASSAGE_WORDS = 20, 4, (3, 4, 5), 3
#: Training texts that must hold an n-gram before it gets a vector; bytes of a training text, whose passages beyond that are drawn by hash.
LEAST_TEXTS, TEXT_BYTES = 3, 1 << 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[*range(9, 14), *b".,;:!?\"()|[]{}"]] = 32


def padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with a blank before each text and after the last; (offsets, bytes)."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    out[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _FOLD[data]
    return offsets + np.arange(n + 1), out


def grams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, valid) of the n-gram at each position, for each n; blanks may only be its first or last byte."""
    wide, blank = data.astype(np.uint32) + np.uint32(1), np.concatenate([[0], np.cumsum(data == 32)])
    total = len(data)
    for n in GRAMS:
        if total < n:
            continue
        code = np.full(total - n + 1, n, np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ wide[k : total - n + 1 + k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        code ^= code >> np.uint32(13)
        inner = blank[n - 1 : total] - blank[1 : total - n + 2]
        yield code >> np.uint32(32 - BUCKET_BITS), inner == 0


def passages(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of every passage of PASSAGE_WORDS words in padded bytes; the last passage of a text takes what is left."""
    start, _, row = words(offsets, data[: offsets[-1]])
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    head = place % PASSAGE_WORDS == 0
    return start[head] - 1, row[head]  # the blank before a word belongs to it


def drawn(text: np.ndarray) -> bytes:
    """The folded text; of a longer one than TEXT_BYTES, as many whole passages as fit, drawn from all of it by a hash of their place."""
    if len(text) <= TEXT_BYTES:
        return _FOLD[text].tobytes()
    data = _FOLD[text]
    start, end, _ = words(np.array([0, len(data)]), data)
    if not len(start):
        return b""
    lo, hi = start[::PASSAGE_WORDS], end[np.minimum(np.arange(PASSAGE_WORDS - 1, len(end) + PASSAGE_WORDS - 1, PASSAGE_WORDS), len(end) - 1)][: -(-len(start) // PASSAGE_WORDS)]
    order = np.argsort(mix64(np.arange(1, len(lo) + 1, dtype=np.uint64)), kind="stable")
    order = order[(hi - lo)[order] < TEXT_BYTES // 64]  # passages of no human size are left out of training
    kept = np.sort(order[np.cumsum((hi - lo + 1)[order]) <= TEXT_BYTES])
    return b" ".join(data[a:b].tobytes() for a, b in zip(lo[kept].tolist(), hi[kept].tolist(), strict=True))


@dataclass
class Model:
    weight: np.ndarray  # of each bucket: its vector times the difference of the softmax rows
    bias: float
    sharpness: float
    scale: float = 1.0  # of the logit, and what is added, as calibrated
    shift: float = 0.0

    def logits(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """A logit for each text; that of the bias, at most 0, where there are no words."""
        n = len(offsets) - 1
        offsets, data = padded(offsets, data)
        at, row = passages(offsets, data)
        out = np.full(n, min(self.bias, 0.0))
        if len(at):
            value, count = np.zeros(len(data) + 1), np.zeros(len(data) + 1)
            for bucket, valid in grams(data):
                value[: len(bucket)] += np.where(valid, self.weight[bucket], 0)
                count[: len(bucket)] += valid
            logit = np.add.reduceat(value, at) / np.maximum(np.add.reduceat(count, at), 1) + self.bias
            first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
            out[row[first]] = pool(logit, first, self.sharpness)[0]
        return out

    def score(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(offsets, data) + self.shift, -40, 40)))


def pool(logit: np.ndarray, first: np.ndarray, sharpness: float) -> tuple[np.ndarray, np.ndarray]:
    """Smooth maximum of each run, and the part of each logit in it."""
    top = np.maximum.reduceat(logit, first)
    size = np.diff(np.append(first, len(logit)))
    e = np.exp(sharpness * (logit - np.repeat(top, size)))
    total = np.add.reduceat(e, first)
    part = e / np.repeat(total, size)
    return np.add.reduceat(part * logit, first), part


def calibrated(model: Model, texts: list[bytes], label: np.ndarray) -> Model:
    """The model with its logits rescaled so that they fit labels it has not seen, classes weighed alike."""
    if len(set(label.tolist())) < 2:
        return model
    z = np.concatenate([model.logits(np.cumsum([0, *map(len, part)]), np.frombuffer(b"".join(part), np.uint8)) for part in (texts[i : i + 100] for i in range(0, len(texts), 100))])
    y = label.astype(np.float64)
    weigh = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    centre, spread = z.mean(), z.std() + 1e-6
    x, a, c = (z - centre) / spread, 1.0, 0.0
    for _ in range(2_000):
        error = (1 / (1 + np.exp(-np.clip(a * x + c, -40, 40))) - y) * weigh
        a, c = max(0.0, a - 0.5 * ((error * x).sum() + 1e-3 * (a - 1))), c - 0.5 * error.sum()
    model.scale, model.shift = a / spread, c - a * centre / spread
    return model


def fit(texts: list[bytes], label: np.ndarray, **options) -> Model:
    """Trains on four fifths of the texts and calibrates the logits on the others."""
    other = np.arange(len(texts)) % 5 == 4
    pick = lambda mask: [t for t, m in zip(texts, mask, strict=True) if m]
    return calibrated(train_vectors(pick(~other), label[~other], **options), pick(other), label[other])


def train_vectors(texts: list[bytes], label: np.ndarray, *, steps: int = 80, rate: float = 0.2, decay: float = 1e-4, seed: int = 7, sharpness: float = 3.0) -> Model:
    """Trains vectors and softmax jointly, classes weighed alike. Without both classes every score is 0.5.

    The step size is scaled by the gradient's overall norm, not by each coordinate's: n-grams
    that tell many texts apart move fast, those of a single text hardly move.
    """
    none = Model(np.zeros(1 << BUCKET_BITS, np.float32), 0.0, sharpness)
    if len(set(label.tolist())) < 2:
        return none
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets, data = padded(np.cumsum([0, *map(len, texts)]), data)
    start, end, row = words(offsets, data[: offsets[-1]])
    if not len(start):
        return none
    hashes = []
    for lo, hi in slices(offsets, 1 << 20):
        a, b = np.searchsorted(start, offsets[[lo, hi]])
        hashes.append(word_hashes(data[offsets[lo] : offsets[hi]], start[a:b] - offsets[lo], end[a:b] - offsets[lo]))
    _, seen, which = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(end[seen] - start[seen] + 1)])
    own = np.full(cuts[-1] + 1, 32, np.uint8)
    size = end[seen] - start[seen]
    own[np.arange(size.sum()) + np.repeat(np.arange(1, len(seen) + 1), size)] = data[np.arange(size.sum()) + np.repeat(start[seen] - (np.cumsum(size) - size), size)]
    of, ids = [], []
    for bucket, valid in grams(own):
        at = np.flatnonzero(valid)
        of.append((np.searchsorted(cuts, at, "right") - 1).astype(np.int32))
        ids.append(bucket[at].astype(np.int32))
    of, ids = np.concatenate(of), np.concatenate(ids)
    keep = of < len(seen)
    of, ids = of[keep], ids[keep]
    n_grams = np.bincount(of, minlength=len(seen)).astype(np.float64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    passage = np.cumsum(place % PASSAGE_WORDS == 0) - 1
    n_passages = int(passage[-1]) + 1
    inverse = 1 / np.maximum(np.bincount(passage, n_grams[which], n_passages), 1)
    doc = row[place % PASSAGE_WORDS == 0]
    head = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1])
    y = label[doc[head]].astype(np.float64)
    weigh = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    # only buckets of several texts have a vector to train
    used, ids, of = frequent(ids, of, which, row)
    rng = np.random.default_rng(seed)
    vec, soft, bias = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    params = [vec, soft, bias]
    moments = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        word_vec = np.stack([np.bincount(of, vec[ids, d], len(seen)) for d in range(DIM)], 1)
        mean = np.stack([np.bincount(passage, word_vec[which, d], n_passages) for d in range(DIM)], 1) * inverse[:, None]
        diff = soft[1] - soft[0]
        logit, part = pool(mean @ diff + (bias[1] - bias[0]), head, sharpness)
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) * weigh
        g_logit = np.repeat(error, np.diff(np.append(head, len(doc)))) * part
        g_diff = g_logit @ mean
        g_word = np.bincount(which, (g_logit * inverse)[passage], len(seen))
        g_vec = np.bincount(ids, g_word[of], len(used))[:, None] * diff[None, :]
        total = g_logit.sum()
        for p, m, g in zip(params, moments, (g_vec, np.stack([-g_diff, g_diff]), np.array([-total, total])), strict=True):
            m *= 0.9
            m += 0.1 * (g + decay * p)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt((m * m).max()) + 1e-10)
    weight = np.zeros(1 << BUCKET_BITS, np.float32)
    weight[used] = vec @ (soft[1] - soft[0])
    return Model(weight, float(bias[1] - bias[0]), sharpness)


def frequent(ids: np.ndarray, of: np.ndarray, which: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, bucket of each n-gram, word of each n-gram) of the buckets that LEAST_TEXTS texts hold."""
    order = np.argsort(of, kind="stable")
    ids, of = ids[order], of[order]
    at = np.searchsorted(of, np.arange(int(which.max()) + 2))
    used, ids = np.unique(ids, return_inverse=True)
    ids, texts = ids.astype(np.int32), np.zeros(len(used), np.int32)
    for own in np.split(which, np.flatnonzero(np.diff(row)) + 1):  # a text at a time: together they would not fit
        own = np.unique(own)
        spans = at[own + 1] - at[own]
        flat = np.arange(spans.sum()) + np.repeat(at[own] - (np.cumsum(spans) - spans), spans)
        texts[np.unique(ids[flat])] += 1
    keep = texts >= LEAST_TEXTS
    number = (np.cumsum(keep) - 1).astype(np.int32)
    stay = keep[ids]
    return used[keep], number[ids[stay]], of[stay]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, toxic: int = 1_200, clean: int = 2_400) -> Model:
    """Learns from at most ``toxic`` and ``clean`` labelled rows of the two classes outside the held-out fold.

    Rows come first by a hash of their id, and executors send at most TEXT_BYTES of a text's
    passages, so what the driver holds is bounded whatever the texts. These bounds are all that is sampled.
    """
    known = samples.one_label(labels.where(samples.remainder(id_col, folds) != held_fold), id_col, label_col)
    picked = samples.first_by_hash(known.where("label = 1"), toxic).unionByName(samples.first_by_hash(known.where("label = 0"), clean))

    @F.arrow_udf("binary")
    def take(text: pa.Array) -> pa.Array:
        offsets, data = utf8(text)
        return pa.array([drawn(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())

    rows = [(bytes(r.raw), r.label) for r in samples.texts(docs, picked, id_col, text_col).select(take("text").alias("raw"), "label").collect()]
    rows.sort(key=lambda r: (zlib.crc32(r[0]), r))
    return fit([t for t, _ in rows], np.array([y for _, y in rows]))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 3, held_fold: int = 1, threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted) for every row.

    Null, empty and wordless texts get the score of the bias alone; null ids are
    in the fold of the empty text; repeated rows and ids are scored one by one; an empty table
    gives none. Without labels of both classes every score is 0.5. Only id and text are read.
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, folds=folds, held_fold=held_fold)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        offsets, data = utf8(text)
        parts = [model.score(offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]) for lo, hi in slices(offsets)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    scored = docs.select(F.col(id_col), (samples.remainder(id_col, folds) == held_fold).alias("held_out"), score(F.col(text_col)).alias("score"))
    return scored.select(id_col, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
